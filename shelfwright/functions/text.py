"""Text helpers: entity decoding, user-facing keys and display names."""

from __future__ import annotations

from html.entities import name2codepoint
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Internal metadata keys that are never offered as fields.
BLOCKED_META_KEYS = (
    "_price",
    "_regular_price",
    "_sale_price",
    "_sale_price_dates_from",
    "_sale_price_dates_to",
    "_stock",
    "_stock_status",
    "_manage_stock",
    "_backorders",
    "_sku",
    "_weight",
    "_length",
    "_width",
    "_height",
    "_tax_status",
    "_tax_class",
    "_virtual",
    "_downloadable",
    "_sold_individually",
    "_featured",
    "_visibility",
    "_product_version",
    "_thumbnail_id",
    "_product_image_gallery",
    "total_sales",
    "_wp_page_template",
    "_wp_old_slug",
    "_wp_old_date",
)

# Prefixes of internal metadata keys.
BLOCKED_META_PREFIXES = (
    "_edit",
    "_wp_",
    "_oembed",
    "_pingme",
    "_encloseme",
    "_menu_item",
    "_wc_",
    "_woocommerce_",
    "attribute_",
)


def is_user_key(key: Column) -> Column:
    """True for metadata keys a user may see and edit."""
    keep = ~key.isin(*BLOCKED_META_KEYS)
    for prefix in BLOCKED_META_PREFIXES:
        keep = keep & ~key.startswith(prefix)
    return keep


def decode_entities(text: Column) -> Column:
    """Decode HTML 4.01 entities and numeric character references in one pass, so that an
    escaped entity (``&amp;lt;``) comes out as text (``&lt;``). Other text is left alone."""
    named = F.create_map(
        *[F.lit(x) for x in chain(*((f"&{n};", chr(c)) for n, c in name2codepoint.items()))]
    )

    def decode(token: Column) -> Column:
        decimal = F.regexp_extract(token, r"^&#([0-9]{1,7});$", 1)
        hexadecimal = F.regexp_extract(token, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        code = F.when(decimal != "", F.conv(decimal, 10, 16)).when(hexadecimal != "", F.upper(hexadecimal))
        value = F.conv(code, 16, 10).cast("int")
        printable = (
            value.isin(9, 10, 13)
            | value.between(0x20, 0x7E)
            | value.between(0xA0, 0xD7FF)
            | value.between(0xE000, 0x10FFFF)
        )
        character = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(named, token), F.when(printable, character), token)

    tokens = F.regexp_extract_all(text, F.lit(r"(&[#0-9A-Za-z]+;|[^&]+|&)"), F.lit(1))
    decoded = F.array_join(F.transform(tokens, decode), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def page_name(parent_title: Column, attributes: Column) -> Column:
    """Name of a variation in a product page: parent title, a dash, its attribute values."""
    return _joined(parent_title, attributes, " — ", "")


def audit_name(parent_title: Column, attributes: Column) -> Column:
    """Name of a variation in the audit view: parent title with attribute values in brackets."""
    return _joined(parent_title, attributes, " (", ")")


def _joined(title: Column, attributes: Column, before: str, after: str) -> Column:
    title = F.coalesce(title, F.lit(""))
    return (
        F.when(attributes.isNull(), title)
        .when(title == "", attributes)
        .otherwise(F.concat(title, F.lit(before), attributes, F.lit(after)))
    )
