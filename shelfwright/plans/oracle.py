"""The named queries as plain SQL over the star tables, for comparison in another engine."""

from __future__ import annotations

from shelfwright.plans.registry import CATEGORIES, COLORS, SIZES, TAGS
from shelfwright.sources.star import MARKER_KEY, PART_STRIDE, VARIATION_BASE
from shelfwright.sources.synth import BRANDS, CATEGORIES as SYNTH_CATEGORIES, CHILDREN, COLORS as SYNTH_COLORS
from shelfwright.sources.synth import MARKER, MARKER_VALUE, SIZES as SYNTH_SIZES


def _term_id(taxonomy: str, name: str) -> str:
    return f"('0x' || substr(md5({taxonomy} || '|' || {name}), 1, 15))::BIGINT"


def _money(x: str) -> str:
    return f"cast(cast({x} AS decimal(19,2)) AS varchar)"


_VARIATION_ID = f"({VARIATION_BASE} + l_partkey * {PART_STRIDE} + l_suppkey)::BIGINT"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "sold": (
        (),
        """SELECT l_partkey, l_suppkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
        sum(l_quantity) AS quantity FROM lineitem GROUP BY l_partkey, l_suppkey""",
    ),
    "objects": (
        ("sold",),
        f"""SELECT (p_partkey + 1)::BIGINT AS object_id, 'product' AS object_type, 0::BIGINT AS parent_id,
          p_name AS title, CASE WHEN p_partkey % 20 = 19 THEN 'draft' ELSE 'publish' END AS status,
          CASE WHEN p_partkey % 10 = 9 THEN '' ELSE 'SKU-' || p_partkey END AS sku,
          p_retailprice::DECIMAL(19,4) AS min_price, p_retailprice::DECIMAL(19,4) AS max_price,
          CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END::BIGINT AS stock_quantity,
          CASE WHEN p_size % 7 = 0 THEN 'outofstock' ELSE 'instock' END AS stock_status
        FROM part
        UNION ALL
        SELECT {_VARIATION_ID}, 'variation', (l_partkey + 1)::BIGINT, '', 'publish', '',
          low::DECIMAL(19,4), high::DECIMAL(19,4), quantity::BIGINT, 'instock' FROM sold""",
    ),
    "meta": (
        ("sold",),
        f"""SELECT (p_partkey + 1)::BIGINT AS object_id, '_regular_price' AS meta_key,
          CASE WHEN p_partkey % 4 = 0 THEN '' ELSE {_money('p_retailprice')} END AS meta_value FROM part
        UNION ALL SELECT (p_partkey + 1)::BIGINT, '_sale_price',
          CASE WHEN p_partkey % 5 = 0 THEN {_money('p_retailprice - 50')} ELSE '' END FROM part
        UNION ALL SELECT (p_partkey + 1)::BIGINT, '_brand', p_brand FROM part
        UNION ALL SELECT (p_partkey + 1)::BIGINT, '_cost',
          CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN 'n/a'
            ELSE {_money('p_retailprice - 120')} END FROM part WHERE p_partkey % 3 <> 0
        UNION ALL SELECT {_VARIATION_ID}, '_regular_price', {_money('low')} FROM sold
        UNION ALL SELECT {_VARIATION_ID}, 'attribute_pa_size', 's' || (l_suppkey % 4) FROM sold
        UNION ALL SELECT {_VARIATION_ID}, '{MARKER_KEY}', 'g' || (l_suppkey % 3) FROM sold
          WHERE l_suppkey % 2 = 0""",
    ),
    "named": (
        (),
        """SELECT p_partkey, 'product_cat' AS taxonomy, p_type AS name FROM part
        UNION ALL SELECT p_partkey, 'product_tag', string_split(p_name, ' ')[2] FROM part
        UNION ALL SELECT p_partkey, 'pa_color', string_split(p_name, ' ')[1] FROM part""",
    ),
    "terms": (
        ("named",),
        f"""SELECT {_term_id('taxonomy', 'name')} AS term_id, taxonomy, name, lower(name) AS slug FROM (
          SELECT DISTINCT taxonomy, name FROM named
          UNION SELECT DISTINCT 'pa_size', 'S' || (s_suppkey % 4) FROM supplier)""",
    ),
    "object_terms": (
        ("named",),
        f"""SELECT (p_partkey + 1)::BIGINT AS object_id, taxonomy, {_term_id('taxonomy', 'name')} AS term_id
        FROM named WHERE taxonomy = 'product_cat' OR (taxonomy = 'product_tag' AND p_partkey % 6 <> 0)
          OR (taxonomy = 'pa_color' AND p_partkey % 8 <> 1)""",
    ),
    "products": (
        ("objects", "meta"),
        """SELECT o.* FROM objects o WHERE object_type = 'product' AND status = 'publish' AND EXISTS (
          SELECT 1 FROM meta m WHERE m.object_id = o.object_id AND meta_key = '_regular_price' AND meta_value <> '')""",
    ),
    "variations": (
        ("objects",),
        "SELECT * FROM objects WHERE object_type = 'variation' AND status = 'publish'",
    ),
    "combined": (
        ("products", "object_terms"),
        f"""SELECT o.* FROM products o WHERE min_price BETWEEN 910 AND 980 AND stock_status = 'instock'
          AND EXISTS (SELECT 1 FROM object_terms t WHERE t.object_id = o.object_id AND taxonomy = 'product_cat'
            AND term_id IN ({', '.join(map(str, CATEGORIES))}))""",
    ),
    # Values formulas read, for every product in scope.
    "wide": (
        ("products", "meta"),
        """SELECT o.object_id, o.stock_quantity::DOUBLE AS stock,
          try_cast(r.meta_value AS DOUBLE) AS rp, try_cast(s.meta_value AS DOUBLE) AS sp,
          try_cast(c.meta_value AS DOUBLE) AS cost, r.meta_value AS rp_text, coalesce(c.meta_value, '') AS cost_text
        FROM products o
        LEFT JOIN meta r ON r.object_id = o.object_id AND r.meta_key = '_regular_price'
        LEFT JOIN meta s ON s.object_id = o.object_id AND s.meta_key = '_sale_price'
        LEFT JOIN meta c ON c.object_id = o.object_id AND c.meta_key = '_cost'""",
    ),
    "operations": (
        (),
        """SELECT id, created_at, CASE WHEN status = 'completed' THEN created_at + INTERVAL 1 DAY END AS completed_at,
          CASE WHEN status <> 'queued' THEN created_at + to_minutes((k % 1440)::INT) END AS last_progress_at,
          CASE WHEN k % 11 = 0 THEN 0 ELSE o_custkey + 1 END::BIGINT AS user_id, status, source,
          CASE WHEN k % 4 = 3 THEN k END AS parent_op_id, k % 5 AS target_count, least(k % 5, k % 3) AS processed,
          0::BIGINT AS failed, 'safe' AS mode, CASE WHEN k % 4 = 3 THEN 'skip' END AS conflict_policy
        FROM (SELECT o_orderkey AS k, o_orderkey + 1 AS id, o_orderdate AS created_at, o_custkey,
          CASE WHEN o_orderkey % 50 = 0 THEN 'queued' WHEN o_orderstatus = 'F' THEN 'completed'
            WHEN o_orderstatus = 'O' THEN 'running' ELSE 'paused' END AS status,
          ['ui', 'cli', 'schedule', 'undo'][(o_orderkey % 4 + 1)::INT] AS source FROM orders)""",
    ),
    "changes": (
        (),
        f"""SELECT l_orderkey + 1 AS operation_id, 'product' AS object_type, l_partkey + 1 AS object_id, 0 AS action_ix,
          'post_field' AS field_type, 'regular_price' AS field_key, {_money('low')} AS old_value,
          CASE WHEN status = 1 THEN {_money('low::DECIMAL(19,2) - 1')} END AS new_value, status
        FROM (SELECT l_orderkey, l_partkey, low, CASE WHEN o_orderkey % 50 <> 0 AND o_orderstatus = 'O' THEN 0
            WHEN flag = 'A' THEN 1 WHEN flag = 'N' THEN 3 ELSE 2 END AS status
          FROM (SELECT l_orderkey, l_partkey, min(l_extendedprice) AS low, min(l_returnflag) AS flag
            FROM lineitem GROUP BY l_orderkey, l_partkey) LEFT JOIN orders ON l_orderkey = o_orderkey)""",
    ),
    "rules": (
        (),
        """SELECT c_custkey + 1 AS id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Rule ' || c_custkey END AS name,
          ['once', 'hourly', 'daily', 'weekly', 'monthly'][(c_custkey % 5 + 1)::INT] AS recurrence,
          CASE WHEN c_custkey % 9 = 0 THEN 'paused' ELSE 'active' END AS status,
          TIMESTAMP '2026-01-31 09:00:00' - to_hours(c_custkey::INT) AS next_run, (c_custkey // 2) * 4 + 3 AS last_op_id,
          ['Brand#11', 'Brand#12', 'Brand#13'][(c_custkey % 3 + 1)::INT] AS brand,
          CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'user' || c_custkey || '@example.com' END AS notify_email
        FROM customer""",
    ),
    # The change set of roundto(cost * 1.35, 0.99), as it is first applied.
    "cost_plus": (
        ("wide",),
        f"""SELECT 1::BIGINT AS operation_id, 'product' AS object_type, object_id, 0 AS action_ix,
          'post_field' AS field_type, 'regular_price' AS field_key, rp_text AS old_value,
          {{number}} AS new_value, CASE WHEN cost IS NULL THEN 3 ELSE 1 END AS status
        FROM (SELECT *, round(round(cost * 1.35::DOUBLE / 0.99::DOUBLE) * 0.99::DOUBLE, 6) AS new_number
          FROM wide WHERE cost_text <> '')""",
    ),
    # Two actions on the combined filter: the price doubled, then the sale price from the new price.
    "doubled": (
        ("combined", "wide", "meta"),
        """SELECT c.object_id, w.rp_text, s.meta_value AS sp_text, w.rp * 2 AS rp2, w.rp * 2 - 0.5 AS sp2
        FROM combined c JOIN wide w ON w.object_id = c.object_id
        LEFT JOIN meta s ON s.object_id = c.object_id AND s.meta_key = '_sale_price'""",
    ),
    # The state an undo of cost_plus meets after later edits.
    "edited": (
        ("cost_plus",),
        """SELECT *, CASE WHEN object_id % 7 = 0 THEN cast(new_value::DECIMAL(19,2) + 5.55 AS varchar)
            WHEN object_id % 7 = 1 AND contains(new_value, '.') THEN new_value || '0'
            WHEN object_id % 7 = 1 THEN new_value || '.0' ELSE new_value END AS current
        FROM cost_plus WHERE status = 1""",
    ),
    "variation_log": (
        ("variations", "meta"),
        """SELECT 1::BIGINT AS operation_id, 'variation' AS object_type, v.object_id, 0 AS action_ix,
          'post_field' AS field_type, 'regular_price' AS field_key, r.meta_value AS old_value,
          {number} AS new_value, v.parent_id
        FROM variations v JOIN meta a ON a.object_id = v.object_id AND a.meta_key = 'attribute_pa_size' AND a.meta_value = 's1'
        JOIN meta r ON r.object_id = v.object_id AND r.meta_key = '_regular_price'""",
    ),
    "attribute_text": (
        ("meta",),
        """SELECT object_id, string_agg(meta_value, ', ' ORDER BY meta_key) AS attributes FROM meta
        WHERE starts_with(meta_key, 'attribute_') AND meta_value <> '' GROUP BY object_id""",
    ),
}


def _number_text(x: str) -> str:
    return rf"regexp_replace(cast(cast({x} AS DECIMAL(38,6)) AS varchar), '\.?0+$', '')"


CTES["cost_plus"] = (CTES["cost_plus"][0], CTES["cost_plus"][1].replace("{number}", _number_text("new_number")))
CTES["variation_log"] = (
    CTES["variation_log"][0],
    CTES["variation_log"][1].replace("{number}", _number_text("round(r.meta_value::DOUBLE + 1, 6)")),
)


def sql(tables: str, body: str) -> str:
    """A query with the derived tables it names, and the ones those need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in tables.split():
        add(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


def _ids(values: list[int]) -> str:
    return ", ".join(map(str, values))


def _products(test: str) -> str:
    return sql("products meta object_terms", f"SELECT object_id FROM products o WHERE {test}")


def _variations(test: str) -> str:
    return sql("variations meta object_terms", f"SELECT object_id FROM variations o WHERE {test}")


def _meta(key: str, test: str = "true", owner: str = "object_id") -> str:
    return f"EXISTS (SELECT 1 FROM meta m WHERE m.object_id = o.{owner} AND meta_key = '{key}' AND {test})"


def _term(taxonomy: str, ids: list[int] | None = None, owner: str = "object_id") -> str:
    chosen = f"AND term_id IN ({_ids(ids)})" if ids else ""
    return f"EXISTS (SELECT 1 FROM object_terms t WHERE t.object_id = o.{owner} AND taxonomy = '{taxonomy}' {chosen})"


_PREFIX = r"coalesce(try_cast(nullif(regexp_extract(meta_value, '^\s*([+-]?(\d+(\.\d*)?|\.\d+))', 1), '') AS DECIMAL(20,4)), 0)"


def _stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


_LOG = "operation_id, object_type, object_id, action_ix, field_type, field_key, old_value, new_value, status"
_UNDO = """{op}::BIGINT AS operation_id, object_type, object_id, action_ix, field_type, field_key"""
_OBJECTS = """object_id, object_type, parent_id, title, status, sku, min_price::DOUBLE AS min_price,
  max_price::DOUBLE AS max_price, stock_quantity, stock_status"""

ORACLES: dict[str, str] = {
    "scan_scope": sql("objects", f"SELECT {_OBJECTS} FROM objects WHERE object_type = 'product' AND status = 'publish'"),
    "scan_scope_variations": sql("variations", f"SELECT {_OBJECTS} FROM variations"),
    "drop_marked": sql(
        "meta",
        f"SELECT m.* FROM meta m ANTI JOIN (SELECT object_id FROM meta WHERE meta_key = '{MARKER_KEY}') x ON m.object_id = x.object_id",
    ),
    "drop_marked_objects": sql(
        "objects meta",
        f"""SELECT {_OBJECTS} FROM objects o ANTI JOIN (SELECT object_id AS id FROM meta WHERE meta_key = '{MARKER_KEY}') x ON o.object_id = x.id""",
    ),
    "drop_marked_links": sql(
        "object_terms meta",
        f"SELECT t.* FROM object_terms t ANTI JOIN (SELECT object_id FROM meta WHERE meta_key = '{MARKER_KEY}') x ON t.object_id = x.object_id",
    ),
    "resolve_all_products": _products("true"),
    "filter_price_gt": _products("min_price > 950"),
    "filter_price_between": _products("min_price BETWEEN 910 AND 950.5"),
    "filter_stock_lt": _products("stock_quantity < 10"),
    "filter_stock_in": _products("stock_quantity IN (3, 5, 7, 11)"),
    "filter_stock_not_in": _products("stock_quantity NOT IN (3, 5, 7, 11)"),
    "filter_status_eq": _products("stock_status = 'instock'"),
    "filter_status_ne": _products("stock_status <> 'instock'"),
    "filter_sku_in": _products("sku IN ('SKU-1', 'SKU-22', 'SKU-151', 'SKU-9')"),
    "filter_sku_contains": _products("contains(sku, 'KU-1')"),
    "filter_category_in": _products(_term("product_cat", CATEGORIES)),
    "filter_category_not_in": _products("NOT " + _term("product_cat", CATEGORIES)),
    "filter_tag_in": _products(_term("product_tag", TAGS)),
    "filter_tag_not_exists": _products("NOT " + _term("product_tag")),
    "filter_color_in": _products(_term("pa_color", COLORS)),
    "filter_color_exists": _products(_term("pa_color")),
    "filter_meta_eq": _products(_meta("_brand", "meta_value = 'Brand#12'")),
    "filter_meta_ne": _products(_meta("_cost", "meta_value <> 'n/a'")),
    "filter_meta_in": _products(_meta("_brand", "meta_value IN ('Brand#11', 'Brand#12', 'Brand#3')")),
    "filter_meta_not_in": _products(_meta("_cost", "meta_value NOT IN ('', 'n/a')")),
    "filter_meta_contains": _products(_meta("_brand", "contains(meta_value, '#1')")),
    "filter_meta_gt": _products(_meta("_cost", f"{_PREFIX} > 820")),
    "filter_meta_le": _products(_meta("_cost", f"{_PREFIX} <= 800")),
    "filter_meta_between": _products(_meta("_cost", f"{_PREFIX} BETWEEN 790 AND 830.25")),
    "filter_meta_exists": _products(_meta("_cost")),
    "filter_meta_not_exists": _products("NOT " + _meta("_cost")),
    "filter_price_variation": _variations("min_price <= 20000"),
    "filter_category_inherited": _variations(_term("product_cat", CATEGORIES, "parent_id")),
    "filter_category_inherited_not_in": _variations("NOT " + _term("product_cat", CATEGORIES, "parent_id")),
    "filter_variation_size_in": _variations(_meta("attribute_pa_size", "meta_value IN ('s1', 's2')")),
    "filter_variation_size_not_in": _variations("NOT " + _meta("attribute_pa_size", "meta_value IN ('s1', 's2')")),
    "filter_variation_size_exists": _variations(_meta("attribute_pa_line", "meta_value <> ''")),
    "filter_variation_size_not_exists": _variations("NOT " + _meta("attribute_pa_line", "meta_value <> ''")),
    "filter_and_combined": sql("combined", "SELECT object_id FROM combined"),
    "filter_or_mixed": _products(
        "(min_price < 905 OR "
        + _term("product_cat", CATEGORIES[:1])
        + " OR "
        + _meta("_brand", "meta_value = 'Brand#12'")
        + " OR NOT "
        + _term("product_tag")
        + ")"
    ),
    "filter_form_combined": _variations(
        "min_price >= 5000 AND min_price <= 60000 AND stock_status = 'instock' AND "
        + _term("product_cat", CATEGORIES, "parent_id")
        + " AND "
        + _term("product_tag", TAGS, "parent_id")
        + " AND "
        + _meta("attribute_pa_size", "meta_value IN ('s1', 's2')")
    ),
    "applicable_targets": _products(
        _meta("_cost", "meta_value <> ''") + " AND " + _meta("_sale_price", "meta_value <> ''")
    ),
    "resolve_combined": sql("combined", "SELECT object_id FROM combined ORDER BY object_id"),
    "count_combined": sql("combined", "SELECT count(*) AS matched FROM combined"),
    # Pages
    "product_page": sql(
        "products meta",
        """SELECT o.object_id AS id, title AS name, 0::BIGINT AS parent_id, sku, min_price::DOUBLE AS price,
          max_price::DOUBLE AS max_price, nullif(s.meta_value, '') AS sale_price, nullif(c.meta_value, '') AS cost,
          stock_status, stock_quantity
        FROM (SELECT * FROM products ORDER BY object_id LIMIT 25 OFFSET 25) o
        LEFT JOIN meta s ON s.object_id = o.object_id AND s.meta_key = '_sale_price'
        LEFT JOIN meta c ON c.object_id = o.object_id AND c.meta_key = '_cost'""",
    ),
    "variation_page": sql(
        "variations meta attribute_text objects",
        """SELECT o.object_id AS id, p.title || ' — ' || attributes AS name, o.parent_id, o.sku,
          o.min_price::DOUBLE AS price, o.max_price::DOUBLE AS max_price, NULL::VARCHAR AS sale_price,
          NULL::VARCHAR AS cost, o.stock_status, o.stock_quantity
        FROM (SELECT * FROM variations v WHERE object_id IN (SELECT object_id FROM meta
            WHERE meta_key = 'attribute_pa_line') ORDER BY object_id LIMIT 50) o
        JOIN attribute_text a ON a.object_id = o.object_id
        LEFT JOIN objects p ON p.object_id = o.parent_id""",
    ),
    "attribute_summary": sql("attribute_text", "SELECT * FROM attribute_text"),
    "meta_pivot": sql(
        "meta",
        """SELECT object_id, max(CASE WHEN meta_key = '_sale_price' THEN nullif(meta_value, '') END) AS sale_price,
          max(CASE WHEN meta_key = '_cost' THEN nullif(meta_value, '') END) AS cost
        FROM meta WHERE meta_key IN ('_sale_price', '_cost') GROUP BY object_id""",
    ),
    "audit_page": sql(
        "variation_log objects attribute_text",
        """SELECT l.object_id, action_ix, l.object_type, p.sku, p.title || ' (' || attributes || ')' AS name,
          field_type, field_key, old_value, new_value, 'applied' AS status
        FROM (SELECT * FROM variation_log ORDER BY object_id LIMIT 50 OFFSET 50) l
        JOIN objects p ON p.object_id = l.parent_id JOIN attribute_text a ON a.object_id = l.object_id""",
    ),
    "audit_sku_search": sql(
        "variation_log objects attribute_text",
        """SELECT l.object_id, action_ix, l.object_type, p.sku, p.title || ' (' || attributes || ')' AS name,
          field_type, field_key, old_value, new_value, 'applied' AS status
        FROM variation_log l
        JOIN objects p ON p.object_id = l.parent_id JOIN attribute_text a ON a.object_id = l.object_id
        WHERE contains(p.sku, 'SKU-1') ORDER BY l.object_id LIMIT 200""",
    ),
    "audit_page_total": sql(
        "variation_log objects",
        """SELECT count(*) AS total FROM variation_log l JOIN objects p ON p.object_id = l.parent_id
        WHERE contains(p.sku, 'SKU-1')""",
    ),
    "sku_matches": sql(
        "objects",
        """SELECT object_id FROM objects WHERE contains(sku, 'SKU-1') UNION
        SELECT c.object_id FROM objects c JOIN objects p ON p.object_id = c.parent_id WHERE contains(p.sku, 'SKU-1')""",
    ),
    "pending_head": sql(
        "wide",
        """SELECT 1::BIGINT AS operation_id, 'product' AS object_type, object_id, 0 AS action_ix, 'post_field' AS field_type,
          'regular_price' AS field_key, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value, 0 AS status
        FROM wide WHERE cost_text <> '' ORDER BY object_id LIMIT 50""",
    ),
    # Formulas
    "derive_price_pct": sql("wide", "SELECT object_id, round(rp * 0.9::DOUBLE, 6) AS result FROM wide"),
    "derive_margin_ratio": sql(
        "wide",
        """SELECT object_id, CASE WHEN stock - 5 <> 0 THEN round((rp - cost) / (stock - 5), 6) END AS result FROM wide""",
    ),
    "derive_round": sql("wide", "SELECT object_id, round(rp * 0.35::DOUBLE) AS result FROM wide"),
    "derive_ceil_floor": sql(
        "wide",
        "SELECT object_id, ceil(rp * 0.333::DOUBLE) AS up, floor(rp * 0.333::DOUBLE) AS down, abs(-rp) AS size FROM wide",
    ),
    "derive_roundto_cost": sql(
        "wide",
        "SELECT object_id, round(round(cost * 1.35::DOUBLE / 0.99::DOUBLE) * 0.99::DOUBLE, 6) AS result FROM wide",
    ),
    "derive_floor_price": sql(
        "wide",
        """SELECT object_id, CASE WHEN rp IS NOT NULL AND cost IS NOT NULL
            THEN round(greatest(rp * 0.8::DOUBLE, cost * 1.1::DOUBLE), 6) END AS highest,
          CASE WHEN rp IS NOT NULL AND cost IS NOT NULL AND sp IS NOT NULL
            THEN round(least(rp * 0.8::DOUBLE, cost, sp), 6) END AS lowest FROM wide""",
    ),
    "derive_numeric_read": sql("wide", "SELECT object_id, cost, sp AS sale FROM wide"),
    "values_equal_matrix": sql(
        "meta",
        r"""SELECT object_id, meta_key, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL
            WHEN regexp_full_match(a, '\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*')
              AND regexp_full_match(b, '\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*')
            THEN try_cast(trim(a) AS DOUBLE) = try_cast(ltrim(trim(b), '+') AS DOUBLE) ELSE a = b END AS same
        FROM (SELECT object_id, meta_key, meta_value AS a, CASE object_id % 8 WHEN 0 THEN meta_value
            WHEN 1 THEN meta_value || '0' WHEN 2 THEN ' ' || meta_value || ' ' WHEN 3 THEN ''
            WHEN 4 THEN meta_value || 'd' WHEN 5 THEN '900.1' WHEN 6 THEN '+' || meta_value END AS b
          FROM meta WHERE meta_key IN ('_regular_price', '_cost'))""",
    ),
    "decode_entities": """SELECT p_partkey, p_type || ' & ' || p_name
        || ' <b> "x" ''y’ &lt; café &unknown; A & ' || p_brand AS name FROM part""",
    # Change sets
    "preview_formula": sql(
        "wide",
        """SELECT count(*) AS matched, count(*) FILTER (cost_text <> '') AS applicable,
          count(*) FILTER (cost_text = '') AS omitted FROM wide""",
    ),
    "preview_set": sql("combined", "SELECT count(*) AS matched, count(*) AS applicable, 0 AS omitted FROM combined"),
    "omitted_targets": sql("wide", "SELECT object_id FROM wide WHERE cost_text = ''"),
    "freeze_targets": sql(
        "wide",
        """SELECT 1::BIGINT AS operation_id, 'product' AS object_type, object_id, i AS action_ix, 'post_field' AS field_type,
          f AS field_key, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value, 0 AS status
        FROM wide, (VALUES (0, 'regular_price'), (1, 'sale_price')) a(i, f) WHERE rp_text <> ''""",
    ),
    "changeset_formula": sql("cost_plus", f"SELECT {_LOG} FROM cost_plus"),
    "changeset_set": sql(
        "combined wide",
        """SELECT 1::BIGINT AS operation_id, 'product' AS object_type, object_id, 0 AS action_ix, 'post_field' AS field_type,
          'regular_price' AS field_key, rp_text AS old_value, '9.99' AS new_value, 1 AS status
        FROM wide WHERE object_id IN (SELECT object_id FROM combined)""",
    ),
    "changeset_two_actions": sql(
        "doubled",
        f"""SELECT 1::BIGINT AS operation_id, 'product' AS object_type, object_id, i AS action_ix, 'post_field' AS field_type,
          f AS field_key, CASE i WHEN 0 THEN rp_text ELSE sp_text END AS old_value,
          CASE i WHEN 0 THEN {_number_text('rp2')} ELSE {_number_text('sp2')} END AS new_value, 1 AS status
        FROM doubled, (VALUES (0, 'regular_price'), (1, 'sale_price')) a(i, f)""",
    ),
    "changeset_statuses": sql(
        "cost_plus",
        """SELECT operation_id, object_type, object_id, action_ix, field_type, field_key,
          CASE WHEN object_id % 9 <> 0 THEN old_value END AS old_value,
          CASE WHEN object_id % 9 <> 0 THEN new_value END AS new_value,
          CASE WHEN object_id % 9 <> 0 THEN status ELSE 2 END AS status FROM cost_plus""",
    ),
    "preview_values": sql(
        "doubled",
        f"""SELECT object_id, i AS action_ix, f AS field_key, CASE i WHEN 0 THEN rp_text ELSE sp_text END AS old_value,
          CASE i WHEN 0 THEN {_number_text('rp2')} ELSE {_number_text('sp2')} END AS new_value, 1 AS status
        FROM doubled, (VALUES (0, 'regular_price'), (1, 'sale_price')) a(i, f) ORDER BY object_id, i LIMIT 20""",
    ),
    "replay_noop": sql("cost_plus", f"SELECT {_LOG} FROM cost_plus"),
    "settle_once": sql("cost_plus", f"SELECT {_LOG} FROM cost_plus"),
    "catalog_after_apply": sql(
        "objects doubled",
        """SELECT o.object_id, title, coalesce(least(rp2, sp2), min_price::DOUBLE) AS min_price,
          coalesce(least(rp2, sp2), max_price::DOUBLE) AS max_price, stock_quantity
        FROM objects o LEFT JOIN doubled d ON d.object_id = o.object_id""",
    ),
    "meta_after_apply": sql(
        "meta doubled",
        f"""SELECT m.object_id, meta_key, CASE WHEN meta_key = '_regular_price' AND rp2 IS NOT NULL THEN {_number_text('rp2')}
          WHEN meta_key = '_sale_price' AND sp2 IS NOT NULL THEN {_number_text('sp2')} ELSE meta_value END AS meta_value
        FROM meta m LEFT JOIN doubled d ON d.object_id = m.object_id""",
    ),
    "objects_after_set": sql(
        "objects combined",
        """SELECT o.object_id, CASE WHEN c.object_id IS NULL THEN o.stock_status ELSE 'onbackorder' END AS stock_status,
          CASE WHEN c.object_id IS NULL THEN o.stock_quantity ELSE 7 END AS stock_quantity
        FROM objects o LEFT JOIN combined c ON c.object_id = o.object_id""",
    ),
    # Undo
    "undo_targets": sql(
        "cost_plus",
        f"""SELECT {_UNDO.format(op=9001)}, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value, 0 AS status
        FROM cost_plus WHERE status = 1""",
    ),
    "undo_changeset_skip": sql(
        "edited",
        f"""SELECT {_UNDO.format(op=9001)}, current AS old_value,
          CASE WHEN object_id % 7 <> 0 THEN old_value END AS new_value,
          CASE WHEN object_id % 7 <> 0 THEN 1 ELSE 3 END AS status FROM edited""",
    ),
    "undo_of_frozen_targets": sql(
        "edited",
        f"""SELECT {_UNDO.format(op=9001)}, CASE WHEN object_id % 5 <> 0 THEN current END AS old_value,
          CASE WHEN object_id % 5 <> 0 AND object_id % 7 <> 0 THEN old_value END AS new_value,
          CASE WHEN object_id % 5 <> 0 AND object_id % 7 <> 0 THEN 1 ELSE 3 END AS status FROM edited""",
    ),
    "undo_changeset_force": sql(
        "edited",
        f"SELECT {_UNDO.format(op=9001)}, current AS old_value, old_value AS new_value, 1 AS status FROM edited",
    ),
    "redo_changeset": sql(
        "edited",
        f"""SELECT {_UNDO.format(op=9002)}, old_value, current AS new_value, 1 AS status FROM edited
        WHERE object_id % 7 <> 0""",
    ),
    "undo_preview_sample": sql(
        "edited",
        """SELECT object_id, 'regular_price' AS field, current, old_value AS restore_to, object_id % 7 = 0 AS drift,
          CASE WHEN object_id % 7 = 0 THEN 'skip' ELSE 'revert' END AS action FROM edited ORDER BY object_id LIMIT 20""",
    ),
    "undo_preview_totals": sql(
        "edited", "SELECT count(*) AS total, count(*) FILTER (object_id % 7 = 0) AS drifted FROM edited"
    ),
    # Logs
    "change_counts": sql(
        "changes",
        """SELECT count(*) FILTER (status = 0) AS pending, count(*) FILTER (status = 1) AS applied,
          count(*) FILTER (status = 2) AS failed, count(*) FILTER (status = 3) AS skipped
        FROM changes WHERE operation_id = 2""",
    ),
    "operation_summary": sql(
        "changes",
        """SELECT operation_id, count(*) AS targets, count(*) FILTER (status = 0) AS pending,
          count(*) FILTER (status = 1) AS applied, count(*) FILTER (status = 2) AS failed,
          count(*) FILTER (status = 3) AS skipped FROM changes GROUP BY operation_id""",
    ),
    "operation_progress": sql(
        "changes operations",
        """SELECT id, o.status, coalesce(target_rows, 0) AS target_rows, coalesce(target_objects, 0) AS target_objects,
          coalesce(c.processed, 0) AS processed, coalesce(c.failed, 0) AS failed,
          CASE WHEN target_objects > 0 THEN floor(least(c.processed, target_objects) / target_objects * 100)
            ELSE 0 END::BIGINT AS percent,
          o.status NOT IN ('queued', 'running') AND coalesce(c.processed, 0) > 0 AS can_undo
        FROM operations o LEFT JOIN (
          SELECT operation_id, sum(n)::BIGINT AS target_rows, count(*) AS target_objects,
            count(*) FILTER (done AND NOT bad) AS processed, count(*) FILTER (bad) AS failed
          FROM (SELECT operation_id, object_id, count(*) AS n, bool_or(status = 2) AS bad, bool_or(status IN (1, 3)) AS done
            FROM changes GROUP BY operation_id, object_id) GROUP BY operation_id) c ON c.operation_id = o.id""",
    ),
    "operation_counters": sql(
        "changes operations",
        """SELECT id, o.status, coalesce(n, 0) AS target_count, coalesce(c.processed, 0) AS processed,
          coalesce(c.failed, 0) AS failed
        FROM operations o LEFT JOIN (
          SELECT operation_id, count(*) AS n, count(*) FILTER (done AND NOT bad) AS processed, count(*) FILTER (bad) AS failed
          FROM (SELECT operation_id, object_id, bool_or(status = 2) AS bad, bool_or(status IN (1, 3)) AS done
            FROM changes GROUP BY operation_id, object_id) GROUP BY operation_id) c ON c.operation_id = o.id""",
    ),
    "recent_operations": sql(
        "operations",
        f"""SELECT id, status, source, user_id, {_stamp('created_at')} AS created_at, {_stamp('completed_at')} AS completed_at
        FROM operations ORDER BY id DESC LIMIT 20""",
    ),
    "operation_history": sql(
        "operations",
        f"""SELECT id, status, source, mode, parent_op_id, conflict_policy, user_id, coalesce(c_name, '') AS user_name,
          target_count, processed, failed, CASE WHEN target_count > 0
            THEN floor(least(processed, target_count) / target_count * 100) ELSE 0 END::BIGINT AS percent,
          status NOT IN ('queued', 'running') AND processed > 0 AS can_undo,
          {_stamp('created_at')} AS created_at, {_stamp('completed_at')} AS completed_at
        FROM (SELECT * FROM operations ORDER BY id DESC LIMIT 20) LEFT JOIN customer ON user_id > 0 AND c_custkey + 1 = user_id""",
    ),
    "active_operation": sql(
        "operations",
        "SELECT id, status FROM operations WHERE status IN ('queued', 'running') AND id <> 1 ORDER BY id LIMIT 1",
    ),
    "stalled_operations": sql(
        "operations",
        f"""SELECT id, {_stamp('last_progress_at')} AS last_progress_at FROM operations
        WHERE status = 'running' AND last_progress_at < TIMESTAMP '2001-07-01 11:50:00' ORDER BY id""",
    ),
    "operation_final_status": sql(
        "operations",
        """SELECT id, CASE WHEN id IN (SELECT parent_op_id FROM operations
            WHERE source = 'undo' AND status = 'completed' AND parent_op_id IS NOT NULL)
          THEN 'reverted' ELSE status END AS status FROM operations""",
    ),
    "completion_report": sql(
        "operations changes rules",
        f"""SELECT o.id, coalesce(nullif(r.name, ''), 'Operation #' || o.id) AS label,
          coalesce(nullif(r.notify_email, ''), 'admin@example.com') AS recipient, target_count AS targets,
          coalesce(applied, 0) AS changed, coalesce(skipped, 0) AS skipped, coalesce(c.failed, 0) AS failed,
          {_stamp('completed_at')} AS completed_at
        FROM operations o
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY last_op_id ORDER BY id DESC) AS n FROM rules) r
          ON r.last_op_id = o.id AND n = 1
        LEFT JOIN (SELECT operation_id, count(*) FILTER (status = 1) AS applied, count(*) FILTER (status = 3) AS skipped,
            count(*) FILTER (status = 2) AS failed FROM changes GROUP BY operation_id) c ON c.operation_id = o.id
        WHERE source = 'schedule' AND o.status = 'completed'""",
    ),
    "retention_expired_ops": sql(
        "operations changes",
        """SELECT operation_id, count(*) AS rows FROM changes WHERE operation_id IN (
          SELECT id FROM operations WHERE completed_at < TIMESTAMP '1998-01-01') GROUP BY operation_id""",
    ),
    "retention_purge_counts": sql(
        "operations changes",
        """SELECT count(*) AS operations, coalesce(sum(n), 0)::BIGINT AS rows FROM (
          SELECT operation_id, count(*) AS n FROM changes WHERE operation_id IN (
            SELECT id FROM operations WHERE completed_at < TIMESTAMP '1998-01-01') GROUP BY operation_id)""",
    ),
    "retention_survivors": sql(
        "operations changes",
        f"""SELECT {_LOG} FROM changes WHERE operation_id NOT IN (
          SELECT id FROM operations WHERE completed_at < TIMESTAMP '1998-01-01')""",
    ),
    # Discovery
    "discover_meta_keys": sql(
        "meta",
        """SELECT meta_key FROM (SELECT DISTINCT meta_key FROM meta WHERE meta_key <> '')
        WHERE meta_key NOT IN ('_regular_price', '_sale_price') AND NOT starts_with(meta_key, 'attribute_')""",
    ),
    "discover_brands": sql(
        "meta",
        """SELECT DISTINCT 'meta:_brand' AS field, meta_value AS brand FROM meta
        WHERE meta_key = '_brand' AND meta_value <> ''""",
    ),
    "discover_categories": sql(
        "terms object_terms",
        """SELECT t.term_id, name, count(l.object_id) AS count FROM terms t LEFT JOIN object_terms l
          ON l.term_id = t.term_id AND l.taxonomy = t.taxonomy
        WHERE t.taxonomy = 'product_cat' GROUP BY t.term_id, name ORDER BY name""",
    ),
    "discover_tags": sql(
        "terms object_terms",
        """SELECT t.term_id, name, count(l.object_id) AS count FROM terms t LEFT JOIN object_terms l
          ON l.term_id = t.term_id AND l.taxonomy = t.taxonomy
        WHERE t.taxonomy = 'product_tag' GROUP BY t.term_id, name ORDER BY name""",
    ),
    "discover_attribute_terms": sql(
        "terms",
        """SELECT 'attribute:' || taxonomy AS field, taxonomy, term_id, slug, name FROM terms
        WHERE starts_with(taxonomy, 'pa_')""",
    ),
    "discover_attributes": sql(
        "terms",
        """SELECT 'attribute:' || taxonomy AS field, taxonomy, upper(taxonomy[4:4]) || taxonomy[5:] AS label,
          string_agg(term_id || ':' || slug || ':' || name, ',' ORDER BY name, term_id) AS terms
        FROM terms WHERE starts_with(taxonomy, 'pa_') GROUP BY taxonomy""",
    ),
    # Rules
    "due_rules": sql(
        "rules",
        f"""SELECT id, name, recurrence, {_stamp('next_run')} AS next_run FROM rules
        WHERE status = 'active' AND next_run <= TIMESTAMP '2026-02-15 12:00:00'""",
    ),
    "recent_rules": sql(
        "rules",
        f"SELECT id, recurrence, {_stamp('next_run')} AS next_run FROM rules ORDER BY id DESC LIMIT 100",
    ),
    "advance_rules": "WITH RECURSIVE rules AS ("
    + CTES["rules"][1]
    + f"""), monthly(id, t, k) AS (
        SELECT id, next_run, 0 FROM rules WHERE recurrence = 'monthly'
        UNION ALL
        SELECT id, date_trunc('month', t) + INTERVAL 1 MONTH + (t - date_trunc('month', t)), k + 1
        FROM monthly WHERE k = 0 OR t <= TIMESTAMP '2026-02-15 12:00:00'),
      stepped AS (SELECT id, max(t) AS t FROM monthly GROUP BY id),
      fixed AS (SELECT id, next_run + to_seconds(greatest(floor((epoch(TIMESTAMP '2026-02-15 12:00:00') - epoch(next_run)) / s) + 1, 1) * s) AS t
        FROM (SELECT *, CASE recurrence WHEN 'hourly' THEN 3600 WHEN 'daily' THEN 86400 WHEN 'weekly' THEN 604800 END AS s FROM rules)
        WHERE s IS NOT NULL)
      SELECT r.id, recurrence, CASE recurrence WHEN 'once' THEN 'completed' ELSE 'active' END AS status,
        {_stamp('coalesce(m.t, f.t, next_run)')} AS next_run, '2026-02-15 12:00:00' AS last_run
      FROM rules r LEFT JOIN stepped m ON m.id = r.id LEFT JOIN fixed f ON f.id = r.id""",
    "rule_run_changeset": sql(
        "wide rules meta",
        f"""SELECT t.template AS operation_id, 'product' AS object_type, w.object_id, 0 AS action_ix, 'post_field' AS field_type,
          'regular_price' AS field_key, rp_text AS old_value, {_number_text('round(rp * 1.5::DOUBLE, 6)')} AS new_value, 1 AS status
        FROM wide w JOIN meta b ON b.object_id = w.object_id AND b.meta_key = '_brand'
        JOIN (SELECT brand, row_number() OVER (ORDER BY brand) AS template FROM (SELECT DISTINCT brand FROM rules WHERE status = 'active'
          AND next_run <= TIMESTAMP '2026-02-15 12:00:00')) t ON t.brand = b.meta_value""",
    ),
    "rule_run_templates": sql(
        "rules",
        """SELECT id, dense_rank() OVER (ORDER BY brand) AS template FROM rules WHERE status = 'active'
          AND next_run <= TIMESTAMP '2026-02-15 12:00:00'""",
    ),
    "stock_after_formula": sql(
        "products",
        """SELECT object_id, stock_quantity::VARCHAR AS old_value, trunc(stock_quantity * 1.5)::BIGINT::VARCHAR AS new_value, 1 AS status,
          trunc(stock_quantity * 1.5)::BIGINT AS stock_quantity FROM products WHERE stock_quantity IS NOT NULL""",
    ),
    "undo_stock_formula": sql(
        "products",
        """SELECT 9001::BIGINT AS operation_id, 'product' AS object_type, object_id, 0 AS action_ix, 'post_field' AS field_type,
          'stock_quantity' AS field_key, trunc(stock_quantity * 1.5)::BIGINT::VARCHAR AS old_value, stock_quantity::VARCHAR AS new_value,
          1 AS status FROM products WHERE stock_quantity IS NOT NULL""",
    ),
    "price_too_large": sql(
        "combined",
        "SELECT object_id, NULL::VARCHAR AS new_value, 3 AS status, min_price::DOUBLE AS min_price FROM combined",
    ),
    "stored_catalog_prices": sql(
        "objects meta",
        "SELECT o.object_id, object_type, sku, meta_value FROM objects o JOIN meta m ON m.object_id = o.object_id AND meta_key = '_regular_price'",
    ),
    "normalize_start": f"""SELECT o_orderkey, {_stamp('CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN o_orderdate ELSE now END')} AS starts_at
      FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 2 THEN date_trunc('day', o_orderdate) ELSE o_orderdate END AS o_orderdate,
        TIMESTAMP '2026-02-15 12:00:00' AS now FROM orders)""",
    # Streams, as the batch queries they must equal
    "stream_enforcement": sql(
        "wide products",
        f"""SELECT event_id, w.object_id, 'regular_price' AS field_key, {_money('value')} AS old_value,
          {_number_text("round(greatest(value, cost * 1.5::DOUBLE), 6)")} AS new_value,
          1 AS status FROM events JOIN wide w ON w.object_id = user_id + 1
          JOIN products p ON p.object_id = w.object_id WHERE stock_status = 'instock' AND cost IS NOT NULL
        UNION ALL
        SELECT event_id, w.object_id, 'regular_price', {_money('value')}, NULL, 3
          FROM events JOIN wide w ON w.object_id = user_id + 1
          JOIN products p ON p.object_id = w.object_id WHERE stock_status = 'instock' AND cost IS NULL""",
    ),
    "stream_admit_once": "SELECT DISTINCT user_id + 1 AS operation_id, event_type FROM events",
    "stream_progress": f"""SELECT user_id + 1 AS operation_id, {_stamp("date_trunc('day', ts)")} AS bucket_start, count(*) AS changes,
        any_value(latest) < TIMESTAMP '2024-01-30 11:50:00' AS stalled
      FROM events JOIN (SELECT user_id AS u, max(ts) AS latest FROM events GROUP BY user_id) ON u = user_id
      GROUP BY user_id, date_trunc('day', ts)""",
}


# The generated catalog, recomputed from the same digests.


def _draw(number: str, what: str, low: int, high: int) -> str:
    value = f"('0x' || substr(md5({number} || ':{what}'), 1, 8))::BIGINT"
    return f"({value} % {high - low + 1} + {low})"


def _pick(number: str, what: str, options: tuple[str, ...]) -> str:
    names = ", ".join(f"'{o}'" for o in options)
    return f"[{names}][{_draw(number, what, 1, len(options))}]"


_SIZE_NAMES = ", ".join(f"'{s}'" for s in SYNTH_SIZES)

CTES["synth"] = (
    (),
    f"""SELECT *, CASE WHEN child > 0 THEN 'variation' ELSE 'product' END AS object_type, n * {CHILDREN} + child AS object_id,
      CASE WHEN child > 0 THEN n * {CHILDREN} ELSE 0 END AS parent_id,
      CASE WHEN NOT is_parent THEN cents / 100.0 END::DECIMAL(19,2) AS price,
      CASE WHEN NOT is_parent AND child = 0 AND {_draw('k', 'discount', 1, 100)} <= 20
        THEN floor(cents * 17 / 20 + 0.5) / 100 END::DECIMAL(19,2) AS sale,
      CASE WHEN is_parent THEN NULL WHEN child > 0 THEN {_draw('k', 'quantity', 0, 200)}
        WHEN {_draw('k', 'in_stock', 1, 100)} <= 85 THEN {_draw('k', 'quantity', 1, 300)} ELSE 0 END AS stock_quantity,
      (floor(cents * 100 / ({_draw('k', 'margin', 20, 60)} + 100) + 0.5) / 100)::DECIMAL(19,2) AS cost,
      {_pick('n', 'category', SYNTH_CATEGORIES)} AS category, {_pick('n', 'color', SYNTH_COLORS)} AS color,
      CASE WHEN child > 0 THEN [{_SIZE_NAMES}][child] END AS size, {_pick('k', 'brand', BRANDS)} AS brand
    FROM (SELECT *, n || '/' || child AS k, {_draw("(n || '/' || child)", 'price', 499, 49999)} AS cents
      FROM (SELECT p_partkey + 1 AS n, c AS child, c = 0 AND {_draw('(p_partkey + 1)', 'variable', 1, 100)} <= 30 AS is_parent
        FROM part, range(0, {len(SYNTH_SIZES) + 1}) r(c)
        WHERE c = 0 OR {_draw('(p_partkey + 1)', 'variable', 1, 100)} <= 30))""",
)

ORACLES |= {
    "synth_objects": sql(
        "synth",
        """SELECT object_id, object_type, parent_id, CASE WHEN child > 0 THEN ''
            WHEN is_parent THEN 'Generated variable ' || n ELSE 'Generated product ' || n END AS title, 'publish' AS status,
          CASE WHEN child > 0 THEN '' WHEN is_parent THEN 'GEN-V-' || n ELSE 'GEN-' || n END AS sku,
          coalesce(sale, price)::DOUBLE AS min_price, coalesce(sale, price)::DOUBLE AS max_price, stock_quantity,
          CASE WHEN is_parent OR stock_quantity > 0 THEN 'instock' ELSE 'outofstock' END AS stock_status FROM synth""",
    ),
    "synth_meta": sql(
        "synth",
        f"""SELECT object_id, '{MARKER}' AS meta_key, '{MARKER_VALUE}' AS meta_value FROM synth
        UNION ALL SELECT object_id, '_brand', brand FROM synth
        UNION ALL SELECT object_id, '_cost', cost::VARCHAR FROM synth WHERE NOT is_parent
        UNION ALL SELECT object_id, '_regular_price', coalesce(price::VARCHAR, '') FROM synth
        UNION ALL SELECT object_id, '_sale_price', coalesce(sale::VARCHAR, '') FROM synth WHERE child = 0
        UNION ALL SELECT object_id, '_stock', stock_quantity::VARCHAR FROM synth WHERE NOT is_parent
        UNION ALL SELECT object_id, 'attribute_pa_size', lower(size) FROM synth WHERE child > 0""",
    ),
    "synth_links": sql(
        "synth",
        f"""SELECT object_id, taxonomy, {_term_id('taxonomy', 'name')} AS term_id FROM (
          SELECT object_id, 'product_cat' AS taxonomy, category AS name FROM synth WHERE child = 0
          UNION ALL SELECT object_id, 'pa_color', color FROM synth WHERE child = 0 AND NOT is_parent
          UNION ALL SELECT object_id, 'pa_size', s FROM synth, (SELECT unnest([{_SIZE_NAMES}]) AS s) WHERE is_parent)""",
    ),
}

_COUNTS = """count(*) FILTER (status = 0) AS pending, count(*) FILTER (status = 1) AS applied,
  count(*) FILTER (status = 2) AS failed, count(*) FILTER (status = 3) AS skipped"""
_STORED = f"""(SELECT * FROM ({ORACLES['changeset_formula']})
  UNION ALL SELECT 2, * EXCLUDE (operation_id) FROM ({ORACLES['changeset_two_actions']}))"""

# The same over stored logs.
ORACLES |= {
    "stored_log_summary": f"SELECT operation_id, count(*) AS targets, {_COUNTS} FROM {_STORED} GROUP BY operation_id",
    "stored_change_counts": f"SELECT {_COUNTS} FROM {_STORED} WHERE operation_id = 2",
    "stored_frozen_targets": ORACLES["freeze_targets"],
    "stored_operations": f"""SELECT o.id, f.status, source, target_count
      FROM ({sql("operations", "SELECT id, source, target_count FROM operations")}) o
      JOIN ({ORACLES['operation_final_status']}) f ON f.id = o.id""",
}

# Counters kept, chains, parts and indexes: what they stand for, computed from scratch.
_CHAIN_ROWS = "products object_terms wide meta"
_CHAIN = f"""SELECT c.object_id, w.rp, w.rp_text, c.stock_quantity, s.meta_value AS sp_text, k.meta_value AS cost_now,
    round((round(w.rp + 10, 6) - 1) * 2, 6) - 1 AS rp5
  FROM (SELECT * FROM products o WHERE stock_status = 'instock' AND {_term('product_cat', CATEGORIES)}) c
  JOIN wide w ON w.object_id = c.object_id
  LEFT JOIN meta s ON s.object_id = c.object_id AND s.meta_key = '_sale_price'
  LEFT JOIN meta k ON k.object_id = c.object_id AND k.meta_key = '_cost'"""
ORACLES |= {
    "kept_operation_summary": ORACLES["operation_summary"],
    "kept_operation_progress": ORACLES["operation_progress"],
    # The fourth operation takes the sale price back to what the second found.
    "chain_changeset": sql(
        _CHAIN_ROWS,
        f"""SELECT 2::BIGINT AS operation_id, 'product' AS object_type, object_id,
          (CASE f WHEN 'regular_price' THEN 4096 WHEN 'stock_quantity' THEN 1 WHEN 'sale_price' THEN 3072 ELSE 4097 END)::INT AS action_ix,
          CASE f WHEN '_cost' THEN 'meta' ELSE 'post_field' END AS field_type, f AS field_key,
          CASE f WHEN 'regular_price' THEN rp_text WHEN 'stock_quantity' THEN stock_quantity::VARCHAR WHEN 'sale_price' THEN sp_text
            ELSE coalesce(cost_now, '') END AS old_value,
          CASE f WHEN 'regular_price' THEN {_number_text('rp5')} WHEN 'stock_quantity' THEN '7' WHEN 'sale_price' THEN sp_text ELSE '5' END AS new_value,
          1 AS status
        FROM ({_CHAIN}), (VALUES ('regular_price'), ('stock_quantity'), ('sale_price'), ('_cost')) a(f)""",
    ),
    "apply_chain_meta": sql(
        _CHAIN_ROWS,
        f"""SELECT m.object_id, meta_key, CASE WHEN c.object_id IS NULL THEN meta_value WHEN meta_key = '_regular_price' THEN {_number_text('rp5')}
            WHEN meta_key = '_cost' THEN '5' ELSE meta_value END AS meta_value
          FROM meta m LEFT JOIN ({_CHAIN}) c ON c.object_id = m.object_id
        UNION ALL SELECT object_id, '_cost', '5' FROM ({_CHAIN}) WHERE cost_now IS NULL""",
    ),
    "undo_chain": sql(
        _CHAIN_ROWS, f"SELECT * FROM meta UNION ALL SELECT object_id, '_cost', '' FROM ({_CHAIN}) WHERE cost_now IS NULL"
    ),
    "parted_meta_after_apply": ORACLES["meta_after_apply"],
    "parted_catalog_after_apply": ORACLES["catalog_after_apply"],
    "indexed_sku_contains": ORACLES["filter_sku_contains"],
    "indexed_sku_matches": ORACLES["sku_matches"],
}

# Streams against batch counterparts: gaps and islands, and the version of each event's time.
ORACLES |= {
    "stream_stalls": f"""WITH marked AS (SELECT user_id + 1 AS operation_id, ts,
        (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 1 DAY)::INT AS opens FROM events),
      islands AS (SELECT *, sum(coalesce(opens, 1)) OVER (PARTITION BY operation_id ORDER BY ts) AS island FROM marked)
      SELECT operation_id, {_stamp('min(ts)')} AS started, {_stamp('max(ts)')} AS last_event, {_stamp('max(ts) + INTERVAL 1 DAY')} AS stalled_at,
        count(*) AS changes FROM islands GROUP BY operation_id, island
      HAVING max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""",
    "stream_enforcement_versions": sql(
        "wide products combined",
        f"""SELECT event_id, object_id, 'regular_price' AS field_key, {_money('value')} AS old_value,
          CASE WHEN cost IS NOT NULL THEN {_number_text("round(greatest(value, cost * 1.5::DOUBLE), 6)")} END AS new_value,
          CASE WHEN cost IS NOT NULL THEN 1 ELSE 3 END AS status
        FROM (SELECT event_id, w.object_id, value, CASE WHEN ts >= TIMESTAMP '2024-01-15' AND c.object_id IS NOT NULL THEN 2000 ELSE cost END AS cost
          FROM events JOIN wide w ON w.object_id = user_id + 1 JOIN products p ON p.object_id = w.object_id
          LEFT JOIN combined c ON c.object_id = w.object_id WHERE p.stock_status = 'instock')""",
    ),
}

ORACLES |= {
    "field_summary": sql(
        "changes",
        f"""SELECT operation_id, CASE object_id % 5 WHEN 1 THEN 'meta:_cost' WHEN 2 THEN 'supplier' WHEN 3 THEN NULL ELSE 'regular_price' END AS field,
          count(*) AS targets, {_COUNTS} FROM changes GROUP BY ALL""",
    ),
    "formula_variables": sql(
        "wide", "SELECT object_id, rp AS of_regular_price, sp AS of_sale_price, stock AS of_stock, NULL::DOUBLE AS of_weight, sp AS of_cost FROM wide"
    ),
    "two_fields_of_one_key": sql(
        "meta combined",
        """SELECT m.object_id, meta_key, CASE WHEN meta_key = '_regular_price' AND c.object_id IS NOT NULL THEN '6' ELSE meta_value END AS meta_value
        FROM meta m LEFT JOIN combined c ON c.object_id = m.object_id""",
    ),
    "operation_caps": sql(
        "combined",
        """SELECT cap, CASE WHEN n <= cap THEN 2 * n ELSE 0 END AS logged
        FROM (SELECT count(*) AS n FROM combined), (VALUES (0::BIGINT), (3), (1000000000)) c(cap)""",
    ),
}

ORACLES |= {
    "archived_log_summary": ORACLES["operation_summary"],
    "archived_change_counts": ORACLES["change_counts"],
    "archived_survivors": ORACLES["retention_survivors"],
    "archived_audit_page": sql(
        "changes objects",
        """SELECT l.object_id, action_ix, l.object_type, coalesce(sku, '') AS sku, coalesce(title, '') AS name, field_type, field_key, old_value, new_value,
          CASE l.status WHEN 0 THEN 'pending' WHEN 1 THEN 'applied' WHEN 2 THEN 'failed' ELSE 'skipped' END AS status
        FROM (SELECT * FROM changes WHERE operation_id = 3 ORDER BY object_id LIMIT 50) l LEFT JOIN objects o ON o.object_id = l.object_id""",
    ),
    "ranked_product_page": ORACLES["product_page"].replace("OFFSET 25", "OFFSET 75"),
}
