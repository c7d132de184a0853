from __future__ import annotations

import random

import pytest

from shelfwright.operators.fields import FieldRegistry
from shelfwright.operators.filters import Condition, Filter, Operator, filter_from_form
from shelfwright.operators.resolve import count_matches, resolve, resolve_sorted, scan_scope
from shelfwright.schema import Scope
from tests.shop import Shop, ids

CLOTHES, SHOES, RED, BLUE, SMALL, LARGE, SALE = 11, 12, 21, 22, 31, 32, 41


@pytest.fixture(scope="module")
def shop(spark):
    s = Shop(spark)
    for term_id, taxonomy, name in [
        (CLOTHES, "product_cat", "Clothes"), (SHOES, "product_cat", "Shoes"), (RED, "pa_color", "Red"),
        (BLUE, "pa_color", "Blue"), (SMALL, "pa_size", "Small"), (LARGE, "pa_size", "Large"), (SALE, "product_tag", "Sale"),
    ]:
        s.term(term_id, taxonomy, name)
    s.product(1, "10", sku="AB-1", categories=[CLOTHES], links=[("pa_color", RED)], meta={"cost": "4", "brand": "Acme"})
    s.product(2, "50", stock=0, stock_status="outofstock", sku="AB_2", categories=[SHOES], meta={"cost": "", "brand": "acme"})
    s.product(3, "90", stock=None, sku="100%", categories=[CLOTHES, SHOES], links=[("pa_color", BLUE), ("product_tag", SALE)],
              meta={"cost": "n/a", "brand": "Globex"})
    s.product(4, "20.5", status="draft")
    s.product(5, "", sku="PARENT", categories=[CLOTHES], links=[("product_tag", SALE)])  # a variable parent: no price of its own
    s.product(6, None)
    s.variation(51, 5, "10", meta={"attribute_pa_size": "small", "cost": "30.00"})
    s.variation(52, 5, "50", meta={"attribute_pa_size": "large", "cost": "4.00"})
    s.variation(53, 5, "90", meta={"attribute_pa_size": ""})
    return s.catalog()


PRODUCT_CASES = [
    ([], [1, 2, 3]),
    ([("price", ">", 10)], [2, 3]),
    ([("price", ">=", 10)], [1, 2, 3]),
    ([("price", "!=", "50")], [1, 3]),
    ([("price", "between", [10, 50])], [1, 2]),
    ([("price", "between", [10])], [1, 2, 3]),
    ([("price", "in", [10, 90])], [1, 3]),
    ([("price", "not_in", [10, 90])], [2]),
    ([("price", "in", [])], [1, 2, 3]),
    ([("price", "contains", 1)], [1, 2, 3]),
    ([("stock_quantity", "=", 5.9)], [1]),
    ([("stock_quantity", "!=", 7)], [1, 2]),  # unmanaged stock never matches
    ([("stock_quantity", "not_in", [5])], [2]),
    ([("stock_status", "=", "instock")], [1, 3]),
    ([("stock_status", "!=", "instock")], [2]),
    ([("stock_status", ">", "a")], [1, 2, 3]),
    ([("sku", "contains", "B_")], [2]),  # wildcard characters are literal
    ([("sku", "contains", "%")], [3]),
    ([("sku", "in", ["AB-1", "100%"])], [1, 3]),
    ([("sku", "not_in", ["AB-1"])], [2, 3]),
    ([("category", "in", [CLOTHES])], [1, 3]),
    ([("category", "=", CLOTHES)], [1, 3]),  # any other operator acts as membership
    ([("category", "in", [str(SHOES), 0, "x"])], [2, 3]),
    ([("category", "in", [0, "x"])], [1, 2, 3]),
    ([("category", "not_in", [CLOTHES])], [2]),
    ([("category", "in", [RED])], []),
    ([("attribute:pa_color", "exists", None)], [1, 3]),
    ([("attribute:pa_color", "not_exists", None)], [2]),
    ([("attribute:pa_color", "in", [RED])], [1]),
    ([("attribute:", "in", [RED])], [1, 2, 3]),
    ([("tag", "in", [SALE])], [3]),
    ([("tag", "not_exists", None)], [1, 2]),
    ([("meta:brand", "=", "Acme")], [1]),
    ([("meta:brand", "!=", "Acme")], [2, 3]),
    ([("meta:none", "!=", "Acme")], []),
    ([("meta:brand", "contains", "cme")], [1, 2]),
    ([("meta:brand", "in", ["Acme", "Globex"])], [1, 3]),
    ([("meta:brand", "not_in", ["Acme", "Globex"])], [2]),
    ([("meta:cost", ">", 3)], [1]),
    ([("meta:cost", "<", 3)], [2, 3]),  # text without a number compares as 0
    ([("meta:cost", "between", [-1, 4])], [1, 2, 3]),
    ([("meta:cost", "between", [1])], [1, 2, 3]),
    ([("meta:cost", "in", [])], [1, 2, 3]),
    ([("meta:none", "in", [])], []),
    ([("meta:cost", "exists", None)], [1, 2, 3]),
    ([("meta:none", "not_exists", None)], [1, 2, 3]),
    ([("meta:cost", "not_exists", None)], []),
    ([("meta:", "exists", None)], [1, 2, 3]),
    ([("colour", "=", "x")], [1, 2, 3]),  # unknown fields say nothing
    ([("price", ">", 10), ("category", "in", [CLOTHES])], [3]),
]


@pytest.mark.parametrize("conditions, expected", PRODUCT_CASES, ids=lambda v: str(v)[:60])
def test_product_filters(shop, conditions, expected):
    flt = Filter(tuple(Condition(*c) for c in conditions))
    assert ids(resolve(shop, flt)) == expected


VARIATION_CASES = [
    ([], [51, 52, 53]),
    ([("price", "<=", 50)], [51, 52]),
    ([("category", "in", [CLOTHES])], [51, 52, 53]),
    ([("category", "in", [SHOES])], []),
    ([("category", "not_in", [SHOES])], [51, 52, 53]),
    ([("tag", "in", [SALE])], [51, 52, 53]),
    ([("attribute:pa_size", "in", [LARGE])], [52]),
    ([("attribute:pa_size", "not_in", [LARGE])], [51, 53]),
    ([("attribute:pa_size", "exists", None)], [51, 52]),
    ([("attribute:pa_size", "not_exists", None)], [53]),
    ([("attribute:pa_size", "in", [999])], [51, 52, 53]),  # no such term: says nothing
    ([("attribute:pa_size", "in", [LARGE, 999])], [52]),
    ([("meta:cost", ">", 10)], [51]),
]


@pytest.mark.parametrize("conditions, expected", VARIATION_CASES, ids=lambda v: str(v)[:60])
def test_variation_filters(shop, conditions, expected):
    flt = Filter(tuple(Condition(*c) for c in conditions), scope=Scope.VARIATION)
    assert ids(resolve(shop, flt)) == expected


# Conditions above that say nothing, by their position.
VOID = [i for i, (c, _) in enumerate(PRODUCT_CASES) if c and c[0][:2] in (
    ("price", "contains"), ("stock_status", ">"), ("attribute:", "in"), ("meta:", "exists"), ("colour", "="))
    or c in ([("price", "between", [10])], [("price", "in", [])], [("category", "in", [0, "x"])])]
SINGLE = [i for i, (c, _) in enumerate(PRODUCT_CASES) if len(c) == 1]


@pytest.mark.parametrize("seed", range(10))
def test_random_combinations(shop, seed):
    """AND is the intersection and OR the union of what the conditions give alone."""
    chosen = random.Random(seed).sample(SINGLE, 4)
    conditions = tuple(Condition(*PRODUCT_CASES[i][0][0]) for i in chosen)
    telling = [set(PRODUCT_CASES[i][1]) for i in chosen if i not in VOID] or [{1, 2, 3}]
    assert set(ids(resolve(shop, Filter(conditions)))) == set.intersection(*telling)
    assert set(ids(resolve(shop, Filter(conditions, "OR")))) == set.union(*telling)


def test_or_relation(shop):
    tests = (Condition("price", "<", 20), Condition("meta:brand", "=", "Globex"), Condition("colour", "=", 1))
    assert ids(resolve(shop, Filter(tests, "or"))) == [1, 3]
    # A null comparison does not hide another condition that holds.
    tests = (Condition("stock_quantity", ">", 100), Condition("tag", "in", [SALE]))
    assert ids(resolve(shop, Filter(tests, "OR"))) == [3]
    only_void = (Condition("attribute:pa_size", "in", [999]),)
    assert ids(resolve(shop, Filter(only_void, "OR", Scope.VARIATION))) == [51, 52, 53]


def test_required_fields(shop):
    registry = FieldRegistry(cost_meta_key="cost")
    assert ids(resolve(shop, Filter(), [registry.variable("cost")])) == [1, 3]
    assert ids(resolve(shop, Filter(), [registry.variable("stock")])) == [1, 2]
    assert count_matches(shop, Filter(), [registry.variable("cost")]).first()["matched"] == 2


def test_ignore_case(shop):
    flt = Filter((Condition("meta:brand", "=", "ACME"),))
    assert ids(resolve(shop, flt)) == []
    assert ids(resolve(shop, flt, ignore_case=True)) == [1, 2]


def test_sorted_and_scope(shop):
    assert [r["object_id"] for r in resolve_sorted(shop, Filter()).collect()] == [1, 2, 3]
    assert ids(scan_scope(shop, Scope.PRODUCT)) == [1, 2, 3, 5, 6]


def test_filter_round_trip():
    flt = Filter((Condition("price", "between", [1, 2]), Condition("tag", Operator.EXISTS)), "or", "variation")
    assert Filter.from_json(flt.to_json()) == flt
    assert Filter.from_dict({}).scope is Scope.PRODUCT and Filter.from_dict({}).relation == "AND"
    assert Filter.from_dict({"scope": "nonsense", "relation": "xor"}) == Filter()
    with pytest.raises(ValueError):
        Condition("price", "~", 1)
    with pytest.raises(ValueError):
        Condition("", "=", 1)


def test_form():
    flt = filter_from_form("product", 1, 2, "instock", " x ", [1], [2], ["Acme"], "attribute:pa_size", [3])
    assert [c.field for c in flt.conditions] == ["price", "price", "stock_status", "sku", "category", "tag", "meta:_brand"]
    assert flt.conditions[3].value == "x"
    flt = filter_from_form("variation", attribute="attribute:pa_size")
    assert [c.operator for c in flt.conditions] == [Operator.EXISTS]
    assert filter_from_form().conditions == ()


def test_repeated_metadata_rows(spark):
    s = Shop(spark)
    s.product(1, "10")
    s.meta += [(1, "k", "a"), (1, "k", "b"), (1, "k", None)]
    catalog = s.catalog()
    for operator, value, expected in [("=", "b", [1]), ("!=", "a", [1]), ("not_in", ["a", "b"], []), ("exists", None, [1])]:
        assert ids(resolve(catalog, Filter((Condition("meta:k", operator, value),)))) == expected
