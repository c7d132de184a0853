from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfwright.functions import formula as fm
from shelfwright.functions import numbers as nb
from shelfwright.functions.recurrence import next_run, start_time
from shelfwright.functions.text import decode_entities, is_user_key
from shelfwright.functions.times import instant
from shelfwright.functions.values import values_equal
from shelfwright.operators.fields import Field, FieldRegistry, UnsupportedField


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def many(spark, columns: dict):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def text(value):
    return F.lit(value).cast("string")


def test_formulas(spark):
    var, n = fm.var, fm.number
    values = {"price": "10", "hundred": "100", "five": "5", "zero": "0", "empty": "", "na": "n/a", "null": None}
    texts = {k: text(v) for k, v in values.items()}
    cases = {
        "precedence": (n(1) + n(2) * 3, 7.0),
        "brackets": ((n(1) + 2) * 3, 9.0),
        "left_division": (n(10) / 2 / 5, 1.0),
        "left_subtraction": (n(8) - 4 - 2, 2.0),
        "negative": (-n(5) + 3, -2.0),
        "double_negative": (3 - -n(2), 5.0),
        "product_of_negatives": (-n(2) * -n(3), 6.0),
        "plus": (+n(4), 4.0),
        "read": (var("price") * 1.2, 12.0),
        "round": (fm.round_(19.6), 20.0),
        "round_half": (fm.round_(2.5), 3.0),
        "round_half_negative": (fm.round_(-2.5), -3.0),
        "ceil": (fm.ceil(19.1), 20.0),
        "floor": (fm.floor(19.9), 19.0),
        "abs": (fm.abs_(n(0) - 7), 7.0),
        "min": (fm.min_(3, 8), 3.0),
        "max": (fm.max_(3, 9, 5), 9.0),
        "roundto": (fm.roundto(var("price") * 1.35, 0.99), 13.86),
        "highest": (fm.max_(var("hundred") * 0.8, var("hundred") * 1.1), 110.0),
        "noise": (n(0.1) + 0.2, 0.3),
        "zero": (var("zero") * 2, 0.0),
        "empty": (var("empty") * 1.2, None),
        "null": (var("null") * 1.2, None),
        "not_a_number": (var("na") * 1.35, None),
        "null_in_call": (fm.max_(var("price"), var("empty")), None),
        "by_zero": (var("price") / 0, None),
        "by_difference": (n(10) / (var("five") - var("five")), None),
        "zero_step": (fm.roundto(var("price"), 0), None),
        "percent": (fm.percent("hundred", -10), 90.0),
    }
    got = many(spark, {k: f.column(texts) for k, (f, _) in cases.items()})
    assert got == {k: v for k, (_, v) in cases.items()}


def test_formula_reads_and_spec():
    f = fm.max_(fm.var("regular_price") * 0.8, fm.var("cost") * 1.1)
    assert sorted(f.variables) == ["cost", "regular_price"]
    assert fm.from_spec(f.spec).spec == f.spec


@pytest.mark.parametrize(
    "spec",
    [["sqrt", 4], ["roundto", 5], ["round", 1, 2], ["min", 5], ["+", 1], ["*", None, 3], "cost", [], ["%", 1, 2]],
)
def test_malformed_specs_are_rejected(spec):
    with pytest.raises((ValueError, TypeError)):
        fm.from_spec(spec)


def test_unknown_variable_is_rejected():
    with pytest.raises(UnsupportedField):
        FieldRegistry().variable("unit_price")


def test_values_equal(spark):
    cases = [
        ("19.90", "19.9", True), ("5", "5.00", True), ("0", "0.0", True), ("10.00", "10", True),
        (" 7", "7 ", True), ("1e2", "100", True), ("19.90", "19.99", False), ("5", "6", False),
        (None, None, True), (None, "", False), ("", None, False), (None, "0", False),
        ("instock", "instock", True), ("Acme", "acme", False), ("", "", True), ("5", "five", False),
        ("instock", "0", False), ("5d", "5", False), ("NaN", "NaN", True), ("Infinity", "1", False),
    ]
    got = many(spark, {f"c{i}": values_equal(text(a), text(b)) for i, (a, b, _) in enumerate(cases)})
    assert [got[f"c{i}"] for i in range(len(cases))] == [c[2] for c in cases]


def test_numeric_reads(spark):
    cases = {"12": 12.0, "-1.5": -1.5, ".5": 0.5, "5.": 5.0, " 3 ": 3.0, "1e3": 1000.0,
             "": None, "abc": None, "5d": None, "5f": None, "NaN": None, "Infinity": None, "1,5": None, "0x1A": None}
    got = many(spark, {f"c{i}": nb.numeric(text(k)) for i, k in enumerate(cases)})
    assert list(got.values()) == list(cases.values())


def test_decimal_prefix(spark):
    cases = {"12.50": 12.5, "12abc": 12.0, "": 0.0, "n/a": 0.0, " 7x": 7.0, "-3": -3.0}
    got = many(spark, {f"c{i}": nb.decimal_prefix(text(k)).cast("double") for i, k in enumerate(cases)})
    assert list(got.values()) == list(cases.values())
    assert one(spark, nb.decimal_prefix(text(None))) is None


def test_number_text(spark):
    cases = [(45.0, "45"), (13.86, "13.86"), (100.0, "100"), (0.0, "0"), (-2.5, "-2.5"), (0.000001, "1.0E-6"),
             (1234567.891234, "1234567.891234"), (123456789.123456, "123456789.12346"), (1e15, "1.0E+15"), (0.1, "0.1")]
    got = many(spark, {f"c{i}": nb.number_text(F.lit(x)) for i, (x, _) in enumerate(cases)})
    assert list(got.values()) == [t for _, t in cases]
    assert [nb.literal_text(x) for x, _ in cases] == [t for _, t in cases]
    assert one(spark, nb.number_text(F.lit(None).cast("double"))) is None


def test_literals():
    assert nb.literal_text(None) is None and nb.literal_text("") == "" and nb.literal_text(5) == "5"
    assert nb.literal_text(True) == "1" and nb.literal_text(False) == ""
    assert nb.literal_text(["a", 1]) == '["a",1]'
    assert nb.literal_int("4.7") == 4 and nb.literal_int(-4.7) == -4 and nb.literal_int("abc") == 0
    assert nb.literal_float("12abc") == 12.0 and nb.literal_float("abc") == 0.0
    assert str(nb.literal_decimal(10)) == "10.0000" and str(nb.literal_decimal(0.00005)) == "0.000050"


def test_next_run(spark):
    def moment(s):
        return datetime.fromisoformat(s)

    noon, long_ago = "2026-08-10 12:00:00", "2026-08-01 09:00:00"
    cases = [
        ("once", noon, noon, None),
        ("hourly", noon, noon, "2026-08-10 13:00:00"),
        ("daily", noon, noon, "2026-08-11 12:00:00"),
        ("weekly", noon, noon, "2026-08-17 12:00:00"),
        ("monthly", noon, noon, "2026-09-10 12:00:00"),
        ("daily", long_ago, noon, "2026-08-11 09:00:00"),
        ("hourly", noon, "2026-08-10 11:00:00", "2026-08-10 13:00:00"),
        ("monthly", "2026-01-31 09:00:00", "2026-01-31 09:00:00", "2026-03-03 09:00:00"),
        ("monthly", "2026-01-31 09:00:00", "2026-04-15 00:00:00", "2026-05-03 09:00:00"),
        ("monthly", "2024-01-31 09:00:00", "2024-02-01 00:00:00", "2024-03-02 09:00:00"),
    ]
    columns = {}
    for i, (kind, start, now, _) in enumerate(cases):
        columns[f"c{i}"] = F.date_format(
            next_run(F.lit(kind), instant(moment(start)), instant(moment(now))), "yyyy-MM-dd HH:mm:ss"
        )
    assert list(many(spark, columns).values()) == [c[3] for c in cases]


def test_start_time(spark):
    now = instant(datetime(2026, 2, 15, 12))
    cases = {"2026-03-01 08:30:00": "2026-03-01 08:30:00", "2026-03-01T08:30:00Z": "2026-03-01 08:30:00",
             "2026-03-01T08:30:00+02:00": "2026-03-01 06:30:00", " 2026-03-01 ": "2026-03-01 00:00:00",
             "": "2026-02-15 12:00:00", "soon": "2026-02-15 12:00:00"}
    got = many(spark, {f"c{i}": F.date_format(start_time(text(k), now), "yyyy-MM-dd HH:mm:ss") for i, k in enumerate(cases)})
    assert list(got.values()) == list(cases.values())


def test_decode_entities(spark):
    cases = {"Home &amp; Kitchen": "Home & Kitchen", "&amp;lt;b&gt;": "&lt;b>", "&quot;&#039;&#39;": "\"''",
             "caf&eacute; &#8364;&#x20AC;": "café €€", "a & b; &nope; &": "a & b; &nope; &",
             "plain": "plain", "": "", "&#128512;": "😀", "&#0; &#xD800;": "&#0; &#xD800;", "&apos;": "&apos;"}
    got = many(spark, {f"c{i}": decode_entities(text(k)) for i, k in enumerate(cases)})
    assert list(got.values()) == list(cases.values())
    assert one(spark, decode_entities(text(None))) is None


def test_user_keys(spark):
    cases = {"_cost": True, "color": True, "_price": False, "_wp_anything": False, "attribute_pa_size": False,
             "_edit_lock": False, "total_sales": False, "_wc_rating": False, "my_price": True}
    got = many(spark, {f"c{i}": is_user_key(text(k)) for i, k in enumerate(cases)})
    assert list(got.values()) == list(cases.values())


def test_field_registry():
    registry = FieldRegistry(cost_meta_key="unit_cost")
    assert registry.handles("regular_price") and registry.handles("meta:anything")
    assert not registry.handles("meta:") and not registry.handles("nonsense")
    assert registry.variable("cost").meta_key == "unit_cost"
    assert registry.variable("stock").column == "stock_quantity"
    assert registry.by_storage("post_field", "sku").key == "sku"
    assert registry.by_storage("meta", "x").key == "meta:x"
    assert registry.by_storage("meta", "") is None and registry.by_storage("term", "x") is None
    with pytest.raises(ValueError):
        registry.register(Field("x", "X", "post_field", "x"))
    registry.register(Field("loud", "Loud", "meta", "loud", meta_key="loud", reader=F.upper))
    assert registry.get("loud").label == "Loud"


def test_old_rules_run_after_now(spark):
    """No number of missed periods is too many."""
    now = datetime(2026, 2, 15, 12)
    rows = [
        (1, "hourly", datetime(2010, 1, 1), datetime(2026, 2, 15, 13)),
        (2, "daily", datetime(1990, 5, 5, 8), datetime(2026, 2, 16, 8)),
        (3, "monthly", datetime(1950, 3, 20, 1), datetime(2026, 2, 20, 1)),
        (4, "monthly", datetime(1970, 1, 31, 9), datetime(2026, 3, 3, 9)),
        (5, "monthly", datetime(2025, 12, 29, 9), datetime(2026, 3, 1, 9)),
        (6, "monthly", datetime(2026, 2, 15, 12), datetime(2026, 3, 15, 12)),
        (7, "monthly", datetime(2030, 1, 30), datetime(2030, 3, 2)),
        (8, "once", datetime(2010, 1, 1), None),
    ]
    frame = spark.createDataFrame(rows, "id int, recurrence string, start timestamp, expected timestamp")
    got = frame.select("id", "expected", next_run(F.col("recurrence"), F.col("start"), F.lit(now)).alias("t")).collect()
    assert [(r.id, r.t) for r in got] == [(r.id, r.expected) for r in got]
