"""Risk-controlled quality rules, in DataFrame functions only.

A rule rejects a document whose defect (an integer, larger is worse) lies over a cutoff. Labelled
documents fix the cutoffs, one per stratum and rule. The number k of good documents that a rule may
reject in a stratum is the largest for which the exact binomial test still refutes "the rule rejects a
share ``risk`` or more of good documents" at level ``delta / m``, with m the number of strata times rules
(Bonferroni). The rejected sets of one rule are nested, so every cutoff over the (k+1)-th worst good document
is safe at once, and the one that catches most bad documents for the fewest good ones may be chosen freely.
With probability ``1 - delta`` every rule then rejects less than ``risk`` of the good documents of its
stratum. Too few labels, or no gain, and there is no rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwright.llm.common import snapshot, split_words

#: Words of a window whose repetition counts.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Defects per ten thousand words, lines or characters.
RULES = ("symbol_share", "dup_line_share", "repeat_share")


@dataclass(frozen=True)
class Risk:
    """``risk``: share of good documents that a rule may reject in a stratum. ``delta``: chance that any rule
    does worse. ``price``: by how much more of the bad documents a rule must catch than of the good."""

    risk: float = 0.01
    delta: float = 0.05
    price: float = 5.0


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more; ``hashes`` holds a hash per window start."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    return F.aggregate(
        F.get(F.transform(F.array(ordered), starts), F.lit(0)),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and, per row, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines,
    n_repeat_words (all long). A null text has no words; one row gives one row, whatever its id."""
    blanked = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(blanked, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def paired(runs: str, step: int) -> Column:
        """Hashes of runs twice as long, each from two runs ``step`` words apart."""
        return F.transform(runs, lambda x, i: F.xxhash64(x, F.get(F.col(runs), i + step)))

    # Every level is a projection of its own, for it is read twice by the next one.
    staged = (
        docs.select(*[F.col(c) for c in keep], blanked.alias("_text"), split_words(F.col(text)).alias("_words"), lines.alias("_lines"))
        .withColumn("_h", paired("_words", 1))
        .withColumn("_h", paired("_h", 2))
        .withColumn("_h", paired("_h", 4))
        .withColumn("_h", F.slice("_h", 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))))
    )
    return staged.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("long")).otherwise(_covered(F.col("_h"))).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def defects() -> dict[str, Column]:
    share = lambda n, of: F.when(F.col(of) > 0, F.floor(10000 * F.col(n) / F.col(of))).otherwise(0).cast("int")
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def allowed(n: Column, risk: float, level: Column) -> Column:
    """The largest k with P(X <= k) <= level for X binomial in n trials of chance ``risk``; -1 if none.

    The sum stops at the mean, which no k of a level under one half passes. Terms are kept as logarithms,
    for (1 - risk)^n underflows."""
    odds = math.log(risk) - math.log1p(-risk)
    state = F.struct((n * math.log1p(-risk)).alias("term"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        cdf = acc["cdf"] + F.exp(acc["term"])
        return F.struct(
            (acc["term"] + F.log((n - i) / (i + 1.0)) + odds).alias("term"),
            cdf.alias("cdf"),
            F.when(cdf <= level, i.cast("long")).otherwise(acc["k"]).alias("k"),
        )

    upto = F.least(F.ceil(n * risk), n - 1).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(upto, F.lit(0))), state, step, lambda acc: acc["k"])).otherwise(F.lit(-1).cast("long"))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, setting: Risk = Risk(), key: str = "doc_id") -> DataFrame:
    """One row per stratum: ``stratum`` and a cutoff per rule (int, null: the rule rejects nothing there).

    measured: ``key``, ``stratum`` and the rules. labels: ``key`` and quality (1 good, 0 bad). A document with
    several labels is good if all are; null ids and labels count for nothing. A null stratum is one of its own.
    Every histogram has at most 10,001 bins, so a stratum that holds most documents is a few rows per task."""
    verdicts = (
        labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull())
        .groupBy(key)
        .agg(F.min("quality").alias("_good"))
    )
    bins = (
        measured.join(verdicts, key)
        .select(F.col(stratum).alias("_s"), "_good", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("defect")) for r in RULES])))
        .groupBy("_s", "rule", "defect")
        .agg(F.sum((F.col("_good") == 1).cast("long")).alias("good"), F.sum((F.col("_good") != 1).cast("long")).alias("bad"))
    )
    group = Window.partitionBy("_s", "rule")
    over = group.orderBy(F.desc("defect")).rowsBetween(Window.unboundedPreceding, -1)
    counted = bins.select(
        "*",
        F.coalesce(F.sum("good").over(over), F.lit(0)).alias("good_over"),
        F.coalesce(F.sum("bad").over(over), F.lit(0)).alias("bad_over"),
        F.sum("good").over(group).alias("n_good"),
        F.sum("bad").over(group).alias("n_bad"),
    )
    tested = bins.select("_s").distinct().agg((F.count("*") * len(RULES)).alias("tests"))
    limits = (
        counted.groupBy("_s", "rule").agg(F.first("n_good").alias("_n")).crossJoin(F.broadcast(tested))  # one row
        .select("_s", "rule", allowed(F.col("_n"), setting.risk, F.lit(setting.delta) / F.col("tests")).alias("k"))
        .withColumnsRenamed({"_s": "_s2", "rule": "rule2"})
    )
    gain = F.col("bad_over") / F.greatest(F.col("n_bad"), F.lit(1)) - setting.price * F.col("good_over") / F.greatest(F.col("n_good"), F.lit(1))
    chosen = (
        counted.join(limits, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("rule") == F.col("rule2")))
        .filter((F.col("good_over") <= F.col("k")) & (gain > 0))
        .groupBy("_s", "rule")
        .agg(F.max(F.struct(F.round(gain, 9).alias("gain"), F.col("defect"))).alias("best"))
    )
    return chosen.groupBy(F.col("_s").alias(stratum)).agg(
        *[F.max(F.when(F.col("rule") == r, F.col("best.defect"))).alias(r) for r in RULES]
    )


def rate(docs: DataFrame, labels: DataFrame, keep: list[str], stratum: str = "lang", setting: Risk = Risk()) -> DataFrame:
    """``keep``, the features, base_failed and kept (false if a base rule or a risk-controlled rule rejects).

    ``keep`` must hold doc_id and the stratum. Documents of a null stratum, without labels, or empty are rated
    like all others; no row is lost or doubled. An empty table gives an empty one."""
    rated = snapshot(features(docs, keep).withColumns(defects()), "features")  # read twice, measured once
    limits = cutoffs(rated.select("doc_id", stratum, *RULES), labels, stratum, setting)
    # As many rows as strata. Written, so that their size is known: while it is small they go to every task, and no row is shuffled.
    limits = snapshot(limits.withColumnsRenamed({r: f"_cut_{r}" for r in RULES} | {stratum: "_stratum"}), "limits")
    over = [F.coalesce(F.col(r) > F.col(f"_cut_{r}"), F.lit(False)) for r in RULES]
    return (
        rated.join(limits, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~(F.col("base_failed") | over[0] | over[1] | over[2]))
        .drop("_stratum", *[f"_cut_{r}" for r in RULES], *RULES)
    )
