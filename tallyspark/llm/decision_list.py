"""Quality rules as a learned decision list, native on Spark.

Text statistics are plain column expressions. The list is learned from labelled
statistics by sequential covering: a rule is a conjunction of thresholds
(`statistic <= x` or `> x`), grown on two thirds of the rows by the largest
information gain and pruned on the rest from its end; covered rows leave, and
the next rule is learned, until none is precise enough. Each step is one grouped
aggregation over all labelled rows: counts of both labels by statistic and bin,
some hundred rows, of which the driver sums prefixes. The list becomes one
ordered CASE expression.

A null text counts as one without words. Rows without label are not learned
from; with no labelled rows or one label only, the list is empty and keeps what
the base rule keeps. Ties between thresholds go to the first in name order.
Repeated rows count each.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_util import checkpointed

#: What parts words: space and 0x09-0x0D.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Statistics that rules are about.
STATISTICS = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "upper_share", "stop_share", "words_a_line", "letter_share", "distinct_share")


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array."""

    def of_windows(h: Column) -> Column:
        def of_places(s: Column) -> Column:
            again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]))
            return _bound(
                F.array_sort(F.transform(again, lambda x: x["i"])),
                lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_places))

    windows = lambda w: F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_bound(words, lambda w: _bound(windows(w), of_windows))).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base counts, STATISTICS) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.filter(F.split(text, GAP), lambda x: x != "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    solid = F.translate("text", " \t\n\x0b\f\r", "")
    counts = rows.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))).alias("lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        (F.length(solid) - F.length(F.translate(solid, "0123456789", ""))).alias("n_digits"),
        (F.length(solid) - F.length(F.translate(solid, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        (F.length(solid) - F.length(F.translate(solid, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_letters"),
        (F.length(solid) - F.length(F.translate(solid, ".!?", ""))).alias("n_stops"),
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return counts.select(
        "id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("lines.again").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.struct(
            F.col("n_words").cast("double").alias("n_words"),
            (F.col("word_chars") / words).alias("word_length"),
            (F.col("n_symbols") / words).alias("symbol_share"),
            (F.col("lines.again") / F.greatest(F.col("lines.n"), F.lit(1))).alias("dup_line_share"),
            (F.col("n_repeat_words") / words).alias("repeat_share"),
            (F.col("n_digits") / chars).alias("digit_share"),
            (F.col("n_upper") / chars).alias("upper_share"),
            (F.col("n_stops") / words).alias("stop_share"),
            (F.col("n_words") / F.greatest(F.col("lines.n"), F.lit(1))).alias("words_a_line"),
            (F.col("n_letters") / chars).alias("letter_share"),
            (F.col("n_distinct") / words).alias("distinct_share"),
        ).alias("x"),
    )


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self, x: str = "x") -> Column:
        c = F.col(f"{x}.{self.statistic}")
        return c > self.threshold if self.above else c <= self.threshold


Rule = list[Condition]


def _covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn(rows: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 4, least_precision: float = 0.9, least_rows: int = 20) -> list[Rule]:
    """Rules for the positive rows of (x: struct of STATISTICS, positive: boolean), in order.

    A rule must be right on least_precision of the rows it covers and cover
    least_rows positive ones. At most `bins` thresholds a statistic.
    """
    cuts = rows.agg(*(F.percentile_approx(f"x.{s}", [(i + 1) / bins for i in range(bins - 1)], 10_000).alias(s) for s in STATISTICS)).first()
    cuts = {s: sorted(set(cuts[s] or [])) for s in STATISTICS}
    grow = (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0).alias("grow")

    def binned(s: str) -> Column:
        return F.aggregate(F.array(*map(F.lit, cuts[s])), F.lit(0), lambda n, c: n + (F.col(f"x.{s}") > c).cast("int")) if cuts[s] else F.lit(0)

    # one row for each distinct combination of bins is all that learning reads again and again
    names = [s for s in STATISTICS if cuts[s]]
    cells = rows.select(grow, "positive", *(binned(s).alias(s) for s in names)).groupBy("grow", *names).agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    cells = checkpointed(cells)
    rules: list[list[tuple[str, bool, int]]] = []

    def inside(rule: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for s, above, b in rule:
            out = out & (F.col(s) > b if above else F.col(s) <= b)
        return out

    def left() -> DataFrame:
        out = cells
        for rule in rules:
            out = out.where(~inside(rule))
        return out

    while len(rules) < max_rules and names:
        rule: list[tuple[str, bool, int]] = []
        here = left().where("grow")
        while len(rule) < max_conditions:
            at = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(s).alias("b")) for s in names))).alias("c")
            table: dict[str, dict[int, tuple[int, int]]] = {s: {} for s in names}
            for r in here.where(inside(rule)).select("pos", "neg", at).groupBy("c.s", "c.b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect():
                table[r["s"]][r["b"]] = (r["pos"], r["neg"])
            pos, neg = (sum(v[i] for v in table[names[0]].values()) for i in (0, 1))
            if not pos or not neg:
                break
            best = (1e-9, None)
            for s in names:
                p = n = 0
                for b in range(len(cuts[s])):
                    p, n = (x + y for x, y in zip((p, n), table[s].get(b, (0, 0)), strict=True))
                    for above, (q, m) in ((False, (p, n)), (True, (pos - p, neg - n))):
                        if q >= least_rows * 2 // 3:
                            gain = q * (log2(q / (q + m)) - log2(pos / (pos + neg)))
                            if gain > best[0]:
                                best = (gain, (s, above, b))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        ends = left().where("not grow").agg(*(x for i in range(1, len(rule) + 1) for x in (F.sum(F.when(inside(rule[:i]), F.col("pos"))).alias(f"p{i}"), F.sum(F.when(inside(rule[:i]), F.col("neg"))).alias(f"n{i}")))).first()
        held = [((ends[f"p{i}"] or 0), (ends[f"n{i}"] or 0), i) for i in range(1, len(rule) + 1)]
        p, n, size = max(held, key=lambda x: ((x[0] - x[1]) / max(x[0] + x[1], 1), -x[2]))
        if p < least_rows // 3 or p < least_precision * (p + n):
            break
        rules.append(rule[:size])
    return [[Condition(s, above, float(cuts[s][b])) for s, above, b in rule] for rule in rules]


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that covers the row, from 1; null where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(_covers(rule), i) if out is None else out.when(_covers(rule), i)
    return F.lit(None).cast("int") if out is None else out


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """(id, counts, base_failed, kept, rule) of every row: kept unless the base rule or a learned rule for label 0 says no."""
    rows = checkpointed(statistics(docs, id_col, text_col).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")))
    labelled = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) == 0).alias("positive"))
    rules = learn(rows.where("not base_failed").join(labelled, "id").select("id", "x", "positive"), **options)
    rule = F.when(~F.col("base_failed"), verdict(rules))
    out = rows.withColumn("rule", rule)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
