"""Quality rules as a learned decision list: text statistics in, ordered Spark conditions out.

Sequential covering: a rule is grown on two thirds of the labelled rows by adding the threshold with
the highest gain, pruned on the last third, and, if it is precise enough there, emitted; the rows it
covers go, and the next rule is grown from the rest. All counts are Spark aggregates over all labelled
rows; the driver sees one count for each statistic, bin and label. Everything runs in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import NOT_WORD, keyed, written

SYMBOLS, UPPER, MARKS = "[^#*$%&|<>]+", "[^A-Z]+", "[^!?]+"
#: Columns the statistics have, and the ratios that rules are made of.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_marks")
FEATURES = {
    "words": "{0}n_words", "word_length": "{0}word_chars / greatest({0}n_words, 1)",
    "symbols": "{0}n_symbols / greatest({0}n_words, 1)", "dup_lines": "{0}n_dup_lines / greatest({0}n_lines, 1)",
    "repeats": "{0}n_repeat_words / greatest({0}n_words, 1)", "distinct": "{0}n_distinct_words / greatest({0}n_words, 1)",
    "upper": "{0}n_upper / greatest({0}word_chars, 1)", "marks": "{0}n_marks / greatest({0}n_words, 1)",
}
BASE_FAILED = "{0}n_words < 50 OR 100 * {0}n_repeat_words > 50 * {0}n_words"


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, by 64-bit hashes of the windows."""
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def covered(g: Column) -> Column:
        again = F.filter(g, lambda x, i: (F.get(g, i - 1)["h"] == x["h"]) | (F.get(g, i + 1)["h"] == x["h"]))
        first = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"))
        return F.aggregate(F.sort_array(F.transform(again, lambda x: x["i"])), first, step, lambda a: a["n"])

    return F.get(F.transform(F.array(F.sort_array(windows)), covered), F.lit(0))


def statistics(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """All rows and columns, and a struct of counts; a null text counts as empty.

    Words are bound once, inside a generator, so that no filter on the counts computes them again.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def count(words: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
        found = {
            "n_words": F.size(words), "word_chars": F.aggregate(words, F.lit(0), lambda a, x: a + F.length(x)),
            "n_symbols": F.length(F.regexp_replace(whole, SYMBOLS, "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": _repeat_words(words),
            "n_lines": F.size(lines), "n_distinct_words": F.size(F.array_distinct(words)),
            "n_upper": F.length(F.regexp_replace(whole, UPPER, "")), "n_marks": F.length(F.regexp_replace(whole, MARKS, "")),
        }
        return F.struct(*(found[c].cast("long").alias(c) for c in COUNTS))

    words = F.filter(F.split(whole, NOT_WORD), lambda x: x != "")
    return docs.select("*", F.explode(F.transform(F.array(words), count)).alias(into))


@dataclass(frozen=True)
class Rule:
    """Rejects rows that meet all conditions (feature, "<=" or ">", threshold)."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    precision: float

    def sql(self, counts: str = "") -> str:
        return " AND ".join(f"({FEATURES[f].format(counts)}) {op} {t!r}D" for f, op, t in self.conditions)


def verdict(rules: list[Rule], counts: str = "") -> Column:
    """Whether to keep a row, as one ordered condition: the base rule, then each learned one, rejects; else it is kept.

    counts: what stands before the names of the counts, such as "stats.".
    """
    out = F.when(F.expr(BASE_FAILED.format(counts)), False)
    return reduce(lambda done, r: done.when(F.expr(r.sql(counts)), False), rules, out).otherwise(True)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """How many bits the covered bad rows save against the rule so far."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _passed(feature: str, cuts: list[float]) -> Column:
    """How many cuts the value is above: its bin."""
    return F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda a, t: a + (F.col(feature) > t).cast("int"))


def learn(
    rows: DataFrame, bad: str, bins: int = 64, max_rules: int = 10, max_conditions: int = 3,
    precision: float = 0.95, support: float = 0.002,
) -> list[Rule]:
    """Rules from labelled rows: the columns COUNTS and a boolean column `bad` (null: no label).

    A rule must reach `precision` on rows it was not grown on and cover `support` of the bad rows.
    No labelled bad rows, or none that a rule can tell apart: an empty list, which keeps everything.
    """
    values = rows.where(f"{bad} IS NOT NULL AND n_words > 0").select(
        F.col(bad).alias("bad"), (F.pmod(F.xxhash64(*COUNTS), F.lit(3)) == 0).alias("prune"),
        *(F.expr(e.format("")).cast("double").alias(f) for f, e in FEATURES.items()),
    )
    values = written(values, "rule-values")
    # cuts of all rows and of bad rows alike, as bad ones may be few
    shares = [k / bins for k in range(bins)]
    cut = values.agg(*(F.percentile_approx(c, shares, 2_000).alias(f"{f}{k}") for f in FEATURES for k, c in enumerate((F.col(f), F.when(F.col("bad"), F.col(f)))))).first()
    cuts = {f: sorted({x for k in (0, 1) for x in cut[f"{f}{k}"] or []}) for f in FEATURES}
    if values.where("bad").isEmpty():
        return []
    binned = values.select(
        "bad", "prune",
        *(_passed(f, cuts[f]).alias(f) for f in FEATURES),
    )
    todo = written(binned.groupBy(*binned.columns).agg(F.count("*").alias("rows")), "rule-bins")
    total = todo.where("bad AND NOT prune").agg(F.sum("rows")).first()[0] or 0
    rules: list[Rule] = []
    # in bins: "<= cut k" is bin <= k, "> cut k" is bin > k
    held = lambda conditions: " AND ".join(f"{f} {op} {k}" for f, op, k in conditions) or "true"
    stack = "stack({}, {}) AS (f, bin)".format(len(FEATURES), ", ".join(f"'{f}', {f}" for f in FEATURES))
    while len(rules) < max_rules:
        conditions: list[tuple[str, str, int]] = []
        while len(conditions) < max_conditions:
            seen = todo.where("NOT prune").where(held(conditions)).select("bad", "rows", F.expr(stack))
            counts: dict[str, dict[int, list[int]]] = {f: {} for f in FEATURES}
            for f, k, is_bad, n in seen.groupBy("f", "bin", "bad").agg(F.sum("rows")).collect():
                counts[f].setdefault(k, [0, 0])[not is_bad] += n
            p0, n0 = (sum(x[i] for x in counts["words"].values()) for i in (0, 1))
            best = (0.0, None)
            for f, by_bin in counts.items():
                p = n = 0
                for k in sorted(by_bin)[:-1]:
                    p, n = p + by_bin[k][0], n + by_bin[k][1]
                    best = max(best, (_gain(p, n, p0, n0), (f, "<=", k)), (_gain(p0 - p, n0 - n, p0, n0), (f, ">", k)), key=lambda x: x[0])
            if best[1] is None or not p0:
                break
            conditions.append(best[1])
            if not n0:
                break
        if not conditions:
            break
        # prune: the shortest start of the rule that is best on the rows it was not grown on
        starts = [conditions[: k + 1] for k in range(len(conditions))]
        sums = [F.sum(F.when(F.expr(held(c)) & (F.col("bad") == b), F.col("rows"))).alias(f"{k}{b}") for k, c in enumerate(starts) for b in (True, False)]
        unseen = todo.where("prune").agg(*sums).first()
        worth = [((unseen[f"{k}True"] or 0), (unseen[f"{k}False"] or 0)) for k in range(len(starts))]
        k = max(range(len(starts)), key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), -k))
        p, n = worth[k]
        conditions = starts[k]
        if p < max(1.0, support * total / 2) or p < precision * (p + n):
            break
        rules.append(Rule(tuple((f, op, float(cuts[f][j])) for f, op, j in conditions), p + n, p / (p + n)))
        todo = todo.where(f"NOT ({held(conditions)})")
    return rules


def judged(docs: DataFrame, labels: DataFrame, good: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """doc_id, the counts, base_failed and kept for every document with an id, and the rules.

    Labels (doc_id, `good`: 0 or 1) may miss documents; of several labels of a document the lowest
    counts, null labels and ids do not. A repeated row is judged as often as it occurs.
    """
    counted = written(statistics(keyed(docs, "doc_id", text="text")).select("doc_id", "stats.*"), "rule-statistics")
    marks = keyed(labels, "doc_id", mark=good).where("mark IS NOT NULL").groupBy("doc_id").agg(F.min("mark").alias("mark"))
    failed = F.expr(BASE_FAILED.format(""))
    rules = learn(counted.where(~failed).join(marks, "doc_id").withColumn("bad", F.col("mark") == 0), "bad")
    return counted.select("*", failed.alias("base_failed"), verdict(rules).alias("kept")), rules


def kept_documents(docs: DataFrame, labels: DataFrame, good: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, that neither the base rule nor the learned list rejects."""
    _, rules = judged(docs, labels, good)
    own = "stats"
    while own in docs.columns:
        own += "_"
    return statistics(docs, into=own).where(verdict(rules, f"{own}.")).drop(own)
