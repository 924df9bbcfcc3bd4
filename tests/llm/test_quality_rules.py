import re
from collections import Counter

from pyspark.sql import functions as F

from clipledger.llm import quality_rules as Q

from . import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def check(df, rows):
    out, rules = Q.judged(df, rows[1])
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = Counter()
    for doc_id, text in rows[0]:
        b = brute(text)
        want[(doc_id, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == want
    return out, rules


def test_tables(spark, small):
    """Counts as by a loop; on held-out labels few errors, and next to no good document rejected."""
    df, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0)
    out, rules = check(df, ([tuple(r) for r in df.select("doc_id", "text").collect()], train))
    assert rules
    held = out.join(labels.join(train, "doc_id", "left_anti"), "doc_id").where("NOT base_failed")
    right, wrong, n = held.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.sum((~F.col("kept") & (F.col("quality") == 1)).cast("int")), F.count("*")).first()
    assert right >= 0.9 * n and wrong <= 0.05 * n


def test_odd_rows(spark):
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    df = odd.frame(spark)
    out, rules = check(df, ([(r[0], r[1]) for r in odd.rows() if r[0] is not None], none))
    assert rules == [] and out.where("kept = base_failed").isEmpty()
    kept = Q.kept_documents(df.withColumn("n_words", F.lit(1)).withColumn("stats", F.lit(2)), none)
    assert kept.columns == [*df.columns[:5], *odd.EXTRA, "n_words", "stats"]
    assert kept.count() == sum(not (brute(r[1])[0] < 50 or 2 * brute(r[1])[4] > brute(r[1])[0]) for r in odd.rows())
    assert Q.judged(odd.empty(spark), none)[0].count() == 0
    only_good = spark.createDataFrame([(14, 1, 0), (14, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.judged(df, only_good)[1] == []


def test_rules_find_planted_thresholds(spark):
    rows = spark.range(4000).selectExpr(
        "id + 100 AS n_words", "(id + 100) * 5 AS word_chars", "CASE WHEN id % 10 = 0 THEN (id + 100) * 2 ELSE id % 3 END AS n_symbols",
        "0L AS n_dup_lines", "0L AS n_repeat_words", "1L AS n_lines", "id + 100 AS n_distinct_words",
        "CASE WHEN id % 7 = 0 THEN (id + 100) * 4 ELSE 0 END AS n_upper", "0L AS n_marks", "id % 10 = 0 OR id % 7 = 0 AS bad",
    )
    rules = Q.learn(rows, "bad")
    assert {r.conditions[0][0] for r in rules} == {"symbols", "upper"}
    assert rows.where(F.col("bad") == Q.verdict(rules)).count() < 0.03 * 4000
