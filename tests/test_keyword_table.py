"""Rule tables through the automaton against plain counting, whatever their size."""

import random
import time

from pyspark.sql import functions as F

from inkfold.operators.classify import classify
from inkfold.operators.keyword_table import classify_by_table, keyword_scores
from inkfold.rules import rule_rows

RULES = [("B", 1, "saas"), ("A", 0, "ai"), ("A", 0, "aa"), ("B", 1, "AI"), ("C", 2, "é b"), ("C", 2, ""), ("C", 2, None), ("A", 0, "ai")]
TEXTS = ["saasaas aaaaa", "email AI é B", "", None, "nothing", "x" * 50_000 + "ai"]


def plain(text, rules):
    out = {}
    for category, order, keyword in rules:
        if keyword and text and (n := text.lower().count(keyword.lower())):
            out[order, category] = out.get((order, category), 0) + n
    return [(o, c, n) for (o, c), n in sorted(out.items())]


def test_counts_of_overlapping_repeated_and_shared_keywords(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    table = spark.createDataFrame(RULES, "category string, rule_ord int, keyword string")
    for size in (200_000, 3, 1):
        got = {r["id"]: [tuple(s) for s in r["scores"]] for r in keyword_scores(df, table, F.col("text"), block_keywords=size).collect()}
        assert got == {i: plain(t, RULES) for i, t in enumerate(TEXTS)}
    assert {len(r["scores"]) for r in keyword_scores(df, table.limit(0), F.col("text")).collect()} == {0}
    assert keyword_scores(df.limit(0), table, F.col("text")).count() == 0


def test_the_same_as_literal_rules(spark):
    rows = [(i, " ".join(random.Random(i).choices("python gpt startup science ai code law bio x".split(), k=i)), f"on {i}") for i in range(40)]
    df = spark.createDataFrame([*rows, (90, None, None), (91, "", "")], "id long, full_text string, title string")
    columns = ["id", "category", F.round("category_score", 9).alias("s")]
    want = classify(df, source=None).select(columns).collect()
    assert sorted(classify_by_table(df, rule_rows(spark)).select(columns).collect()) == sorted(want)


def test_fifty_thousand_keywords(spark):
    rng = random.Random(5)
    keywords = list({"".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(60_000)})[:50_000]
    rules = [(f"c{i % 20}", i % 20, k) for i, k in enumerate(keywords)]
    table = spark.createDataFrame(rules, "category string, rule_ord int, keyword string")
    texts = ["".join(rng.choices("abcdefgh ", k=300)) for _ in range(20)] + ["".join(rng.choices("abcdefgh ", k=200_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    large = keyword_scores(df, table, F.col("text"))
    begin = time.perf_counter()
    got = {r["id"]: [tuple(s) for s in r["scores"]] for r in large.collect()}
    assert time.perf_counter() - begin < 60
    assert all(got[i] == plain(texts[i], rules) for i in range(20))
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(large) - size(keyword_scores(df, table.limit(5), F.col("text")))) < 50
