"""Keyword scans: passes over a text do not grow with the keywords, and count what one expression per keyword counts."""

import random
import re

from pyspark.sql import functions as F

from inkfold.functions.patterns import presence_passes, scan_passes
from inkfold.functions.text import WORD
from inkfold.operators.classify import classify
from inkfold.rules import CATEGORY_KEYWORDS, PAYWALL_TERMS, RuleSet

KEYWORDS = ("ai", "a", "a b", "a b a", "a a", "b-a", "b", "b-", "-b", "c++", "c", "c++ b", "ab", "aba", "é a", "a_b", "a.b", ".a")


def texts(n=400):
    rng = random.Random(5)
    parts = ["a", "b", "c", "ab", "aba", "ai", "c++", "é", "_", "-", ".", "\n", "ü", "😀", "1", "'", "\\"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_whole_words_are_counted_as_one_expression_each_would(spark):
    rules = RuleSet(categories=tuple((k, (k,)) for k in KEYWORDS) + (("all", KEYWORDS),), subcategories=(), boosts=())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i long, full_text string").withColumn("title", F.lit(""))
    got = classify(df, source=None, rules=rules, whole_word=True)
    one_each = [F.regexp_count(F.lower(F.concat_ws(" ", "title", "title", "full_text")), F.lit(rf"(?<!{WORD})\Q{k}\E(?!{WORD})"))
                .cast("bigint").alias(f"k{n}") for n, k in enumerate(KEYWORDS)]
    found = 0
    for r in got.select("category_scores", *one_each).collect():
        for n, k in enumerate(KEYWORDS):
            assert r["category_scores"][k] == r[f"k{n}"], k
            found += r[f"k{n}"]
        assert r["category_scores"]["all"] == sum(r[f"k{n}"] for n in range(len(KEYWORDS)))
    assert found > 1000


def test_whole_words_take_one_pass_over_the_text(spark):
    df = spark.createDataFrame([("t", "x")], "title string, full_text string")
    p = classify(df, source=None, whole_word=True)._jdf.queryExecution().analyzed().toString()
    assert len([k for words in CATEGORY_KEYWORDS.values() for k in words]) > 100
    assert p.count("regexp_count(") + p.count("regexp_extract_all(") == 1


def test_passes_find_what_one_expression_finds():
    """At every position the longest keyword, by the pass it belongs to; no other pass tells the position again."""
    rng = random.Random(9)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abc -+.") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30))})
        text = "".join(rng.choice("abcd -+.\n") for _ in range(300))
        expect = sorted((i, max((w for w in words if text.startswith(w, i)), key=len, default=None) or "") for i in range(300))
        found = [m for p in scan_passes(tuple(words)) for m in longest(p, text)]
        assert sorted(found) == [x for x in expect if x[1]]


def longest(pattern, text):
    # Python has no look-ahead inside a look-behind of one character that captures; the look is taken from the match
    first, _, rest = pattern.rpartition("(?<=(?=(")
    if not first:
        return [(m.start(), m.group(1)) for m in re.finditer(pattern, text)]
    trie = rest.removesuffix("))(?s:.))")
    return [(m.start(), k.group()) for m in re.finditer(first, text) if (k := re.compile(trie).match(text, m.start()))]


def test_scan_costs_most_positions_one_test():
    passes = scan_passes(tuple(sorted({k for words in CATEGORY_KEYWORDS.values() for k in words})))
    assert 1 < len(passes) < 12 and all(p.startswith("[") for p in passes)


def test_paywall_terms_that_hold_another_one_are_not_looked_for(spark):
    passes = presence_passes(PAYWALL_TERMS)
    assert "remium" in "".join(passes) and "remium\\ " not in "".join(passes)
    rows = [(f"x {t} y",) for t in PAYWALL_TERMS] + [(t[:-1],) for t in ("premium", "paywall", "members only")]
    df = spark.createDataFrame(rows, "t string")
    hits = [any(c) for c in df.select(*[F.col("t").rlike(p) for p in passes]).collect()]
    assert hits == [True] * len(PAYWALL_TERMS) + [False] * 3


def test_issue_articles_hold_each_text_once(spark, tmp_path):
    from inkfold.plans.digest_queries import LISTED, issue_articles, processed_documents

    spark.createDataFrame([(1, "a text", "en", "s"), (2, None, "de", "s")], "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    whole, made = issue_articles(spark, str(tmp_path)), processed_documents(spark, str(tmp_path))
    assert whole.dtypes == made.dtypes and sorted(whole.collect(), key=str) == sorted(made.collect(), key=str)
    assert sorted(spark.read.parquet(*whole.inputFiles()).columns) == sorted(set(made.columns) - {"content"})
    assert spark.read.parquet(*issue_articles(spark, str(tmp_path), *LISTED).inputFiles()).columns == list(LISTED)


def test_damage_by_lines_needs_more_than_twenty_characters(spark):
    from inkfold.functions.text import has_single_char_lines

    rows = [("\n".join(" " * k + "a" for _ in range(n)) + "\n \n" * k,) for n in range(1, 16) for k in (0, 1, 3)] + [(None,), ("",), (" \n" * 40,)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", has_single_char_lines("t").alias("h")).collect():
        t = r["t"]
        lines = [x.strip() for x in (t or "").split("\n") if x.strip()]
        expect = bool(t) and "\n" in t and len(t.strip()) > 20 and len(lines) > 5 and sum(len(x) <= 1 for x in lines) / len(lines) > 0.6
        assert (r["h"] or False) == expect, t
