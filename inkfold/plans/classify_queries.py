"""Queries over rule classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions.features import article_features
from inkfold.operators.classify import (
    classify, classify_articles, section_match, threshold_category, with_subcategory,
)
from inkfold.operators.keyword_table import classify_by_table, keyword_scores
from inkfold.plans import sql_parts as q
from inkfold.plans.catalog import query
from inkfold.rules import CATEGORY_KEYWORDS, boost_rows, rule_rows, rules_from_tables, subrule_rows
from inkfold.sources.tables import documents_as_articles, table


def articles(spark, sf):
    return documents_as_articles(table(spark, sf, "documents"))


@query("classify", f"""
    WITH {q.ARTICLES}, {q.classified()} SELECT entry_ord, category, round(category_score, 9) AS category_score FROM cls""")
def classify_query(spark, sf):
    return classify(articles(spark, sf)).select(
        "entry_ord", "category", F.round("category_score", 9).alias("category_score")
    )


@query("category_scores", f"""
    WITH {q.ARTICLES}, {q.scored('s', 'art', 'full_text', 'title', None)}
    SELECT entry_ord, unnest({q.CATEGORY_LIST}) AS category, unnest(scores) AS score FROM s""")
def category_scores_query(spark, sf):
    """Rules read from tables give the same scores as the built-in ones."""
    rules = rules_from_tables(rule_rows(spark), subrule_rows(spark), boost_rows(spark))
    scored = classify(articles(spark, sf), source=None, rules=rules)
    return scored.select("entry_ord", F.explode_outer("category_scores").alias("category", "score"))


@query("classify_by_table", f"""
    WITH {q.ARTICLES}, {q.classified(source=None)} SELECT entry_ord, category, round(category_score, 9) AS category_score FROM cls""")
def classify_by_table_query(spark, sf):
    """The built-in rules as a table for the automaton."""
    return classify_by_table(articles(spark, sf), rule_rows(spark)).select(
        "entry_ord", "category", F.round("category_score", 9).alias("category_score"))


@query("keyword_table_scores", """
    WITH k AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM benchmark),
    r AS (SELECT keyword, length(keyword) AS rule_ord FROM k WHERE length(keyword) >= 3),
    d AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT doc_id, 'letters ' || rule_ord AS category,
           sum((length(t) - length(replace(t, keyword, ''))) // length(keyword))::BIGINT AS score
    FROM d JOIN r ON contains(t, keyword) GROUP BY doc_id, rule_ord""")
def keyword_table_scores(spark, sf):
    """Every word of the benchmark as a keyword, its length as its category."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")).distinct()
    rules = words.filter(F.length("keyword") >= 3).select(
        F.concat(F.lit("letters "), F.length("keyword").cast("string")).alias("category"),
        F.length("keyword").alias("rule_ord"), "keyword")
    scored = keyword_scores(table(spark, sf, "documents"), rules, F.col("text"))
    return scored.select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.category", "s.score")


@query("source_boost", f"""
    WITH {q.ARTICLES}, {q.classified(source='title')}
    SELECT entry_ord, category, round(category_score, 9) AS category_score FROM cls""")
def source_boost(spark, sf):
    """The title stands in for the source, so that boost terms occur."""
    return classify(articles(spark, sf), source="title").select(
        "entry_ord", "category", F.round("category_score", 9).alias("category_score")
    )


def _whole_word_sum(words: list[str]) -> str:
    def doubled(k: str) -> str:
        return "".join(c if c.isalnum() or c == "_" else c + c for c in k)

    def quoted(k: str) -> str:
        return "".join(c if c.isalnum() or c in " _/-" else "\\" + c for c in k)

    return " + ".join(
        f"len(regexp_extract_all(twice, '(?:^|{q.NW}){quoted(doubled(k))}(?:{q.NW}|$)'))" for k in words
    )


@query("classify_whole_words", f"""
    WITH {q.ARTICLES},
    t AS (SELECT entry_ord, regexp_replace(lower(title || ' ' || title || ' ' || full_text), '({q.NW})', '\\1\\1', 'g') AS twice FROM art)
    SELECT entry_ord, {', '.join(f'CAST({_whole_word_sum(w)} AS BIGINT) AS {c.lower().replace(" ", "_")}'
                                  for c, w in CATEGORY_KEYWORDS.items())} FROM t""")
def classify_whole_words(spark, sf):
    c = classify(articles(spark, sf), source=None, whole_word=True)
    return c.select("entry_ord", *[
        F.col("category_scores")[name].alias(name.lower().replace(" ", "_")) for name in CATEGORY_KEYWORDS
    ])


@query("subcategory", f"""
    WITH {q.ARTICLES}, {q.classified()} SELECT entry_ord, category, subcategory FROM cls""")
def subcategory(spark, sf):
    return classify_articles(articles(spark, sf)).select("entry_ord", "category", "subcategory")


@query("subcategory_of_given_category", f"""
    WITH {q.ARTICLES}, given AS (SELECT *, unnest(['AI', 'Programming', 'Tech News', 'Science']) AS category FROM art),
    {q.classified('given').split(', main_cat AS')[0].replace('scored_rows', 'unused_rows').replace('picked', 'unused')},
    main_cat AS (SELECT *, lower(full_text) AS body_low FROM given),
    {q.classified().split('FROM picked), ')[1]} SELECT entry_ord, category, subcategory FROM cls""")
def subcategory_of_given_category(spark, sf):
    cats = F.array(*[F.lit(c) for c in ("AI", "Programming", "Tech News", "Science")])
    given = articles(spark, sf).withColumn("category", F.explode(cats))
    return with_subcategory(given).select("entry_ord", "category", "subcategory")


@query("threshold_category", f"""
    WITH {q.ARTICLES}, {q.scored('s', 'art', 'full_text', 'title', None)},
    m AS (SELECT entry_ord, scores, list_max(scores) AS best, list_sum(scores) AS total FROM s)
    SELECT entry_ord, CASE WHEN total > 0 AND best / total >= 0.7 THEN {q.CATEGORY_LIST}[list_position(scores, best)]
                           ELSE 'Unclassified' END AS category FROM m""")
def threshold(spark, sf):
    scored = classify(articles(spark, sf), source=None)
    total = F.aggregate(F.map_values("category_scores"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    shares = scored.withColumn("_total", total).withColumn(
        "_shares", F.transform_values("category_scores", lambda k, v: F.try_divide(v, F.col("_total")))
    )
    return shares.select("entry_ord", threshold_category("_shares").alias("category"))


_SEC = {n: f"{s}" for n, s in q.section_scores("lower(full_text)").items()}


@query("section_match", f"""
    WITH {q.ARTICLES}, s AS (SELECT entry_ord, length(content) AS n_chars, {q.occurrences('content', '"')} AS quotes,
        greatest(1, {q.word_count('content')} // 200) AS minutes,
        {_SEC['Essays of the Week']} AS essays, {_SEC['News of the Week']} AS news, {_SEC['Startup of the Week']} AS startup FROM art)
    SELECT entry_ord, essays, news, startup, concat_ws('|',
        CASE WHEN essays > 0 AND n_chars >= 1000 AND quotes >= 1 AND minutes >= 5 THEN 'Essays of the Week' END,
        CASE WHEN news > 0 AND minutes <= 5 THEN 'News of the Week' END,
        CASE WHEN startup > 0 AND n_chars >= 500 AND quotes >= 1 AND minutes >= 3 THEN 'Startup of the Week' END) AS sections FROM s""")
def section_match_query(spark, sf):
    a = articles(spark, sf)
    a = section_match(a.withColumn("features", article_features("content", "content", "url")))
    score = F.col("section_scores")
    return a.select(
        "entry_ord", score["Essays of the Week"].alias("essays"), score["News of the Week"].alias("news"),
        score["Startup of the Week"].alias("startup"), F.array_join("sections", "|").alias("sections"),
    )
