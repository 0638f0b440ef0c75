"""Digests as rows. Sorting the rows of an (issue, kind) by ``DIGEST_ORDER`` gives the document.

No group is ever gathered: headings and counts are small aggregates, every article is one row, and
the sink sorts by range. A row's ``line`` may span several lines; the document is its rows joined by
line breaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.blocks import (
    block_basic, block_issue, block_snippet, reading_item, title_link,
)
from inkfold.functions.text import blank_if_null, first_non_empty, format_issue_date, slug, truncate_words
from inkfold.operators.enrich import local_body
from inkfold.operators.extract import extract_paragraphs
from inkfold.operators.numbering import position
from inkfold.operators.summary import category_counts, paywalled_count
from inkfold.schemas import DIGEST_ORDER

TITLE = "Weekly Digest"
BEFORE = -1


def _rows(df: DataFrame, kind: str, line: Column, part: int, **order: Column | str | int) -> DataFrame:
    defaults: dict[str, Column] = {
        "issue": F.col("issue"), "kind": F.lit(kind), "part": F.lit(part),
        "section_ord": F.lit(0), "section": F.lit(""), "sub_ord": F.lit(0), "subsection": F.lit(""),
        "feed_ord": F.lit(BEFORE), "entry_ord": F.lit(BEFORE), "line_ord": F.lit(0),
    }
    for name, value in order.items():
        defaults[name] = F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)
    types = {"issue": "string", "kind": "string", "section": "string", "subsection": "string"}
    return df.select(
        *[defaults[c].cast(types.get(c, "bigint")).alias(c) for c in DIGEST_ORDER], line.alias("line")
    )


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _with_category(articles: DataFrame) -> DataFrame:
    """An article without category counts as ``Unclassified``; ``issue`` is always set."""
    return articles.withColumn("category", F.coalesce("category", F.lit("Unclassified")))


def _issues(articles: DataFrame) -> DataFrame:
    return articles.select("issue").distinct()


def _generated() -> Column:
    return F.concat(F.lit("Generated on "), format_issue_date("issue"))


def _article_order() -> dict[str, str]:
    return {"feed_ord": "feed_ord", "entry_ord": "entry_ord"}


def _count_line() -> Column:
    return F.concat(F.lit("- "), F.col("category"), F.lit(": "), F.col("articles").cast("string"), F.lit(" articles"))


def _heading(level: int, text: Column) -> Column:
    return F.concat(F.lit("#" * level + " "), text)


def _subgroups(articles: DataFrame) -> DataFrame:
    """Per (issue, category, subcategory): counts and order; blank subcategories have ``is_other``."""
    groups = (
        articles.groupBy("issue", "category", "subcategory")
        .agg(F.count("*").alias("articles"), F.min(F.struct("feed_ord", "entry_ord")).alias("first"))
        .withColumn("is_other", F.col("subcategory") == "")
    )
    named = Window.partitionBy("issue", "category")
    return groups.withColumns(
        {
            "n_subs": F.count_if(~F.col("is_other")).over(named),
            "seen_rank": F.row_number().over(named.orderBy("is_other", "first")),
            "name_rank": F.row_number().over(named.orderBy("is_other", "subcategory")),
        }
    )


def newsletter(articles: DataFrame, title: str = TITLE, body: Column | None = None) -> DataFrame:
    """Counts per category, then the blocks of every category A to Z.

    ``body`` is the block; by default ``processed_content``, or the basic block where that is empty.
    """
    kind = "newsletter"
    articles = _with_category(articles)
    block = body if body is not None else F.coalesce(first_non_empty("processed_content"), block_basic(local_body()))
    counts = category_counts(articles, "issue")
    head = F.concat(F.lit(f"# {title}\n\n"), _generated(), F.lit("\n\n## In This Issue\n"))
    return _union(
        _rows(_issues(articles), kind, head, 0),
        _rows(counts, kind, _count_line(), 1, section="category"),
        _rows(_issues(articles), kind, F.lit("\n---\n"), 2),
        _rows(counts, kind, F.concat(_heading(2, F.col("category")), F.lit("\n")), 3, section="category"),
        _rows(articles, kind, F.concat(block, F.lit("\n---\n")), 3, section="category", **_article_order()),
    )


def sectioned_newsletter(articles: DataFrame, title: str = TITLE, limit: int = 1500) -> DataFrame:
    """Newsletter with a section per subcategory in first-seen order and ``Other`` last."""
    kind = "newsletter_sections"
    a = _with_category(articles).withColumn("subcategory", blank_if_null("subcategory"))
    groups = _subgroups(a)
    counts = groups.groupBy("issue", "category").agg(F.sum("articles").alias("articles"))
    head = F.concat(F.lit(f"# {title}\n"), _generated(), F.lit("\n\n## In This Issue"))
    sub_name = F.when(F.col("is_other"), "Other").otherwise(F.col("subcategory"))
    placed = a.join(
        groups.select("issue", "category", "subcategory", "seen_rank"), ["issue", "category", "subcategory"]
    ).withColumn("_text", first_non_empty("content", "full_text"))
    placed = extract_paragraphs(placed, "_text", limit, "_extract")
    return _union(
        _rows(_issues(a), kind, head, 0),
        _rows(counts, kind, _count_line(), 1, section="category"),
        _rows(_issues(a), kind, F.lit("---\n"), 2),
        _rows(counts, kind, _heading(2, F.col("category")), 3, section="category"),
        _rows(groups.filter("n_subs > 0"), kind, _heading(3, sub_name), 3, section="category", sub_ord="seen_rank"),
        _rows(placed, kind, F.concat(block_issue(F.col("_extract")), F.lit("\n---\n")), 3,
              section="category", sub_ord="seen_rank", **_article_order()),
    )


def reading_list(articles: DataFrame, title: str = TITLE) -> DataFrame:
    """Links by category."""
    kind = "reading_list"
    articles = _with_category(articles)
    cats = articles.select("issue", "category").distinct()
    head = F.concat(F.lit(f"# {title} - Reading List\n\n"), _generated(), F.lit("\n"))
    return _union(
        _rows(_issues(articles), kind, head, 0),
        _rows(cats, kind, F.concat(_heading(2, F.col("category")), F.lit("\n")), 1, section="category"),
        _rows(articles, kind, reading_item(), 1, section="category", sub_ord=1, **_article_order()),
        _rows(cats, kind, F.lit(""), 1, section="category", sub_ord=2),
    )


def marked_reading_list(articles: DataFrame, title: str = TITLE) -> DataFrame:
    """Reading list with paywall note and locks; headings only when there is more than one category."""
    kind = "reading_list_marked"
    articles = _with_category(articles)
    cats = articles.select("issue", "category").distinct()
    several = cats.groupBy("issue").agg((F.count("*") > 1).alias("several"))
    cats = cats.join(several, "issue").filter("several")
    notes = paywalled_count(articles, "issue")
    head = F.concat(
        F.lit(f"# {title} - Reading List\n\n"), _generated(), F.lit("\n"),
        F.coalesce(F.concat(F.lit("\n"), F.col("note"), F.lit("\n")), F.lit("")),
    )
    # With a single category the section is one value, so arrival order is kept either way.
    return _union(
        _rows(notes, kind, head, 0),
        _rows(cats, kind, _heading(2, F.col("category")), 1, section="category"),
        _rows(articles, kind, reading_item(marked=True), 1, section="category", sub_ord=1, **_article_order()),
        _rows(cats, kind, F.lit(""), 1, section="category", sub_ord=2),
    )


def snippets(articles: DataFrame, title: str = TITLE, limit: int = 500) -> DataFrame:
    """Extended reading list: categories A to Z, ``Uncategorized`` last, word-limited bodies."""
    kind = "snippets"
    name = F.coalesce(first_non_empty("category"), F.lit("Uncategorized"))
    a = articles.withColumn("category", name)
    last = (F.col("category") == "Uncategorized").cast("bigint")
    a = a.withColumn("_text", first_non_empty("content", "full_text"))
    a = extract_paragraphs(a, "_text", limit, "_extract")
    block = block_snippet(F.col("_extract"), truncate_words("summary", limit))
    cats = articles.select("issue", name.alias("category")).distinct()
    head = F.concat(F.lit(f"# {title} - Extended Reading List\n\n"), _generated(), F.lit("\n"))
    return _union(
        _rows(_issues(articles), kind, head, 0),
        _rows(cats, kind, F.concat(_heading(2, F.col("category")), F.lit("\n")), 1,
              section_ord=last, section="category"),
        _rows(a, kind, block, 1, section_ord=last, section="category", **_article_order()),
    )


def number_contents(articles: DataFrame) -> DataFrame:
    """Add ``number``: ``i.j.k``, or ``i.j`` in a category without subcategories.

    Categories and subcategories are ranked on their small aggregate; the last number is a block-wise
    position, so a category may hold any share of the rows.
    """
    a = _with_category(articles).withColumn("subcategory", blank_if_null("subcategory"))
    groups = _contents_groups(a)
    keys = ["issue", "category", "subcategory"]
    ranks = groups.select(*keys, "cat_no", "name_rank", "n_subs")
    numbered = position(a, keys, "_place", ("feed_ord", "entry_ord"), attach=ranks)
    number = F.concat_ws(
        ".", F.col("cat_no"), F.when(F.col("n_subs") > 0, F.col("name_rank")), F.col("_place")
    )
    return numbered.withColumn("number", number).drop("n_subs", "_place")


def _contents_groups(a: DataFrame) -> DataFrame:
    groups = _subgroups(a)
    return groups.withColumn(
        "cat_no", F.dense_rank().over(Window.partitionBy("issue").orderBy("category"))
    )


def contents(articles: DataFrame, title: str = TITLE) -> DataFrame:
    """Table of contents with slugs, then numbered lists."""
    kind = "contents"
    a = _with_category(articles).withColumn("subcategory", blank_if_null("subcategory"))
    groups = _contents_groups(a)
    cats = groups.select("issue", "category", "cat_no").distinct()
    cat_no = F.col("cat_no").cast("string")
    sub_no = F.concat(cat_no, F.lit("."), F.col("name_rank").cast("string"))
    sub_name = F.when(F.col("is_other"), "Other").otherwise(F.col("subcategory"))
    head = F.concat(F.lit(f"# {title} - Contents\n\n"), _generated(), F.lit("\n\n## Table of Contents"))

    def anchor(text: Column) -> Column:
        return F.concat(F.lit("["), text, F.lit("](#"), slug(text), F.lit(")"))

    subs = groups.filter("n_subs > 0")
    items = number_contents(articles)
    item = F.concat(F.col("number"), F.lit(". "), title_link())
    return _union(
        _rows(_issues(a), kind, head, 0),
        _rows(cats, kind, F.concat(cat_no, F.lit(". "), anchor(F.col("category"))), 1, section_ord="cat_no"),
        _rows(subs.filter(~F.col("is_other")), kind,
              F.concat(F.lit("   "), sub_no, F.lit(". "), anchor(F.col("subcategory"))), 1,
              section_ord="cat_no", sub_ord="name_rank"),
        _rows(_issues(a), kind, F.lit(""), 2),
        _rows(cats, kind, F.concat(F.lit("## "), cat_no, F.lit(". "), F.col("category")), 3, section_ord="cat_no"),
        _rows(subs, kind, F.concat(F.lit("### "), sub_no, F.lit(". "), sub_name), 3,
              section_ord="cat_no", sub_ord="name_rank"),
        _rows(items, kind, item, 3, section_ord="cat_no", sub_ord="name_rank", line_ord=1, **_article_order()),
        _rows(groups, kind, F.lit(""), 3, section_ord="cat_no", sub_ord="name_rank", feed_ord=2**62),
    )


def assemble_parts(
    df: DataFrame, key: str, pos: str, text: str, sep: str = "\n", rows_per_part: int = 1000
) -> DataFrame:
    """Ordered text per key in parts of ``rows_per_part`` positions: rows (key, part, text).

    Joining the parts of a key by ``sep`` gives the whole text; a part is bounded whatever the key holds.
    ``pos`` is unique inside a key.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return (
        df.withColumn("part", F.floor(F.col(pos) / rows_per_part))
        .groupBy(key, "part").agg(ordered.alias("_items"))
        .select(key, "part", F.array_join(F.transform("_items", lambda i: i["t"]), sep).alias(text))
    )


def category_lists(articles: DataFrame, block: Column, rows_per_part: int = 1000) -> DataFrame:
    """Category -> blocks in arrival order, as rows (category, feed_ord, part, blocks).

    The array of a part is bounded; sorting the parts gives the whole list.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("entry_ord").alias("o"), block.alias("b"))))
    return (
        articles.withColumn("part", F.floor(F.col("entry_ord") / rows_per_part))
        .groupBy("category", "feed_ord", "part").agg(ordered.alias("_items"))
        .select("category", "feed_ord", "part", F.transform("_items", lambda i: i["b"]).alias("blocks"))
    )
