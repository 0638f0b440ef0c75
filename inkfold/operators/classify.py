"""Rule classification: category, subcategory, score maps, section match.

Keyword scores count substrings, each keyword on its own. Scanning a text once per keyword is the
obvious form and costs hundreds of passes over the largest column. Here a few regular expressions,
tries of all keywords behind a look at their first characters, list the longest keyword at every
position; that short list then holds every other keyword too, as a prefix of an entry, and is cheap
to count in. Only a keyword that can overlap itself ("saas" in "saasaas") is recounted in the text.
Whole words are listed the same way, by one trie tried where a word may begin.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.patterns import scan_passes, trie_regex
from inkfold.functions.text import WORD, as_col, blank_if_null, weighted_text
from inkfold.rules import DEFAULT_RULES, SECTION_RULES, RuleSet

SEP = "\n"


def whole_word_pattern(keywords: list[str]) -> str:
    """Captures the longest keyword starting at a position that does not touch another word character."""
    return f"(?<!{WORD})(?=({trie_regex(keywords)})(?!{WORD}))"


def overlaps_itself(keyword: str) -> bool:
    return any(keyword.startswith(keyword[i:]) for i in range(1, len(keyword)))


def _ends_word(keyword: str, longer: str) -> bool:
    """Whether ``keyword`` does not touch a word character where ``longer`` stands as a whole word."""
    after = longer[len(keyword):len(keyword) + 1]
    return longer.startswith(keyword) and not (after == "_" or after and unicodedata.category(after)[0] in "LN")


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it in ``body`` as ``name``.

    A column of an earlier projection is not enough: a filter or join key derived from the result is
    pushed below that projection and would put the whole text scan inside the inner loops.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def _hits(text: str, keywords: list[str]) -> str:
    """SQL: one line per position where a keyword starts, holding the longest one."""
    listed = sorted({k for k in keywords if SEP not in k})
    if not listed:
        return _sql_text(SEP)
    found = ", ".join(f"regexp_extract_all({text}, {_sql_text(p)}, 1)" for p in scan_passes(tuple(listed)))
    return f"concat({_sql_text(SEP)}, array_join(concat({found}), {_sql_text(SEP)}))"


def _whole_hits(text: str, keywords: list[str]) -> str:
    """SQL: the longest whole keyword at every position where one starts, each between two marks of its own."""
    listed = sorted({k for k in keywords if k and SEP not in k})
    if not listed:
        return "''"
    found = f"regexp_extract_all({text}, {_sql_text(whole_word_pattern(listed))}, 1)"
    return f"concat({_sql_text(SEP)}, array_join({found}, {_sql_text(SEP + SEP)}), {_sql_text(SEP)})"


def _occurrences(text: str, keyword: str) -> str:
    """SQL: non-overlapping occurrences of a literal."""
    k = _sql_text(keyword)
    return f"(octet_length({text}) - octet_length(replace({text}, {k}, ''))) div octet_length({k})"


def _marked(hits: str, marks: list[str]) -> str:
    """SQL: how often some marks stand in a hit list. They are one array literal, so that the plan stays small for hundreds."""
    listed = ", ".join(_sql_text(m) for m in marks)
    return (
        f"if(octet_length({hits}) > 1, aggregate(array({listed}), 0L, (n, m) -> "
        f"n + (octet_length({hits}) - octet_length(replace({hits}, m, ''))) div octet_length(m)), 0L)"
    )


def _whole_score(keywords: tuple[str, ...], text: str, hits: str, every: list[str]) -> str:
    """SQL: total occurrences of some keywords as whole words. A keyword also stands in the entries of longer ones that
    begin with it as a word."""
    longest = sorted({k for k in every if k and SEP not in k})
    direct = [k for k in keywords if not k or SEP in k or overlaps_itself(k) and any(
        _ends_word(k[:i], k) and k.startswith(k[len(k) - i:]) for i in range(1, len(k)))]
    marks = [SEP + e + SEP for k in keywords if k not in direct for e in longest if _ends_word(k, e)]
    terms = ["0L", *([_marked(hits, marks)] if marks else [])]
    for k in direct:
        pattern = rf"(?<!{WORD})\Q{k}\E(?!{WORD})"
        terms.append(f"cast(regexp_count({text}, {_sql_text(pattern)}) as bigint)")
    return " + ".join(terms)


def _score(keywords: tuple[str, ...], text: str, hits: str) -> str:
    """SQL: total occurrences of some keywords, read from the hit list."""
    direct = [k for k in keywords if SEP in k or overlaps_itself(k)]
    listed = [k for k in keywords if k not in direct]
    terms = ["0L"]
    if listed:
        terms.append(_marked(hits, [SEP + k for k in listed]))
    for k in direct:
        count = _occurrences(text, k)
        terms.append(count if SEP in k else f"if(contains({hits}, {_sql_text(SEP + k)}), {count}, 0L)")
    return " + ".join(terms)


def _scores(
    groups: tuple[tuple[str, tuple[str, ...]], ...], text: str, whole_word: bool, extra: list[str] | None = None
) -> str:
    """SQL: array of one score per group; ``extra`` adds a term to each."""
    keywords = [k for _, words in groups for k in words]
    if whole_word:
        terms = [_whole_score(words, "l", "h", keywords) for _, words in groups]
    else:
        terms = [_score(words, "l", "h") for _, words in groups]
    if extra:
        terms = [f"{t} + {e}" for t, e in zip(terms, extra)]
    hits = _whole_hits("l", keywords) if whole_word else _hits("l", keywords)
    return _let(text, "l", _let(hits, "h", f"array({', '.join(terms)})"))


def _first_best(scores: str, body: str) -> str:
    """SQL: ``body`` with the scores as ``s`` and the best as ``b`` (v = score, o = minus its index).

    On a tie the first declared wins.
    """
    best = "array_max(transform(s, (v, i) -> named_struct('v', v, 'o', -i)))"
    return _let(scores, "s", _let(best, "b", body))


def _names(groups) -> str:
    return "array(" + ", ".join(_sql_text(name) for name, _ in groups) + ")"


def _boosts(rules: RuleSet, source: str) -> list[str]:
    """SQL: what the source adds to each category, once per boost rule."""
    out = []
    for cat, _ in rules.categories:
        terms = [
            f"if({source} rlike {_sql_text('|'.join(re.escape(t) for t in words))}, {weight}L, 0L)"
            for c, words, weight in rules.boosts if c == cat
        ]
        out.append(" + ".join(terms) or "0L")
    return out


def classify(
    df: DataFrame, text: Column | str = "full_text", title: Column | str = "title",
    source: Column | str | None = "source", rules: RuleSet = DEFAULT_RULES, whole_word: bool = False,
) -> DataFrame:
    """Add category, category_score (share of the total) and category_scores (map)."""
    out = df.withColumns(
        {
            "_low": weighted_text(title, text),
            "_source": F.lower(blank_if_null(source)) if source is not None else F.lit(""),
            "_empty": (blank_if_null(text) == "") & (blank_if_null(title) == ""),
        }
    )
    names = _names(rules.categories)
    boosts = _boosts(rules, "_source") if source is not None else None
    result = _first_best(
        _scores(rules.categories, "_low", whole_word, boosts),
        "named_struct("
        f"'category', if(_empty or b.v = 0, 'Other', {names}[-b.o]), "
        "'score', if(_empty or b.v = 0, 0D, b.v / aggregate(s, 0L, (a, x) -> a + x)), "
        f"'scores', map_from_arrays({names}, s))",
    )
    out = out.withColumn("_class", F.expr(result))
    return out.withColumns(
        {
            "category": F.col("_class.category"),
            "category_score": F.col("_class.score"),
            "category_scores": F.col("_class.scores"),
        }
    ).drop("_low", "_source", "_empty", "_class")


def with_subcategory(
    df: DataFrame, text: Column | str = "full_text", category: str = "category",
    rules: RuleSet = DEFAULT_RULES, whole_word: bool = False, name: str = "subcategory",
) -> DataFrame:
    """Add the best subcategory inside the row's category; null when there is none.

    The text is scanned once, with the keywords of the row's own category only.
    """
    cases = " ".join(
        f"when {_sql_text(c)} then "
        + _first_best(_scores(subs, "_low", whole_word), f"if(b.v > 0, {_names(subs)}[-b.o], null)")
        for c, subs in rules.subcategories
    )
    out = df.withColumns({"_low": F.lower(blank_if_null(text)), "_category": F.col(category)})
    best = F.expr(f"case _category {cases} end") if cases else F.lit(None).cast("string")
    return out.withColumn(name, best).drop("_low", "_category")


def classify_articles(
    df: DataFrame, text: Column | str = "full_text", title: Column | str = "title",
    source: Column | str | None = "source", rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """Category and subcategory in one go, as the local rule path does."""
    return with_subcategory(classify(df, text, title, source, rules), text, rules=rules)


def threshold_category(scores: Column | str, threshold: float = 0.7) -> Column:
    """Best key of a score map when its score reaches the threshold, else ``Unclassified``."""
    entries = F.transform(
        F.map_entries(as_col(scores)),
        lambda e, i: F.struct(e["value"].alias("value"), (-i).alias("ord"), e["key"].alias("key")),
    )
    top = F.array_max(entries)
    return F.when(top["value"] >= threshold, top["key"]).otherwise(F.lit("Unclassified"))


def section_match(df: DataFrame, text: Column | str = "full_text", sections: dict = SECTION_RULES) -> DataFrame:
    """Add ``section_scores`` (map of keyword counts) and ``sections`` (names whose thresholds also hold).

    Needs ``features``; thresholds use its length, quote_count and reading_time.
    """
    groups = tuple((name, tuple(rule["keywords"])) for name, rule in sections.items())
    out = df.withColumn("_low", F.lower(blank_if_null(text)))
    out = out.withColumn("_sections", F.expr(_scores(groups, "_low", whole_word=False)))
    hits = []
    for i, (name, rule) in enumerate(sections.items()):
        ok = F.get("_sections", F.lit(i)) > 0
        for key, field, upper in (
            ("min_length", "length", False), ("min_quotes", "quote_count", False),
            ("min_reading_time", "reading_time", False), ("max_reading_time", "reading_time", True),
        ):
            if key in rule:
                value = F.col(f"features.{field}")
                ok = ok & (value <= rule[key] if upper else value >= rule[key])
        hits.append(F.when(ok, F.lit(name)))
    names = F.array(*[F.lit(n) for n in sections])
    return out.withColumns(
        {"section_scores": F.map_from_arrays(names, F.col("_sections")), "sections": F.array_compact(F.array(*hits))}
    ).drop("_low", "_sections")
