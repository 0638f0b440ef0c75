"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a column expression of the text; every rule names a measure and the bounds it must keep to.
``apply_rules`` compiles the table into one select without user functions, joins or shuffles.

Null text has no words; empty and blank texts too; they fail the base rules. Rows are judged one by one, so
ties, repeated rows, null ids and further columns do not matter. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import bind

#: Fixed values.
BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "a",
              "de", "la", "le", "les", "et", "des", "que", "un",
              "der", "die", "und", "das", "den", "ist", "von", "zu",
              "el", "los", "en", "se", "las", "una", "por", "con"]


@dataclass(frozen=True)
class Rule:
    """``measure`` per ``per`` must lie in [low, high]; a rule holds only from ``least`` words on."""
    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    least: int = 0


#: The table. Bounds are loose: prose of any language passes, machine noise does not.
RULES = [
    Rule("too_many_symbols", "n_symbols", "n_words", high=0.1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.3, least=50),
    Rule("word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("no_stop_words", "n_stop_words", "n_words", low=0.03),
]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that the text holds at least twice.

    Windows are sorted with their places; equal neighbours are repeats; places of repeats, sorted again, cover
    three words each, less what the next one covers as well.
    """
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(
            " ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def covered(grams: Column) -> Column:
        marked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def twins(s: Column) -> Column:
            again = F.filter(s, lambda e, j: F.coalesce(
                (F.get(s, j - 1)["g"] == e["g"]), F.lit(False)) | F.coalesce(
                (F.get(s, j + 1)["g"] == e["g"]), F.lit(False)))
            return F.array_sort(F.transform(again, lambda e: e["i"]))

        def spread(places: Column) -> Column:
            gaps = F.transform(places, lambda p, j: F.least(
                F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return bind(bind(marked, twins), spread)

    def count(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(covered(grams))

    return F.when(F.size(words) < 3, 0).otherwise(bind(windows(words), count))


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Every measure of a text and its words; all are counts of type long."""
    full = F.filter(F.split(text, "\n"), lambda line: F.length(_without(line, BLANKS)) > 0)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    out = {
        "n_words": F.size(words),
        "word_chars": F.length(_without(text, BLANKS)),
        "n_symbols": F.length(text) - F.length(_without(text, SYMBOLS)),
        "n_dup_lines": bind(full, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_lines": F.size(full),
        "n_repeat_words": repeated_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: F.array_contains(stop, w))),
    }
    return {k: v.cast("long") for k, v in out.items()}


def compiled(rules: list[Rule], of: dict[str, Column]) -> Column:
    """The names of the broken rules, as one expression over measures."""
    broken = []
    for r in rules:
        value = of[r.measure] / F.greatest(of[r.per], F.lit(1)) if r.per else of[r.measure]
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        broken.append(F.when(bad & (of["n_words"] >= r.least), F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``docs`` plus ``quality``: struct of the measures, ``base_failed``, ``broken`` (rule names) and ``kept``."""
    rules = RULES if rules is None else rules
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def judge(m: Column) -> Column:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop_words"]
        of = {n: m[n] for n in names}
        failed = (of["n_words"] < 50) | (of["n_repeat_words"] * 100 > of["n_words"] * 50)
        broken = compiled(rules, of)
        return F.struct(*[of[n].alias(n) for n in names], failed.alias("base_failed"), broken.alias("broken"),
                        (~failed & (F.size(broken) == 0)).alias("kept"))

    counted = bind(words_of(body), lambda w: F.struct(*[c.alias(n) for n, c in measures(body, w).items()]))
    return docs.withColumn("quality", bind(counted, judge))


def rules_digest(judged: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(f"quality.{f}").alias(f) for f in fields],
                         F.array_join("quality.broken", ",").alias("broken"))
