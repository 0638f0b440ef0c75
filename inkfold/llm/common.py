"""Helpers the operators share: row keys, whole-row binding, spans of matches, shared tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from inkfold.session import work_dir

KEYS = ["_k1", "_k2"]
#: Texts are cut in blocks of so many characters, so that a part costs its own length and not its place.
CUT = 256
#: Running sums are folded in blocks of so many numbers, so that long arrays are not copied per number.
FOLD = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_keys(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add a two-part key: the id (0 for null) and 128 bits of the text's SHA-256. It is never null.

    Rows with equal keys hold the same text, so results by key serve all of them; an id that is used for several
    texts, be it by a third of all rows, is told apart by the digest.
    """
    body = F.col(f"`{text}`")
    marked = F.concat(F.when(F.col(f"`{doc_id}`").isNull(), "n").otherwise("i"), F.when(body.isNull(), "n").otherwise("t"),
                      F.coalesce(body.cast("string"), F.lit("")))
    return df.withColumns({
        "_k1": F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(0)),
        "_k2": F.substring(F.unhex(F.sha2(marked, 256)), 1, 16),
    })


def unnamed(docs: DataFrame, doc_id: str, text: str, added: Sequence[str] = ()) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """``docs`` under inner names, so that none of its columns can clash with a column of an operator.

    Returns the rows, the inner name of the text, and what gives rows their own columns back. ``id`` is added: the id
    where it is a whole number, else a hash of it, null where it is null. Columns ``added`` come back behind their own.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = F.col(f"c{names.index(doc_id)}")
    whole = isinstance(docs.schema[doc_id].dataType, IntegralType)
    rows = inner.withColumn("id", own.cast("long") if whole else F.when(own.isNotNull(), F.xxhash64(own)))
    return rows, f"c{names.index(text)}", lambda df: df.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *added)


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with an underscore behind columns that have one of the names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for c in df.columns:
        new = c
        while new.lower() in {n.lower() for n in names} or (new != c and new.lower() in taken):
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return df.toDF(*out)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once in the row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def run_folds(numbers: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` of 0 and ``numbers`` (array<int>) one after another, up to and with each place."""
    def block(acc: Column, part: Column) -> Column:
        grown = F.aggregate(part, F.slice(acc, -1, 1),
                            lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))
        return F.concat(acc, F.slice(grown, 2, FOLD))

    def all_blocks(nums: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(nums) - 1) / F.lit(FOLD)).cast("int")),
            lambda b: F.slice(nums, b * FOLD + 1, FOLD))
        sums = F.aggregate(parts, F.array(F.lit(0)), block)
        return F.slice(sums, 2, F.size(nums))

    none = F.array().cast("array<int>")
    return bind(numbers, lambda nums: F.when(F.size(nums) == 0, none).otherwise(all_blocks(nums)))


def run_sums(numbers: Column) -> Column:
    """Sums of ``numbers`` (array<int>) up to and with each place."""
    return run_folds(numbers, lambda a, x: a + x)


def cut(text: Column, places: Column) -> Column:
    """The parts of ``text`` at ``places``, array<struct<start, stop>> in code points with start <= stop."""
    def inside(x: Column) -> Column:
        def part(p: Column) -> Column:
            a, b = F.floor(p["start"] / CUT).cast("int"), F.floor(p["stop"] / CUT).cast("int")
            block = lambda i: F.coalesce(F.get(x["blocks"], i), F.lit(""))
            return F.when(a == b, F.substring(block(a), p["start"] - a * CUT + 1, p["stop"] - p["start"])).otherwise(F.concat(
                F.substring(block(a), p["start"] - a * CUT + 1, F.lit(CUT)),
                F.array_join(F.slice(x["blocks"], a + 2, b - a - 1), ""),
                F.substring(block(b), F.lit(1), p["stop"] - b * CUT)))

        return F.transform(x["places"], part)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return bind(F.struct(blocks.alias("blocks"), places.alias("places")), inside)


def apart(spans: Column, held: Column) -> Column:
    """The ``spans`` that share no place with any of ``held``, in one walk over both.

    Held spans stand in the order at their start, others at their stop; of those before a span's stop the furthest end
    tells whether one of them reaches into it.
    """
    marks = F.array_sort(F.concat(
        F.transform(held, lambda b: F.struct((2 * b["start"] + 1).alias("at"), b["stop"].alias("stop"), F.lit(-1).alias("i"))),
        F.transform(spans, lambda c, i: F.struct((2 * c["stop"]).alias("at"), F.lit(0).alias("stop"), i.alias("i")))))

    def reach(m: Column) -> Column:
        furthest = run_folds(F.transform(m, lambda x: x["stop"]), F.greatest)
        own = F.filter(F.zip_with(m, furthest, lambda x, e: F.struct(x["i"].alias("i"), e.alias("e"))), lambda x: x["i"] >= 0)
        return F.transform(F.array_sort(own), lambda x: x["e"])

    def free(ends: Column) -> Column:
        both = F.zip_with(spans, ends, lambda c, e: F.struct(c.alias("c"), e.alias("e")))
        return F.transform(F.filter(both, lambda x: x["e"] <= x["c"]["start"]), lambda x: x["c"])

    return F.when((F.size(spans) == 0) | (F.size(held) == 0), spans).otherwise(bind(bind(marks, reach), free))


def found(text: Column, pattern: str, context: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, stop, hit, left>>, places in code points.

    ``left`` holds up to ``context`` characters before the match. The text between matches and the matches
    alternate, so their lengths add up to the places. Patterns must not match the empty string.
    """
    def place(parts: Column) -> Column:
        steps = F.zip_with(parts["gaps"], parts["hits"],
                           lambda g, h: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(h), F.lit(0)))
        return F.zip_with(
            F.slice(run_sums(steps), F.lit(1), F.size(parts["hits"])),
            F.zip_with(parts["hits"], F.slice(parts["gaps"], F.lit(1), F.size(parts["hits"])),
                       lambda h, g: F.struct(h.alias("hit"), g.alias("gap"))),
            lambda stop, x: F.struct(
                (stop - F.length(x["hit"])).alias("start"), stop.alias("stop"), x["hit"].alias("hit"),
                (F.right(x["gap"], F.lit(context)) if context else F.lit("")).alias("left")))

    none = F.array().cast("array<struct<start:int,stop:int,hit:string,left:string>>")
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), bind(parts, place)).otherwise(none)


def labelled(kind: int, hits: Column) -> Column:
    """Matches with their kind's number, as array<struct<kind, start, stop, hit, left>>."""
    return F.transform(hits, lambda h: F.struct(
        F.lit(kind).alias("kind"), h["start"].alias("start"), h["stop"].alias("stop"),
        h["hit"].alias("hit"), h["left"].alias("left")))


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of every span, comma-joined in the given order."""
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", name[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")
