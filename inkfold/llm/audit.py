"""Filter interaction audit by contraction of contingency tensors.

Five filters judge every document. Per part (language) the documents are counted by which filters they fail: a
tensor of 2 x 2 x 2 x 2 x 2 cells, one axis per filter, pass and fail on each. What a filter removes, leaves or
repeats at a step of an order of filters is a contraction of that tensor: every axis is multiplied with the selector
of pass, of fail, or of all. One einsum makes the numbers of all steps of all orders.

Spark counts the cells; a group that is handed to numpy has 32 rows at most. The fifth filter, the repeat of a text,
works on digests of 256 bits: counts are gathered per digest with the least id, so a text that a third of all rows
hold is a few rows per task.

Null text is empty; an empty text has no words and no characters, so it fails only the filter of few words and that of
repeated texts. A null part is the part of the empty name. A row with a null id repeats nothing, is nothing that
others repeat, and has no label. Rows that are repeated with their id are no repeats of each other, and all count.
Repeated labels of an id count as positive if one of them is. Further columns are not used, whatever their names. An
empty table gives an empty table. Ids may be of any type with an order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.textbytes import utf8

FILTERS = "ABCDE"
#: The filters' bounds and signs.
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SIGNS, CAPITALS = b"#$%&*|", bytes(range(65, 91))
INNER_BYTES = bytes(range(0x80, 0xC0))  # of a code point, all but the first
#: Pieces that rows of one id are dealt to where labels are joined.
SALT = 8

MEASURES = ["n", "good", "toxic"]
AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")
#: Every order with every step, in order, and the filter of that step.
STEPS = [(order, step) for order in permutations(range(len(FILTERS))) for step in range(len(FILTERS))]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails, A lowest."""
    words = text.split()  # bytes are parted at space and 0x09 to 0x0D
    points = len(text.translate(None, INNER_BYTES))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < FEW_WORDS)
            | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > CAPITAL_PERCENT * points) << 2
            | (len(text.translate(None, SIGNS)) < len(text)) << 3)


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts become their digest and the bits of their failures."""
    for batch in batches:
        data, offsets = utf8(batch.column("_text"))
        raw, bits, digests = data.tobytes(), [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = raw[lo:hi]
            bits.append(text_failures(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())],
            names=["doc_id", "part", "bits", "digest"])


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, ``bits`` (failures of A to D) and ``digest`` of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"),
                       F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(feature_batches, f"doc_id {kind}, part string, bits int, digest binary")


def with_labels(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality",
                toxic: str = "toxic") -> DataFrame:
    """``rows`` plus ``good`` and ``toxic`` (boolean). An id with very many rows is dealt to SALT pieces, and a null
    id meets no label.

    Labels grow with the documents, and Spark's estimate of their size is that of the files, SALT times and more below
    that of the rows: left to it, millions of them are gathered in the driver. So both sides are shuffled at any size.
    """
    flag = lambda c: F.coalesce(F.max((F.col(f"`{c}`") == 1)), F.lit(False))
    known = (labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("doc_id"))
             .agg(flag(quality).alias("good"), flag(toxic).alias("toxic")).where("good or toxic")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    salt = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 16))).otherwise(
        F.pmod(F.xxhash64("digest"), F.lit(SALT))).cast("int")
    return rows.withColumn("_salt", salt).join(known.hint("merge"), ["doc_id", "_salt"], "left").select(
        *rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def failure_counts(rows: DataFrame) -> DataFrame:
    """part, ``cell`` (bits of all failures, A lowest) and the measures ``n``, ``good``, ``toxic``."""
    same = ["digest", "bits", "part", "good", "toxic"]
    per_id = rows.groupBy(*same, "doc_id").agg(F.count("*").alias("c"))
    per_text = per_id.groupBy(*same).agg(
        F.min("doc_id").alias("low"), F.min_by("c", "doc_id").alias("at_low"), F.sum("c").alias("c"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))), F.lit(0)).alias("no_id"))
    # a text's rows are now one per part and label, so what meets under a digest is small
    least = F.min("low").over(Window.partitionBy("digest"))
    first = F.when(F.col("low") == F.col("least"), F.col("at_low")).otherwise(0) + F.col("no_id")
    split = per_text.withColumn("least", least).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("bits").alias("cell"), first.alias("c")),
        F.struct((F.col("bits") + 16).alias("cell"), (F.col("c") - first).alias("c")))).alias("x"))
    counted = lambda flag: F.sum(F.when(F.col(flag), F.col("x.c")).otherwise(0))
    return split.groupBy("part", F.col("x.cell").alias("cell")).agg(
        F.sum("x.c").alias("n"), counted("good").alias("good"), counted("toxic").alias("toxic"))


def _selectors(choose) -> np.ndarray:
    """Steps x filters x 2: what ``choose(order, step, place of the filter in the order)`` selects on every axis."""
    return np.array([[choose(order, step, order.index(f)) for f in range(len(FILTERS))] for order, step in STEPS],
                    np.int64)


def audit_part(cells: pd.DataFrame) -> pd.DataFrame:
    """The steps of all orders for the cells of one part."""
    tensor = np.zeros((len(MEASURES), 2 ** len(FILTERS)), np.int64)
    tensor[:, cells["cell"].to_numpy()] = cells[MEASURES].to_numpy().T
    # cells are numbered with A lowest, so the axes come from E to A
    tensor = tensor.reshape(len(MEASURES), *[2] * len(FILTERS)).transpose(0, 5, 4, 3, 2, 1)

    def contract(choose) -> np.ndarray:
        axes = _selectors(choose)
        return np.einsum("mabcde,sa,sb,sc,sd,se->ms", tensor, *[axes[:, f] for f in range(len(FILTERS))],
                         optimize=True)

    kept = contract(lambda order, step, at: PASS if at <= step else ALL)[0]
    gone = contract(lambda order, step, at: PASS if at < step else FAIL if at == step else ALL)
    failing = contract(lambda order, step, at: FAIL if at == step else ALL)[0]
    alone = contract(lambda order, step, at: FAIL if at == step else PASS)[0]
    which = np.array([order[step] for order, step in STEPS])
    total = np.zeros(len(FILTERS), np.int64)
    np.add.at(total, which, gone[0])
    return pd.DataFrame({
        "part": cells["part"].iloc[0], "filter_order": ["".join(FILTERS[f] for f in order) for order, _ in STEPS],
        "step": np.array([step + 1 for _, step in STEPS], np.int32), "kept": kept, "removed": gone[0],
        "redundant": failing - gone[0], "unique_fails": alone, "good_lost": gone[1], "toxic_lost": gone[2],
        "shapley": total[which]})


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, as counts of rows of the part."""
    cells = failure_counts(with_labels(judged(docs, doc_id, text, part), labels))
    return cells.groupBy("part").applyInPandas(audit_part, AUDIT)
