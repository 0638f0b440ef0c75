"""Ranked lexical search over bags of words, each distinct bag scored once.

The score of a document for a query depends on the terms of the queries it holds, how often, and on one number ``m``
that follows from its length. Documents are cut down to the queries' vocabulary; those with equal term counts and equal
``m`` are one class. Classes are found by a digest and made sure of by the counts themselves, which are part of the
grouping key. A class keeps its first documents by id, as many as a result can hold; it is scored once, and what it
scored is expanded to these documents. All numbers but the weight of a term are 64-bit integers.

A result of k documents lies within the k best classes by (score, least id): each class before that of a document puts
one document before it. So a task keeps k classes per query, whatever it reads, and both cuts to k rows (documents per
class, classes per query) are made per task before the shuffle: a class that a third of all rows share sends k rows per
task.

Queries are taken in blocks of a bounded number of words and items; the vocabulary and the lists of a block are what
tasks are sent. The corpus is read once per block.

Null and empty texts have no terms and are never found; they do not count as documents. Rows with equal ids are
documents of their own, null ids come last among equals. Items without terms find nothing; repeated items and items
with a null id are queries of their own. Ids of documents are numbers. Further columns are not used, whatever their
names. An empty table of either kind gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import stored
from inkfold.llm.decontaminate import words_of
from inkfold.llm.textbytes import blocks

BEST = 20
#: Words and items of one block of queries.
BLOCK_WORDS, BLOCK_ITEMS = 1_000_000, 10_000
#: Postings and scores that are worked on at a time in a task.
CELLS = 1 << 21
FOUND = "item int, score long, members array<struct<late:boolean,id:long>>"


def query_blocks(items: DataFrame, item_id: str, text: str, words: int, most: int) -> Iterator[list[tuple]]:
    """(id, counts of terms) of the items, in blocks; the driver holds one block."""
    block, held = [], 0
    for row in items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        terms = Counter(words_of((row["t"] or "").encode()))
        if not terms:
            continue
        block.append((row["i"], terms))
        held += sum(terms.values())
        if held >= words or len(block) >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def lists_of(block: list[tuple]) -> tuple[dict[bytes, int], dict[str, np.ndarray]]:
    """The vocabulary of a block, and per term the items that hold it and how often."""
    number: dict[bytes, int] = {}
    rows = [(number.setdefault(w, len(number)), i, n) for i, (_, terms) in enumerate(block) for w, n in terms.items()]
    term, item, times = np.array(sorted(rows), np.int64).T
    return number, {"item": item, "times": times, "start": np.searchsorted(term, np.arange(len(number) + 1))}


def bag_batches(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Per document the number of its terms, and term numbers with counts, ascending, as bytes of 32-bit pairs."""
    get = number.get
    for batch, data, offsets in blocks(batches, "text"):
        raw, n, bags = data.tobytes(), [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = words_of(raw[lo:hi])
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            term, times = np.unique(ids[ids >= 0], return_counts=True)
            n.append(len(words))
            bags.append(np.stack([term, times], axis=1).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])


def pairs_of(bags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a column of bags, and where each bag begins (one more than bags)."""
    bags = bags.cast(pa.large_binary())
    offsets = np.frombuffer(bags.buffers()[1], np.int64)[bags.offset:bags.offset + len(bags) + 1]
    data = bags.buffers()[2]
    flat = np.zeros(0, "<i4") if data is None else np.frombuffer(data, "<i4")[offsets[0] // 4:offsets[-1] // 4]
    return flat.reshape(-1, 2).astype(np.int64), (offsets - offsets[0]) // 8


def frequency_batches(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """How many documents of a task hold each term."""
    total = np.zeros(terms, np.int64)
    for batch in batches:
        total += np.bincount(pairs_of(batch.column("bag"))[0][:, 0], minlength=terms)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])


def score_batches(batches: Iterator[pa.RecordBatch], lists: dict[str, np.ndarray], weight: np.ndarray, items: int,
                  best: int) -> Iterator[pa.RecordBatch]:
    """The best classes of a task for every item, by (score, least id)."""
    kept: dict | None = None
    least = np.ones(items, np.int64)  # a score below it is of no use to the item any more
    for batch in batches:
        pairs, bounds = pairs_of(batch.column("bag"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        m = batch.column("m").to_numpy(zero_copy_only=False)
        worth = weight[pairs[:, 0]] * ((1_000_000_000 * pairs[:, 1]) // (1000 * pairs[:, 1] + 12 * m[row]))
        postings = np.diff(lists["start"])[pairs[:, 0]]
        work = np.append(0, np.cumsum(postings))[bounds]  # postings before every row
        members = batch.column("members")
        late = np.array(batch.column("late"), bool)
        first = batch.column("first").fill_null(0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            end = min(at + max(1, CELLS // items), int(np.searchsorted(work, work[at] + CELLS, side="right")) - 1)
            end = max(end, at + 1)
            total = _scores(pairs[bounds[at]:bounds[end], 0], worth[bounds[at]:bounds[end]],
                            row[bounds[at]:bounds[end]] - at, lists, end - at, items)
            r, i = np.nonzero(total >= least)
            some = {"item": i, "score": total[r, i], "late": late[at + r], "first": first[at + r],
                    "members": members.take(pa.array(at + r))}
            kept = _best(some if kept is None else _both(kept, some), best)
            full = np.bincount(kept["item"], minlength=items) == best
            worst = np.full(items, np.iinfo(np.int64).max)
            np.minimum.at(worst, kept["item"], kept["score"])
            least = np.where(full, worst, 1)
            at = end
    if kept is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept["item"].astype(np.int32)), pa.array(kept["score"]), kept["members"]],
            names=["item", "score", "members"])


def _scores(term: np.ndarray, worth: np.ndarray, row: np.ndarray, lists: dict[str, np.ndarray], rows: int,
            items: int) -> np.ndarray:
    """Rows x items, exact: sums of 64-bit products, their upper and lower bits added apart."""
    begin = lists["start"][term]
    size = lists["start"][term + 1] - begin
    which = np.repeat(np.arange(len(term)), size)
    place = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    value = worth[which] * lists["times"][place]
    cell = row[which] * items + lists["item"][place]
    high, low = (np.bincount(cell, v, rows * items).astype(np.int64) for v in (value >> 24, value & 0xFFFFFF))
    return ((high << 24) + low).reshape(rows, items)


def _both(a: dict, b: dict) -> dict:
    return {k: pa.concat_arrays([a[k], b[k]]) if k == "members" else np.concatenate([a[k], b[k]]) for k in a}


def _best(rows: dict, best: int) -> dict:
    order = np.lexsort((rows["first"], rows["late"], -rows["score"], rows["item"]))
    item = rows["item"][order]
    begins = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(begins, np.diff(np.append(begins, len(item))))
    order = order[rank < best]
    return {k: v.take(pa.array(order)) if k == "members" else v[order] for k, v in rows.items()}


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", best: int = BEST, block_words: int = BLOCK_WORDS,
           block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The ``best`` documents of every item: item_id, ``rank`` (from 1), doc_id and ``score``."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    out = None
    for block in query_blocks(items, item_id, item_text, block_words, block_items):
        part = _search_block(slim, block, kind, best)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def _search_block(slim: DataFrame, block: list[tuple], kind: str, best: int) -> DataFrame:
    spark = slim.sparkSession
    number, lists = lists_of(block)
    terms, n_items = len(number), len(block)
    sent = spark.sparkContext.broadcast(number)  # at most BLOCK_WORDS terms
    bags = stored(slim.mapInArrow(lambda it: bag_batches(it, sent.value), "doc_id long, n long, bag binary"), "bags")
    n, length = bags.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = bags.mapInArrow(lambda it: frequency_batches(it, terms), "term long, df long").groupBy("term").agg(
        F.sum("df").alias("df"))
    weight = np.zeros(terms, np.int64)
    for row in df.toLocalIterator():  # at most BLOCK_WORDS rows
        weight[row["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * row["df"] + 1)))
    lists_sent = spark.sparkContext.broadcast((lists, weight))
    found = _classes(bags, n, length, best).mapInArrow(
        lambda it: score_batches(it, *lists_sent.value, n_items, best), FOUND)
    least = F.get("members", F.lit(0))
    near = Window.partitionBy("item").orderBy(F.desc("score"), least["late"], least["id"])
    each = (found.withColumn("_rank", F.row_number().over(near)).where(F.col("_rank") <= best)
            .select("item", "score", F.explode("members").alias("d")))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "d.late", "d.id"))
    ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {kind}")
    return (each.withColumn("rank", rank).where(F.col("rank") <= best).join(ids, "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), F.col("d.id").alias("doc_id"), "score"))


def _classes(bags: DataFrame, n: int, length: int, best: int) -> DataFrame:
    """One row per class: its bag and ``m``, the first documents by id (``members``) and the least one (``late``,
    ``first``)."""
    m = F.expr(f"75 + (25 * n * {n}L) div {max(length, 1)}L")
    held = bags.where(F.octet_length("bag") > 0).withColumn("m", m)
    key = held.select(
        F.unhex(F.sha2(F.concat("bag", F.col("m").cast("string").cast("binary")), 256)).alias("h"), "bag", "m",
        F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id")).alias("d"))
    same = ["h", "bag", "m"]  # equal digests are told apart by the counts themselves
    ranked = key.withColumn("_rank", F.row_number().over(Window.partitionBy(*same).orderBy("d.late", "d.id")))
    return (ranked.where(F.col("_rank") <= best).groupBy(*same).agg(F.sort_array(F.collect_list("d")).alias("members"))
            .select("bag", "m", "members", F.get("members", F.lit(0))["late"].alias("late"),
                    F.get("members", F.lit(0))["id"].alias("first")))
