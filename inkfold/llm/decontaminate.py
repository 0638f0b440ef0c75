"""Benchmark decontamination with a positional inverted index.

The index is divided by documents: every task turns the words of its documents into postings, (term, place) in
order, for the terms that test items hold. A test window is ten words of an item in a row. Its lists are
intersected from the rarest term on, each shifted by the term's offset, so that a window that no document holds ends
after one short list. How rare a term is has been counted over the whole corpus before. Places that survive all
lists are exact phrase matches; places where every term lies near its offset are proximity matches.

Test items are taken in blocks of a bounded number of words; the corpus is read once per block and once more for
the counts, and what a task is sent stays bounded however many items there are.

Null texts have no words. Items without words never occur; items of fewer words than a window are one window.
Repeated rows and repeated items are matched like others; a null item id counts as one item but is not listed. An
empty table gives an empty table; further columns are not used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import KEYS, unnamed, with_keys
from inkfold.llm.textbytes import blocks

WINDOW = 10
#: Words by which a term of a proximity match may lie off its place in production: a window of ten words meets two
#: words at most where one is put in every nine.
SLOP = 2
#: Words of test items that are looked for in one pass over the corpus.
BLOCK_WORDS = 1_000_000
#: Bytes of words; capitals are lowered, all other bytes part words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))
SHIFT = 40  # a posting is term << SHIFT | place


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Windows:
    """Test windows over numbered terms."""
    terms: dict[bytes, int]
    grams: np.ndarray  # windows x WINDOW term numbers, -1 behind short ones
    item: np.ndarray  # the item's place in ``ids``
    ids: list

    @staticmethod
    def of(items: list[tuple], window: int) -> Windows:
        terms: dict[bytes, int] = {}
        grams, owner, ids = [], [], []
        for item_id, text in items:
            words = [terms.setdefault(w, len(terms)) for w in words_of((text or "").encode())]
            if not words:
                continue
            ids.append(item_id)
            for i in range(max(len(words) - window, 0) + 1):
                gram = words[i:i + window]
                grams.append(gram + [-1] * (window - len(gram)))
                owner.append(len(ids) - 1)
        return Windows(terms, np.array(grams, np.int64).reshape(-1, window), np.array(owner, np.int64), ids)


def count_batches(batches: Iterator[pa.RecordBatch], terms: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for _, data, _ in blocks(batches, "text"):
        for word, n in Counter(words_of(data.tobytes())).items():  # a word over two texts' border is no matter here
            if word in terms:
                total[terms[word]] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()),
                                      pa.array(list(total.values()), pa.int64())], names=["term", "n"])


class Postings:
    """The inverted index of some documents: sorted (term, place), places counted over all of them."""

    def __init__(self, term: np.ndarray) -> None:
        place = np.flatnonzero(term >= 0)
        self.keys = np.sort((term[place] << SHIFT) | place)
        self.size = len(term)

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the posting lists of terms begin and end."""
        return (np.searchsorted(self.keys, term << SHIFT), np.searchsorted(self.keys, (term + 1) << SHIFT))

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term << SHIFT) | np.maximum(place, 0)
        at = np.searchsorted(self.keys, key)
        return (place >= 0) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)

    def near(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether a posting of the term lies within ``slop`` of the place."""
        at = np.searchsorted(self.keys, (term << SHIFT) | np.maximum(place - slop, 0))
        return (place + slop >= 0) & (at < len(self.keys)) & (
            self.keys[np.minimum(at, len(self.keys) - 1)] <= ((term << SHIFT) | np.maximum(place + slop, 0)))


#: Candidates that are intersected at a time.
CANDIDATES = 1 << 18


def matches(index: Postings, windows: Windows, order: np.ndarray, slop: int) -> tuple:
    """(window, place of its first word, whether exact) of all matches, exact and near.

    ``order`` has each window's term positions from the rarest on.
    """
    out = []
    anchor = windows.grams[np.arange(len(order)), order[:, 0]]
    lo, hi = index.lists(anchor)
    live = np.flatnonzero(hi > lo)
    ends = np.cumsum((hi - lo)[live])
    at = 0
    while at < len(live):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right"))
        stop = max(stop, at + 1)
        some = live[at:stop]
        at = stop
        sizes = (hi - lo)[some]
        window = np.repeat(some, sizes)
        step = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = (index.keys[np.repeat(lo[some], sizes) + step] & ((1 << SHIFT) - 1)) - order[window, 0]
        exact = np.ones(len(window), bool)
        for j in range(1, order.shape[1]):  # from the rarest list to the longest
            offset = order[window, j]
            term = windows.grams[window, offset]
            hit = (term < 0) | index.holds(term, place + offset)
            exact &= hit
            alive = exact if not slop else (hit | index.near(term, place + offset, slop))
            window, place, exact = window[alive], place[alive], exact[alive]
        out.append((window, place, exact))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


HITS = ("doc_id long, n_words long, hits array<long>, near long, items array<string>, _k1 long, _k2 binary")


def match_batches(batches: Iterator[pa.RecordBatch], windows: Windows, order: np.ndarray,
                  slop: int) -> Iterator[pa.RecordBatch]:
    """Per document its words, the places of hit words, near matches and the items that occur."""
    length = (windows.grams >= 0).sum(axis=1)
    ids = [None if i is None else str(i) for i in windows.ids]
    get = windows.terms.get
    wide = windows.grams.shape[1] + slop
    for batch, data, offsets in blocks(batches, "text"):
        raw = data.tobytes()
        begins, term, at = [], [], 0
        counts = []
        for i in range(len(offsets) - 1):
            words = words_of(raw[offsets[i]:offsets[i + 1]])
            begins.append(at)
            counts.append(len(words))
            term.append(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))
            term.append(np.full(wide, -1))  # so that no match crosses two texts
            at += len(words) + wide
        window, place, exact = matches(Postings(np.concatenate(term)), windows, order, slop)
        begins_a = np.array(begins)
        # by the rarest term's own place: the first word of a proximity match may be expected before its text
        row = np.searchsorted(begins_a, place + order[window, 0], side="right") - 1
        hits: dict[int, list] = {}
        items: dict[int, set] = {}
        near: Counter = Counter()
        for r, w, p, e in zip(row.tolist(), window.tolist(), place.tolist(), exact.tolist(), strict=True):
            if e:
                hits.setdefault(r, []).append((p - begins[r], int(length[w])))
                items.setdefault(r, set()).add(int(windows.item[w]))
            else:
                near[r] += 1
        n = len(counts)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(counts, pa.int64()),
            pa.array([_covered(hits.get(r, ())) for r in range(n)], pa.list_(pa.int64())),
            pa.array([near[r] for r in range(n)], pa.int64()),
            pa.array([sorted({ids[i] for i in items.get(r, ()) if ids[i] is not None}) for r in range(n)],
                     pa.list_(pa.string())),
            batch.column("_k1"), batch.column("_k2")],
            names=["doc_id", "n_words", "hits", "near", "items", "_k1", "_k2"])


def _covered(spans) -> list[int]:
    return sorted({p for start, n in spans for p in range(start, start + n)})


def _rarest_first(windows: Windows, counts: dict[int, int]) -> np.ndarray:
    freq = np.array([counts.get(t, 0) for t in range(len(windows.terms))] + [np.iinfo(np.int64).max])
    return np.argsort(freq[windows.grams], axis=1, kind="stable")


def _blocks(benchmark: DataFrame, item_id: str, text: str, words: int) -> Iterator[list[tuple]]:
    """Items in blocks of a bounded number of words; the driver holds one block at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`")).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(words_of((row[1] or "").encode()))
        if held >= words:
            yield block
            block, held = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, ``n_words``, ``hits`` (places of words inside exact matches), ``near``
    (proximity matches that are not exact), ``items`` (ids as strings) and the keys."""
    slim = with_keys(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                                 F.col(f"`{text}`").alias("text"))).select("doc_id", "text", *KEYS)
    parts = []
    for items in _blocks(benchmark, item_id, item_text, block_words):
        windows = Windows.of(items, window)
        if not len(windows.grams):
            continue
        # plain values: workers need not know this module's classes by name
        terms = slim.sparkSession.sparkContext.broadcast(vars(windows))
        counts = slim.select("text").mapInArrow(
            lambda it, b=terms: count_batches(it, b.value["terms"]), "term long, n long").groupBy("term").agg(
            F.sum("n").alias("n"))
        order = slim.sparkSession.sparkContext.broadcast(
            _rarest_first(windows, {r["term"]: r["n"] for r in counts.collect()}))  # at most block_words terms
        parts.append(slim.mapInArrow(lambda it, b=terms, o=order: match_batches(it, Windows(**b.value), o.value, slop), HITS))
    if not parts:
        none = Windows({}, np.zeros((0, window), np.int64), np.zeros(0, np.int64), [])
        empty = np.zeros((0, window), np.int64)
        return slim.mapInArrow(lambda it: match_batches(it, none, empty, slop), HITS)
    if len(parts) == 1:
        return parts[0]
    every = parts[0].select("doc_id", "n_words", *KEYS)
    # repeated rows have equal results, which count once
    rest = [p.where((F.size("hits") > 0) | (F.col("near") > 0)).dropDuplicates(KEYS) for p in parts]
    found = rest[0]
    for p in rest[1:]:
        found = found.unionByName(p)
    lists = found.groupBy(*KEYS).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.sum("near").alias("near"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return every.join(lists, KEYS, "left").select(
        "doc_id", "n_words", F.coalesce("hits", F.array().cast("array<long>")).alias("hits"),
        F.coalesce("near", F.lit(0)).alias("near"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), *KEYS)


def contamination_digest(found: DataFrame) -> DataFrame:
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"), F.col("near").cast("long").alias("n_near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      **settings) -> DataFrame:
    """``docs`` without the rows that hold a test window exactly; proximity matches drop nothing. Same columns, whatever
    their names."""
    rows, body, back = unnamed(docs, doc_id, text)
    found = contamination(rows, benchmark, "id", body, **settings)
    bad = found.where(F.size("hits") > 0).select(*KEYS).distinct()
    return back(with_keys(rows, "id", body).join(bad, KEYS, "left_anti"))
