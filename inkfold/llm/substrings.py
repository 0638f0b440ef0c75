"""Repeated passages: every byte under a string of ``span`` bytes that also starts elsewhere in the corpus.

Three steps, of which only the last looks at text again:

1. Anchors. In every window of ``span`` bytes the ``ANCHOR``-byte string of least hash is its anchor. Equal windows
   have equal anchors, so repeated strings meet by anchor hash. Windows with one anchor in a row make a run.
2. Runs whose anchor occurs once cannot repeat and go. Runs that are equal as a whole (hash of all their bytes)
   are repeats of one another; one per class goes on, if its anchor has other classes.
3. Suffix sort. The remaining runs of an anchor are sorted by the suffix that starts at the anchor, and by the
   text before it read backwards. Comparisons find the common extension by binary search on prefix polynomial
   hashes inside a merge sort; extensions that count are verified on the bytes. Neighbours are joined from the
   longest right extension down; within the joined set the best left extension is that of a neighbour in the
   backward order. Left and right together tell which windows repeat.

An anchor with very many classes is divided: each part is sorted by itself, and what a part has not settled meets
by fingerprint. No task sees more than PART runs of an anchor at once.

Null text is empty. Texts under ``span`` bytes keep all bytes. Repeated rows are repeats of one another. A null id
counts as a document. An empty table gives an empty table; further columns are not used.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import KEYS, stored, with_keys
from inkfold.llm.textbytes import U64, Powers, blocks, mixed, prefix_hashes, stretch_hashes

SPAN = 200
ANCHOR = 40
#: Classes of an anchor that are sorted together.
PART = 2048
#: Bytes of runs that are sorted together, and of text that anchors are chosen in (the low bits hold the place).
UNIT_BYTES = 1 << 20
PLACE_BITS = 22


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` numbers in a row."""
    out, step = values, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def runs_of(data: np.ndarray, span: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Runs over one stretch of bytes: first start, last start, anchor place and anchor hash per window start."""
    prefix = prefix_hashes(data, powers)
    at = np.arange(len(data) - ANCHOR + 1)
    hashes = mixed(stretch_hashes(prefix, powers, at, at + ANCHOR))
    low = U64((1 << PLACE_BITS) - 1)
    least = _least((hashes & ~low) | at.astype(U64), span - ANCHOR + 1)
    return hashes, (least & low).astype(np.int64)


def anchor_batches(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    most = (1 << PLACE_BITS) - 1
    for batch, data, offsets in blocks(batches, "text"):
        view = data.tobytes()
        out = []
        size = np.diff(offsets)
        rows, latest = np.repeat(np.arange(len(size)), size), np.repeat(offsets[1:] - span, size)
        for lo in range(0, max(len(data), 1), most - span + 1):  # one step, but for a very long text
            part = data[lo:lo + most]
            if len(part) < span:
                continue
            hashes, anchor = runs_of(part, span, powers)
            # windows that lie in one text
            row = rows[lo:lo + len(anchor)]
            inside = np.arange(lo, lo + len(anchor)) <= latest[lo:lo + len(anchor)]
            new = inside.copy()
            new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
            a = anchor[first]
            whole = np.fromiter((xxhash.xxh3_64_intdigest(view[lo + s:lo + e + span])
                                 for s, e in zip(first.tolist(), ends.tolist(), strict=True)), U64, len(first))
            r = row[first]
            out.append((r, lo + first - offsets[r], ends - first, a - first, hashes[a], whole))
        if not out:
            continue
        r, start, more, off, h, whole = (np.concatenate(x) for x in zip(*out, strict=True))
        keys = [batch.column(k).take(pa.array(r)) for k in KEYS]
        pack = (start << 20) | (more << 10) | off
        yield pa.RecordBatch.from_arrays(
            [*keys, pa.array(pack), pa.array(h.view(np.int64)), pa.array(whole.view(np.int64))],
            names=[*KEYS, "pack", "h", "whole"])


# --- suffix sort -----------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of some strings in one buffer, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, group: np.ndarray, powers: Powers):
        self.data, self.start, self.stop, self.group, self.powers = data, start, stop, group, powers
        self.prefix = prefix_hashes(data, powers)
        padded = np.append(data, np.zeros(8, np.uint8)).astype(U64)
        self.head = np.zeros(len(start), U64)  # the first eight bytes as a number; most comparisons end here
        for i in range(8):
            here = np.minimum(start + i, len(data))
            self.head |= np.where(start + i < stop, padded[here], U64(0)) << U64(56 - 8 * i)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes x and y, by binary search on hashes."""
        a, b = self.start[x], self.start[y]
        lo = np.zeros(len(x), np.int64)
        hi = np.minimum(self.stop[x] - a, self.stop[y] - b)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (stretch_hashes(self.prefix, self.powers, a, a + mid)
                    == stretch_hashes(self.prefix, self.powers, b, b + mid))
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix x sorts before suffix y (or with it)."""
        gx, gy, hx, hy = self.group[x], self.group[y], self.head[x], self.head[y]
        out = (gx < gy) | ((gx == gy) & (hx < hy))
        tie = np.flatnonzero((gx == gy) & (hx == hy))
        if len(tie):
            u, v = x[tie], y[tie]
            n = self.extension(u, v)
            a, b = self.start[u] + n, self.start[v] + n
            over_u, over_v = a == self.stop[u], b == self.stop[v]
            last = len(self.data) - 1
            smaller = self.data[np.minimum(a, last)] < self.data[np.minimum(b, last)]
            out[tie] = np.where(over_u, ~over_v | or_equal, ~over_v & smaller)
        return out

    def sorted(self) -> np.ndarray:
        """Merge sort: at every level all neighbouring runs are merged at once, each suffix finding its place in
        the other run by binary search."""
        n = len(self.start)
        order, width = np.arange(n), 1
        while width < n:
            place = np.arange(n)
            run = place // width
            left = run % 2 == 0
            begin = np.where(left, (run + 1) * width, (run - 1) * width)
            end = np.minimum(begin + width, n)
            lo, hi = np.minimum(begin, n), np.maximum(end, np.minimum(begin, n))
            zero = lo.copy()
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                x, y = order[open_], order[mid]
                # a suffix of the right run goes behind equal ones of the left
                l_side = left[open_]
                less = np.empty(len(open_), bool)
                less[l_side] = self.before(y[l_side], x[l_side], False)
                less[~l_side] = self.before(y[~l_side], x[~l_side], True)
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            target = np.where(left, place + lo - zero, place - width + lo - zero)
            merged = np.empty(n, np.int64)
            merged[target] = order
            order, width = merged, width * 2
        return order


def repeated_windows(runs: list[tuple[bytes, int]], group: np.ndarray, span: int, powers: Powers) -> list[list]:
    """Per run (bytes, place of its anchor) the ranges of window starts that occur in another run of its group."""
    text = b"".join(r for r, _ in runs)
    data = np.frombuffer(text, np.uint8)
    size = np.array([len(r) for r, _ in runs])
    base = np.cumsum(size) - size
    anchor = base + np.array([a for _, a in runs])
    n = len(data)
    right = Suffixes(data, anchor, base + size, group, powers)
    left = Suffixes(data[::-1].copy(), n - anchor, n - base, group, powers)
    rank = np.empty(len(runs), np.int64)
    rank[left.sorted()] = np.arange(len(runs))
    by_rank = np.argsort(rank)
    order = right.sorted()
    x, y = order[:-1], order[1:]
    reach = np.where(group[x] == group[y], right.extension(x, y), 0)
    covered: list[list] = [[] for _ in runs]
    owner = list(range(len(runs)))
    members: dict[int, list[int]] = {}

    def top(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    def pair(i: int, j: int, q: int) -> None:
        """Runs i and j agree on q bytes from the anchor on: find how many before it, verify, and note windows."""
        (s, a), (t, b) = runs[i], runs[j]
        lo, hi = 0, min(a, b)
        if q + hi < span:
            return
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if s[a - mid:a] == t[b - mid:b]:
                lo = mid
            else:
                hi = mid - 1
        if s[a:a + q] != t[b:b + q]:  # a collision of hashes
            q = next(k for k in range(q) if s[a + k] != t[b + k])
        if lo + q >= span:
            covered[i].append((a - lo, a + min(0, q - span)))
            covered[j].append((b - lo, b + min(0, q - span)))

    for k in np.argsort(-reach, kind="stable").tolist():
        q = int(reach[k])
        if q < ANCHOR:
            break
        i, j = top(int(x[k])), top(int(y[k]))
        mine, other = (members.pop(z, None) or [int(rank[z])] for z in (i, j))
        if len(mine) < len(other):
            i, j, mine, other = j, i, other, mine
        for r in other:
            at = bisect_left(mine, r)
            for near in mine[max(at - 1, 0):at + 1]:
                pair(int(by_rank[r]), int(by_rank[near]), q)
            insort(mine, r)
        owner[j] = i
        members[i] = mine
    return covered


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges of whole numbers (ends included) as one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


RUN_COLUMNS = "_k1 long, _k2 binary, start long, anchor int, h long, part long, parts long, run binary"
RESULT = "_k1 long, _k2 binary, start long, stop long, f1 long, f2 long"


def _unit(rows: list[tuple], span: int, powers: Powers) -> list[tuple]:
    """Settle the runs of whole groups: covered ranges, and fingerprints where a group has several parts."""
    groups: dict[tuple, int] = {}
    group = np.array([groups.setdefault((r["h"], r["part"]), len(groups)) for r in rows])
    covered = repeated_windows([(r["run"], r["anchor"]) for r in rows], group, span, powers)
    out = []
    seen: set[tuple] = set()
    for r, g, ranges in zip(rows, group.tolist(), covered, strict=True):
        merged = _merged(ranges)
        for a, b in merged:
            out.append((r["_k1"], r["_k2"], r["start"] + a, r["start"] + b + span, None, None))
        if r["parts"] > 1:
            inside = np.zeros(len(r["run"]) - span + 1, bool)
            for a, b in merged:
                inside[max(a, 0):b + 1] = True
            for s, known in enumerate(inside.tolist()):
                f = xxhash.xxh3_128_intdigest(r["run"][s:s + span])
                if known and (g, f) in seen:
                    continue  # one of a class stands for it in the other parts
                seen.add((g, f))
                signed = [int(v) - (1 << 63) for v in (f >> 64, f & ((1 << 64) - 1))]
                out.append((r["_k1"], r["_k2"], r["start"] + s, r["start"] + s + span, *signed))
    return out


def settle_batches(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h, part); groups are settled whole, many at a time."""
    powers, rows, held = Powers(), [], 0
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def flush(done: list) -> pa.RecordBatch:
        cols = list(zip(*_unit(done, span, powers), strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            if held >= UNIT_BYTES and (r["h"], r["part"]) != (rows[-1]["h"], rows[-1]["part"]):
                yield flush(rows)
                rows, held = [], 0
            rows.append(r)
            held += len(r["run"])
    if rows:
        yield flush(rows)


def cut_out_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs: a row per run."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            text = (row["text"] or "").encode()
            for e in row["edges"]:
                start, more, off = e["pack"] >> 20, (e["pack"] >> 10) & 1023, e["pack"] & 1023
                out.append((row["_k1"], row["_k2"], start, off, e["h"], e["part"], e["parts"],
                            text[start:start + more + e["span"]]))
        cols = list(zip(*out, strict=True)) or [[]] * 8
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                         names=[f.split()[0] for f in RUN_COLUMNS.split(", ")])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN,
                   part: int = PART) -> DataFrame:
    """The rows of ``docs`` as doc_id, text, keys and ``repeats``: array<struct<start, stop>> of byte ranges that
    windows of ``span`` bytes cover which also start elsewhere; in no order, overlapping."""
    if not 2 * ANCHOR <= span <= 1000:
        raise ValueError(f"span must lie between {2 * ANCHOR} and 1000")
    slim = with_keys(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    anchors = slim.select(*KEYS, "text").mapInArrow(
        lambda it: anchor_batches(it, span), "_k1 long, _k2 binary, pack long, h long, whole long")
    often = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    meets = stored(anchors.join(often, "h"), "anchors")
    classes = meets.groupBy("h", "whole").agg(
        F.count("*").alias("n"), F.min(F.struct(*KEYS, "pack")).alias("one"))
    mixed_groups = classes.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    parts = F.ceil(F.col("m") / part)
    edges = classes.join(mixed_groups, "h").select(
        F.col("one._k1").alias("_k1"), F.col("one._k2").alias("_k2"), F.struct(
            F.col("one.pack").alias("pack"), "h", F.pmod(F.xxhash64("whole"), parts).alias("part"),
            parts.alias("parts"), F.lit(span).alias("span")).alias("e"))
    edges = edges.groupBy(*KEYS).agg(F.collect_list("e").alias("edges"))
    cut = slim.select(*KEYS, "text").join(edges, KEYS).mapInArrow(cut_out_batches, RUN_COLUMNS)
    settled = (cut.repartition("h", "part").sortWithinPartitions("h", "part")
               .mapInArrow(lambda it: settle_batches(it, span), RESULT))
    settled = stored(settled, "settled")
    # at most one row per part and fingerprint, so these lists are as short as the number of parts
    across = (settled.where("f1 is not null").groupBy("f1", "f2")
              .agg(F.collect_list(F.struct(*KEYS, "start", "stop")).alias("all"))
              .where(F.size("all") > 1).select(F.inline("all")))
    start = F.shiftright("pack", 20)
    whole = meets.join(classes.where("n > 1").select("h", "whole"), ["h", "whole"], "left_semi").select(
        *KEYS, start.alias("start"),
        (start + F.shiftright("pack", 10).bitwiseAND(F.lit(1023)) + span).alias("stop"))
    ranges = (whole.unionByName(settled.where("f1 is null").select(*KEYS, "start", "stop")).unionByName(across)
              .groupBy(*KEYS).agg(F.collect_set(F.struct("start", "stop")).alias("repeats")))
    return slim.join(ranges, KEYS, "left")


def cut(text: bytes, repeats: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``text``, and the maximal removed ranges (ends excluded)."""
    spans = [(a, b + 1) for a, b in _merged([(a, b - 1) for a, b in repeats])]
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), spans


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, repeats in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                                         batch.column("repeats").to_pylist(), strict=True):
            raw = (text or "").encode()
            kept, spans = cut(raw, [(r["start"], r["stop"]) for r in repeats or ()])
            out.append((doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats_digest(spans: DataFrame) -> DataFrame:
    """Per document what removing its repeated spans leaves."""
    return spans.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "repeats").mapInArrow(
        digest_batches, DIGEST)
