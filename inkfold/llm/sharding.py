"""Shards of near equal bytes by histogram sort.

Documents are ordered by a 64-bit hash of their text, so equal texts stay together. Splitters between shards are
found by counting: all bytes are counted below evenly spread probes, the probes around every wanted boundary are
refined, and again, until each splitter lies within a tolerance of its target. Then rows move once.

A group of equal texts larger than the tolerance would push a boundary aside. There are few of them by
arithmetic (fewer than shards / tolerance), so they are dealt out first, largest to the emptiest shard, and the
splitters share out what remains of every shard's room. Only a group larger than a whole shard is divided, by a hash of
the ids. Where rows that are repeated with their id are more than a splitter may miss, this hash cannot part them: the
rows are written once then, and the divided groups are ordered by a number every written row has.

Only DataFrame functions are used. Null text has no bytes; every row counts 16 bytes besides its text. Rows with
null ids and repeated rows are rows like others; an empty table gives an empty table. Columns named like one that is
added get an underscore behind their name; other columns keep theirs, whatever it is.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import renamed, stored, unnamed

ROW_BYTES = 16
#: Share of a shard that a splitter may miss its target by, and from which a group counts as large.
TOLERANCE = 0.005
PROBE_BITS = 12
REFINE_BITS = 8
#: Runs inside a shard that are numbered apart from each other.
RUNS = 64


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus size, text_crc32, ``_at`` (place in the order, an unsigned hash made signed) and ``_tie``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumns({
        "size": (F.octet_length(body) + ROW_BYTES).cast("long"),
        "text_crc32": F.crc32(body.cast("binary")),
        "_at": F.xxhash64(body),
        "_tie": F.xxhash64(F.col(f"`{doc_id}`").cast("string"), body),
    })


def _probe_of(at: Column, bits: int) -> Column:
    """The number of the probe interval of a place: its upper bits, with the sign turned so that order holds."""
    return F.shiftright(at, 64 - bits) + F.lit(1 << (bits - 1)).cast("long")


def find_splitters(sizes: DataFrame, targets: list[int], slack: float) -> list[int]:
    """Probe numbers of 64-bit places, one per target: the bytes below a splitter meet its target within
    ``slack`` where the order allows it.

    ``sizes`` has ``_at`` and ``size``. Each round counts exactly, in partial sums on the executors; the driver
    sees 2^12 counts at first and 2^8 counts per open boundary after that.
    """
    bits = PROBE_BITS
    counts = dict(sizes.groupBy(_probe_of(F.col("_at"), bits).alias("p")).agg(F.sum("size").alias("b"))
                  .collect())
    # open boundaries: target -> (first probe of its interval, bytes below it)
    found: dict[int, int] = {}
    state = _narrow(targets, {0: (0, sorted(counts.items()))}, dict.fromkeys(targets, 0), bits)
    while True:
        still = {}
        for target, (probe, below, inside) in state.items():
            if inside <= slack or bits == 64 or below == target:
                nearer = probe if target - below <= below + inside - target else probe + 1
                found[target] = min(nearer << (64 - bits), (1 << 64) - 1)
            else:
                still[target] = (probe, below)
        if not still:
            return [found[t] for t in targets]
        step = min(REFINE_BITS, 64 - bits)
        parents = sorted({p for p, _ in still.values()})
        rows = (sizes.where(_probe_of(F.col("_at"), bits).isin(parents))
                .groupBy(_probe_of(F.col("_at"), bits).alias("q"), _low(F.col("_at"), bits, step).alias("p"))
                .agg(F.sum("size").alias("b")).collect())
        inside: dict[int, list] = {p: [] for p in parents}
        for q, p, b in rows:
            inside[q].append(((q << step) + p, b))
        below = {p: b for p, b in still.values()}
        state = _narrow(list(still), {p: (below[p], sorted(inside[p])) for p in parents},
                        {t: p for t, (p, _) in still.items()}, bits)
        bits += step


def _low(at: Column, bits: int, step: int) -> Column:
    """The ``step`` bits of a place that follow its upper ``bits``."""
    return F.shiftright(at, 64 - bits - step).bitwiseAND(F.lit((1 << step) - 1).cast("long"))


def _narrow(targets, intervals, parent, bits) -> dict:
    """The probe interval each target falls in: (probe, bytes below it, bytes in it)."""
    out = {}
    for t in targets:
        below, counts = intervals[parent[t]]
        probe, inside = 0, 0
        for probe, inside in counts:
            if below + inside > t:
                break
            below += inside
        else:
            probe, inside = probe + 1, 0
        out[t] = (probe, below, inside)
    return out


def _deal(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, list], list[int]]:
    """Large groups to shards, largest first, each to the emptiest; one that does not fit is cut to the room.

    Returns pieces per group as (bytes up to here, shard), and the bytes already in every shard.
    """
    room = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    load = [0] * shards
    pieces: dict[int, list] = {}
    for at, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        done = 0
        while done < size:
            s = max(range(shards), key=lambda i: (room[i] - load[i], -i))
            free = room[s] - load[s]
            take = size - done if size <= max(room) or free <= 0 else min(size - done, free)
            load[s] += take
            done += take
            pieces.setdefault(at, []).append((done, s))
    return pieces, load


def histogram_shards(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text",
                     tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` plus size, text_crc32, shard and slot (gapless from 0 in every shard), moved by one exchange.

    Order inside a shard follows the hash of the text, then a hash of the id.
    """
    added = ["size", "text_crc32", "shard", "slot"]
    docs_id, docs_text = docs.columns.index(doc_id), docs.columns.index(text)
    docs = renamed(docs, *added)
    inner, body, back = unnamed(docs, docs.columns[docs_id], docs.columns[docs_text], added)
    rows = sized(inner, "id", body)
    sizes = stored(rows.select("_at", "_tie", "size"), "shard_sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    share = max(total / shards, 1.0)
    large = (sizes.groupBy("_at").agg(F.sum("size").alias("b")).where(F.col("b") > tolerance * share)
             .collect())  # fewer than shards / tolerance groups can be this large
    groups = [(r["_at"], r["b"]) for r in large]
    pieces, load = _deal(groups, shards, total)
    cut = [at for at, p in pieces.items() if len(p) > 1]
    if cut:
        same = (sizes.where(F.col("_at").isin(cut)).groupBy("_at", "_tie").agg(F.sum("size").alias("b"))
                .where(F.col("b") > tolerance * share))
        if not same.isEmpty():
            own = F.when(F.col("_at").isin(cut), F.xxhash64("_tie", F.monotonically_increasing_id())).otherwise(F.col("_tie"))
            rows = stored(rows.withColumn("_tie", own), "shard_rows")
            sizes = rows.select("_at", "_tie", "size")
    light = sizes.where(~F.col("_at").isin([at for at, _ in groups])) if groups else sizes
    targets, done = [], 0
    for s in range(shards - 1):
        done += max(0, total * (s + 1) // shards - total * s // shards - load[s])
        targets.append(done)
    # equal targets stand for shards without room
    unique = sorted(set(targets))
    where = dict(zip(unique, find_splitters(light, unique, tolerance * share), strict=True))
    splits = [where[t] for t in targets]
    shard = _by_splitters(F.col("_at"), splits)
    rows, sizes = _with_whole(rows, pieces), _with_whole(sizes, pieces)
    shard = F.coalesce("_whole", shard)
    for at in cut:  # each is larger than a shard: at most ``shards`` of them
        bounds = [b for b, _ in pieces[at][:-1]]
        inner = sizes.where(F.col("_at") == at).select(F.col("_tie").alias("_at"), "size")
        ties = find_splitters(inner, bounds, tolerance * share)
        order = F.array(*[F.lit(s) for _, s in pieces[at]])
        shard = F.when(F.col("_at") == at, F.get(order, _by_splitters(F.col("_tie"), ties))).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    counted = sizes.withColumn("shard", shard.cast("int"))
    run = F.pmod(F.shiftright("_tie", 8), F.lit(RUNS)).cast("int").alias("_run")
    # rows of a run are numbered apart; the rows of the runs before it are added (shards x RUNS counts)
    before = counted.groupBy("shard", run).agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(
            Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dealt = placed.withColumn("_run", run).join(
        F.broadcast(before.select("shard", "_run", "_before")), ["shard", "_run"])
    nth = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_at", "_tie"))
    slotted = dealt.withColumn("slot", F.col("_before") + nth - 1)
    return back(slotted)


def _by_splitters(at: Column, splits: list[int]) -> Column:
    """How many splitters lie at or below a place, by halving the list."""
    signed = sorted(s - (1 << 63) for s in splits)

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at < F.lit(signed[mid]).cast("long"), part(lo, mid)).otherwise(part(mid + 1, hi))

    return part(0, len(signed))


def _with_whole(rows: DataFrame, pieces: dict[int, list]) -> DataFrame:
    """``rows`` plus ``_whole``: the shard of a large group that stays whole, else null. The table that is
    broadcast has fewer than shards / tolerance rows."""
    whole = {at: p[0][1] for at, p in pieces.items() if len(p) == 1}
    if not whole:
        return rows.withColumn("_whole", F.lit(None).cast("int"))
    shard_of = F.from_json(F.lit(json.dumps([{"_at": at, "_whole": s} for at, s in whole.items()])),
                           "array<struct<_at:bigint,_whole:int>>")
    return rows.join(F.broadcast(rows.sparkSession.range(1).select(F.inline(shard_of))), "_at", "left")


def shard_digest(sharded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return sharded.select(
        F.col(f"`{doc_id}`").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
