"""Source health: the per-domain failure count and back-off as a fold over a fetch log.

Each event is a function on (failures, back-off). A run of events is again such a function: the
failure count needs only the events after the last success, and the back-off map has the form
``min(high, max(low, factor * x))``, which is closed under composition. So runs of a bounded number of
consecutive events are composed where they lie, then the runs of a partition, then what is left: at most one run per
domain and partition. All of it is array folds in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Back-off bounds in seconds, failures before it grows, and its steps.
BASE = 1.0
CAP = 60.0
THRESHOLD = 3
GROW = 2.0
DECAY = 0.8

#: Bits of an event's number inside a run, and bits of its number inside a partition.
RUN_BITS, PARTITION_BITS = 12, 33


def _map(factor: float, low: float, high: float) -> Column:
    return F.struct(F.lit(factor).alias("factor"), F.lit(low).alias("low"), F.lit(high).alias("high"))


def _run(n: int, had_success: bool, tail: int, maps: list[Column]) -> Column:
    """A run of events. ``tail`` counts the failures after its last success; ``maps`` is the back-off map for each
    failure count (0, 1, 2 or more) before the run."""
    return F.struct(F.lit(n).cast("bigint").alias("n"), F.lit(had_success).alias("had_success"),
                    F.lit(tail).cast("bigint").alias("tail"), F.array(*maps).alias("maps"))


def no_event() -> Column:
    return _run(0, False, 0, [_map(1.0, BASE, CAP)] * THRESHOLD)


def with_event(run: Column, ok: Column) -> Column:
    """The run and after it one event."""
    def decayed(m: Column) -> Column:
        return F.struct((m["factor"] * DECAY).alias("factor"), F.greatest(F.lit(BASE), m["low"] * DECAY).alias("low"),
                        F.greatest(F.lit(BASE), m["high"] * DECAY).alias("high"))

    def grown(m: Column, before: Column) -> Column:
        low, high = F.least(F.lit(CAP), m["low"] * GROW), F.least(F.lit(CAP), m["high"] * GROW)
        # once both ends meet the start value no longer matters and the factor must not overflow
        more = F.struct(F.when(low < high, m["factor"] * GROW).otherwise(F.lit(1.0)).alias("factor"), low.alias("low"),
                        high.alias("high"))
        failures = F.when(run["had_success"], run["tail"]).otherwise(before + run["tail"]) + 1
        return F.when(failures >= THRESHOLD, more).otherwise(m)

    n = (run["n"] + 1).alias("n")
    success = F.struct(n, F.lit(True).alias("had_success"), F.lit(0).cast("bigint").alias("tail"),
                       F.transform(run["maps"], decayed).alias("maps"))
    failure = F.struct(n, run["had_success"].alias("had_success"), (run["tail"] + 1).alias("tail"),
                       F.transform(run["maps"], grown).alias("maps"))
    return F.when(ok, success).otherwise(failure)


def then(first: Column, second: Column) -> Column:
    """The run of ``first`` and after it ``second``."""
    def put(m: Column, g: Column) -> Column:
        low = F.least(g["high"], F.greatest(g["low"], g["factor"] * m["low"]))
        high = F.least(g["high"], F.greatest(g["low"], g["factor"] * m["high"]))
        # once both ends meet the start value no longer matters and the factor must not overflow
        factor = F.when(low < high, m["factor"] * g["factor"]).otherwise(F.lit(1.0))
        return F.struct(factor.alias("factor"), low.alias("low"), high.alias("high"))

    def mapped(m: Column, before: Column) -> Column:
        failures = F.when(first["had_success"], first["tail"]).otherwise(before + first["tail"])
        return put(m, F.get(second["maps"], _index(failures)))

    return F.struct(
        (first["n"] + second["n"]).alias("n"), (first["had_success"] | second["had_success"]).alias("had_success"),
        F.when(second["had_success"], second["tail"]).otherwise(first["tail"] + second["tail"]).alias("tail"),
        F.transform(first["maps"], mapped).alias("maps"))


def _index(failures: Column) -> Column:
    return F.least(failures, F.lit(THRESHOLD - 1).cast("bigint")).cast("int")


def _in_order(number: str, run: Column) -> Column:
    """The composition of the runs of a group, in the order of ``number``."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(number).alias("number"), run.alias("run"))))
    return F.aggregate(parts, no_event(), lambda s, r: then(s, r["run"]))


def log_summaries(fetch_log: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows (domain, block, run) that compose, in the order of ``block``, to all events of a domain, one per partition.

    Events are sorted in range partitions and numbered there; consecutive numbers make a run, whose array of events is
    of bounded length, and the runs of a partition are composed to one.
    """
    log = fetch_log.filter(F.col("domain").isNotNull()).select("domain", "ts", "event_id", "ok")
    keys = ["domain", "ts", "event_id"]
    ranged = log.repartitionByRange(partitions, *keys) if partitions else log.repartitionByRange(*keys)
    numbered = ranged.sortWithinPartitions(*keys).select(
        "domain", "ok", F.monotonically_increasing_id().alias("number"))
    events = F.array_sort(F.collect_list(F.struct("number", F.coalesce("ok", F.lit(False)).alias("ok"))))
    block = F.shiftright("number", RUN_BITS).alias("block")
    runs = numbered.groupBy("domain", block).agg(events.alias("events")).select(
        "domain", "block", F.aggregate("events", no_event(), lambda s, e: with_event(s, e["ok"])).alias("run"))
    of_partition = F.shiftright("block", PARTITION_BITS - RUN_BITS).alias("part")
    return runs.groupBy("domain", of_partition).agg(_in_order("block", F.col("run")).alias("run")).withColumnRenamed(
        "part", "block")


def fold_summaries(summaries: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Apply the summaries of every domain in order: (domain, events, failures, backoff).

    ``state`` holds earlier results of this function; its domains start from there.
    """
    runs = summaries.groupBy("domain").agg(_in_order("block", F.col("run")).alias("run"))
    old = "struct<events:bigint,failures:bigint,backoff:double>"
    if state is not None:
        runs = runs.join(state.select("domain", F.struct("events", "failures", "backoff").alias("old")), "domain", "full")
    else:
        runs = runs.withColumn("old", F.lit(None).cast(old))
    start = F.struct(F.lit(0).cast("bigint").alias("events"), F.lit(0).cast("bigint").alias("failures"),
                     F.lit(BASE).alias("backoff"))
    s, r = F.col("old"), F.col("run")
    m = F.get("run.maps", _index(s["failures"]))
    return runs.select("domain", F.coalesce("old", start).alias("old"), F.coalesce("run", no_event()).alias("run")).select(
        "domain", (s["events"] + r["n"]).alias("events"),
        F.when(r["had_success"], r["tail"]).otherwise(s["failures"] + r["tail"]).alias("failures"),
        F.least(m["high"], F.greatest(m["low"], m["factor"] * s["backoff"])).alias("backoff"))


def source_health(fetch_log: DataFrame, partitions: int | None = None) -> DataFrame:
    """Failure count and back-off of every domain after its last event, in (ts, event_id) order.

    A success sets the count to 0 and takes the back-off down by a fifth, never below 1; a failure adds
    one and from the third on doubles the back-off up to 60. An event that does not say whether it was one counts as a
    failure; events without domain are left out.
    """
    return fold_summaries(log_summaries(fetch_log, partitions))


def after(failures: int, backoff: float, ok: bool) -> tuple[int, float]:
    """One step of the fold, for states that are kept event by event."""
    if ok:
        return 0, max(BASE, backoff * DECAY)
    failures += 1
    return failures, min(CAP, backoff * GROW) if failures >= THRESHOLD else backoff
