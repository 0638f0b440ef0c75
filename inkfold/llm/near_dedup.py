"""Near-duplicates by SuperMinHash, banding, verification and union-find.

A text's set is its distinct word shingles, as 64-bit hashes. SuperMinHash gives every element one random
permutation of the signature's places and draws for them that rise by one each step, so that after step j no
place can fall below j: a signature is complete, and its computation stops, once its largest value lies below the
next step. Long texts take one or two steps however many places there are.

Texts with equal sets are one class. Bands of the signature put classes into buckets. In a bucket every class is
compared with one of them, on the full sets; links make components; a bucket that then holds one component is
settled. Buckets with several are compared with other members for a few rounds, and all classes that are still apart,
share a bucket and pass an exact bound on their difference are compared in full. So a group of n near copies costs
some n comparisons of sets, and no pair that shares a bucket is left out. The bound is on parities: every element flips one bit of its set's, so two
sets differ in at least as many elements as their parities in bits.

Null and empty texts have the empty set and link with nothing. A text of fewer words than a shingle is one shingle.
Repeated rows fall into one class. Null ids take part as classes but never represent a group if another id is there.
An empty table gives an empty table; further columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import KEYS, stored, unnamed, with_keys
from inkfold.llm.components import extended
from inkfold.llm.textbytes import U64, Powers, blocks, given_back, mixed, prefix_hashes, stretch_hashes

PLACES = 128
BANDS = 32  # of four places: a pair at 0.8 misses all bands with probability 5e-8
SIMILAR = 80
#: Rounds in which buckets are compared with a pivot, before what still differs is compared in full.
PIVOT_ROUNDS = 4
#: Words of 64 bits in a set's parity.
PARITY = 16
#: Bytes of text whose shingles a task holds at a time; some twenty arrays of 8 bytes a byte exist for them.
BLOCK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text: (text number, hash), sorted by both."""
    data = LOWER[data]
    blank = BLANK[data]
    begins = np.zeros(len(data), bool)  # where a word may begin: at a text's first byte and after blanks
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = ~blank & (begins | np.append(True, blank[:-1]))
    ends_text = np.zeros(len(data), bool)
    ends_text[(offsets[1:] - 1)[offsets[1:] > offsets[:-1]]] = True
    last = ~blank & (ends_text | np.append(blank[1:], True))
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[start]
    prefix = prefix_hashes(data, powers)
    words = mixed(stretch_hashes(prefix, powers, start, stop) + (stop - start).astype(U64))
    # a shingle's hash folds its words one after another; shorter texts fold what they have
    counts = np.bincount(row, minlength=len(offsets) - 1)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(row))  # words from here to the text's end
    folded = words.copy()
    for k in range(1, width):
        n = max(len(words) - k, 0)
        more = left[:n] > k
        folded[:n][more] = mixed(folded[:n][more] * U64(0xD6E8FEB86659FD93) + words[k:][more])
    whole = (left >= width) | ((left == counts[row]) & (counts[row] < width))
    row, folded = row[whole], folded[whole]
    order = np.lexsort((folded, row))
    row, folded = row[order], folded[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (folded[1:] != folded[:-1])
    return row[new], folded[new]


def super_minhash(row: np.ndarray, element: np.ndarray, rows: int, places: int = PLACES) -> np.ndarray:
    """Signatures (rows x places) of sets given as (row, element), sorted by row; empty sets keep infinity."""
    out = np.full(rows * places, np.inf)
    _steps(out, row, element, rows, places)
    return out.reshape(rows, places)


def _draws(element: np.ndarray, step: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """A random fraction and a random place in [step, places) of every element."""
    x = mixed(element + U64(((step + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
    fraction = (x >> U64(32)).astype(np.float64) * 2.0 ** -32
    place = step + (((x & U64(0xFFFFFFFF)) * U64(places - step)) >> U64(32)).astype(np.int64)
    return fraction, place


def _steps(out: np.ndarray, row: np.ndarray, element: np.ndarray, rows: int, places: int) -> None:
    fraction, place = _draws(element, 0, places)
    np.minimum.at(out, row * places + place, fraction)
    todo = np.flatnonzero(out.reshape(rows, places).max(axis=1) >= 1)
    todo = todo[np.bincount(row, minlength=rows)[todo] > 0]
    # sets that need more steps are small; a few thousand elements' permutations are held at a time
    sizes = np.bincount(row, minlength=rows)
    begin = np.cumsum(sizes) - sizes
    at = 0
    while at < len(todo):
        n, held = at, 0
        while n < len(todo) and (n == at or held + sizes[todo[n]] <= 20_000):
            held += sizes[todo[n]]
            n += 1
        chosen = todo[at:n]
        index = np.concatenate([np.arange(begin[r], begin[r] + sizes[r]) for r in chosen])
        _later_steps(out, row[index], element[index], place[index], places)
        at = n


def _later_steps(out: np.ndarray, row: np.ndarray, element: np.ndarray, first: np.ndarray, places: int) -> None:
    perm = np.tile(np.arange(places, dtype=np.int16), (len(row), 1))
    who = np.arange(len(row))
    perm[who, first], perm[:, 0] = 0, first
    for step in range(1, places):
        worst = out.reshape(-1, places)[row].max(axis=1)
        open_ = worst >= step
        if not open_.any():
            return
        row, element, perm = row[open_], element[open_], perm[open_]
        fraction, k = _draws(element, step, places)
        who = np.arange(len(row))
        here = perm[who, k].astype(np.int64)
        perm[who, k] = perm[:, step]
        perm[:, step] = here
        np.minimum.at(out, row * places + here, step + fraction)


def signature_batches(batches: Iterator[pa.RecordBatch], width: int, bands: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch, data, offsets in blocks(batches, "text", BLOCK):
        row, element = shingle_sets(data, offsets, width, powers)
        n = len(offsets) - 1
        sizes = np.bincount(row, minlength=n)
        signature = super_minhash(row, element, n)
        grouped = signature.reshape(n, bands, -1).view(U64)
        hashes = np.zeros((n, bands), U64)
        for j in range(grouped.shape[2]):
            hashes = mixed(hashes * U64(0xD6E8FEB86659FD93) + grouped[:, :, j])
        hashes = mixed(hashes + np.arange(bands, dtype=U64))
        ends = np.cumsum(sizes)
        raw = element.view(np.uint8)
        same = [xxhash.xxh3_128_digest(raw[8 * (e - s):8 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        flat = pa.array(hashes.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("doc_id", *KEYS)], pa.array(sizes.astype(np.int64)),
             pa.array(same, pa.binary()), lists], names=["doc_id", *KEYS, "n", "same", "bands"])


SIGNED = "doc_id long, _k1 long, _k2 binary, n long, same binary, bands array<long>"
SET = "class long, elements binary, parity array<long>"


def set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch, data, offsets in blocks(batches, "text", BLOCK):
        row, element = shingle_sets(data, offsets, width, powers)
        n = len(offsets) - 1
        bounds = np.append(0, np.cumsum(np.bincount(row, minlength=n))) * 8
        parity = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PARITY),
                                          pa.array(parities(row, element, n).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("class"), pa.Array.from_buffers(
                pa.large_binary(), n,
                [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(element.tobytes())]
            ).cast(pa.binary()), parity], names=["class", "elements", "parity"])


def parities(row: np.ndarray, element: np.ndarray, rows: int) -> np.ndarray:
    """PARITY words of every set, one after another: each element flips the bit its hash names."""
    out = np.zeros(rows * PARITY, U64)
    bit = element % U64(64 * PARITY)
    np.bitwise_xor.at(out, row * PARITY + (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return out


def element_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as rows of (class, element)."""
    for batch in batches:
        for owner, raw in zip(batch.column("class").to_pylist(), batch.column("elements"), strict=True):
            values = np.frombuffer(raw.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), owner)), pa.array(values)],
                                             names=["class", "element"])


def overlap_batches(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets agree enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            a, b = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= similar * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
            pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                    similar: int = SIMILAR, bands: int = BANDS) -> DataFrame:
    """Per row of ``docs``: doc_id, keys, ``n_shingles`` and ``component_id``, the least id of its group."""
    slim = with_keys(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                                 F.col(f"`{text}`").alias("text")))
    signed = stored(slim.select("doc_id", *KEYS, "text").mapInArrow(
        lambda it: given_back(signature_batches(it, width, bands)), SIGNED), "signatures")
    # a class is named by a key of its least row
    classes = signed.where("n > 0").groupBy("same").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(*KEYS)).alias("one"), F.first("n").alias("n"))
    named = stored(classes.select("same", "least", "one._k1", "one._k2", "n",
                                  F.xxhash64("same").alias("class")), "classes")
    members = (signed.select(*KEYS, "bands").dropDuplicates(KEYS).join(named.select(*KEYS, "class", "n"), KEYS)
               .select("class", "n", F.explode("bands").alias("bucket")))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    members = stored(members.join(crowded, "bucket"), "buckets")
    roots = _roots(slim, named, members, width, similar)
    labelled = named.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "same", "least", F.coalesce("root", "class").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = labelled.join(least, "root").select("same", "component_id")
    return signed.join(ids, "same", "left").select(
        "doc_id", *KEYS, F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _roots(slim: DataFrame, named: DataFrame, members: DataFrame, width: int, similar: int) -> DataFrame:
    """Components (node, root) by verified links between classes that share a bucket; no link would join more.

    Sets are made once, for the classes in crowded buckets. A few rounds compare the members of a bucket with one
    member of another component; what still differs then, and can be similar at all, is compared in full.
    """
    wanted = members.select("class").distinct().join(named.select("class", *KEYS), "class")
    texts = slim.select(*KEYS, "text").join(wanted, KEYS).dropDuplicates(["class"]).select("class", "text")
    sets = stored(texts.mapInArrow(lambda it: given_back(set_batches(it, width)), SET), "sets")
    roots = compared = rooted = None
    members = members.withColumn("shared", F.col("n"))
    pairs = _pivot_pairs(members.withColumn("root", F.col("class")), 0)
    for step in range(1, PIVOT_ROUNDS + 2):
        # a set has no more in common with any other than its shingles that some other set holds
        both = F.least("n", "m", "shared", "shared_m")
        pairs = pairs.where(100 * both >= similar * (F.col("n") + F.col("m") - both))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        before = roots
        if roots is None or not pairs.isEmpty():
            good = stored(
                pairs.join(sets.select(F.col("class").alias("a"), F.col("elements").alias("x")), "a")
                .join(sets.select(F.col("class").alias("b"), F.col("elements").alias("y")), "b")
                .mapInArrow(lambda it: given_back(overlap_batches(it, similar)), "a long, b long"), "verified")
            roots = extended(roots, good)
            compared = pairs if compared is None else compared.unionByName(pairs)
        if step > PIVOT_ROUNDS:
            break
        if roots is not before:  # else the same buckets are open, with the same members
            rooted = _open_buckets(members, roots)
            if rooted.isEmpty():
                break
        if step == 1:
            rooted = _with_shared(rooted, sets)
        members = rooted.drop("root")
        pairs = _pivot_pairs(rooted, step) if step < PIVOT_ROUNDS else _remaining_pairs(rooted, sets, similar)
    return roots


def _open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with their ``root``."""
    rooted = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s")
    return stored(rooted.join(several.select("bucket"), "bucket").select("bucket", "class", "n", "shared", "root"),
                  "open")


def _with_shared(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """``rooted`` with ``shared``: the shingles of a class that another class of an open bucket holds as well."""
    open_sets = sets.select("class", "elements").join(rooted.select("class").distinct(), "class", "left_semi")
    elements = open_sets.mapInArrow(lambda it: given_back(element_batches(it)), "class long, element long")
    alone = elements.groupBy("element").agg(F.count("*").alias("c"), F.min("class").alias("class")).where("c = 1")
    own = alone.groupBy("class").agg(F.count("*").alias("own"))
    return stored(rooted.join(own, "class", "left").withColumn(
        "shared", F.col("n") - F.coalesce("own", F.lit(0))).drop("own"), "open")


def _pivot_pairs(rooted: DataFrame, step: int) -> DataFrame:
    """Every member of a bucket with one member, the pivot, if that belongs to another component.

    At first the pivot is the least class, so that a group meets the same pivot in all its buckets; then the one
    with the fewest shingles of its own, the likely origin of the others; then another one in every bucket.
    """
    rank = (F.col("class") if step == 0 else F.col("n") - F.col("shared") if step == 1
            else F.xxhash64(F.lit(step), "bucket", "class"))
    pivot = rooted.groupBy("bucket").agg(F.min(F.struct(
        rank.alias("rank"), "class", "n", "shared", "root")).alias("p"))
    return rooted.join(pivot, "bucket").where(F.col("root") != F.col("p.root")).select(
        F.col("p.class").alias("a"), F.col("p.n").alias("m"), F.col("p.shared").alias("shared_m"),
        F.col("class").alias("b"), "n", "shared")


def _remaining_pairs(rooted: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Classes of different components that share a bucket and whose difference may be small enough.

    Classes with too many shingles of their own can link with nothing and are left out. All bounds are in the
    condition of the join, so that it emits no pair that they rule out.
    """
    able = rooted.where(100 * F.col("shared") >= similar * F.col("n")).join(sets.select("class", "parity"), "class")
    x = able.select("bucket", F.col("class").alias("a"), F.col("n").alias("m"), F.col("shared").alias("shared_m"),
                    F.col("root").alias("r"), F.col("parity").alias("p"))
    y = able.select("bucket", F.col("class").alias("b"), "n", "shared", F.col("root").alias("s"),
                    F.col("parity").alias("q"))
    both = F.least("n", "m", "shared", "shared_m")
    differ = sum((F.bit_count(F.col("p")[i].bitwiseXOR(F.col("q")[i])) for i in range(PARITY)), F.lit(0))
    return (x.join(y, "bucket").where((F.col("r") < F.col("s"))
                                      & (100 * both >= similar * (F.col("n") + F.col("m") - both))
                                      & ((100 + similar) * differ <= (100 - similar) * (F.col("n") + F.col("m"))))
            .select("a", "m", "shared_m", "b", "n", "shared"))


def near_digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_shingles", "component_id",
                       F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: Ids that stand for missing ones begin here: they come after all others.
NO_ID = 1 << 62


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one row of every group: of the least id, where it has one; of rows that are repeated with their id,
    and of copies without ids, one as well. Rows without words are in no group and stay. Same columns, whatever their
    names; ids that are no whole numbers are compared by a hash."""
    rows, body, back = unnamed(docs, doc_id, text)
    filled = F.coalesce(F.col(body), F.lit(""))
    rows = rows.withColumn("id", F.coalesce("id", F.lit(NO_ID) + F.xxhash64(filled).bitwiseAND(F.lit(NO_ID - 1))))
    # keys and ids only, but joined twice below: written once, the plan that carries the texts stays short
    found = stored(near_duplicates(rows, "id", body, **settings).where("n_shingles > 0")
                   .select("doc_id", *KEYS, "component_id"), "found")
    out = found.where(F.col("doc_id") != F.col("component_id")).select(*KEYS).distinct()
    kept = with_keys(rows, "id", body).join(out, KEYS, "left_anti")
    # one of the rows that share id and text: each task keeps one before they are shuffled
    again = found.groupBy(*KEYS).agg(F.count("*").alias("rows")).where("rows > 1").select(*KEYS)
    first = F.row_number().over(Window.partitionBy(*KEYS).orderBy("id"))
    one = kept.join(again, KEYS, "left_semi").withColumn("first", first).where("first = 1").drop("first")
    return back(kept.join(again, KEYS, "left_anti").unionByName(one))
