"""Toxicity by class-conditional Kneser-Ney models of how words are spelled.

Two models, one of toxic and one of ordinary texts, give every character of a word a probability after the characters
before it. Strings of LONG down to SHORT + 1 characters are counted per class, with absolute discounting and
continuation counts; what is rare or unknown in a class backs off to shorter strings, whose continuation counts are
shared by both models and taken from the whole corpus. So a rare expression, or a form of an expression that no label has
shown, weighs by the parts of it that a class knows, and one that neither knows weighs nothing.

A word's evidence is the difference of its two log-likelihoods. Of a text it is added up and divided by the text's length;
beside this mean stand the share of words whose evidence is strong, and the strongest evidence per character. A logistic
curve over the three, fitted on labelled texts that the models have not counted, makes the score.

The fit reads a bounded sample: SAMPLE labelled rows, texts of up to LONGEST bytes, and keeps GRAMS strings per length,
the commonest. So the model that tasks are sent is bounded. The shared counts come from all texts: every task emits the
distinct short strings of its words, and Spark adds them up. All texts are scored whole.

Null and blank texts have no words; their score is that of no evidence. Repeated rows are scored alike, and count in the
shared counts, which are of distinct strings, as one. Labels without id, or of value null, are not used; of repeated
labels the mean counts. Without a label, or with labels of one value only, the score of every row is that value's share
(0.5 without any). Ids may be of any type, may be null, and are handed through. Further columns are not used, whatever
their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import stored
from inkfold.llm.decontaminate import WORD_BYTES
from inkfold.llm.textbytes import U64, blocks, mixed

SAMPLE, LONGEST, GRAMS = 6000, 30_000, 400_000
#: Characters of the strings that are counted per class at most, and that are shared at most. Three signs fill a key.
LONG, SHORT = 5, 2
SIGN_BITS = 21
DISCOUNT = 0.75
#: Words that a task remembers the evidence of, and words that are spelled at a time.
REMEMBERED, SPELLED = 400_000, 50_000
#: The sign before and behind every word.
EDGE = " "
#: Evidence from which a word counts as strong.
STRONG = 4.0
#: Probability of a sign after a context that nothing is known of.
UNKNOWN = 1e-4
BASE = U64(0x9E3779B97F4A7C15)
FEATURES = 3
RIDGE = 1e-2


# --- strings of words ------------------------------------------------------------------------------------------


def signs_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words of a text, with EDGE between them, and the place of every sign in its word. A sign at
    place 0 stands before a word; the sign behind a word has the place after its last."""
    plain = b" " + text.translate(WORD_BYTES) + b" "
    points = np.frombuffer(plain.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    edge = points == ord(EDGE)
    place = np.arange(len(points), dtype=np.int32)
    before = np.maximum.accumulate(np.where(edge, place, 0))
    before = np.append(np.int32(0), before[:-1])  # the last edge before a sign
    at = place - before
    at[edge & np.append(True, edge[:-1])] = 0
    return points, at


def packed_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of up to SHORT + 1 signs, packed into 64 bits, and how often they occur: for every sign of a
    word and the one behind it, it and what stands before it in the word, SHORT signs at most."""
    points, at = signs_of(text)
    sign = points.astype(np.int64)
    key = np.zeros(len(sign), np.int64)
    for back in range(SHORT, -1, -1):
        moved = np.append(np.zeros(back, np.int64), sign[:len(sign) - back])
        key = (key << SIGN_BITS) | np.where(at >= back, moved, 0)
    return np.unique(key[at > 0], return_counts=True)


def unpacked(keys: np.ndarray) -> list[str]:
    signs = np.stack([(keys >> (SIGN_BITS * i)) & ((1 << SIGN_BITS) - 1) for i in range(SHORT, -1, -1)], axis=1)
    length = (signs > 0).sum(axis=1)
    text = signs.astype("<u4").tobytes().decode("utf-32-le")
    return [text[(SHORT + 1) * (i + 1) - n:(SHORT + 1) * (i + 1)] for i, n in enumerate(length.tolist())]


def corpus_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct short strings of every block of texts, and how often they occur in it."""
    for _, data, offsets in blocks(batches, "_text"):
        keys, n = packed_counts(_parted(data, offsets))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])


def _parted(data: np.ndarray, offsets: np.ndarray) -> bytes:
    """The texts of a block with a blank between them."""
    raw = data.tobytes()
    return b" ".join([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed strings as strings."""
    for batch in batches:
        grams = unpacked(batch.column("key").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), batch.column("n")], names=["gram", "n"])


def class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct strings of up to LONG signs of labelled texts, by label."""
    for batch in batches:
        labels = batch.column("label").to_numpy()
        for label in (0, 1):
            some = batch.filter(pa.array(labels == label))
            for _, data, offsets in blocks([some], "_text"):
                points, at = signs_of(_parted(data, offsets))
                text = points.astype("<u4").tobytes().decode("utf-32-le")
                grams, n = [], []
                rolls = rolled(points, LONG)
                for length in range(2, LONG + 1):
                    # strings shorter than the longest are those at a word's beginning
                    ends = np.flatnonzero((at >= length - 1) if length == LONG else (at == length - 1))
                    _, first, times = np.unique(rolls[length][ends], return_index=True, return_counts=True)
                    grams += [text[e - length + 1:e + 1] for e in ends[first].tolist()]
                    n.append(times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams, pa.string()), pa.array(np.concatenate(n)), pa.array([label] * len(grams), pa.int32())],
                    names=["gram", "n", "label"])


def rolled(points: np.ndarray, longest: int) -> list[np.ndarray]:
    """Polynomials modulo 2^64 of the 0, 1, ... ``longest`` signs that end at every place."""
    sign = points.astype(U64) + U64(1)
    out = [np.zeros(len(points), U64)]
    for _ in range(longest):
        out.append(np.append(U64(0), out[-1][:-1]) * BASE + sign)
    return out


def key_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Strings of one length as the keys by which ``evidence`` looks for them and for their contexts."""
    for batch in batches:
        points = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), "<u4")
        points = points.astype(U64).reshape(batch.num_rows, length) + U64(1)
        keys = [np.zeros(batch.num_rows, U64)]
        for i in range(length):
            keys.append(keys[-1] * BASE + points[:, i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(mixed(keys[i]).view(np.int64)) for i in (-1, -2)]
            + [batch.column(c) for c in batch.schema.names[1:]], names=["key", "context", *batch.schema.names[1:]])


# --- counts ----------------------------------------------------------------------------------------------------


def shared_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct strings of up to SHORT + 1 signs of the words of all texts: ``gram`` and its occurrences ``n``."""
    texts = docs.select(F.col(f"`{text}`").alias("_text"))
    keys = texts.mapInArrow(corpus_batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return keys.mapInArrow(text_batches, "gram string, n long")


def levels(all_of: DataFrame, longest: int, shortest: int, counts: list[str]) -> dict[int, DataFrame]:
    """Kneser-Ney counts of the strings of every length, per column of ``counts``: occurrences for the longest and for
    those at the beginning of a word, elsewhere the number of signs that stand before the string."""
    at = all_of.where(F.char_length("gram") == longest).select("gram", *counts)
    out = {longest: at}
    for length in range(longest - 1, shortest - 1, -1):
        initial = all_of.where((F.char_length("gram") == length) & F.col("gram").startswith(EDGE))
        inner = at.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(
            *[F.count_if(F.col(c) > 0).alias(c) for c in counts])
        out[length] = at = initial.select("gram", *counts).unionByName(inner)
    return out


def _with_context(level: DataFrame, counts: list[str]) -> DataFrame:
    """Strings with the total and the kinds of what follows their context, per count."""
    context = F.expr("substring(gram, 1, char_length(gram) - 1)").alias("context")
    per = level.groupBy(context).agg(
        *[F.sum(c).alias(f"{c}_all") for c in counts], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in counts])
    return level.select("gram", *counts, context).join(per, "context").drop("context")


# --- the model -------------------------------------------------------------------------------------------------


def is_held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled texts, by the hash of their id: ``_text``, ``label``, ``aside`` (every fourth, which
    is for the fit of the curve only)."""
    known = (labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").alias("_l"))
             .where(F.col("_id").isNotNull() & F.col("_l").isNotNull() & ~is_held_out(F.col("_id")))
             .groupBy("_id").agg((F.avg("_l") >= 0.5).cast("int").alias("label")))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # so the broadcast side is bounded
    texts = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    rows = texts.where(F.octet_length("_text") <= LONGEST).join(F.broadcast(chosen), "_id")
    # of an id that is repeated one text is taken, so that the sample stays bounded
    return (rows.groupBy("_id", "label").agg(F.min("_text").alias("_text"))
            .select("_text", "label", (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(4)) == 0).alias("aside")))


def slots_of(keys: np.ndarray) -> np.ndarray:
    """An open hash table of distinct keys: slot -> 1 + place of the key, 0 where a slot is free."""
    bits = max(int(4 * len(keys)).bit_length(), 4)
    slots = np.zeros(1 << bits, np.int32)
    slot = (keys >> U64(64 - bits)).astype(np.int64)
    left = np.arange(len(keys))
    while len(left):
        free = left[slots[slot[left]] == 0]
        slots[slot[free]] = free + 1  # of several keys for a slot the last one stays
        left = left[slots[slot[left]] != left + 1]
        slot[left] = (slot[left] + 1) & (len(slots) - 1)
    return slots


def find(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """The place of every key in (slots, keys), -1 for unknown ones."""
    slots, keys = table
    slot = (wanted >> U64(64 - (len(slots).bit_length() - 1))).astype(np.int64)
    out = slots[slot].astype(np.int64) - 1
    todo = np.flatnonzero(out >= 0)
    todo = todo[keys[out[todo]] != wanted[todo]]
    while len(todo):
        slot[todo] = (slot[todo] + 1) & (len(slots) - 1)
        out[todo] = slots[slot[todo]] - 1
        todo = todo[out[todo] >= 0]
        todo = todo[keys[out[todo]] != wanted[todo]]
    return out


def _table(rows: DataFrame, length: int, counts: list[str]) -> dict:
    """Strings of one length and their contexts, by key. A string has the discounted share of its context per count; a
    context has what it leaves to the shorter string (1 where the class has not seen it)."""
    more = [f"{c}{end}" for c in counts for end in ("", "_all", "_kinds")]
    keyed = rows.select("gram", *more).mapInArrow(
        lambda it: key_batches(it, length), "key long, context long, " + ", ".join(f"{c} long" for c in more))
    read = keyed.orderBy("key").toArrow()  # numbers only
    column = {c: read.column(c).to_numpy() for c in read.column_names}
    keys = column["key"].view(U64)
    contexts, first, which = np.unique(column["context"].view(U64), return_index=True, return_inverse=True)
    share, left = [], []
    for c in counts:
        total = np.maximum(column[f"{c}_all"], 1)
        share.append(np.maximum(column[c] - DISCOUNT, 0) / total)
        left.append(np.where(column[f"{c}_all"] > 0, DISCOUNT * column[f"{c}_kinds"] / total, 1.0)[first])
    return {"grams": (slots_of(keys), keys), "contexts": (slots_of(contexts), contexts), "context": which,
            "share": np.array(share), "left": np.array(left)}


def fit_spelling(sample: DataFrame, shared: DataFrame, grams: int = GRAMS) -> dict[int, dict]:
    """By length of string, the table of both classes (above SHORT) or of the shared counts (up to SHORT).

    Of every length the commonest ``grams`` strings of the sample are kept, and shared counts for the endings of these.
    """
    counted = sample.where("not aside").mapInArrow(class_batches, "gram string, n long, label int")
    both = ["plain", "toxic"]
    per = stored(counted.groupBy("gram").agg(*[
        F.sum(F.when(F.col("label") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(both)]), "class_grams")
    out, kept = {}, None
    for length, level in levels(per, LONG, SHORT + 1, both).items():
        kept = stored(_with_context(level, both).orderBy(F.desc(F.col("toxic") + F.col("plain")), "gram").limit(grams),
                      "class_level")
        out[length] = _table(kept, length, both)
    for length, level in levels(shared, SHORT + 1, 1, ["n"]).items():
        if length <= SHORT:
            ends = kept.select(F.expr(f"right(gram, {length})").alias("gram")).distinct()
            out[length] = _table(_with_context(level, ["n"]).join(ends, "gram"), length, ["n"])
    return out


def evidence(words: list[bytes], tables: dict[int, dict]) -> np.ndarray:
    """Toxic less ordinary log-likelihood of every word."""
    points, at = signs_of(b" ".join(words))
    rolls = rolled(points, LONG)
    place = np.flatnonzero(at > 0)  # what is predicted: all signs but the first edge
    depth = at[place]
    odds = np.full((2, len(place)), UNKNOWN)
    for length in range(1, LONG + 1):
        some = np.flatnonzero(depth >= length - 1)
        ends = place[some]
        table = tables[length]
        gram = find(table["grams"], mixed(rolls[length][ends]))
        known = gram >= 0
        context = np.full(len(some), -1)
        context[known] = table["context"][gram[known]]
        context[~known] = find(table["contexts"], mixed(rolls[length - 1][ends[~known] - 1]))
        seen = context >= 0
        some, gram, context = some[seen], gram[seen], context[seen]
        lower = odds[:, some] * table["left"][:, context]
        odds[:, some] = lower + np.where(gram >= 0, table["share"][:, np.maximum(gram, 0)], 0)
    word = np.cumsum(points == ord(EDGE))[place] - 1 - (points[place] == ord(EDGE))
    return np.bincount(word, np.log(odds[1]) - np.log(odds[0]), len(words))


class Evidence:
    """Evidence and length of words, spelled once per word; starts anew when it has grown large."""

    def __init__(self, tables: dict[int, dict]) -> None:
        self.tables = tables
        self.number: dict[bytes, int] = {}
        self.value = np.zeros(0)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > REMEMBERED:
            self.number, self.value = {}, np.zeros(0)
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        open_ = np.flatnonzero(ids < 0)
        if len(open_):
            new = list(dict.fromkeys([words[i] for i in open_.tolist()]))
            parts = [evidence(new[lo:lo + SPELLED], self.tables) for lo in range(0, len(new), SPELLED)]
            self.number.update(zip(new, range(len(self.value), len(self.value) + len(new)), strict=True))
            self.value = np.concatenate([self.value, *parts])
            ids[open_] = [self.number[words[i]] for i in open_.tolist()]
        return self.value[ids]


def features(data: np.ndarray, offsets: np.ndarray, known: Evidence) -> np.ndarray:
    """Per text of a block: evidence per byte of its words, the root of the share of strong words, the strongest
    evidence per byte. A text without words has none of it."""
    n = len(offsets) - 1
    raw = data.tobytes().translate(WORD_BYTES)
    split = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    words = [w for part in split for w in part]
    row = np.repeat(np.arange(n), [len(part) for part in split])
    value = known.of(words)
    size = np.fromiter(map(len, words), np.float64, len(words)) + 1
    total = np.maximum(np.bincount(row, minlength=n), 1)
    peak = np.full(n, -np.inf)
    np.maximum.at(peak, row, value / size)
    return np.stack([np.bincount(row, value, n) / np.maximum(np.bincount(row, size, n), 1),
                     np.sqrt(np.bincount(row, value > STRONG, n) / total), np.where(np.isfinite(peak), peak, 0)], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Mean and scale of the features and the weights (the last without a feature) of a ridge logistic regression, by
    Newton steps; both labels weigh the same."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(FEATURES + 1)
    ridge = RIDGE * np.append(np.ones(FEATURES), 0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge * w
        bend = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge + 1e-9)
        w = w - np.linalg.solve(bend, slope)
    return [mean, scale, w]


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          sample: int = SAMPLE) -> dict:
    """The model: ``share`` of label 1, and, where both labels occur, ``tables`` and ``curve``."""
    rows = stored(labelled_sample(docs, labels, doc_id, text, label, sample), "toxic_sample")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    model: dict = {"share": ones / n if n else 0.5, "tables": None, "curve": None}
    per = dict(rows.groupBy("aside").agg(F.count_distinct("label")).collect())
    if per.get(False) != 2:
        return model
    shared = stored(shared_counts(docs, text), "shared_grams")
    tables = fit_spelling(rows, shared)
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    names = [f"x{i}" for i in range(FEATURES)]
    aside = rows.where("aside") if per.get(True) == 2 else rows
    frame = aside.select("_text", "label").mapInArrow(
        lambda it: feature_batches(it, sent.value), "label int, " + ", ".join(f"{c} double" for c in names)
    ).orderBy(*names, "label").toArrow()  # at most ``sample`` rows of numbers
    x = np.column_stack([frame.column(c).to_numpy() for c in names])
    return model | {"tables": tables, "curve": fit_curve(x, frame.column("label").to_numpy().astype(np.float64))}


def feature_batches(batches: Iterator[pa.RecordBatch], tables: dict) -> Iterator[pa.RecordBatch]:
    """Rows with the features of ``_text`` in its place."""
    known = Evidence(tables)
    for part, data, offsets in blocks(batches, "_text"):
        x = features(data, offsets, known)
        rest = [c for c in part.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *[pa.array(x[:, i]) for i in range(FEATURES)]],
                                         names=[*rest, *[f"x{i}" for i in range(FEATURES)]])


def score_batches(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    if model["tables"] is None:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(batch.num_rows, model["share"]))], names=["doc_id", "score"])
        return
    mean, scale, w = model["curve"]
    for batch in feature_batches(batches, model["tables"]):
        x = np.column_stack([batch.column(f"x{i}").to_numpy() for i in range(FEATURES)])
        score = 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def toxicity(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``score``, 0 to 1, of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # (LONG - SHORT) x GRAMS strings, as arrays
    return rows.mapInArrow(lambda it: score_batches(it, sent.value), f"doc_id {kind}, score double")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs, learn(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
