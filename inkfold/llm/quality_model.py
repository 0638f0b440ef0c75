"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word of the training sample has a sparse random index vector; its word vector is the sum of the index vectors
of its neighbours, at unit length. Words carry the vector of their shape too (letters, capitals, digits, signs), so
that words never seen have one. A document is the mean of its word vectors, with pseudo-words for repeats of the
word before, of words, and of lines. The network has one hidden layer, is trained in numpy, and its probabilities
are calibrated by a temperature fitted on a part of the sample that training does not see.

The sample is bounded: SAMPLE labelled rows of the smallest id hashes, whole texts, those above LONGEST bytes left
out of the fit. Scoring covers all rows and whole texts. Ids, sources and languages are no inputs of a score.

Null text is scored as the empty text. Conflicting labels of an id are averaged; null labels are left out. Without
labels of both kinds the score is the share of label 1 (one half without labels). Repeated rows get equal scores; an
empty table gives an empty table.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import unnamed
from inkfold.llm.textbytes import given_back

SAMPLE = 4000
LONGEST = 200_000
WORDS = 20_000  # vectors kept, of the commonest words of the sample
WIDTH, NONZERO, HIDDEN = 64, 6, 24
NEAR = 2
STEPS, RATE, DECAY = 400, 0.02, 1e-3

#: Signs of byte classes in shapes.
SHAPE = bytes(b"a"[0] if 97 <= c <= 122 or c >= 128 else b"A"[0] if 65 <= c <= 90 else b"0"[0] if 48 <= c <= 57
              else b"."[0] if c in b".,;:'\"()?-" else b"!"[0] if c == 33 else b"#"[0] for c in range(256))
PSEUDO = ["<same as before>", "<seen before>", "<line seen before>"]


def shape_of(word: bytes) -> str:
    """The classes of a word's bytes in order, runs of a class once, and whether it is long."""
    signs = word.translate(SHAPE)
    out = signs[:1] + bytes(b for a, b in zip(signs, signs[1:], strict=False) if a != b)
    return "shape:" + out[:6].decode() + ("+" if len(word) > 24 else "")


def _random_vector(name: bytes) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(name))
    v = np.zeros(WIDTH, np.float32)
    v[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return v


@dataclass
class Vectors:
    """Rows of vectors: words with their shapes, shapes alone, pseudo-words; the last row is an unknown shape."""
    rows: dict = field(default_factory=dict)
    matrix: np.ndarray = field(default_factory=lambda: np.zeros((1, WIDTH), np.float32))

    @staticmethod
    def fit(texts: list[bytes]) -> Vectors:
        # the words of one text at a time: those of the whole sample would take some ten times its bytes
        counts: Counter = Counter()
        for t in texts:
            counts.update(t.split())
        common = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:WORDS] if n > 1]
        number = {w: i for i, w in enumerate(common)}
        index = np.array([_random_vector(w) for w in common], np.float32).reshape(-1, WIDTH)
        context = np.zeros_like(index)
        for t in texts:
            ids = np.array([number.get(w, -1) for w in t.split()])
            for step in range(1, NEAR + 1):
                a, b = ids[:-step], ids[step:]
                both = (a >= 0) & (b >= 0)
                np.add.at(context, a[both], index[b[both]])
                np.add.at(context, b[both], index[a[both]])
        context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-6)
        shapes = sorted({shape_of(w) for w in counts})
        by_shape = {s: 2 * _random_vector(s.encode()) for s in shapes}
        rows: dict = {}
        out = []
        for w, v in zip(common, context, strict=True):
            rows[w] = len(out)
            out.append(v + by_shape[shape_of(w)])
        for s, v in by_shape.items():
            rows[s] = len(out)
            out.append(v)
        for p in PSEUDO:
            rows[p] = len(out)
            out.append(2 * _random_vector(p.encode()))
        out.append(np.zeros(WIDTH, np.float32))
        return Vectors(rows, np.array(out, np.float32))


class Rows(dict):
    """Word -> row of its vector, made once per word; starts anew when it has grown large."""

    def __init__(self, vectors: Vectors) -> None:
        super().__init__()
        self.vectors = vectors

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        rows = self.vectors.rows
        row = rows.get(word)
        if row is None:
            row = rows.get(shape_of(word), len(self.vectors.matrix) - 1)
        self[word] = row
        return row


def pooled(text: bytes, rows: Rows) -> np.ndarray:
    """The document vector of a whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(WIDTH, np.float32)
    m = rows.vectors.matrix
    ids = np.fromiter(map(rows.__getitem__, words), np.int64, n)
    total = np.zeros(WIDTH, np.float64)
    for lo in range(0, n, 65536):
        total += m[ids[lo:lo + 65536]].sum(axis=0, dtype=np.float64)
    lines = [x for x in text.split(b"\n") if x]
    again = (len(lines) - len(set(lines))) / max(len(lines), 1) * n
    extra = (sum(map(operator.eq, words, words[1:])), n - len(set(words)), again)
    for name, count in zip(PSEUDO, extra, strict=True):
        total += count * m[rows.vectors.rows[name]]
    return (total / n).astype(np.float32)


@dataclass
class Network:
    """Standardised input, tanh layer, logit, temperature."""
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Full-batch Adam; both labels weigh the same."""
    rng = np.random.default_rng(7)
    net = {"w1": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "b1": np.zeros(HIDDEN),
           "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    m, v = ({k: np.zeros_like(p) for k, p in net.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ net["w1"] + net["b1"])
        d = weight * (_sigmoid(h @ net["w2"] + net["b2"]) - y)
        back = np.outer(d, net["w2"]) * (1 - h * h)
        grads = {"w1": z.T @ back + DECAY * net["w1"], "b1": back.sum(axis=0),
                 "w2": h.T @ d + DECAY * net["w2"], "b2": np.array([d.sum()])}
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net[k] = net[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Network(mean, scale, net["w1"], net["b1"], net["w2"], float(net["b2"][0]))


def fitted_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, from a grid."""
    grid = np.geomspace(0.2, 8, 60)

    def loss(t: float) -> float:
        p = np.clip(_sigmoid(logits / t), 1e-9, 1 - 1e-9)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    return float(min(grid, key=loss))


@dataclass
class Model:
    vectors: Vectors
    network: Network | None
    share: float  # of label 1, the score without a network


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """A model of (text, label) rows; every fifth row only calibrates."""
    y = np.array([q for _, q in rows], np.float64)
    vectors = Vectors.fit([t for t, _ in rows])
    if not len(y) or y.min() == y.max():
        return Model(vectors, None, float(y.mean()) if len(y) else 0.5)
    table = Rows(vectors)
    x = np.array([pooled(t, table) for t, _ in rows], np.float64)
    aside = np.arange(len(y)) % 5 == 4
    network = train(x[~aside], y[~aside])
    if aside.any():
        network.temperature = fitted_temperature(network.logits(x[aside]), y[aside])
    return Model(vectors, network, float(y.mean()))


def is_held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    known = (labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").alias("_q"))
             .where(F.col("_id").isNotNull() & F.col("_q").isNotNull() & ~is_held_out(F.col("_id")))
             .groupBy("_id").agg((F.avg("_q") >= 0.5).cast("int").alias("_q")))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # so the broadcast side is bounded
    texts = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    rows = (texts.join(F.broadcast(chosen), "_id").where(F.octet_length("_t") <= LONGEST)
            .groupBy("_id").agg(F.min(F.struct("_t", "_q")).alias("r")).orderBy(F.xxhash64("_id"), "_id")
            .limit(sample).select("r._t", "r._q").collect())
    return fit([(r["_t"].encode(), r["_q"]) for r in rows])


def score_batches(batches: Iterator[pa.RecordBatch], model: Model, text: str) -> Iterator[pa.RecordBatch]:
    rows = Rows(model.vectors)
    for batch in batches:
        texts = batch.column(text)
        if model.network is None:
            scores = np.full(len(texts), model.share)
        else:
            x = np.array([pooled((t.as_py() or "").encode(), rows) for t in texts], np.float64)
            scores = model.network.scores(x.reshape(-1, WIDTH))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                         names=[*batch.schema.names, "_score"])


def with_scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` plus ``score``, the calibrated probability of label 1."""
    # WORDS vectors and a small network, as plain values: workers need not know this module's classes by name
    sent = docs.sparkSession.sparkContext.broadcast(
        (vars(model.vectors), model.network and vars(model.network), model.share))

    def received() -> Model:
        vectors, network, share = sent.value
        return Model(Vectors(**vectors), network and Network(**network), share)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _score double"
    return docs.mapInArrow(lambda it: given_back(score_batches(it, received(), text)), schema).withColumnRenamed("_score", score)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    scored = with_scores(rows, learn(rows, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score is below one half. Same columns, whatever their names."""
    rows, body, back = unnamed(docs, "doc_id", "text")
    scored = with_scores(rows, learn(docs.select("doc_id", "text"), labels), body)
    return back(scored.where(F.col("score") >= 0.5))
