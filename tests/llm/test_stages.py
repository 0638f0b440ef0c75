"""Pipeline stages on tables with everything a table can have: clashing names, text ids, null ids, repeated rows, none."""

import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkfold.llm import components, near_dedup
from inkfold.llm.bpe import encode_and_decode
from inkfold.llm.common import apart
from inkfold.llm.decontaminate import drop_contaminated
from inkfold.llm.near_dedup import drop_near_duplicates
from inkfold.llm.pii import mask_pii
from inkfold.llm.pii import scan as pii_scan
from inkfold.llm.quality_model import Vectors, keep_good
from inkfold.llm.queries import default_vocabulary

INNER = ["_k1", "_k2", "_spans", "spans", "score", "_score", "_quality_score", "ids", "decoded", "n", "class", "c0", "id", "hits",
         "same", "bands", "_id", "_text", "_t", "size", "first", "rows", "doc_id_"]
LONG = "the quick brown fox jumps over the lazy dog while seven other animals look on from the far side "
ROWS = [(1, LONG + "a"), (1, LONG + "a"), (2, LONG + "a"), (3, LONG + "b"), (None, LONG + "a"), (None, "x " * 30 + "alone"),
        (None, "x " * 30 + "alone"), (4, "write to joe@example.com now"), (5, None), (5, None), (6, ""), (7, "benchmark words in a row are here now so drop it ok"),
        (8, "short"), (8, "short"), (8, "other text of id eight"), (9, "y" * 60_000)]
BENCH = "benchmark words in a row are here now so drop it"


def docs(spark, text_ids=False, rows=ROWS):
    """Rows with a string in every inner name; ``_k1`` holds its row's number, so that none can be mixed up."""
    full = [(f"d{i}" if text_ids and i is not None else i, t, *[f"{c}-{k}" for c in INNER]) for k, (i, t) in enumerate(rows)]
    kind = "string" if text_ids else "long"
    return spark.createDataFrame(full, f"doc_id {kind}, text string, " + ", ".join(f"`{c}` string" for c in INNER))


def stages(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, BENCH), (None, None)], "item_id long, text string")
    return {"quality": lambda d: keep_good(d, labels.withColumn("doc_id", F.col("doc_id").cast(d.schema["doc_id"].dataType))),
            "near_dedup": drop_near_duplicates, "decontamination": lambda d: drop_contaminated(d, bench), "pii": mask_pii,
            "tokens": lambda d: encode_and_decode(d, default_vocabulary())}


@pytest.mark.parametrize("text_ids", [False, True])
def test_columns_come_back_as_they_were(spark, text_ids):
    table = docs(spark, text_ids)
    before = {r["_k1"]: r.asDict() for r in table.collect()}
    for name, stage in stages(spark).items():
        out = stage(table)
        rows = [r.asDict() for r in out.collect()]
        if name == "tokens":
            assert out.columns == [*["doc_id", "text", *[c + "_" if c in ("ids", "decoded") else c for c in INNER]], "ids", "decoded"]
            assert [r["decoded"] for r in rows] == [r["text"] or "" for r in rows] and len(rows) == len(ROWS)
            assert all(r["ids_"] == before[r["_k1"]]["ids"] for r in rows)
            continue
        assert out.schema == table.schema, name
        for r in rows:
            assert {k: v for k, v in r.items() if k != "text" or name != "pii"} == {
                k: v for k, v in before[r["_k1"]].items() if k != "text" or name != "pii"}, name
        assert len({r["_k1"] for r in rows}) == len(rows)
        if name == "pii":
            assert [r["text"] for r in rows if r["text"] and "write" in r["text"]] == ["write to <email> now"] and len(rows) == len(ROWS)
        if name == "decontamination":
            assert len(rows) == len(ROWS) - 1 and not [r for r in rows if r["text"] and r["text"].startswith("benchmark")]


@pytest.mark.parametrize("text_ids", [False, True])
def test_one_row_of_every_group(spark, text_ids):
    got = drop_near_duplicates(docs(spark, text_ids))
    texts = Counter(r["text"] for r in got.collect())
    group = [t for t in texts if t and t.startswith("the quick")]
    assert sum(texts[t] for t in group) == 1 and texts["x " * 30 + "alone"] == 1
    assert texts["short"] == 1 and texts["other text of id eight"] == 1
    assert texts[None] == 2 and texts[""] == 1  # without words: in no group
    if not text_ids:
        assert [r["doc_id"] for r in got.collect() if r["text"] in group] == [1]


def test_many_repeated_rows(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(LONG).alias("text"))
    assert drop_near_duplicates(rows).count() == 1
    assert drop_near_duplicates(rows.withColumn("doc_id", F.lit(None).cast("long"))).count() == 1


def test_empty_tables(spark, tmp_path):
    table = docs(spark).limit(0)
    for name, stage in stages(spark).items():
        assert stage(table).count() == 0, name
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_spans_apart(spark):
    """One walk gives what every pair gives, and takes no square time."""
    import random
    import time

    rng = random.Random(4)
    span = lambda n: [(s := rng.randrange(n), s + rng.randrange(1, 9)) for _ in range(rng.randrange(40))]
    rows = [(i, span(200), span(200)) for i in range(60)] + [(90, [], [(1, 2)]), (91, [(1, 2)], []), (92, [(3, 5)], [(5, 6), (1, 3)])]
    kind = "array<struct<start:int,stop:int>>"
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}")
    for i, a, b, got in df.select("i", "a", "b", apart(F.col("a"), F.col("b")).alias("x")).collect():
        assert got == [c for c in a if not any(h.start < c.stop and c.start < h.stop for h in b)], i

    def seconds(n):
        text = " ".join(f"a{i}@b.cd on 2024-01-02 with @name{i} and 0{i % 7}-555-01-{i:05d}" for i in range(n))
        one = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begin = time.perf_counter()
        pii_scan(one).collect()
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(8_000) < 12 * max(seconds(1_000), 0.5)


def test_rounds_without_news_cost_nothing(spark, monkeypatch):
    """The driver plans a round only as far as it brings something: two texts that share buckets but are no copies
    are compared once, and what follows is neither verified nor merged again."""
    words = [f"word{i}" for i in range(400)]
    other = words[:200] + [w if i % 12 else f"new{i}" for i, w in enumerate(words[200:])]  # some two thirds in common
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(other[:-1])), (4, "alone " * 3)]
    writes = Counter()

    def counted(df, name, kept=near_dedup.stored):
        writes[name] += 1
        return kept(df, name)

    monkeypatch.setattr(near_dedup, "stored", counted)
    monkeypatch.setattr(components, "stored", counted)
    out = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4]
    assert writes["found"] == 1 and writes["verified"] == 1 and sum(writes.values()) <= 20, writes


def test_fit_holds_the_words_of_one_text():
    """The sample's words are not held all at once: as objects they take some ten times its bytes, on the driver."""
    texts = [b" ".join(b"%x" % ((i * 31 + j * 7) % 997) for j in range(2000)) for i in range(150)]
    tracemalloc.start()
    try:
        vectors = Vectors.fit(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(vectors.rows) > 997 and peak < 3 * sum(map(len, texts))
