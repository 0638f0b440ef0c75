"""Ranked search, the filter audit and toxicity against plain versions, and the cases they define."""

import itertools
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import toxicity as tox
from inkfold.llm.audit import audit_part, filter_audit, judged, with_labels
from inkfold.llm.decontaminate import words_of
from inkfold.llm.search import search

SCHEMA = "doc_id long, text string, lang string, source string, bits int, digest string, n long, item int, _text string"
FILL = ("x", 7, "y", 7, 7, "z")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def make(spark):
    """Documents of (id, text, lang), with further columns named like the operators' inner ones."""
    return lambda rows: spark.createDataFrame([(*r, *FILL) for r in rows], SCHEMA)


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(docs, items, best=20):
    """The definition, text by text."""
    held = [(i, Counter(terms(t))) for i, t, _ in docs if terms(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            score = 0
            for w in terms(text):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    score += weight * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m))
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:best], 1)]
    return Counter(out)


WORDS = "red Fish swims in cold Water near ÄRGER stone and old wood 7 café".split()


def some_docs():
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 40))), "en") for i in range(120)]
    docs += [(i, "Red fish, red FISH!", "fr") for i in range(500, 560)]  # one class, more than a result holds
    docs += [(600, None, None), (601, "", "en"), (602, " \n", "en"), (None, "red fish red fish", "en"),
             (None, "old wood", "de"), (603, "wood " * 30_000, "de"), (603, "wood " * 30_000, "de")]
    return docs


def test_search_is_the_definition(make, spark):
    docs = some_docs()
    items = [(1, "red fish"), (2, "old WOOD wood stone"), (3, None), (4, "..."), (5, "nowhere"), (None, "Ärger café"),
             (6, "red fish"), (6, "red fish"), (7, "red fish swims in cold water near stone and old wood 7 " * 40)]
    table = spark.createDataFrame([(*i, "other") for i in items], "item_id long, text string, doc_id string")
    for settings in ({}, {"block_words": 3}, {"block_items": 2, "best": 3}):
        got = search(make(docs), table, **settings)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == ranked(docs, items, settings.get("best", 20))


def test_search_in_pieces_of_a_task(make, spark, monkeypatch):
    from inkfold.llm import search as module

    monkeypatch.setattr(module, "CELLS", 8)
    docs, items = some_docs()[:80], [(i, " ".join(WORDS[i:i + 3])) for i in range(6)]
    got = search(make(docs).coalesce(1), spark.createDataFrame(items, "item_id long, text string"), best=4)
    assert Counter(map(tuple, got.collect())) == ranked(docs, items, 4)


def test_search_of_nothing(make, spark):
    items = spark.createDataFrame([(1, "red")], "item_id long, text string")
    assert search(make([]), items).count() == 0
    assert search(make(some_docs()), items.limit(0)).count() == 0
    assert search(make([(1, "blue", "en")]), items).count() == 0


def audited(docs, labels):
    """The definition, row by row."""
    good, bad = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    seen = defaultdict(set)
    for i, t, _ in docs:
        if i is not None:
            seen[t or ""].add(i)
    fails = []
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append((part or "", i, {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j < i for j in seen[t])}))
    out, removed = {}, Counter()
    for part in {f[0] for f in fails}:
        rows = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, c in enumerate(order):
                failing = [x for x in rows if x[2][c]]
                here = [x for x in failing if not any(x[2][e] for e in order[:s])]
                out[part, order, s + 1] = [
                    sum(not any(x[2][e] for e in order[:s + 1]) for x in rows), len(here), len(failing) - len(here),
                    sum(sum(x[2].values()) == 1 for x in failing), sum(x[1] in good for x in here), sum(x[1] in bad for x in here)]
                removed[part, c] += len(here)
    return {k: [*v, removed[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def test_audit_is_the_definition(make, spark):
    rng = np.random.default_rng(5)
    docs = []
    for i in range(150):
        words = [str(x) for x in rng.integers(0, rng.choice([40, 4000]), rng.choice([30, 250]))]
        text = " ".join(words) + rng.choice(["", " &", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUV"])
        docs.append((i, text, str(rng.choice(["en", "de"]))))
    docs += [(i + 1000, docs[i][1], "fr") for i in range(0, 60, 2)] + docs[:9]  # copies, and rows repeated with their id
    docs += [(2000, None, None), (2001, "", "en"), (None, "", "en"), (None, docs[0][1], "de"), (2002, "é" * 60_000, "de")]
    docs += [(-i, "same words", "en") for i in range(40)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 3)] + [(3, 1, 1), (None, 1, 1), (1002, None, 1), (-7, 1, None)]
    table = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit(make(docs), table).collect()
    want = audited(docs, labels)
    assert len(got) == len(want) == 120 * 5 * 4
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want


def test_audit_of_nothing_and_of_few(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(make([]), none).count() == 0
    rows = filter_audit(make([(1, "a", "en")]), none).collect()
    assert len(rows) == 600 and {r["shapley"] for r in rows if r["filter_order"][r["step"] - 1] == "A"} == {120}
    assert all(r["kept"] == 0 for r in rows if r["step"] == 5)


def test_audit_sends_no_labels_to_the_driver(make, spark, tmp_path):
    path = str(tmp_path / "labels")
    spark.range(20_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(path)
    # files so small that the estimate from them allows a broadcast
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1_000_000
    got = with_labels(judged(make([(i, f"text {i}", "en") for i in range(30)])), spark.read.parquet(path))
    assert got.where("good").count() == 30
    for df in (got, filter_audit(make([(1, "a", "en")]), spark.read.parquet(path))):
        df.collect()
        shown = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in shown and "Broadcast" not in shown


def test_audit_counts_large_numbers():
    import pandas as pd

    cells = pd.DataFrame({"part": "x", "cell": [0, 31], "n": [10**14, 10**14], "good": [0, 1], "toxic": [0, 0]})
    rows = audit_part(cells)
    assert set(rows["kept"]) == {10**14} and rows.loc[rows["step"] == 1, "shapley"].eq(24 * 10**14).all()


def plain_kneser_ney(counts, shared, word):
    """Evidence of a word by the definition: strings in dictionaries, one sign after another."""
    b = e = tox.EDGE

    def all_grams(words, longest):
        out = Counter()
        for w, n in words.items():
            s = b + w + e
            for p in range(1, len(s)):
                out[s[max(0, p - longest + 1):p + 1]] += n
        return out

    def tables(words, longest):
        grams = all_grams(words, longest)
        at = {longest: {g: n for g, n in grams.items() if len(g) == longest}}
        for k in range(longest - 1, 0, -1):
            at[k] = {g: n for g, n in grams.items() if len(g) == k and g[0] == b}
            for g in at[k + 1]:
                at[k][g[1:]] = at[k].get(g[1:], 0) + 1
        return at

    common = tables(shared, tox.SHORT + 1)

    def step(table, gram, lower):
        after = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        if not after:
            return lower
        total, kinds = sum(after), len(after)
        return max(table.get(gram, 0) - tox.DISCOUNT, 0) / total + tox.DISCOUNT * kinds / total * lower

    total = 0.0
    s = b + word + e
    own = [tables(c, tox.LONG) for c in counts]
    for p in range(1, len(s)):
        logs = []
        for own_table in own:
            prob = tox.UNKNOWN
            for k in range(1, min(tox.LONG, p + 1) + 1):
                gram = s[p - k + 1:p + 1]
                prob = step(common[k] if k <= tox.SHORT else own_table[k], gram, prob)
            logs.append(math.log(prob))
        total += logs[1] - logs[0]
    return total


def test_kneser_ney_is_the_definition(make, spark):
    plain_texts = ["the cat sat on the mat", "a café near the mattress", "statistics of the cats"]
    toxic_texts = ["the catfool sat", "foolish cat fools a fool", "matfool"]
    rows = [(t, 0, False) for t in plain_texts] + [(t, 1, False) for t in toxic_texts] + [("fool fool", 0, True)]
    sample = spark.createDataFrame(rows, "_text string, label int, aside boolean")
    corpus = [*plain_texts, *toxic_texts, "other words of the corpus, seen without a label", None, ""]
    docs = make([(i, t, "en") for i, t in enumerate(corpus)])
    got = tox.fit_spelling(sample, tox.shared_counts(docs))
    decoded = [Counter(w.decode() for t in texts for w in words_of((t or "").encode()))
               for texts in (plain_texts, toxic_texts, corpus)]
    words = ["cat", "fool", "foolish", "fools", "matfool", "café", "the", "a", "corpus", "labels", "of"]
    values = tox.evidence([w.encode() for w in words], got)
    want = [plain_kneser_ney(decoded[:2], decoded[2], w) for w in words]
    # what the sample has not shown in any class has no evidence, whatever the shared counts are
    assert np.allclose(values, want, atol=1e-4)
    assert values[words.index("fools")] > 2 and values[words.index("the")] < 1


def toxic_docs(n=400):
    rng = np.random.default_rng(11)
    bits = "er on the an re ti es nd at hin ou ble ing".split()
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(bits, rng.integers(1, 4))) for _ in range(rng.integers(15, 120))]
        bad = i % 4 == 0
        for _ in range(max(1, len(words) // 12) if bad else 0):
            words[rng.integers(len(words))] = "vlurk" + str(rng.choice(bits))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_of_held_out_rows(make, spark):
    docs, labels = toxic_docs()
    odd = [(9000, None, "en"), (9001, "", None), (None, "the vlurkon vlurking of", "en"), (9002, "the vlurkti " * 20_000, "en"),
           (9003, docs[4][1], "de"), (9003, docs[4][1], "de"), (9004, "\x02\x03 \x00 ..!", "en")]
    known = [*labels, (9001, None), (None, 1), (0, 1), (9003, 1)]
    table = spark.createDataFrame([(*r, 1, "x") for r in known], "doc_id long, toxic int, quality int, text string")
    rows = tox.toxicity_digest(make(docs + odd), table).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[None][0]["predicted"] == by[9002][0]["predicted"] == 1
    assert by[9000][0]["predicted"] == by[9001][0]["predicted"] == by[9004][0]["predicted"] == 0
    assert by[9003][0]["score"] == by[9003][1]["score"] == by[4][0]["score"]


def test_held_out_labels_are_not_read(make, spark):
    docs, labels = toxic_docs(160)
    df = make(docs)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = table.withColumn("toxic", F.when(tox.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: r["score"] for r in tox.toxicity_digest(df, t).collect()} for t in (table, turned))
    assert one == two


HELD = [i for i in range(30) if crc32(str(i).encode()) % 5 == 0]
FREE = [i for i in range(30) if i not in HELD]


@pytest.mark.parametrize(("labels", "score"), [
    ([], 0.5), ([(FREE[0], 1)], 1.0), ([(FREE[0], 0), (FREE[1], 0)], 0.0), ([(HELD[0], 1), (HELD[1], 0)], 0.5)])
def test_toxicity_without_both_labels(make, spark, labels, score):
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = tox.toxicity_digest(make([(i, f"text {i}", "en") for i in range(30)]), table).collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == set(HELD)
    assert {r["score"] for r in rows} == {score}


def test_toxicity_of_nothing(make, spark):
    docs, labels = toxic_docs(60)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert tox.toxicity_digest(make([]), table).count() == 0
    text_ids = make(docs).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    known = table.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert tox.toxicity_digest(text_ids, known).count() == 60
