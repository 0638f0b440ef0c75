"""Small fixtures against plain versions, and the cases every operator defines: nulls, empty, long, repeated."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import near_dedup, sharding, substrings
from inkfold.llm.bpe import bpe_digest
from inkfold.llm.chat import chat_digest, format_chat
from inkfold.llm.common import KEYS, with_keys
from inkfold.llm.components import extended
from inkfold.llm.decontaminate import contamination, contamination_digest, drop_contaminated
from inkfold.llm.near_dedup import drop_near_duplicates, near_digest, near_duplicates
from inkfold.llm.pii import find_pii, mask_pii, pii_digest
from inkfold.llm.quality_model import learn, quality_digest
from inkfold.llm.quality_rules import apply_rules
from inkfold.llm.queries import default_vocabulary, op8_decontamination
from inkfold.llm.secrets import find_secrets, secret_digest
from inkfold.llm.sharding import histogram_shards
from inkfold.llm.substrings import repeated_spans, repeats_digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string"


@pytest.fixture(scope="module")
def make(spark):
    def build(texts):
        rows = [(i, t, "en", f"s{i % 3}", 0, 1, "x") if not isinstance(t, tuple) else (*t, "en", None, 0, 1, "x")
                for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


ODD = ["", None, " \n\t ", "x", "é\U0001F600" * 3, "a" * 3000, "1" * 5000, "a.b" * 3000 + "@x.y", "+" * 50]


def test_keys_tell_texts_of_one_id_apart(make, spark):
    text = F.concat(F.when(F.col("id") % 2 == 0, "see gold fish ").otherwise("mail a@b.cd of "), F.col("id").cast("string"))
    same = spark.range(400_000).select(text.alias("t")).groupBy(F.hash(F.lit(False), "t").alias("h")).agg(
        F.min("t").alias("a"), F.max("t").alias("b")).where("a like 'mail%' and b like 'see%'").first()
    docs = make([(7, same["a"]), (7, same["b"])])  # 32 bits do not tell these apart
    assert with_keys(docs).select(*KEYS).distinct().count() == 2
    bench = spark.createDataFrame([(3, "Gold fish")], "item_id long, text string")
    assert [r["text"] for r in drop_contaminated(docs, bench).collect()] == [same["a"]]
    assert {r["text"] for r in mask_pii(docs).collect()} == {same["a"].replace("a@b.cd", "<email>"), same["b"]}


def test_pii_formats_places_and_odd_texts(make):
    texts = [*ODD, "é mail a@b.c_d@e.f ok", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "ip 1.2.3.4.5.6.7.8",
             "300.1.1.1 call +1 (234) 555-0101.", "\U0001F600 x@y.z\U0001F600"]
    found = by_id(pii_digest(find_pii(make([*texts, texts[-1]]))))
    n = len(ODD)
    assert found[n]["spans"] == "email:7:12,email:12:18"
    assert (found[n + 1]["n_card"], found[n + 1]["spans"]) == (1, "card:5:24")
    assert found[n + 2]["spans"] == "ip:3:10,ip:11:18"
    assert found[n + 3]["spans"] == "phone:15:32"
    assert found[n + 4]["spans"] == "email:2:7" and found[n + 4]["spans"] == found[n + 5]["spans"]
    assert len(found) == len(texts) + 1 and found[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_pii_patterns_discover_and_mask(make):
    texts = [f"my number is +1 (200) 555-01{i:02d} today" for i in range(12)]
    texts += ["my number is 200-555-0999 today", "lot 200-555-0998 here", None]
    docs = make(texts)
    found = by_id(pii_digest(find_pii(docs)))
    assert found[12]["n_phone"] == 0 and found[12]["spans"] == "phone:13:25" and found[13]["spans"] == ""
    masked = mask_pii(docs)
    assert masked.columns == docs.columns
    rows = by_id(masked)
    assert rows[0]["text"] == "my number is <phone> today" and rows[12]["text"] == "my number is <phone> today"
    assert rows[13]["text"] == texts[13] and rows[14]["text"] is None


def test_pii_unknown_things_are_not_wrong_ones(make):
    texts = [f"phone: +1 (200) 555-01{i:02d} now" for i in range(20)]
    texts += [f"phone: 200-555-09{i:02d} now" for i in range(10)]  # a third of all instances, none of them known
    texts += ["phone: 200 555 0955 now", "phone: (200) 555-0956 now"]
    # "desk" has no seed: it is trusted once "phone:" has vouched for five of its instances
    texts += [f"desk 200-555-09{i:02d} now" for i in range(6)] + ["desk 200-555-0977 now"]
    # "room" comes before short numbers as well, so it vouches for nothing
    texts += [f"room +1 (200) 555-02{i:02d} now" for i in range(6)] + [f"room {i} now" for i in range(6)]
    texts += ["room 200-555-0988 now"]
    # "serial" comes before numbers of which every tenth passes the card check by chance
    texts += [f"serial 4{i:015d} now" for i in range(100)]
    found = [r["spans"] for _, r in sorted(by_id(pii_digest(find_pii(make(texts)))).items())]
    assert found[20:30] == ["phone:7:19"] * 10
    assert found[30] == "phone:7:19" and found[31] == "phone:7:21"
    assert found[32:39] == ["phone:5:17"] * 7
    assert found[51] == "" and sum(s != "" for s in found[52:]) == 10


def test_secrets_by_owner(make):
    live = "Ab1" * 9 + "9"
    texts = ['token = "abcdef01" password:x', "AKIA" + "A1" * 9, "f" * 30, f"see {live} here", None, "token:token =abcdefg"]
    shared = "Zz9" * 10
    docs = make(texts + [f"w {shared}"] * 9)
    found = by_id(secret_digest(find_secrets(docs)))
    assert found[0]["spans"] == "assign:0:17" and found[1]["n_access"] == 1 and found[2]["n_hex"] == 1
    assert found[3]["spans"] == f"live:4:{4 + len(live)}" and found[5]["n_assign"] == 0
    assert found[6]["spans"] == "" and found[6]["n_example"] == 1


def plain_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = Counter(grams)
    return len(words), len({i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(3)})


def test_quality_rules_repeats(make):
    texts = [*ODD, "a b c a b c d", "a a a a a", "of the x y " * 40, "w " * 700]
    docs = make(texts)
    for r in apply_rules(docs).collect():
        assert (r["quality"]["n_words"], r["quality"]["n_repeat_words"]) == plain_rules(r["text"])
        assert not r["quality"]["kept"]
    assert apply_rules(docs.limit(0)).count() == 0


def test_classifier_learns_marks_from_seen_labels_only(make, spark):
    good = [f"the ship {i} sails to the port of call and back again" for i in range(60)]
    bad = ["buy&&& now%%% cheap### " * (3 + i % 5) for i in range(60)]
    docs = make(good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(5, None), (None, 1)],
                                   "doc_id long, quality int")
    rows = by_id(quality_digest(docs, labels))
    assert len(rows) == 122 and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [i for i in range(120) if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == int(i < 60) for i in held]) > 0.95
    assert learn(docs, labels.limit(0)).network is None


def test_shards_are_near_equal_and_gapless(make):
    texts = [f"text {i} " * (1 + i % 40) for i in range(1200)] + ["copy " * 30] * 900 + [None, ""]
    docs = make(texts)
    rows = histogram_shards(docs.drop("size"), 8).collect()
    load, slots = Counter(), {}
    for r in rows:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(texts) and sorted(load) == list(range(8))
    assert max(load.values()) - min(load.values()) < 0.03 * sum(load.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = {}
    for r in rows:
        if not (r["text"] or "").startswith("copy"):
            homes.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    assert histogram_shards(docs.drop("size").limit(0), 8).count() == 0


def test_large_groups_are_dealt_and_only_huge_ones_cut():
    pieces, load = sharding._deal([(1, 50), (2, 30), (3, 400)], 4, 800)
    assert sum(load) == 480 and len(pieces[1]) == 1 and len(pieces[3]) > 1 and pieces[3][-1][0] == 400


def test_chat_round_trip_and_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    text = lambda t: [("text", t, None, None, None, None, None)]
    tricky = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|"
    rows = [(1, 0, "user", text(tricky)), (1, 1, "assistant", text("yes é")), (1, 200, "assistant", text(tricky)),
            (None, None, None, None), (2, 0, "us\ner~<|", [("image", None, "a.png", 56, 28, None, None), None,
                                                      ("audio", None, "b.wav", None, None, 2.0, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    chats = format_chat(df)
    full = {r["conv_id"]: r for r in chats.collect()}
    assert full[2]["attachments"] == ["a.png", "b.wav"] and full[2]["attachment_tokens"] == 2 + 50
    got = {r["conv_id"]: r for r in chat_digest(chats).collect()}
    want = f"user\n{tricky}\nassistant\nyes é\nassistant\n{tricky}\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[1]["n_turns"] == 3
    assert got[1]["loss_sha256"] == hashlib.sha256(("yes é" + tricky).encode()).hexdigest()
    assert got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 0


def plain_repeats(texts, span):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("part", [2, 2048])
def test_repeated_passages_to_the_byte(make, part):
    rng = np.random.default_rng(part)
    word = lambda n: " ".join(rng.choice(["ab", "cé", "the", "zu", "of", "xyz", "q"], n))
    passage = word(120)
    texts = [*ODD, word(80), passage, "ab" * 400, passage[30:250] + word(40), "a" * 450, word(30) + passage]
    texts += [word(9 + i) + passage[i:210 + 3 * i] + word(25) for i in range(12)] + [texts[9]]
    rows = by_id(repeats_digest(repeated_spans(make(texts), part=part)))
    got = [tuple(rows[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))]
    assert got == plain_repeats(texts, 200)


def test_suffixes_sort_like_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start = np.arange(350)
    s = substrings.Suffixes(data, start, np.full(350, 400), np.zeros(350, int), substrings.Powers())
    raw = data.tobytes()
    assert s.sorted().tolist() == sorted(range(350), key=lambda i: raw[i:])


def test_decontamination_windows(make, spark):
    item = "The cat sat on the mat and ate ten fish today"
    short = "Gold fish"
    texts = [*ODD, f"so {item.upper()}, well", "the cat sat on the mat", "a gold-fish swims", f"{item} {item}",
             "the cat sat on the mat oh and ate ten fish"]
    bench = spark.createDataFrame([(7, item), (3, short), (5, None), (6, "")], "item_id long, text string")
    docs = make(texts)
    rows = by_id(contamination_digest(contamination(docs, bench)))
    n = len(ODD)
    assert (rows[n]["n_hit"], rows[n]["n_items"]) == (11, 1) and rows[n + 1]["n_hit"] == 0
    assert rows[n + 2]["n_hit"] == 2 and rows[n + 3]["n_hit"] == 22
    near = by_id(contamination(docs, bench, slop=2))
    assert near[n + 4]["near"] > 0 and near[n + 4]["hits"] == []
    split = by_id(contamination_digest(contamination(docs, bench, block_words=5)))
    assert {k: v["items_sha256"] for k, v in split.items()} == {k: v["items_sha256"] for k, v in rows.items()}
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(texts) - 3
    assert by_id(contamination_digest(contamination(docs, bench.limit(0))))[n]["n_hit"] == 0


def test_proximity_matches_are_reported(make, spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    put_in = " ".join(w + (" extra" if i % 9 == 8 else "") for i, w in enumerate(words))
    swapped = " ".join(["w1", "w0", *words[2:10]])  # the rarest term's window begins before the text
    docs = make(["nothing here", swapped, put_in, put_in, " ".join(words), "w1 " * 20])
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1]))], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(r["n_hit"], r["n_near"]) for r in op8_decontamination(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert rows[0] == (0, 0) and rows[1][0] == 0 and rows[1][1] > 0 and rows[5] == (0, 0)
    assert rows[2][0] == 0 and rows[2][1] >= 20 and rows[3] == rows[2] and rows[4] == (40, 0)
    twice = docs.unionAll(docs)
    for block in (5, 1000):
        got = contamination_digest(contamination(twice, bench, slop=2, block_words=block))
        assert {(r["n_hit"], r["n_near"]) for r in got.collect()} == set(rows)


def test_components_grow_as_at_once(spark):
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    schema = "a long, b long"
    labels = None
    for at in (0, 100, 100, 200):  # one part twice: links that join nothing new
        labels = extended(labels, spark.createDataFrame(pairs[at:at + 100], schema))
    labels = extended(labels, spark.createDataFrame([], schema))
    root = {n: n for p in pairs for n in p}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    got = labels.collect()
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert len(got) == len(linked) and {r["node"]: r["root"] for r in got} == {n: top(n) for n in linked}


def plain_components(texts, width):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and root[i] != root[j] and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_as_components(make, width):
    rng = np.random.default_rng(width)
    base = [f"w{i}" for i in rng.integers(0, 500, 90)]
    texts = [*ODD, "One", "one", "two words", "Two Words"]
    for k in range(14):
        words = list(base)
        for i in rng.integers(0, 90, k):
            words[i] = f"e{k}x{i}"
        texts.append(" ".join(words))
    texts += [texts[-14], " ".join(f"z{i}" for i in range(40))]
    docs = make(texts)
    rows = by_id(near_digest(near_duplicates(docs, width=width)))
    assert [(rows[i]["n_shingles"], rows[i]["component_id"]) for i in range(len(texts))] == plain_components(texts, width)
    kept = drop_near_duplicates(docs, width=width)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows.values())
    assert near_duplicates(docs.limit(0)).count() == 0


def test_classes_of_one_common_bucket_are_compared(spark):
    rooted = spark.createDataFrame([(1, 10, 100, 100, 10), (1, 20, 100, 100, 20), (1, 30, 100, 100, 20), (2, 40, 100, 10, 40)],
                                   "bucket long, class long, n long, shared long, root long")
    sets = spark.createDataFrame([(c, [0] * near_dedup.PARITY) for c in (10, 20, 30, 40)], "class long, parity array<long>")
    pairs = near_dedup._remaining_pairs(rooted, sets, near_dedup.SIMILAR)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(10, 20), (10, 30)]


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = near_dedup.mixed(np.arange(3000, dtype=np.uint64))
    for size in (3, 60, 1500):
        a, b = pool[:size], pool[size // 5: size + size // 5]
        row = np.repeat([0, 1], [len(a), len(b)])
        s = near_dedup.super_minhash(row, np.concatenate([a, b]), 2)
        assert np.isfinite(s).all()
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((s[0] == s[1]).mean() - true) < 0.15
    assert rng is not None


def test_bpe_equals_the_library(make):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_vocabulary())
    texts = [*ODD, "it's  a <|endoftext|>test\n\n x'll 12,3", "<|endoftext|>", "tab\t\t end  ", " 　 日本"]
    rows = by_id(bpe_digest(make(texts), default_vocabulary()))
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = plain.decode(ids, skip_special_tokens=False)
        assert rows[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "the", "re") for b in ("x", "na", "ti", "zu", "of", "el")]
    rng = np.random.default_rng(5)
    text = lambda: " ".join(rng.choice(words, 80))
    clean = [text() for _ in range(40)]
    test_item = text()
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(100, clean[0] + " end"), (101, f"{text()} {test_item} {text()}"), (102, "mail me@x.org " + text())]
    docs += [(200 + i, "w### z&&& " * 30 + str(i)) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text")) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1) for i in range(40)] + [(200 + i, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, test_item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    assert sorted(rows) == [*range(40), 102]
    assert rows[102]["text"].startswith("mail <email> ") and rows[3]["decoded"] == clean[3]
