"""Byte-pair encoding through a table of distinct words.

Texts are split into words inside Spark tasks, with the tokenizer's own rule. The words of a batch form a table of
distinct words; each is encoded once, and a table of words met before is kept between batches. Ids come back to their
places by a join on the word's number (an indexed take). Decoding joins ids with the table of pieces, byte strings,
the same way, and reads the bytes of a text as UTF-8.

Special strings of the vocabulary stand for their ids wherever they occur. Null text is empty and has no tokens.
Rows are encoded one by one, so repeated rows and null ids do not matter. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from struct import pack
from types import ModuleType

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import renamed
from inkfold.llm.textbytes import blocks

#: Fixed value: the rule of this vocabulary that splits words.
#: Letters, the most frequent, are tried first: nothing that another alternative matches begins with them.
WORDS = regex.compile(r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words that a task remembers between blocks; the table starts anew beyond it.
REMEMBERED = 100_000


def byte_of_sign() -> dict[str, int]:
    """The signs that stand for bytes in the vocabulary: printable bytes for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A vocabulary file: words to ids, ids to pieces."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_of_sign()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*spec["model"]["vocab"].values(), *self.special.values()])
        self.pieces = np.full(size, b"", object)
        for piece, i in spec["model"]["vocab"].items():
            self.pieces[i] = bytes(signs[c] for c in piece) if all(c in signs for c in piece) else piece.encode()
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        self.split_special = regex.compile("|".join(
            f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and spec.get("normalizer") is None
        self.signs = {b: c for c, b in signs.items()} if plain else None
        self.known: dict[str, bytes] = {}  # a word's ids, four bytes each

    def words(self, text: str) -> list[str]:
        """Words and special strings in order."""
        if self.split_special is None or not self.split_special.search(text):
            return WORDS.findall(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += WORDS.findall(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + WORDS.findall(text[at:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text: each distinct word is encoded once."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [self.words(t) for t in texts]
        known = self.known
        self.learn(list(set().union(*split).difference(known)))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]

    def learn(self, words: list[str]) -> None:
        """Encode distinct words. Words that the rule has split need the merges only, if nothing else is done to them."""
        if self.signs is None:
            encoded = (e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))
        else:
            merge = self.tokenizer.model.tokenize
            encoded = ([self.special[w]] if w in self.special else [
                t.id for t in merge(w.encode().decode("latin-1").translate(self.signs))] for w in words)
        for word, ids in zip(words, encoded, strict=True):
            self.known[word] = pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.pieces[ids].tolist()).decode("utf-8", errors="replace")


def codec(path: str) -> Codec:
    """The codec of a vocabulary, kept by a worker for its next tasks. The functions of this module travel with each task,
    so what is to stay is kept under a name of the process."""
    kept = sys.modules.setdefault("inkfold_codecs", ModuleType("inkfold_codecs")).__dict__
    if path not in kept:
        kept[path] = Codec(path)
    return kept[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    """Blocks of rows with their ids."""
    c = codec(path)
    for part, _, _ in blocks(batches, text):
        lists = c.encode([t or "" for t in part.column(text).to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in lists])]).astype(np.int32)
        flat = np.concatenate([*lists, np.zeros(0, "<u4")]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=[*part.schema.names, ids])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str, ids: str, text: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        texts = [c.decode(np.asarray(x.values)) if x.is_valid else "" for x in batch.column(ids)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                         names=[*batch.schema.names, text])


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _free(df: DataFrame, *names: str) -> None:
    if taken := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} are there already; name other ones")


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` plus ``ids``, array<int>. ``vocabulary`` is the path of a byte-level vocabulary on every machine."""
    _free(docs, ids)
    return docs.mapInArrow(lambda it: encode_batches(it, vocabulary, text, ids), f"{_fields(docs)}, `{ids}` array<int>")


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` plus ``text``, the decoded ids."""
    _free(rows, text)
    return rows.mapInArrow(lambda it: decode_batches(it, vocabulary, ids, text), f"{_fields(rows)}, `{text}` string")


def encode_and_decode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids",
                      decoded: str = "decoded") -> DataFrame:
    """``docs`` plus ids and the text these decode to, in one pass of the same tasks. Columns of ``docs`` that have one of
    these names get an underscore behind it, until the name is free."""
    docs = renamed(docs, ids, decoded)
    return docs.mapInArrow(
        lambda it: decode_batches(encode_batches(it, vocabulary, text, ids), vocabulary, ids, decoded),
        f"{_fields(docs)}, `{ids}` array<int>, `{decoded}` string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.asarray(x.values).astype("<u4") for x in batch.column("ids")]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
            pa.array([sha(i.tobytes()) for i in ids], pa.string()),
            pa.array([sha(t.encode()) for t in batch.column("decoded").to_pylist()], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def bpe_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: digest_batches(decode_batches(
        encode_batches(it, vocabulary, "text", "ids"), vocabulary, "ids", "decoded")), DIGEST)
