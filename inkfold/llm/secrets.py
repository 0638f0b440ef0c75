"""Secrets, judged by who owns them in the whole corpus.

Strings after a password-like name, access keys and long hex strings are base spans. Every candidate value,
and every long mixed token besides, is hashed; the corpus is counted by hash over distinct repositories and
distinct owners. A value that many owners hold is a copied example, one that few hold looks live. Mixed tokens
that look live are new spans of kind ``live``.

Only DataFrame functions are used. Null text is the empty text; a null owner or repository counts as one owner;
repeated rows give repeated results and count as one repository. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import KEYS, apart, count_kind, found, labelled, span_text, stored, with_keys

KINDS = ["assign", "access", "hex", "live"]

#: The formats.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: A token of mixed letters and digits, at least so long.
MIXED = "[A-Za-z0-9_]{24,}"


def base_spans(text: Column) -> Column:
    """Strict spans as array<struct<kind, start, stop, hit, left>>; hit is the secret value."""
    assigned = F.transform(found(text, ASSIGN), lambda h: F.struct(
        h["start"].alias("start"), h["stop"].alias("stop"),
        F.regexp_extract(h["hit"], ASSIGN_VALUE, 2).alias("hit"), h["left"].alias("left")))
    assigned = F.filter(assigned, lambda h: F.length(h["hit"]) >= 6)
    kinds = (assigned, found(text, ACCESS), found(text, HEX))
    return F.concat(*[labelled(k, x) for k, x in enumerate(kinds)])


def mixed_tokens(text: Column) -> Column:
    """Long tokens with upper case, lower case and digits."""
    hits = F.filter(found(text, MIXED), lambda h: h["hit"].rlike("[A-Z]") & h["hit"].rlike("[a-z]")
                    & (F.length(F.regexp_replace(h["hit"], "[^0-9]", "")) >= 4))
    return labelled(3, hits)


def scan(docs: DataFrame, doc_id: str, text: str, repository: Column, owner: Column) -> DataFrame:
    """One pass over the texts: keys, owners, base spans and mixed tokens apart from them, in the shared folder."""
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"),
                       repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    body = F.coalesce(F.col("_text"), F.lit(""))
    rows = with_keys(slim, "doc_id", "_text").select(
        "doc_id", *KEYS, "repository", "owner", base_spans(body).alias("base"), mixed_tokens(body).alias("mixed"))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
        F.sha2(s["hit"], 256).alias("value")))
    return stored(rows.select("doc_id", *KEYS, "repository", "owner", hashed(F.col("base")).alias("base"),
                              hashed(apart(F.col("mixed"), F.col("base"))).alias("mixed")), "secret_scan")


def ownership(scanned: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every candidate value in the corpus."""
    holders = scanned.select("repository", "owner", F.explode(F.concat("base", "mixed")).alias("s"))
    per = holders.groupBy(F.col("s.value").alias("value"), "owner", "repository").agg(F.count("*").alias("n"))
    per = per.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return per.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"),
                                    F.sum("n").alias("occurrences"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: Column | None = None,
                 owner: Column | None = None, most_owners: int = 2) -> DataFrame:
    """Per row: doc_id, keys, ``base`` and ``spans`` by start, ``n_live`` and ``n_example`` of all candidates.

    ``most_owners`` is the largest number of distinct owners of a value that looks live. By default ``source`` is
    the owner and each of its languages a repository.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    scanned = scan(docs, doc_id, text, repository, owner)
    value = F.struct(F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.stop").alias("stop"),
                     (F.col("owners") <= most_owners).alias("live"))
    judged = (scanned.select(*KEYS, F.explode(F.concat("base", "mixed")).alias("s"))
              .withColumn("value", F.col("s.value")).join(ownership(scanned), "value")
              .groupBy(*KEYS).agg(F.collect_set(value).alias("judged")))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                  s["stop"].alias("stop")))
    more = F.transform(F.filter("judged", lambda s: (s["kind"] == 3) & s["live"]), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    count = lambda live: F.coalesce(F.size(F.filter("judged", lambda s: s["live"] == live)), F.lit(0))
    return (scanned.select("doc_id", *KEYS, F.array_sort(base).alias("base")).join(judged, KEYS, "left")
            .select("doc_id", *KEYS, "base", F.array_sort(F.concat("base", F.coalesce(more, none))).alias("spans"),
                    F.when(F.col("judged").isNull(), 0).otherwise(count(True)).cast("long").alias("n_live"),
                    F.when(F.col("judged").isNull(), 0).otherwise(count(False)).cast("long").alias("n_example")))


def secret_digest(found_spans: DataFrame) -> DataFrame:
    """Counts and digests per document, of ``find_secrets``' rows."""
    return found_spans.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{n}") for k, n in enumerate(KINDS[:3])],
        F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        span_text(F.col("spans"), KINDS).alias("spans"), "n_live", "n_example")
