"""Personal data by bootstrapped contextual extraction.

Emails, addresses of hosts, card numbers and phone numbers that fit their formats are the seeds. The words to
the left of a seed are a lexical pattern. Patterns and the things they precede form a graph over the whole
corpus. A pattern is judged by the known instances it precedes against the things known to be something else: short
numbers and dates, seeds of other number kinds, names that begin with an @. Things of a fitting shape that only
fail the strict format are unknown, not wrong; they weigh only as far as such things fit the format by chance. What
a well supported pattern vouches for is a new span, and a known instance of the next round, until nothing new is
accepted.

Only DataFrame functions are used. Per row: null text is the empty text; a null id is kept; repeated rows give
repeated results; other columns are not touched. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import (
    KEYS, apart, bind, count_kind, cut, found, labelled, run_folds, span_text, stored, unnamed, with_keys)

KINDS = ["email", "ip", "card", "phone"]
MARK = "\u0001"
CONTEXT = 64

#: The formats of seeds. Loops run over one character class, so that no long text is matched by
#: recursion; a dot or blank that stands between two fitting characters is marked first.
EMAIL_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
EMAIL = ("(?:(?<![A-Za-z0-9._%+\u0001-])|\\G)[A-Za-z0-9._%+\u0001-]++@"
         "[A-Za-z0-9-]++\u0001[A-Za-z0-9\u0001-]++")
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_FITS = rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$"
CARD_GAP = r"(?<=[0-9])[ -](?=[0-9])"
CARD = "[0-9][0-9\u0001]{12,}"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Things a pattern may vouch for: numbers with inner punctuation, and names with an @ but no full host.
LOOSE_NUMBER = r"\+?[0-9][0-9.()-]{7,62}[0-9](?![0-9])"
LOOSE_MAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
#: Numbers with blanks and brackets, of 9 to 12 and of 13 to 19 digits; after a blank stand two digits at least.
SPACED_PHONE = r"(?<![0-9])\(?[0-9](?:[0-9]|[ ().-]{1,3}(?=[0-9]{2})[0-9]){8,11}(?![0-9])"
SPACED_CARD = "(?<![0-9])[0-9](?:[0-9]|[ -](?=[0-9]{2})[0-9]){12,18}(?![0-9])"

#: Things known to be none of these: numbers of at most SHORT digits, dates, and names that begin with an @.
NUMBER = r"(?<![A-Za-z0-9])[0-9](?:[0-9.,:/()-]*[0-9])?"
SHORT = 4
DATE = "^[12][0-9]{3}[-/.][0-9]{2}[-/.][0-9]{2}$"
HANDLE = "(?<![A-Za-z0-9._%+-])@[A-Za-z0-9_-]++"
NO_NUMBER, NO_MAIL = 4, 5
#: By kind, the share of other things of a loose shape that fit the strict format by chance: one in ten numbers passes
#: the card check.
CHANCE = [0.01, 0.01, 0.1, 0.01]


def _luhn(digits: Column) -> Column:
    def worth(back: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return bind(F.reverse(digits), lambda back: F.aggregate(
        F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + worth(back, i))) % 10 == 0


def _is_card(hit: Column) -> Column:
    digits = F.replace(hit, F.lit(MARK), F.lit(""))
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))


def seeds(text: Column) -> Column:
    """Spans of the strict formats by kind and place, as array<struct<kind, start, stop, hit, left>>."""
    clean = F.translate(text, MARK, "\u0002")
    emails = F.when(F.contains(text, F.lit("@")), bind(
        F.regexp_replace(clean, EMAIL_DOT, MARK), lambda t: found(t, EMAIL, CONTEXT)))
    ips = F.filter(found(text, IP, CONTEXT), lambda h: h["hit"].rlike(IP_FITS))
    cards = F.when(text.rlike("[0-9][ -]?[0-9]"), F.filter(bind(
        F.regexp_replace(clean, CARD_GAP, MARK), lambda t: found(t, CARD, CONTEXT)), lambda h: _is_card(h["hit"])))
    phones = F.when(F.contains(text, F.lit("+")), F.filter(
        found(text, PHONE, CONTEXT),
        lambda h: F.length(F.regexp_replace(h["hit"], "[^0-9]", "")).between(9, 15)))
    none = F.array().cast("array<struct<start:int,stop:int,hit:string,left:string>>")
    return F.concat(*[labelled(k, F.coalesce(x, none)) for k, x in enumerate((emails, ips, cards, phones))])


def candidates(text: Column) -> Column:
    """Looser spans; kind is that of the format they come near to."""
    def kind(hit: Column) -> Column:
        digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
        return (F.when(hit.startswith("+"), F.when(digits.between(9, 15), 3))
                .when(hit.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), 1)
                .when(hit.rlike(r"^[0-9-]+$") & digits.between(13, 19), 2)
                .when(digits.between(9, 12), 3))

    none = F.array().cast("array<struct<start:int,stop:int,hit:string,left:string>>")
    numbers = F.transform(found(text, LOOSE_NUMBER, CONTEXT), lambda h: F.struct(
        kind(h["hit"]).alias("kind"), h["start"].alias("start"), h["stop"].alias("stop"),
        h["hit"].alias("hit"), h["left"].alias("left")))
    mails = F.when(F.contains(text, F.lit("@")), found(text, LOOSE_MAIL, CONTEXT))
    tight = F.filter(numbers, lambda c: c["kind"].isNotNull())
    spaced = F.filter(F.concat(*[labelled(k, F.coalesce(F.when(text.rlike("[0-9][ ()]"), found(text, p, CONTEXT)), none))
                                 for k, p in ((3, SPACED_PHONE), (2, SPACED_CARD))]), lambda h: h["hit"].rlike("[ (]"))
    both = bind(tight, lambda t: F.concat(t, F.filter(spaced, lambda h: ~F.exists(
        t, lambda c: (c["kind"] == h["kind"]) & (c["start"] == h["start"])))))
    return F.concat(both, labelled(0, F.coalesce(mails, none)))


def others(text: Column) -> Column:
    """Things that are known to be no personal data, as spans of kind NO_NUMBER and NO_MAIL."""
    none = F.array().cast("array<struct<start:int,stop:int,hit:string,left:string>>")
    numbers = F.filter(found(text, NUMBER, CONTEXT), lambda h: h["hit"].rlike(DATE) | (
        F.length(F.regexp_replace(h["hit"], "[^0-9]", "")) <= SHORT))
    handles = F.when(F.contains(text, F.lit("@")), found(text, HANDLE, CONTEXT))
    return F.concat(labelled(NO_NUMBER, numbers), labelled(NO_MAIL, F.coalesce(handles, none)))


def _patterns(left: Column) -> Column:
    """The last word and the last two words before a span, in lower case, as patterns of one and two words."""
    words = F.filter(F.split(F.lower(left), r"[\s\u0001\u0002]+"), lambda w: w != "")
    return bind(words, lambda w: F.filter(F.array(
        F.when(F.size(w) >= 1, F.element_at(w, -1)),
        F.when(F.size(w) >= 2, F.concat_ws(" ", F.element_at(w, -2), F.element_at(w, -1)))),
        lambda p: p.isNotNull()))


def _trusted(edges: DataFrame, known: DataFrame | None, least: float, support: int) -> DataFrame:
    """Patterns (kind, pattern) that vouch for what they precede, given the instances accepted so far.

    Of the known instances those count as right that chance does not explain: were all unknown ones something else,
    CHANCE of their like would be among the seeds. They are set against the things known to be something else.
    """
    if known is not None:
        edges = edges.join(known.withColumn("got", F.lit(1)), ["kind", "inst"], "left")
    sure = F.col("seed") == 1 if known is None else (F.col("seed") == 1) | F.col("got").isNotNull()
    count = lambda what: F.sum(what.cast("long"))
    kinds = range(len(KINDS))
    per = edges.groupBy("pattern").agg(
        *[count((F.col("kind") == k) & (F.col("seed") == 1)).alias(f"seeds{k}") for k in kinds],
        *[count((F.col("kind") == k) & sure).alias(f"known{k}") for k in kinds],
        *[count((F.col("kind") == k) & ~sure).alias(f"open{k}") for k in kinds],
        *[count(F.col("kind") == k).alias(f"wrong{k}") for k in (NO_NUMBER, NO_MAIL)])

    def judged(k: int) -> Column:
        wrong = F.col(f"wrong{NO_NUMBER}") if k else F.col(f"wrong{NO_MAIL}")
        for other in kinds:
            if k and other and other != k:
                wrong = wrong + F.col(f"seeds{other}")
        got = F.col(f"known{k}")
        right = got - F.col(f"open{k}") * (CHANCE[k] / (1 - CHANCE[k]))
        return F.struct(F.lit(k).alias("kind"), ((got >= support) & (right >= least * (got + wrong))).alias("good"))

    return (per.select("pattern", F.explode(F.array(*[judged(k) for k in kinds])).alias("j"))
            .where("j.good").select("j.kind", "pattern"))


def _accepted(edges: DataFrame, rounds: int | None, least: float, support: int) -> DataFrame:
    """Instances (kind, inst) that patterns vouch for. ``edges``: kind, pattern, inst, seed, one row each.

    Every round trusts patterns by their known instances and accepts what these precede; that is known in the next
    round. Nothing is taken back, so the rounds end; ``rounds`` ends them earlier.
    """
    loose = edges.where((F.col("seed") == 0) & (F.col("kind") < len(KINDS)))
    known, step = None, 0
    while rounds is None or step < rounds:
        more = loose.join(_trusted(edges, known, least, support), ["kind", "pattern"]).select("kind", "inst").distinct()
        more = stored(more if known is None else more.join(known, ["kind", "inst"], "left_anti"), "pii_round")
        if more.isEmpty():
            break
        known = more if known is None else known.unionByName(more)
        step += 1
    return loose.select("kind", "inst").limit(0) if known is None else known


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the texts: keys, seed spans and looser spans that touch no seed, kept in the shared folder."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    keyed = with_keys(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text")),
                      "doc_id", "_text")
    rows = keyed.select("doc_id", *KEYS, seeds(body).alias("base"), candidates(body).alias("loose"),
                        others(body).alias("other"))

    base, loose, other = F.col("base"), F.col("loose"), F.col("other")
    rows = rows.withColumns({"loose": apart(loose, base), "other": apart(other, base)})
    return stored(rows.withColumn("other", F.transform(apart(other, loose), lambda c: F.struct(
        c["kind"].alias("kind"), F.xxhash64(c["hit"]).alias("inst"), _patterns(c["left"]).alias("patterns")))), "pii_scan")


def discovered(scanned: DataFrame, rounds: int | None = None, least: float = 0.9, support: int = 5) -> DataFrame:
    """New spans per document: the keys and ``more``, array<struct<kind, start, stop>>."""
    other = scanned.select(F.explode("other").alias("o")).select(
        F.col("o.kind").alias("kind"), F.explode("o.patterns").alias("pattern"),
        F.col("o.inst").cast("string").alias("inst"), F.lit(0).alias("seed"))
    spans = scanned.select(*KEYS, F.explode(F.concat(
        F.transform("base", lambda s: F.struct(s.alias("s"), F.lit(1).alias("seed"))),
        F.transform("loose", lambda s: F.struct(s.alias("s"), F.lit(0).alias("seed"))))).alias("x"))
    parts = spans.select(*KEYS, F.col("x.s.kind").alias("kind"), F.col("x.s.start").alias("start"),
                         F.col("x.s.stop").alias("stop"), F.sha2("x.s.hit", 256).alias("inst"),
                         F.col("x.seed").alias("seed"), F.col("x.s.left").alias("left"))
    edges = stored(parts.select("kind", F.explode(_patterns(F.col("left"))).alias("pattern"), "inst", "seed")
                   .unionByName(other).groupBy("kind", "pattern", "inst").agg(F.max("seed").alias("seed")), "pii_edges")
    good = _accepted(edges, rounds, least, support)
    return (parts.where("seed = 0").join(good, ["kind", "inst"], "left_semi")
            .groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop"))).alias("more")))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row of ``docs``: doc_id, the keys, ``base`` (seed spans) and ``spans`` (with discovered ones), by kind
    and start."""
    scanned = scan(docs, doc_id, text)
    more = discovered(scanned, **settings)
    short = "array<struct<kind:int,start:int,stop:int>>"
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                  s["stop"].alias("stop"))).cast(short)
    both = F.array_sort(F.concat("base", F.coalesce(F.col("more").cast(short), F.array().cast(short))))
    return (scanned.select("doc_id", *KEYS, base.alias("base")).join(more, KEYS, "left")
            .select("doc_id", *KEYS, "base", both.alias("spans")))


def pii_digest(found_spans: DataFrame) -> DataFrame:
    """Counts and digests per document, of ``find_pii``'s rows."""
    return found_spans.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.sha2(span_text(F.array_sort("base"), KINDS), 256).alias("base_sha256"),
        span_text(F.col("spans"), KINDS).alias("spans"))


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are one, of the first kind."""
    names = F.array(*[F.lit(f"<{n}>") for n in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def between(r: Column) -> Column:
        """What stands before the first span of every run of overlapping ones, and after the last."""
        ends = lambda i: F.coalesce(F.get(r["ends"], i), F.lit(0))
        gaps = F.transform(r["ordered"], lambda s, i: F.struct(
            ends(i - 1).alias("start"), s["start"].alias("stop"), names[s["kind"]].alias("name")))
        return F.concat(F.filter(gaps, lambda g: g["start"] <= g["stop"]), F.array(F.struct(
            ends(F.size(r["ends"]) - 1).alias("start"), F.length(text).alias("stop"), F.lit("").alias("name"))))

    def filled(gaps: Column) -> Column:
        return F.array_join(F.zip_with(cut(text, gaps), gaps, lambda t, g: F.concat(t, g["name"])), "")

    furthest = lambda o: F.struct(
        o.alias("ordered"), run_folds(F.transform(o, lambda s: s["stop"]), F.greatest).alias("ends"))
    return F.when(F.size(spans) == 0, text).otherwise(bind(bind(bind(ordered, furthest), between), filled))


def mask_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with every span of personal data replaced by ``<kind>``. Same rows and columns, whatever their names; null
    stays null."""
    rows, body, back = unnamed(docs, doc_id, text)
    spans = (find_pii(rows, "id", body, **settings).where(F.size("spans") > 0)
             .groupBy(*KEYS).agg(F.first("spans").alias("spans")))
    joined = with_keys(rows, "id", body).join(spans, KEYS, "left")
    return back(joined.withColumn(body, F.when(F.col("spans").isNull(), F.col(body)).otherwise(
        _masked(F.col(body), F.col("spans")))))
