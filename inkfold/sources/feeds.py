"""Atom feeds and feed lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.functions.text import blank_if_null, domain, let, parse_published, strip
from inkfold.schemas import ENTRY
from inkfold.session import written

CORRUPT = "_corrupt_record"


def entry_fields(prefix: str = "") -> dict[str, Column]:
    """The article fields of an Atom entry; ``prefix`` is the struct column holding it, if any."""

    def c(path: str) -> Column:
        return F.col(prefix + path)

    def first_filled(values: Column) -> Column:
        return F.nullif(F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0)), F.lit(""))

    def array(values: Column, ddl: str) -> Column:
        return F.coalesce(values, F.array().cast(ddl))

    link_ddl = "array<struct<_VALUE:string,_rel:string,_href:string>>"
    media_ddl = "array<struct<_VALUE:string,_medium:string,_url:string>>"
    all_links = F.concat(array(c("link"), link_ddl), array(c("source.link"), link_ddl))
    alternate = F.get(F.filter(all_links, lambda l: l["_rel"] == "alternate"), F.lit(0))["_href"]
    media = F.concat(array(c("`media:content`"), media_ddl), array(c("`media:group`.`media:content`"), media_ddl))
    image = F.get(F.filter(media, lambda m: m["_medium"] == "image"), F.lit(0))["_url"]
    url = F.coalesce(alternate, F.lit(""))
    text = c("content._VALUE")
    return {
        "title": blank_if_null(c("title._VALUE")),
        "url": url,
        "image_url": F.coalesce(image, F.get(media, F.lit(0))["_url"]),
        "author": F.coalesce(first_filled(c("author.name")), first_filled(c("author.n"))),
        "source": c("source.title._VALUE"),
        "summary": blank_if_null(c("summary._VALUE")),
        "read_more_url": url,
        "published": c("published"),
        "published_ts": parse_published(c("published")),
        "full_text": text,
        "content": text,
        "domain": domain(url),
    }


def feed_file() -> Column:
    """The file of a row; local paths come as ``file:/x`` or ``file:///x`` depending on who lists them."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")


#: What parts the text of a feed into records: everything from one mark to the next belongs to the entry it opens.
MARK = "<entry"
#: What may follow the mark where it is the tag itself.
OPENED = r"^[\s>/]"
#: A text that begins like a document, and so cannot stand behind the mark of an entry.
HEAD = r"^\s*<(?:\?xml|!--|!DOCTYPE|[A-Za-z:]*feed\b)"


#: The bits of a row's number that count inside a task; those above name the task, which a piece has only one of.
ROW_BITS = (1 << 33) - 1


def entry_records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Texts of feed files in pieces: (``feed_file``, ``_block``, ``_row``, ``_text``), one row per mark.

    The reader cuts files into byte ranges and finds the next mark at the beginning of each by itself, so a large file
    is read by many tasks. ``_text`` is what follows a mark; a file's first row is what stands before its first.
    """
    reader = spark.read.option("lineSep", MARK)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        feed_file().alias("feed_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)).alias("_row"), F.col("value").alias("_text"))


def parsed_entry(text: Column) -> Column:
    """The entry that the text behind a mark opens, as a struct; null where it is malformed.

    Only what the entry's own end closes is read: the rest of the feed after the last entry is not part of it.
    """
    end = F.locate("</entry", text)
    whole = F.when(end > 0, F.concat(F.lit(MARK), F.left(text, end - 1), F.lit("</entry>"))).when(
        text.rlike(r"^[^<>]*/>"), F.concat(F.lit(MARK), F.substring_index(text, "/>", 1), F.lit("/>")))
    read = F.from_xml(F.when(text.rlike(OPENED), whole), ENTRY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # a field that is the NUL sign is what the reader gives for text it could not decode
    return let(read, lambda e: F.when(e[CORRUPT].isNull() & ~F.coalesce(e["published"] == "\x00", F.lit(False)), e))


#: Pieces of files, about 200 bytes each, up to which their table is sent to all tasks; beyond it rows are shuffled.
SENT_PIECES = 100_000


def _pieces(records: DataFrame) -> DataFrame:
    """One row per piece of a file, in the work folder: the number of the feed (``feed_ord``), the first row of the piece
    and how many rows of the file stand before it. It is the only table that is counted ahead, and small."""
    spark = records.sparkSession
    per = written(records.groupBy("_path", "feed_file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")),
                  "feed_pieces")
    in_file = Window.partitionBy("_path", "feed_file").orderBy("_block")
    per = per.withColumn("_before", F.sum("_n").over(in_file) - F.col("_n")).drop("_n")
    # feeds are numbered inside range partitions, and the partitions' counts are added up
    files = written(per.groupBy("feed_file").agg(F.min("_path").alias("_path"))
                    .repartitionByRange("_path", "feed_file").sortWithinPartitions("_path", "feed_file")
                    .select("_path", "feed_file", F.spark_partition_id().alias("_part"),
                            F.monotonically_increasing_id().alias("_id")), "feed_files")
    parts = files.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_low") + 1).alias("_add"))
    numbered = files.join(parts, "_part").select("_path", "feed_file", (F.col("_id") + F.col("_add")).alias("feed_ord"))
    return written(per.join(numbered, ["_path", "feed_file"]), "feed_places")


def read_atom(
    spark: SparkSession, paths: list[str], limit: int = 0, strict: bool = False, glob: str | None = None
) -> DataFrame:
    """All entries of the given feed files, globs or folders, with ``feed_ord`` and ``entry_ord``.

    Feeds are numbered in the order of ``paths``, files of one path by name; a file that two paths name counts for the
    first. Entries are numbered as they stand in the file, across the pieces it is read in: rows of a piece are
    consecutive, and what lies before a piece is counted per piece. A malformed entry is left out, keeps its number and
    is counted in ``corrupt_records`` (which is computed only where it is used); entries after it are read. ``strict``
    drops its whole feed. A comment or CDATA section that holds the mark of an entry makes the entry around it malformed.
    Files are read as UTF-8. Every path is a scan of its own: name folders rather than files.
    """
    records = reduce(DataFrame.unionByName, [
        entry_records(spark, path, glob).withColumn("_path", F.lit(i)) for i, path in enumerate(paths)])
    pieces = _pieces(records)
    small = pieces.limit(SENT_PIECES + 1).count() <= SENT_PIECES
    sent = F.broadcast if small else lambda df: df

    def entries(places: DataFrame) -> DataFrame:
        placed = records.join(sent(places), ["_path", "feed_file", "_block"]).withColumn(
            "entry_ord", F.col("_before") + F.col("_row") - F.col("_first"))
        return placed.filter(F.col("entry_ord") > 0)  # number 0 is what stands before a file's first entry

    entry = parsed_entry(F.col("_text"))
    bad = entries(pieces).filter(entry.isNull()).groupBy("feed_ord").agg(F.count("*").alias("_bad"))
    # the count comes with the pieces, so that the entries are joined once
    out = entries(pieces.join(bad, "feed_ord", "left").withColumn("corrupt_records", F.coalesce("_bad", F.lit(0))))
    if strict:
        out = out.filter(F.col("corrupt_records") == 0)
    if limit > 0:
        out = out.filter(F.col("entry_ord") <= limit)
    # a filter on the entry would be pushed below its projection and parse it once more
    out = out.select("feed_ord", "entry_ord", "feed_file", "corrupt_records",
                     F.explode(F.array_compact(F.array(entry))).alias("_entry"))
    return out.select("feed_ord", "entry_ord", "feed_file", "corrupt_records",
                      *[v.alias(k) for k, v in entry_fields("_entry.").items()])


def read_feed_dirs(spark: SparkSession, folders: list[str], limit: int = 0, strict: bool = False) -> DataFrame:
    """``*.atom`` files of several folders as one batch, folders in order of priority.

    A folder that is missing or holds no feed is no feed; without any feed the result has no rows.
    """
    there = [f for f in folders if _is_there(spark, f)]
    if there:
        return read_atom(spark, there, limit, strict, "*.atom")
    return spark.createDataFrame([], ENTRY).select(
        F.lit(0).cast("bigint").alias("feed_ord"), F.lit(0).cast("bigint").alias("entry_ord"),
        F.lit("").alias("feed_file"), F.lit(0).cast("bigint").alias("corrupt_records"),
        *[v.alias(k) for k, v in entry_fields().items()])


def _is_there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def entries_from_column(df: DataFrame, xml: str) -> DataFrame:
    """Article fields of Atom entries stored as text, one entry per row; other columns are kept."""
    parsed = df.withColumn("_entry", F.from_xml(F.col(xml), ENTRY))
    keep = [c for c in df.columns if c != xml]
    return parsed.select(*keep, *[v.alias(k) for k, v in entry_fields("_entry.").items()])


def feed_lines(df: DataFrame, text: str, line_no: str = "feed_ord", url: str = "feed_url") -> DataFrame:
    """Feed list lines with their 1-based number in the file; blank lines and ``#`` comments are left out."""
    lines = df.select(
        *[c for c in df.columns if c != text], F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("_pos", "_line")
    )
    stripped = strip("_line")
    return lines.select(
        *[c for c in df.columns if c != text],
        (F.col("_pos") + 1).cast("bigint").alias(line_no), stripped.alias(url),
    ).filter((F.col(url) != "") & ~F.col(url).startswith("#"))


def read_feed_list(spark: SparkSession, path: str) -> DataFrame:
    """Feed list file -> (feed_ord, feed_url)."""
    return feed_lines(spark.read.text(path, wholetext=True), "value")
