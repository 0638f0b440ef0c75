"""Feed files: fields, order, malformed records, lists, folders."""

import pytest

from inkfold.sources.feeds import entry_records, read_atom, read_feed_dirs, read_feed_list

HEAD = '<?xml version="1.0"?>\n<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/">\n'
FULL = """<entry><title type="html">T &amp; one</title><link rel="self" href="https://self/"/>
<link rel="alternate" href="https://u@a.com:80/1"/><published>2025-02-06T18:40:50Z</published>
<author><name>Ann</name></author><source><title>Src</title><link rel="alternate" href="https://src/"/></source>
<summary>S</summary><content type="html">&lt;p&gt;body&lt;/p&gt;</content>
<media:content medium="video" url="v"/><media:content medium="image" url="i"/></entry>
"""
BARE = "<entry><title>two</title><author><n>Nick</n></author><published>soon</published></entry>\n"
SOURCE_LINK = ('<entry><source><link rel="alternate" href="https://src/2"/></source>'
               '<media:group><media:content url="g"/></media:group></entry>\n')
BAD = "<entry><title>bad</ttle></entry>\n"


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    first, second = tmp_path_factory.mktemp("first"), tmp_path_factory.mktemp("second")
    (first / "b.atom").write_text(HEAD + FULL + BARE + SOURCE_LINK + "</feed>")
    (first / "a.atom").write_text(HEAD + BARE + BARE + "</feed>")
    (first / "skip.xml").write_text(HEAD + FULL + "</feed>")
    (second / "c.atom").write_text(HEAD + BARE + BAD + "</feed>")
    return str(first), str(second)


def test_fields(spark, folders):
    rows = {r["entry_ord"]: r for r in read_atom(spark, [f"{folders[0]}/b.atom"]).collect()}
    one = rows[1]
    assert (one["title"], one["url"], one["read_more_url"]) == ("T & one", "https://u@a.com:80/1", "https://u@a.com:80/1")
    assert (one["author"], one["source"], one["summary"], one["image_url"]) == ("Ann", "Src", "S", "i")
    assert (one["content"], one["full_text"], one["domain"]) == ("<p>body</p>", "<p>body</p>", "u@a.com:80")
    assert str(one["published_ts"]) == "2025-02-06 18:40:50"
    two = rows[2]
    assert (two["title"], two["url"], two["author"], two["summary"]) == ("two", "", "Nick", "")
    assert (two["content"], two["image_url"], two["source"], two["published"], two["published_ts"]) == (None, None, None, "soon", None)
    assert (rows[3]["title"], rows[3]["url"], rows[3]["image_url"]) == ("", "https://src/2", "g")


def test_order_and_limit(spark, folders):
    rows = read_feed_dirs(spark, list(folders)).collect()
    assert sorted((r["feed_ord"], r["entry_ord"], r["title"]) for r in rows) == [
        (1, 1, "two"), (1, 2, "two"), (2, 1, "T & one"), (2, 2, "two"), (2, 3, ""), (3, 1, "two")]
    swapped = read_feed_dirs(spark, list(folders)[::-1], limit=1).collect()
    assert sorted((r["feed_ord"], r["title"]) for r in swapped) == [(1, "two"), (2, "two"), (3, "T & one")]


def test_folders_without_feeds(spark, folders, tmp_path):
    (tmp_path / "empty").mkdir()
    none = [str(tmp_path / "empty"), str(tmp_path / "missing")]
    both = read_feed_dirs(spark, [none[0], *folders, none[1]])
    assert both.count() == 6 and {r["feed_ord"] for r in both.collect()} == {1, 2, 3}
    blank = read_feed_dirs(spark, none)
    assert blank.count() == 0 and [f.dataType for f in blank.schema] == [f.dataType for f in both.schema]
    assert blank.columns == both.columns


@pytest.fixture
def small_pieces(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_file_in_many_pieces(spark, tmp_path, small_pieces):
    """Entries keep their numbers and are read once wherever the file is cut, and after malformed ones too."""
    bad = {3, 17, 40}
    entry = lambda i: f"<entry><title>t{i} {'é' * (i % 50)}</{'ttle' if i in bad else 'title'}><summary>s</summary></entry>"
    body = "".join(entry(i) + "\n" * (i % 3) for i in range(1, 200))
    (tmp_path / "b.atom").write_text(HEAD + body + "</feed>")
    (tmp_path / "a.atom").write_text(HEAD + "</feed>")
    (tmp_path / "0.atom").write_text("")
    (tmp_path / "c.atom").write_text("<entry/><entryway/><entry\n><title>two</title></entry><entry><title>cut off</ti")
    df = read_feed_dirs(spark, [str(tmp_path)])
    assert entry_records(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    rows = {(r["feed_file"].rsplit("/", 1)[1], r["entry_ord"]): r for r in df.collect()}
    assert {n for f, n in rows if f == "b.atom"} == set(range(1, 200)) - bad
    assert all(r["title"].split(" ")[0] == f"t{n}" and r["corrupt_records"] == 3 for (f, n), r in rows.items() if f == "b.atom")
    assert {n: r["title"] for (f, n), r in rows.items() if f == "c.atom"} == {1: "", 3: "two"}
    assert {r["corrupt_records"] for (f, _), r in rows.items() if f == "c.atom"} == {2}
    assert len({r["feed_ord"] for r in rows.values()}) == 2
    few = read_feed_dirs(spark, [str(tmp_path)], limit=4)
    assert sorted((r["feed_file"][-6:], r["entry_ord"]) for r in few.collect()) == [("b.atom", 1), ("b.atom", 2), ("b.atom", 4), ("c.atom", 1), ("c.atom", 3)]
    # without the count of malformed entries they are parsed once, and nothing but the pieces' table is joined
    plan = read_feed_dirs(spark, [str(tmp_path)]).select("feed_ord", "entry_ord", "title")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1 and plan.count("Join") == 1


def test_malformed(spark, folders):
    path = f"{folders[1]}/c.atom"
    assert [r["corrupt_records"] for r in read_atom(spark, [path]).collect()] == [1]
    assert read_atom(spark, [path], strict=True).count() == 0


def test_feed_list(spark, tmp_path):
    (tmp_path / "feeds.txt").write_text("# feeds\nhttps://a/\n\n  https://b/ \r\n #no\nhttps://c/")
    rows = read_feed_list(spark, str(tmp_path / "feeds.txt")).collect()
    assert [(r["feed_ord"], r["feed_url"]) for r in rows] == [(2, "https://a/"), (4, "https://b/"), (6, "https://c/")]
