"""Small inputs with results worked out by hand."""

import time

import pytest
from pyspark.sql import functions as F

from inkfold.functions import html, markup
from inkfold.functions import text as tx
from inkfold.functions.features import article_features, paywall_flag
from inkfold.functions.html import unescape
from inkfold.functions.tree import budget_blocks, main_fragment, outer_blocks
from inkfold.operators.budget import budget_paragraphs, truncate_html_words, word_budget
from inkfold.operators.classify import classify, classify_articles, with_subcategory
from inkfold.operators.enrich import parse_response, resolve_enrichment, with_pages
from inkfold.operators.extract import extract_paragraphs, extract_text, with_images
from inkfold.operators.keywords import top_keywords
from inkfold.rules import RuleSet


def value(spark, column, **cols):
    """One row of literals, one result."""
    df = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k)
                                 for k, v in cols.items()])
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, keyword, n", [
    ("aaaa ai", "aa", 2), ("email", "ai", 1), ("", "x", 0), ("àà", "à", 2), ("c++ c+++", "c++", 2)])
def test_count_occurrences(spark, text, keyword, n):
    assert value(spark, tx.count_occurrences("t", keyword), t=text) == n


@pytest.mark.parametrize("words, minutes", [(0, 1), (399, 1), (400, 2), (1000, 5)])
def test_reading_time(spark, words, minutes):
    assert value(spark, tx.reading_time(F.lit(words))) == minutes


def test_word_count_sees_unicode_space(spark):
    assert value(spark, tx.word_count("t"), t=" a b c\x1cd\n") == 4
    assert value(spark, tx.word_count("t"), t=None) == 0
    assert value(spark, tx.has_words("t", 3), t=" a b  c d") is True
    assert value(spark, tx.has_words("t", 5), t=" a b  c d") is False


def test_sentences(spark):
    text = "Hi. I am Dr. Bob e.g. this one! Really? Yes."
    assert value(spark, tx.sentences("t"), t=text) == ["Hi. I am Dr. Bob e.g. this one!", "Really?", "Yes."]


def test_lead_summary(spark):
    assert value(spark, tx.lead_summary("t"), t="One. Two. Three. Four.") == "One. Two. Three."
    assert value(spark, tx.lead_summary("t"), t="") == ""
    long = value(spark, tx.lead_summary("t"), t=("x" * 400 + ". ") * 4)
    assert len(long) == 503 and long.endswith("...")


def test_token_estimate(spark):
    assert value(spark, tx.token_estimate("t"), t="abcd efgh") == 4


@pytest.mark.parametrize("raw, shown", [
    ("2025-02-06T18:40:50Z", "February 06, 2025"), ("2025-02-26T18:40:50+00:00", "2025-02-26T18:40:50+00:00"), ("soon", "soon")])
def test_format_published(spark, raw, shown):
    assert value(spark, tx.format_published("t"), t=raw) == shown


def test_domain(spark):
    assert value(spark, tx.domain("u"), u="https://u@h.com:80/x?y#z") == "u@h.com:80"
    assert value(spark, tx.host("u"), u="https://u@H.com:80/x?y#z") == "h.com"
    assert value(spark, tx.domain("u"), u="no url") == ""


@pytest.mark.parametrize("text, kind, out", [
    ("A m a z o n", "spaced_chars", "<p>Amazon</p>"),
    ("A\nm\na\nz\no\nn\ni\ns\nb\ni\ng\n", "single_char_lines", "<p>Amazonisbig</p>"),
    ("<p>\nA\nb\nc of a longer line", "split_lines", "<p>Abc of a longer line</p>"),
    ("plain text", None, None)])
def test_repair(spark, text, kind, out):
    assert value(spark, tx.repair_kind("t"), t=text) == kind
    assert value(spark, tx.repair_split_text("t", tx.repair_kind("t")), t=text) == out


def test_boilerplate_and_scrub(spark):
    assert value(spark, html.strip_boilerplate("t"), t="<nav>x</nav><p>a</p><SCRIPT t>b\nc</script>") == "<p>a</p>"
    assert value(spark, html.scrub_html("t"), t="<!doctype x><meta a>k<style>s</style><html>gone</html>") == "k"


def test_unescape(spark):
    assert value(spark, html.unescape("t"), t="a &amp;lt; &#233; &#x1F600; &copy; &#0;") == "a &lt; é 😀 © �"


def test_block_texts(spark):
    page = "<article><h1>T</h1><p>One <b>two</b> x<br><p>Three</p>out<P class=a> &amp; </P><p> </p></article>"
    assert value(spark, html.block_texts(html.main_content("t")), t=page) == ["T", "Onetwox", "Three", "&"]


def test_text_of_pages(spark):
    pages = [
        (1, "<body><p>no article</p><p>here</p></body>"),
        (2, "<body><article><article><p>in</p></article><p>out</p></article><p>not</p></body>"),
        (3, "<body><p>menu</p><div class='x Post-Body'><div><p>deep</p></div><p>more</p></div><p>not</p></body>"),
        (4, "<article>bare <i>text</i>  only</article>"),
        (5, ""),
    ]
    got = extract_text(spark.createDataFrame(pages, "id int, html string")).orderBy("id").collect()
    assert [r["text"] for r in got] == ["no article here", "in out", "deep more", "bare text only", ""]


def test_images(spark):
    tags = ("<img src='a' width=10 height=10><img src=b width='10' height='x'><img src=\"a\"><img alt=q>"
            "<img src=c width=60 height=10><IMG SRC=d>")
    rows = [(1, f"<article>{tags}</article>"), (2, f"<body>{tags}</body>")]
    got = with_images(spark.createDataFrame(rows, "id int, html string")).orderBy("id").collect()
    # The first copy of "a" is the one that counts, and it is tiny.
    assert [i["src"] for i in got[0]["images"]] == ["b", "c", "d"]
    assert [i["src"] for i in got[1]["images"]] == ["b", "c"]


def test_first_of_each_source(spark):
    images = F.array(*[F.struct(F.lit(s).alias("src"), F.lit("").alias("width"), F.lit("").alias("height")) for s in "aba"])
    assert [i["src"] for i in value(spark, html.first_of_each_source(images))] == ["a", "b"]


def test_features(spark):
    f = value(spark, article_features("t", "h", "u"), t='Say "x" api. Def {', h="<a href=1><a href=2>", u="https://a.b/")
    assert (f["has_quotes"], f["quote_count"], f["link_count"], f["has_code"]) == (6, 2, 2, True)
    assert (f["technical_terms"], f["sentence_count"], f["word_count"], f["reading_time"]) == (1, 2, 5, 1)


@pytest.mark.parametrize("text, url, host, substring", [
    ("short", "https://www.microsoft.com/x", False, True), ("short", "https://www.ft.com/x", True, True),
    ("x" * 1000, "https://ft.com/", False, False), ("", "https://ft.com/", True, True),
    ("A Premium text", None, True, True), ("free", None, False, False)])
def test_paywall(spark, text, url, host, substring):
    assert value(spark, paywall_flag("t", "u"), t=text, u=url) is host
    assert value(spark, paywall_flag("t", "u", "substring"), t=text, u=url) is substring


@pytest.mark.parametrize("title, text, source, category, score", [
    ("", "email", None, "AI", 1.0), ("AI", "", None, "AI", 1.0), ("x", None, "TechCrunch", "Tech News", 0.5),
    ("zzz", "", None, "Other", 0.0), ("", "", "techcrunch", "Other", 0.0), ("", "javascript", None, "Programming", 1.0)])
def test_classify(spark, title, text, source, category, score):
    df = spark.createDataFrame([(title, text, source)], "title string, full_text string, source string")
    got = classify(df).first()
    assert (got["category"], got["category_score"]) == (category, score)


def test_prefix_and_self_overlapping_keywords(spark):
    rules = RuleSet(categories=(("A", ("saas", "aa")), ("B", ("ab", "abc", "abcd")), ("C", ("a\nb", "c'\\d"))))
    df = spark.createDataFrame([("", "saasaas abcdab a\nb c'\\d c'\\d")], "title string, full_text string")
    got = classify(df, source=None, rules=rules).first()["category_scores"]
    text = "  saasaas abcdab a\nb c'\\d c'\\d"
    assert got == {name: sum(text.count(k) for k in words) for name, words in rules.categories}


def test_whole_words(spark):
    df = spark.createDataFrame([("", "email ai, ai-app java c++")], "title string, full_text string")
    got = classify(df, source=None, whole_word=True).first()["category_scores"]
    assert (got["AI"], got["Tech News"], got["Programming"]) == (2, 1, 2)


def test_subcategory(spark):
    df = spark.createDataFrame([("gpt", "AI"), ("gpt", "Science"), ("zzz", "AI"), ("", "AI"), (None, "AI"), ("use case bias", "AI")],
                               "full_text string, category string")
    assert [r["subcategory"] for r in with_subcategory(df).collect()] == ["LLMs", None, None, None, None, "AI Ethics"]


def test_filter_on_category_keeps_the_result(spark):
    df = spark.createDataFrame([("", "gpt gpt", "s"), ("", "python", "s")], "title string, full_text string, source string")
    assert [r["subcategory"] for r in classify_articles(df).filter("category = 'AI'").collect()] == ["LLMs"]


def test_keywords(spark):
    df = spark.createDataFrame([("the data data api",), ("b1 caféx été zzz zzz Api api",), ("",), (None,)], "t string")
    assert value(spark, tx.extract_words("t"), t="the data data api") == ["data", "data", "api"]
    assert [r["keywords"] for r in top_keywords(df, "t").collect()][:3] == [["data", "api"], ["zzz", "api"], []]


def test_word_budget(spark):
    assert value(spark, budget_paragraphs(F.split("t", r"\|"), 5), t="a b c|d e f g|h") == ["a b c", "d e..."]
    assert value(spark, budget_paragraphs(F.split("t", r"\|"), 3), t="a b c|d|e") == ["a b c"]
    rows = [(1, i, w) for i, w in enumerate(["a b c", " ", "d e f g", "h"])] + [(2, 0, "x y")]
    df = spark.createDataFrame(rows, "id int, pos long, p string")
    got = {(r["id"], r["pos"]): r["p"] for r in word_budget(df, "id", "pos", "p", 5).collect()}
    assert got == {(1, 0): "a b c", (1, 2): "d e...", (2, 0): "x y"}


def test_truncate_html_words(spark):
    cut = truncate_html_words("t", 3)
    assert value(spark, cut, t="<div><p>a <b>b c d</b> e</p><p>f</p></div>") == "<div><p>a <b>b c</b></p></div>"
    assert value(spark, cut, t="<p>a b</p>") == "<p>a b</p>"
    assert value(spark, cut, t="a  b\nc d") == "a b c" and value(spark, cut, t="a  b") == "a  b"
    assert value(spark, cut, t="<i><br>a</b><B>b</b ><img/></i>c d</p> <u>") == "<i><br>a</b><B>b</b ><img/></i>c"
    assert value(spark, cut, t="<div><p>a b c</P><i>x</i></div >") == "<div><p>a b c</P></div >"
    assert value(spark, cut, t="") == "" and value(spark, cut, t=None) is None


def seconds(spark, column, text):
    """Time of one row, warm."""
    df = spark.createDataFrame([(text,)], "t string").select(F.xxhash64(column))
    df.collect()
    begin = time.perf_counter()
    df.collect()
    return time.perf_counter() - begin


def test_long_rows_take_time_in_proportion(spark):
    """Sixteen times the text takes no more than some thirty times as long; the square would be 256."""
    cases = {
        "nested": (truncate_html_words("t", 10**9), lambda n: "<b>x " * n + "</b>" * n),
        "flat": (truncate_html_words("t", 10**9), lambda n: "<b>x</b> " * n),
        "paragraphs": (F.array_join(budget_paragraphs(F.split("t", r"\|"), 10**9), "|"), lambda n: "a b c|" * n)}
    for name, (column, text) in cases.items():
        short, long = seconds(spark, column, text(2_000)), seconds(spark, column, text(32_000))
        assert long < 30 * max(short, 0.1), (name, short, long)


def test_tree_helpers():
    page = "<div class='content'><div>x</div>y</div>z"
    assert main_fragment(page) == "<div>x</div>y"
    assert main_fragment("<p>none</p>") is None
    assert [b[2] for b in outer_blocks("<div><p>a</p></div><p>b<p>c</p><ul><li>d</li></ul>")] == [
        "<div><p>a</p></div>", "<p>b", "<p>c</p>", "<ul><li>d</li></ul>"]
    text = "<p>a b</p><h2>c d e f</h2><p>g</p>"
    assert budget_blocks(text, 4) == "<p>a b</p>\n\n"
    assert budget_blocks("<p id=1>a b c</p>", 2) == "<p id=1>a b...</p>\n\n"
    assert budget_blocks("<i>a b</i>\n\nc d", 3) == "<p>a b</p>\n\n<p>c...</p>\n\n"


def test_extract_paragraphs(spark):
    rows = [(1, "<div class='a'>one two <b>three</b> four</div>"), (2, "just <b text"), (3, ""), (4, None), (5, "<p>T<h>i<s>x</p>")]
    df = extract_paragraphs(spark.createDataFrame(rows, "id int, t string"), "t", 3, kind="kind").orderBy("id")
    assert [(r["kind"], r["extracted"]) for r in df.collect()] == [
        ("html", "<div class='a'>one two three...</div>\n\n"), ("plain", "<p>just <b text</p>\n\n"), ("empty", ""), ("empty", ""),
        ("plain", "<p>T i x</p>\n\n")]


def test_markup(spark):
    assert value(spark, markup.images("t"), t="![a](u) [b](v)") == '<img src="u" alt="a"> [b](v)'
    assert value(spark, markup.footnotes("t"), t="see [12](#fn1-2) x") == 'see <sup><a href="#footnote-12">12</a></sup> x'
    assert value(spark, markup.handles("t"), t="Bob (@b)[Jan 1] Al (@al)") == (
        '<strong>Bob</strong> <span class="twitter-handle">@b</span> <span class="tweet-date">Jan 1</span> '
        '<strong>Al</strong> <span class="twitter-handle">@al</span>')
    assert value(spark, markup.bold("t"), t='**x** <a title="**no**">') == '<strong>x</strong> <a title="**no**">'
    div = '<div class="metadata">\n**Source:** X\t**Time:** 1:30\n</div>'
    assert value(spark, markup.to_html("t"), t=f"a\n{div}\nb") == (
        'a\n<hr/>\n<div class="metadata"><strong>Source:</strong> X&nbsp;&nbsp;•&nbsp;&nbsp;<strong>Time:</strong> 1:30</div>\n<hr/>\nb')
    assert value(spark, markup.simple_markdown("t"), t="## H\n- **b** *e* [l](u)") == (
        '<h2>H</h2>\n<li><strong>b</strong> <em>e</em> <a href="u">l</a></li>')


@pytest.mark.parametrize("response, expect", [
    ('{"category": "AI", "confidence": 0.7}', (True, "AI", "N/A", "", 0.7)),
    ('{"subcategory": "S", "formatted_markdown": "m", "confidence": "0.25"}', (True, "Unclassified", "S", "m", 0.25)),
    ('{"category": "AI", "confidence": "high"}', (True, "AI", "N/A", "", None)),
    ("Subcategory: LLMs\nCategory: AI\n", (False, "LLMs", "LLMs", "Subcategory: LLMs\nCategory: AI\n", None)),
    ("nothing", (False, None, None, "nothing", None)), ("[1, 2]", (False, None, None, "[1, 2]", None))])
def test_parse_response(spark, response, expect):
    r = parse_response(spark.createDataFrame([(response,)], "response string")).first()
    assert (r["is_json"], r["r_category"], r["r_subcategory"], r["r_markdown"], r["r_confidence"]) == expect


def test_node_text_of_very_many_adjacent_tags(spark):
    from inkfold.functions.html import node_text

    rows = [("<tr></tr>\n" * 50_000 + "end",), (" <b> a </b>  <i>\n</i> c ",), ("x" + " " * 20_000 + "y",)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(node_text("t", "|")).collect()]
    assert out == ["|end", "|a|c", rows[2][0]]


def test_references_are_decoded_once(spark):
    rows = [("Caf&eacute; &times; &#38;lt; &unknown; &amp;lt; &#x41;", "Caf\u00e9 \u00d7 &lt; &unknown; &lt; A"), ("", ""), ("& ;", "& ;"),
            ("&lt;&gt;", "<>"), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r["got"] for r in df.select(unescape("t").alias("got")).collect()] == [want for _, want in rows]


def test_main_part_of_unclosed_articles_and_bare_classes(spark):
    rows = [("<body>MENU <article><p>ART</p></body>", "ART"), ("<body><div><article><p>ART</p></div><p>TAIL</p></body>", "ART"),
            ("<body><div class=post><p>POST</p></div><p>TAIL</p></body>", "POST")]
    got = extract_text(spark.createDataFrame(rows, "html string, want string").coalesce(1)).collect()
    assert [r["text"] for r in got] == [r["want"] for r in got]


def test_repeated_urls_do_not_multiply_articles(spark):
    columns = ("feed_ord long, entry_ord long, title string, url string, author string, source string, published string, "
               "image_url string, summary string, full_text string, content string")
    articles = spark.createDataFrame([(1, 1, "t", "u", None, None, None, None, "", None, None)], columns)
    pages = spark.createDataFrame([("u", "<p>one</p>"), ("u", "<p>two</p>")], "url string, html string")
    assert [r["content"] for r in with_pages(articles, pages).collect()] == ["two"]
    answers = spark.createDataFrame([("u", "[1]"), ("u", "[1]")], "url string, response string")
    assert [r["resolved_by"] for r in resolve_enrichment(articles, answers).collect()] == ["rules"]
