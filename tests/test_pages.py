from __future__ import annotations

from html.parser import HTMLParser

from shopmetrics.operators.pages import attach_previews, page_previews

TAGS = (
    '<meta property="og:image" content="i.png">'
    '<meta property="og:title" content="T &amp; U">'
    '<meta property="og:description" content="D">'
)
NO_TITLE = "Không có tiêu đề"


def preview(spark, html):
    df = spark.createDataFrame([("u", html)], "url string, html string")
    row = page_previews(df).first()
    return (row.has_preview, row.image, row.title, row.description)


def test_spellings(spark):
    assert preview(spark, f"<head>{TAGS}</head>") == (True, "i.png", "T & U", "D")
    swapped = "<META content='i > j.png' property='og:image'/><meta data-property='og:title' content='x'>"
    assert preview(spark, swapped) == (True, "i > j.png", NO_TITLE, "")
    unquoted = "<meta property=og:title content=Word><meta property=og:image content=a/b.png>"
    assert preview(spark, unquoted) == (True, "a/b.png", "Word", "")
    first = '<meta property="og:title" content="1"><meta property="og:title" content="2">'
    assert preview(spark, first) == (True, None, "1", "")
    spread = '<meta\n  property = "og:title"\n  content = "two\nlines" >'
    assert preview(spark, spread)[2] == "two\nlines"


def test_missing_parts(spark):
    assert preview(spark, "<p>no tags</p>") == (True, None, NO_TITLE, "")
    assert preview(spark, None) == (False, None, None, None)
    assert preview(spark, '<meta property="og:image">' + TAGS) == (False, None, None, None)
    assert preview(spark, '<meta property="og:title" content="">') == (True, None, "", "")
    assert preview(spark, '<meta property="og:image:width" content="3">')[1] is None


def test_text_that_is_no_tag(spark):
    hidden = f"<!-- {TAGS} --><script>var a = '{TAGS}';</script>"
    assert preview(spark, hidden) == (True, None, NO_TITLE, "")


class Metas(HTMLParser):
    """First content of each property, by Python's HTML parser over the whole page."""

    def __init__(self):
        super().__init__()
        self.found = {}

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "meta" and "property" in own:
            self.found.setdefault(own["property"], own.get("content"))


def test_references_and_open_comments_against_a_parser(spark):
    title = '<meta property="og:title" content="{}">'
    values = [
        "caf&eacute; &Eacute", "&#x1F600; &#128512;", "&notin; &notit; &amp;lt;", "&copy 2 &unknown; &", "&#0;&#x80;",
        "a &lt;b&gt; &quot;c&quot; &#39;d&apos;", "&NotEqualTilde; &nbsp;|", "&hellip&mdash;", "no reference",
    ]
    htmls = [title.format(v) for v in values] + [
        "<!-- never closed " + title.format("hidden"), "<script>x = 1 " + title.format("hidden"),
        title.format("seen") + "<!-- open", "<style>p {} </style>" + title.format("after"),
        "<meta content='first' property='og:title' content='last'>", "<meta property='og:title' content>",
        "<!-- a -->" + title.format("later") + "<!-- b -->", "<p title='<meta>'>" + title.format("x"),
    ]
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string")
    for row in page_previews(df).collect():
        parser = Metas()
        parser.feed(htmls[row.page_id])
        parser.close()
        want = parser.found.get("og:title", NO_TITLE)
        assert row.title == ("" if want is None else want), htmls[row.page_id]


def test_long_page(spark):
    html = "<p>" + "word ' < \" " * 50_000 + "</p>" + TAGS
    assert preview(spark, html)[0]


def test_attach(spark):
    found = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "product_id string, url string")
    pages = spark.createDataFrame(
        [(2, "a", "<p>later</p>"), (1, "a", TAGS), (3, "b", None), (4, "z", TAGS)],
        "page_id int, url string, html string",
    )
    rows = {r.product_id: r for r in attach_previews(found, pages, "page_id").collect()}
    assert (rows["1"].image, rows["1"].placeholder) == ("i.png", None)
    assert (rows["2"].title, rows["2"].placeholder) == (None, "Không có ảnh")
    assert rows["3"].placeholder == "Không có ảnh" and len(rows) == 3
