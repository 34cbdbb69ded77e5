"""Text and links of pages against Python's own parser, and pages that are written badly."""

import os
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from peerlens.llm import warc


class Reader(HTMLParser):
    """What a page says: text with a line for each block, and the links of its anchors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.hidden = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden.append(tag)
        if tag in warc.BLOCK_TAGS:
            self.out.append("\n")
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href"][:1]

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
            self.out.append(" ")
        elif tag in warc.BLOCK_TAGS and not self.hidden:
            self.out.append("\n")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data.replace("\xa0", " "), flags=re.ASCII))

    def text(self):
        return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t]+", " ", "".join(self.out))).strip(" \n")


def by_parser(html):
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return reader.text(), list(dict.fromkeys(reader.links))


def by_operator(spark, pages):
    rows = spark.createDataFrame([(i, "http://e/", h) for i, h in enumerate(pages)], "page_id long, url string, html string").repartition(2)
    out = {(r["page_id"], r["warc_type"]): r["block"] for r in warc.derive(warc.responses(rows)).collect()}
    links = lambda i: [x[9:] for x in out[i, "metadata"].split("\r\n") if x.startswith("outlink: ")]
    return [(out[i, "conversion"], links(i)) for i in range(len(pages))]


PAGES = [
    "<header>Top</header><p>hello</p><head><title>T</title></head>",
    "<p>1 < 2 &eacute; 3 <4 &lt;b&gt; &amp;lt; &#233;&#xE9;&#x1F600; &unknown; &copy;&middot; a&nbsp;b AT&T; &;</p>",
    """<a data-href="x" href='y'>l</a><a class=b href=z>m</a><A HREF = "q?a=1&amp;b=2&amp;b=2">n</a><a name="n">o</a><a href="y">p</a><area href="no">""",
    "<div>a<br>b<br/>c<hr>d</div>e<b>f</b> <i>g</i>\r\n\t h<ul><li>1<li>2</ul>",
    '<script type="x">var t = "</p><p>";</script>kept<style>p{}</style> <!-- <p>gone</p> --> also<!doctype html>',
    "<html lang=fr><head><meta charset=x></head><body><h1>Été</h1></body></html>",
    "", None, "no tags at all", "   \n ", "<p></p><p> </p>", "x" * 300_000, "<p>" * 20_000 + "deep", "a &lt;p&gt; b",
]


def test_pages_against_a_parser(spark):
    for html, got in zip(PAGES, by_operator(spark, PAGES), strict=True):
        assert got == by_parser(html), (html or "")[:200]


def test_pages_that_break_off(spark):
    """Where the parser of this Python and the rule differ, or either may change, the rule is what is stated."""
    pages = {"<p>a<script>alert(1)": "a", "<p>a<style>p{": "a", "<p>a<!-- b": "a", "<p>a<scr": "a", "a</": "a", "a <": "a <", "<head><title>T</title> b": "T b", "&amp": "&amp", "<scripture>x</scripture>": "x", "&#0;&#xD800;&#9999999;": "&#0;&#xD800;&#9999999;"}
    assert [t for t, _ in by_operator(spark, list(pages))] == list(pages.values())


def test_undated_records_have_whole_headers(spark):
    rows = warc.responses(spark.createDataFrame([(1, "http://e/", "<p>x</p>"), (1, "http://e/", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string"))
    bare = rows.withColumn("date", F.lit(None).cast("string"))
    for made in (warc.derive(bare), warc.derive(bare, F.lit(None).cast("string"))):
        got = made.collect()
        assert len(got) == 6 and all(f"WARC-Date: {warc.UNDATED}\r\n" in r["header"] and f"WARC-Refers-To-Date: {warc.UNDATED}\r\n" in r["header"] for r in got)
        assert len({(r["record_id"], r["warc_type"]) for r in got}) == 4
    assert warc.derive(bare.withColumn("payload", F.lit(None).cast("string"))).where("content_length IS NULL OR block IS NULL").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_all_pages_of_a_table_against_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    whole = [r["html"] for r in pages.collect() if r["html"] and r["html"].endswith(">") and not re.search(r"&\w+(?!\w*;)\b[^;]", r["html"][-12:])]
    assert len(whole) > 200
    for html, got in zip(whole, by_operator(spark, whole), strict=True):
        assert got == by_parser(html)
