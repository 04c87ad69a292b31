"""Page text against texts known beforehand, and the keyword job."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from sunmelt.functions import text
from sunmelt.operators import textscan

# Markup and the text it gives when it stands alone.
PIECES = [
    ("<p>one.</p>", "one."), ("<b class='a>b'> two </b>", "two"), ('<a href="x>y" id=1>3 > 2</a>', "3 > 2"),
    ("<!-- a <b> c -->", ""), ("<script>if (a < b) { t = '</p>'; }</script>", "if (a < b) { t = '</p>'; }"),
    ("<STYLE>p > a { }</STYLE>", "p > a { }"), ("<!DOCTYPE html>", ""), ("<br/>", ""), ("<i>\n\t</i>", ""),
    ("<p>a &amp; b</p>", "a & b"), ("<p>&lt;tag&gt;</p>", "<tag>"), ("<p>&#65;&#x42;</p>", "AB"),
    ("<p>&copy 1</p>", "\u00a9 1"), ("<p>&nope;</p>", "&nope;"), ("<p>&eacute;t&eacute; </p>", "\u00e9t\u00e9"),
    ("<p>&#8364;</p>", "\u20ac"), ("<p>AT&T</p>", "AT&T"), ("<p>&#146;</p>", "\u2019"),
    ("<p>&#0000000065;</p>", "A"), ("<p>x</p>", "x"),
]


def test_markup_text_of_pieces_put_together(spark):
    rnd = random.Random(11)
    chosen = [[rnd.choice(PIECES) for _ in range(rnd.randrange(1, 20))] for _ in range(300)]
    pages = [(i, "".join(markup for markup, _ in page)) for i, page in enumerate(chosen)]
    df = spark.createDataFrame(pages, "i int, h string")
    got = {r["i"]: r["t"] for r in df.select("i", text.markup_text(F.col("h")).alias("t")).collect()}
    for i, page in enumerate(chosen):
        want = " ".join(t for _, t in page if t)
        assert got[i] == want, pages[i][1]


def test_character_references(spark):
    cell = "&ampfoo &notin; &notit; &copy2 &#0; &#55296; &zzz; a&b &frac12; &#146; &#x80; &#129; &#7; &#0000000065; &#xFDD0; &#99999999999;"
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(text.decode_entities(F.col("c"))).first()[0] == html.unescape(cell)


def test_keyword_sentences_equal_a_plain_loop(spark):
    body = "<p>We process data. Nothing here! Is it Missing? Knn rules.</p><p>Interpolate now.  End</p>"
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "page_id int, html string")
    got = [(r["page_id"], r["sentence_no"], r["sentence"]) for r in textscan.keyword_sentences(df).collect()]
    pattern = re.compile("|".join(text.KEYWORDS), re.I)
    want = [
        (1, i, s) for i, s in enumerate(re.split(r"(?<=[.!?]) +", "We process data. Nothing here! Is it Missing? Knn rules. Interpolate now.  End")) if pattern.search(s)
    ]
    assert sorted(got) == want and len(want) == 4


@pytest.mark.parametrize(
    "page, title, abstract",
    [
        ('{"title":"A "quoted" one","abstract":"Short.","x":1}', 'A "quoted" one', "Short."),
        ("<html><TITLE lang=en>T\n2</TITLE></html>", "T\n2", None),
        ("nothing", None, None),
        ('"title":"","y"', "", None),
    ],
)
def test_page_heads(spark, page, title, abstract):
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    r = textscan.page_heads(df).first()
    assert (r["title"], r["abstract"]) == (title, abstract)
