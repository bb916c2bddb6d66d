import pytest
from pyspark.sql import functions as F

from quire.functions import markup
from quire.operators import markup_rows, regions
from quire.rules import DEFAULT


def rows(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    return [(r.kind, r.tag, r.text) for r in markup_rows.token_rows(df).orderBy("pos").collect()]


def spans(spark, html, pattern=markup.MARK):
    df = spark.createDataFrame([(html,)], "html string").select(markup.skeleton(F.col("html")).alias("bare"))
    return markup.with_spans(df, pattern).first()["__spans"]


def test_token_rows(spark):
    assert rows(spark, "<!DOCTYPE html><p>a<br/>b</p><!-- <p>no</p> --><script>var t='</p>';</script>") == [
        ("open", "p", None), ("text", "", "a"), ("void", "br", None), ("text", "", "b"), ("close", "p", None)
    ]


@pytest.mark.parametrize(
    "html, expected",
    [
        ('<p title="a>b">x</p>', ["p", "x", "p"]),
        ("x < y", ["x ", "<", " y"]),
        ('<p title="open>x</p><b>y</b>', ["<", 'p title="open>x', "p", "b", "y", "b"]),
        ("<P>unclosed<b>z", ["p", "unclosed", "b", "z"]),
    ],
)
def test_hostile_markup(spark, html, expected):
    assert [t or x for _, t, x in rows(spark, html)] == expected


def test_huge_attributes_do_not_exhaust_the_stack(spark):
    long_value = "<a title='" + "x" * 200_000 + "' href=y>z</a>"
    many = "<a " + " ".join(f'd{i}="v>"' for i in range(20_000)) + ">z</a>"
    for html in (long_value, many):
        assert [t or x for _, t, x in rows(spark, html)] == ["a", "z", "a"]
        assert spans(spark, html)[0]["len"] == 1


def test_attributes(value):
    token = "<a href='q?a=1&amp;b' Title=\"x>'y\" checked HREF=z>"
    assert value(markup.attributes, token) == {"href": "q?a=1&b", "title": "x>'y", "checked": ""}
    assert value(lambda t: markup.attribute(t, "href"), "<a x=' href=3' href = 4>") == "4"
    assert value(lambda t: markup.attribute(t, "href"), "<a>") is None


def test_element_spans_nest_and_close(spark):
    found = spans(spark, "<table><tr><td>ab<table><tr><td>c</table></table><p>one<p>two <b>three")
    by_tag = [(s["tag"], s["len"], s["parent"]) for s in found]
    assert by_tag == [
        ("table", 3, -1), ("tr", 3, 0), ("td", 3, 1), ("table", 1, 2), ("tr", 1, 3), ("td", 1, 4),
        ("p", 3, -1), ("p", 8, -1), ("b", 5, 7),
    ]


def test_stray_closing_tags_are_ignored(spark):
    assert [(s["tag"], s["len"]) for s in spans(spark, "</td><p>a</b></div>b</p></p>")] == [("p", 2)]


def test_many_elements_stay_in_order(spark):
    """More elements than one buffer block holds."""
    found = spans(spark, "".join(f"<i>{'x' * (n % 7)}</i>" for n in range(1000)))
    assert [s["len"] for s in found] == [n % 7 for n in range(1000)]
    assert [s["id"] for s in found] == list(range(1000))


def test_texts(value):
    html = "<p> a <b>b </b> </p>c<!-- x --> d"
    assert value(lambda h: markup.node_text(markup.skeleton(h)), html) == "abcd"
    assert value(lambda h: markup.joined_text(markup.skeleton(h)), html) == " a \nb \n \nc\n d"


def test_line_breaks(value):
    assert value(markup.br_to_breaks, "left<br>  <br/>right<br>") == "left\n\nright\n"
    assert value(markup.br_to_breaks, "a<BR />\n <br>b<br/>c") == "a\n\nb\nc"


def test_plain_text_detection(value):
    assert [value(markup_rows.is_plain_text, t) for t in ("", " \n<p>", "a <p>", " <")] == [True, False, True, False]


def test_title_cascade(spark):
    cases = {
        "<title> A  B </title><h1>Head</h1>": "A B",
        "<title>Untitled</title><h1>Hea</h1><h2>Head line</h2>": "Head line",
        "<title>Some Site</title><b>short</b><b>Long enough</b>": "Long enough",
        "<p>none</p>": "fallback",
        "<b>1</b><b>2</b><b>3</b><b>4</b><b>5</b><b>Sixth bold text</b>": "fallback",
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id int, html string")
    titled = markup_rows.titles(pages, fallback="fallback", rules=DEFAULT.but(site_names=("Some Site",)))
    assert [r["title"] for r in titled.orderBy("page_id").collect()] == list(cases.values())


def test_wrappers(value):
    assert value(markup.strip_wrappers, "<html><head><title>x</title></head><body><table><tr><td>a</td></tr></table></body></html>") == "a"


def headers(spark, html):
    df = spark.createDataFrame([(html,)], "html string").select(markup.skeleton(F.col("html")).alias("bare"))
    return df.transform(regions.break_headers).select(markup.joined_text(F.col("bare")).alias("t")).first()["t"]


def test_headers(spark):
    assert headers(spark, "a<b>Head</b>c") == "a\n\n\n\nHead\n\n\n\nc"
    assert headers(spark, "a<b>Hea</b>c") == "a\nHea\nc"
    assert headers(spark, f"a<strong>{'x' * 100}</strong>c") == f"a\n{'x' * 100}\nc"


def test_references_to_controls_make_no_marks(value):
    bare = lambda h: markup.node_text(markup.skeleton(h))
    assert value(bare, "<p>before &#1;lost text</p><p>after</p>") == "before \ufffdlost textafter"
    assert value(markup.skeleton, "&#x1;script&#x2;&#0000000065;&#x00000042;&#99999999999;&#0;") == "\ufffdscript\ufffdAB\ufffd\ufffd"
