import time
import timeit
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions.spans import nested, spans_of
from quire.operators import regions
from quire.operators.content import extract_content
from quire.rules import DEFAULT


def after(spark, html, step, rules=DEFAULT):
    df = spark.createDataFrame([(html,)], "html string").select(markup.skeleton(F.col("html")).alias("bare"))
    return df.transform(step, rules=rules).select(markup.node_text(F.col("bare")).alias("t")).first()["t"]


NAV = "<table><tr><td><a href=a>Home</a><a href=b>Essays</a><a href=c>RSS</a></td></tr></table>"
LONG = "words and more " * 40


def test_short_table_with_keywords_goes(spark):
    assert after(spark, f"x{NAV}<table><tr><td>home</td></tr></table>y", regions.remove_navigation) == "xhomey"


def test_keywords_count_as_substrings_across_nodes(spark):
    html = "<table><tr><td>re<b>search</b> bel lisp</td></tr></table>y"
    assert after(spark, html, regions.remove_navigation) == "y"


def test_link_heavy_table_goes_with_all_content(spark):
    links = "".join(f"<a href=x>{t}</a>" for t in ("Home", "Essays", "RSS", "one", "two"))
    assert after(spark, f"<table><tr><td>{links}{LONG}</td></tr></table>y", regions.remove_navigation) == "y"
    four = links.replace("<a href=x>two</a>", "")
    assert after(spark, f"<table><tr><td>{four}{LONG}</td></tr></table>y", regions.remove_navigation) != "y"


def test_nested_navigation_inside_a_kept_table(spark):
    html = f"<table><tr><td>{NAV}{LONG}</td></tr></table>"
    assert after(spark, html, regions.remove_navigation) == LONG.strip()


def test_outer_table_with_most_text_wins(spark):
    html = f"<table><tr><td>outer<table><tr><td>{LONG}</td></tr></table></td></tr></table><p>rest</p>"
    assert after(spark, html, regions.main_region) == "outer" + LONG.strip()


def test_first_of_equal_tables_wins(spark):
    tables = [f"<table><tr><td>{'a' * 600}</td></tr></table>", f"<table><tr><td>{'b' * 600}</td></tr></table>"]
    assert after(spark, "".join(tables), regions.main_region) == "a" * 600


@pytest.mark.parametrize(
    "html, text",
    [
        ("<head><title>t</title></head><body>b<table>small</table></body>", "bsmall"),
        ("<title>t</title>no body", "no body"),
        ("", ""),
    ],
)
def test_fallbacks(spark, html, text):
    assert after(spark, html, regions.main_region) == text


def test_one_element_of_every_kind_of_parent(spark):
    html = "<ul><li><a href=x>alone</a></li><li><a href=x>not</a> alone in here</li></ul><p>See <a href=x>this</a> now</p>"
    assert after(spark, html, regions.remove_lone_links) == "notalone in hereSeethisnow"
    nested = "<ul><li><b><a href=x>deep</a>!</b></li></ul>"
    assert after(spark, nested, regions.remove_lone_links) == "deep!"
    long_link = f"<li><a href=x>{'y' * 80}</a></li>"
    assert after(spark, long_link, regions.remove_lone_links) == "y" * 80


WORDS, FIVE, LONG_ONE = "word word word", "<a href=x>lllll</a>", "<a href=x>" + "m" * 12 + "</a>"


@pytest.mark.parametrize(
    "html, left",
    [
        (f"<li>{FIVE}xy</li>", "xy"),  # little else in a list item
        (f"<li>{FIVE}{WORDS}</li>", "lllll" + WORDS),
        (f"<td>{WORDS}{FIVE} and more</td>", WORDS + "llllland more"),
        (f"<p>{FIVE}xy</p>", "lllllxy"),  # no container, text beside it
        (f"<p>{FIVE} {FIVE}</p>", ""),  # blanks and other links beside it
        (f"<p>{FIVE}<i>xy</i></p>", "lllllxy"),
        (f"<font><a href=x>{'l' * 79}</a></font>", ""),
        (f"<font><a href=x>{'l' * 80}</a></font>", "l" * 80),
        (f"<li>xy{LONG_ONE}<i>wordword</i>{FIVE}</li>", "xy" + "m" * 12 + "wordword" + "lllll"),
        # the first stands alone; what it leaves is little beside the second, which does not
        (f"<li>{LONG_ONE} {LONG_ONE}<i>wordword</i></li>", "wordword"),
        (f"<p>{LONG_ONE} {LONG_ONE}<i>wordword</i></p>", "m" * 12 + "wordword"),
        (f"<td>{LONG_ONE}{LONG_ONE}word word</td>", "word word"),
    ],
)
def test_lone_links(spark, html, left):
    assert after(spark, html, regions.remove_lone_links) == left


PAGE = """<html><body><table><tr><td><font size="2" face="verdana">{}</font></td></tr></table></body></html>"""


def extracted(spark, html, title="", compat=True):
    df = spark.createDataFrame([(html, title)], "html string, title string")
    return extract_content(df, rules=DEFAULT.but(compat=compat)).first()


@pytest.mark.parametrize("compat", [True, False])
def test_whole_page(spark, compat):
    body = "Rivers carry sand down to the plain, and every flood lays another thin sheet of it over the last one."
    page = PAGE.format(f"March 2011<br><br>{body}<br><br>Y Combinator again.")
    found = extracted(spark, page, "Test", compat)
    assert found.paragraphs == [body]
    assert found.content_html == f'<div class="essay-content"><p>{body}</p></div>'
    assert found.n_chars == len(body)


def test_empty_and_malformed_pages(spark):
    assert extracted(spark, "").content_html == '<div class="essay-content">\n</div>'
    odd = extracted(spark, "<i>Never closed<ul>and closed twice, among some words of filler</i></ul></ul>")
    assert odd.content_html.startswith('<div class="essay-content">')


def test_compat_glues_where_blocks_break(spark):
    page = "<body><p>First paragraph that is long enough to stay put, really and truly.</p><p>Second paragraph that is also long enough to stay put.</p></body>"
    assert len(extracted(spark, page, compat=True).paragraphs) == 1
    assert len(extracted(spark, page, compat=False).paragraphs) == 2


def test_huge_pages_take_time_in_proportion(spark):
    """Tens of thousands of elements, closed or not, go through the whole chain in seconds."""
    for html in ("<p>x</p>" * 50_000, "<span>x" * 50_000):
        began = time.monotonic()
        extracted(spark, f"<body>{html}</body>", compat=False)
        assert time.monotonic() - began < 30


def test_kernels_are_linear():
    def took(n):
        names, lengths = ["span"] * n + ["p", "/p"] * n, [1] * (3 * n + 1)
        return min(timeit.repeat(lambda: nested(names, lengths, None, None), timer=time.process_time, number=1, repeat=7))

    assert took(40_000) < 3 * took(20_000) + 0.05  # four times as long if it were quadratic


def test_images_of_the_chosen_region(spark):
    rules = DEFAULT.but(region_tags=("article",), nav_tags=("table",))
    text = "Words of a page that is long enough to be the region of it. " * 12
    html = ('<table><tr><td><img src="banner.gif">Home Essays RSS Bio</td></tr></table><article>' + text + '<img src="a.png"><IMG SRC="b.png" alt=c>'
            '<img src="home.gif"><img></article><p><img src="foot.png"></p>')  # fmt: skip
    df = spark.createDataFrame([(html, "", "http://s.example/d/x.html")], "html string, title string, url string")
    found = extract_content(df, rules=rules, base="url").first()
    assert [i.url for i in found.image_refs] == ["http://s.example/d/a.png", "http://s.example/d/b.png"]
    assert "img" not in found.content_html


def test_kernels_hold_few_pages_at_a_time():
    """Ten times as many pages in a batch take no more memory beside it; nulls and slices keep their places."""
    page, size = ["div", "p", "/p", "a", "/a", "/div"] * 50, [5] * 301

    def peak(pages):
        batch = pa.array([page] * pages), pa.array([size] * pages)
        tracemalloc.start()
        found = [(len(c), max(map(len, c.to_pylist()))) for c in spans_of([batch], "a", 3_000)]
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(n for n, _ in found) == pages and {most for _, most in found} == {150} and max(n for n, _ in found) == 10
        return used

    small, large = peak(100), peak(1_000)
    assert large < 2 * small + 3_000_000  # the sizes of the batch's own lists grow, its elements are given back

    names = pa.array([["p"], None, [], ["p", "/p", "b"]])
    lengths = pa.array([[1, 2], [9], [3], [1, 2, 3, 4]])
    rows = [e and [(x["tag"], x["open"], x["close"], x["len"]) for x in e] for c in spans_of([(names, lengths)], None, 1) for e in c.to_pylist()]
    assert rows == [[("p", 0, 1, 2)], None, [], [("p", 0, 1, 2), ("b", 2, 3, 4)]]
    sliced = [len(e) for c in spans_of([(names.slice(2), lengths.slice(2))], None, 1) for e in c.to_pylist()]
    assert sliced == [0, 2]
