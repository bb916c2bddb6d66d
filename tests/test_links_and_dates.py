import random

from pyspark.sql import functions as F

from quire.functions.dates import DATE_LINE, iso_date, nearby_date
from quire.operators import links, page_dates
from quire.rules import DEFAULT

INDEX = """<table><tr><td>
<a href="first.html">First essay</a> <a href="http://cdn.example/x/ok/one.txt?t=1">Chapter one</a>
<a href="http://elsewhere.example/two.html">Blocked</a><a href="#x">Fragment</a><a href="faq.html">FAQ page</a>
<a href="faq.html?x">FAQ with query</a><a href="first.html">First again</a><a href="ab.html">ab</a><a href="paper.pdf">Paper</a>
<a>no target</a><a href="">Empty</a><a href="http://cdn.example/y/ok/one.txt">Chapter one copy</a><a href="one.txt">Relative one</a>
</td></tr><tr><td>March 2004: <a href="dated.html">Dated</a></td></tr>
<tr><td><a href="year.html">Year</a> from 1999</td></tr></table>"""


def listed(spark, rules):
    df = spark.createDataFrame([(1, INDEX)], "page_id bigint, html string")
    return links.document_links(df, rules=rules).orderBy("pos").collect()


def test_index_links(spark):
    rules = DEFAULT.but(site_base="https://site.example", external_allow=("example/x/ok", "example/y/ok"))
    found = listed(spark, rules)
    assert [(r.doc_id, r.title) for r in found] == [
        ("first.html", "First essay"), ("one.txt", "Chapter one"), ("faq.html?x", "FAQ with query"), ("dated.html", "Dated"),
        ("year.html", "Year"),
    ]
    assert [r.url for r in found][:2] == ["https://site.example/first.html", "http://cdn.example/x/ok/one.txt?t=1"]
    assert [(r.date, r.raw_date_str) for r in found][-2:] == [("2004-03-01", "March 2004"), ("1999-01-01", "1999")]
    assert found[0].date is None and found[0].raw_date_str == ""


def test_compat_keeps_external_copies(spark):
    rules = DEFAULT.but(external_allow=("cdn.example",), compat=True)
    assert [r.doc_id for r in listed(spark, rules)] == ["first.html", "one.txt", "faq.html?x", "one.txt", "dated.html", "year.html"]


def test_first_link_wins_like_the_loop(spark):
    rng = random.Random(11)
    choices = ["a.html", "b.html", "c.txt", "http://cdn.example/a.html", "http://cdn.example/c.txt?q"]
    pages = [(i, [rng.choice(choices) for _ in range(rng.randint(0, 8))]) for i in range(120)]
    df = spark.createDataFrame(
        [(i, "".join(f'<a href="{h}">link {n}</a>' for n, h in enumerate(hs))) for i, hs in pages], "page_id int, html string"
    )
    for compat in (False, True):
        expected = set()
        for i, hs in pages:
            seen = set()
            for n, h in enumerate(hs):
                key = h.split("?")[0].rsplit("/", 1)[-1] if h.startswith("http") else h
                if (h if compat else key) in seen:
                    continue
                seen.add(key)
                expected.add((i, n, key))
        rules = DEFAULT.but(external_allow=("cdn.example",), compat=compat)
        found = links.document_links(df, rules=rules, with_dates=False).collect()
        assert {(r.page_id, r.pos, r.doc_id) for r in found} == expected


def test_page_dates(spark):
    cases = {
        '<font size="2" face="verdana">October 2017<br />\n<br />Words</font>': ("2017-10-01", "October 2017"),
        '<p>x</p><font size="2" face="verdana">August 2012, rev. May 2015<br>x</font>': ("2012-08-01", "August 2012, rev. May 2015"),
        '<font size="2" face="verdana">1987\nWords</font>': ("1987-01-01", "1987"),
        '<font size=3>May 2001<br></font><font size="2" face="verdana">April 2002<br></font>': ("2002-04-01", "April 2002"),
        "<font>Augusta 2001<br>x</font>": ("2001-01-01", "Augusta 2001"),
        "<font>Foo 1850<br>x</font><p>2001 on</p>": (None, "Foo 1850"),
        "<font>x</font><div>  september 2010 and on</div>": ("2010-09-01", "september 2010"),
        "<p>1850 was long ago</p><p>May 2001</p>": (None, "1850"),
        "<p>nothing</p>": (None, ""),
        "<!-- <font>May 1999<br></font> --><p>2004 began</p>": ("2004-01-01", "2004"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "n int, html string")
    found = df.transform(page_dates.with_page_date).orderBy("n").collect()
    assert [(r.page_date, r.page_raw_date) for r in found] == list(cases.values())


def test_page_date_takes_precedence_only_when_parsed(spark):
    df = spark.createDataFrame(
        [("a", "2001-01-01", "2001", "2002-01-01", "2002"), ("b", "2001-01-01", "2001", None, "1850")],
        "doc_id string, date string, raw_date_str string, page_date string, page_raw_date string",
    )
    rows = df.transform(page_dates.prefer_page_date).orderBy("doc_id").collect()
    assert [(r.date, r.raw_date_str) for r in rows] == [("2002-01-01", "2002"), ("2001-01-01", "2001")]


def test_wide_blanks_in_dates(spark, values):
    assert values(iso_date, ["March\u00a02004", "x\u2003May\u2003 1999"]) == ["2004-03-01", "1999-05-01"]
    assert values(nearby_date, ["in March\u00a02004 and"]) == ["March\u00a02004"]
    assert values(lambda t: t.rlike(DATE_LINE), ["March\u00a02004", "March 2004,\u00a0rev. May\u00a02005"]) == [True, True]
    for html in ("<font>March&nbsp;2004<br>x</font>", "<p>March&nbsp;2004 began</p>", "<font>March\u00a02004<br></font>"):
        df = spark.createDataFrame([(html,)], "html string").transform(page_dates.with_page_date)
        assert df.first().page_date == "2004-03-01"


def test_anchor_text_is_the_same_with_and_without_dates(spark):
    df = spark.createDataFrame([(1, "<p><a href='x.html'> Foo <b>Bar </b> baz</a></p>")], "page_id int, html string")
    for with_dates in (True, False):
        assert [a.text for a in df.transform(links.anchors, with_dates=with_dates).first().anchors] == ["FooBarbaz"]
