from pyspark.sql import functions as F

from quire.operators import paragraphs as para
from quire.rules import DEFAULT


def test_split(values):
    text = "First paragraph\there  with\r\n\r\nOK\n\n" + "x" * 10 + "\n \xa0\n" + "y" * 11 + "\nsame  one\n\n"
    assert values(para.split_paragraphs, [text]) == [["First paragraph here with", "y" * 11 + "\nsame one"]]
    assert values(para.split_paragraphs, [""]) == [[]]


def test_limits(values):
    nav, ad = "home " + "n" * 94, "y combinator " + "a" * 36
    assert values(para.is_navigation, [nav, nav + "n", "research is fun"]) == [True, False, True]
    assert values(para.is_ad, [ad, ad + "a"]) == [True, False]
    re_title = "Someone re: a topic: "
    assert values(para.is_link_title, [re_title, re_title + "x" * (60 - len(re_title)), "a b c d e f g h re: i", "Russian translation"]) == [
        True, False, False, False
    ]
    lines = ["January 2003", "march 2008, rev. June 2008", "In May 2003", "May 2003."]
    assert values(para.is_date_line, lines) == [True, True, False, False]


def test_word_matching_is_an_option(values):
    rules = DEFAULT.but(keyword_match="word")
    assert values(lambda p: para.is_navigation(p, rules), ["research is fun", "the arc is long"]) == [False, True]


def test_trailing_noise_limits(values):
    cases = {
        "Title Of Another Page": True, "Title Of another Page x x": True, "fragment without an end": True, "Short End.": True, "Short end.": False,
        "a real sentence that is short.": False, "A" * 60: True, "A" * 61: False, "x" * 40: False, "x" * 39: True,
        "A sentence that has thirty-one.": False, "ends here.": False,
    }
    cases["A" * 60] = False  # 60 long: one word, but not under 50 or 40
    assert dict(zip(cases, values(para.is_trailing_noise, list(cases)))) == cases


KEEP = "A full sentence of more than thirty letters stays where it is."
CASES = [
    ("a marker ends the text, wherever it stands", "", [KEEP, "He said: see also: the list", KEEP], [KEEP]),
    ("the title goes in any case", "  My Title ", [KEEP, "MY TITLE", KEEP], [KEEP, KEEP]),
    ("short navigation goes, long stays", "", ["home sweet home", KEEP, "home " + "x" * 95], [KEEP, "home " + "x" * 95]),
    ("short advertisement goes, long stays", "", ["y combinator here", KEEP, "y combinator " + "k" * 90], [KEEP, "y combinator " + "k" * 90]),
    ("a link title has a colon, a hint and few blanks", "", ["German: translation", KEEP], [KEEP]),
    ("many blanks are no link title", "", ["a b c d e f g h: translation of it", KEEP], ["a b c d e f g h: translation of it", KEEP]),
    ("date lines go", "", ["May 2003", "June 2004, rev. July 2005", "May 2003 and on", KEEP], ["May 2003 and on", KEEP]),
    ("fragments at the end go one by one", "", [KEEP, "Other Page Title", "and a fragment"], [KEEP]),
    ("a fragment before a sentence stays", "", [KEEP, "and a fragment", KEEP], [KEEP, "and a fragment", KEEP]),
    ("a short sentence ends the trimming", "", [KEEP, "It ends so.", "Lost Title"], [KEEP, "It ends so."]),
    ("all may go", "", ["Lost Title", "x y z"], []),
    ("nothing stays nothing", "", [], []),
]


def test_rules_one_by_one(spark):
    df = spark.createDataFrame([(i, t, ps) for i, (_, t, ps, _) in enumerate(CASES)], "id int, title string, ps array<string>")
    done = df.select("id", para.trim_tail(para.keep_content(F.col("ps"), F.col("title"))).alias("ps"))
    found = {CASES[r.id][0]: r.ps for r in done.collect()}
    assert found == {name: want for name, _, _, want in CASES}


def test_container(spark):
    df = spark.createDataFrame([(["a < b & 'c'", "d"],), ([],)], "ps array<string>")
    assert [r.h for r in df.select(para.wrap_paragraphs(F.col("ps")).alias("h")).collect()] == [
        "<div class=\"essay-content\"><p>a &lt; b &amp; 'c'</p><p>d</p></div>", '<div class="essay-content"></div>'
    ]


BOX = '<div class="essay-content">\n{}</div>'
PLAIN = [
    ("", "", ""),
    ("one & more\ntwo", "<p>one &amp; more two</p>\n", None),
    ("one\n\n   \ntwo", "<p>one</p>\n<p>two</p>\n", None),
    ("  code(x);\n  DEF y", "<pre><code>  code(x);\n  DEF y</code></pre>\n", "<pre><code>\n  code(x);\n\n\n  DEF y\n\n\n</code></pre>\n"),
    ("  indented prose\n'quoted'", "<p>indented prose &#39;quoted&#39;</p>\n", None),
    ("prose\n  ;\nprose", "<p>prose</p>\n<pre><code>  ;</code></pre>\n<p>prose</p>\n", "<p>prose</p>\n<pre><code>\n  ;\n\n\n</code></pre>\n<p>prose</p>\n"),
]


def test_plain_text(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PLAIN)], "id int, t string")
    for compat in (False, True):
        done = df.select("id", para.plain_text_to_html(F.col("t"), DEFAULT.but(compat=compat)).alias("h")).collect()
        want = {i: BOX.format(old if compat and old is not None else new) for i, (_, new, old) in enumerate(PLAIN)}
        assert {r.id: r.h for r in done} == want
