import hashlib
import html
import random
from urllib.parse import urljoin

from quire.functions import dates, text, urls


def test_escape(values):
    cases = {"<script>": "&lt;script&gt;", "Tom & Jerry": "Tom &amp; Jerry", '"quoted"': "&quot;quoted&quot;", "it's": "it&#39;s"}
    assert values(text.escape_html, list(cases)) == list(cases.values())


def test_strip_is_unicode_aware(values):
    cases = ["\xa0 x ", " \tx y\n\u3000", "", " \t ", "\x1cx\x1f", "x"]
    assert values(text.py_strip, cases) == [c.strip() for c in cases]


def test_clean_text(values):
    rng = random.Random(1)
    cases = ["".join(rng.choice("ab \n\t\xa0\u2003\x1f") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    assert values(text.clean_text, cases) == [" ".join(c.split()) for c in cases]


def test_entities_as_in_html(values):
    cases = ["a &amp; b", "&amp;lt;", "&lt;&gt;&quot;", "&#8217;&#x2019;&#X2019;", "&nbsp;x&eacute;", "no entity & none", "&unknown;",
             "&#0;", "&#x110000;", "AT&T", "&", "a&amp", "&copy;2003", "&apos;", ""]
    assert values(text.decode_entities, cases) == [html.unescape(c) for c in cases]


def test_dates(values):
    cases = {"January 2003": "2003-01-01", "march 2008, rev. June 2008": "2008-03-01", "1993": "1993-01-01", "Foo 1850": None,
             "1850": None, "dismay 2003": "2003-05-01", "": None, None: None, "12003": None, "in 2001 or 2002": "2001-01-01",
             " May 2010 ": "2010-05-01"}
    parsed = values(dates.parse_date, list(cases))
    assert [p["date"] for p in parsed] == list(cases.values())
    assert [p["raw_date_str"] for p in parsed] == [(c or "").strip() for c in cases]


def test_display_date(values):
    rows = [("", "2003-01-01"), ("May 2003", "2003-05-01"), ("", None), (None, "")]
    assert values(dates.display_date, rows) == ["2003-01-01", "May 2003", "Unknown date", "Unknown date"]


def test_urls_resolve_like_urljoin(values):
    bases = ["http://a.example/b/c/d.html?q#f", "https://a.example", "https://a.example/x/"]
    refs = ["g.html", "./g", "../g", "../../g", "../../../g", "/g", "//other.example/g", "?y", "#s", "", "g/../h", "g?y/./x", "..", ".",
            "http://z.example/"]
    rows = [(b, r) for b in bases for r in refs]
    assert values(urls.resolve_url, rows) == [urljoin(b, r) for b, r in rows]


def test_ids_and_keys(values):
    assert values(urls.document_id, ["https://cdn.example/x/acl1.txt?t=1&", "x.html?y"]) == ["acl1.txt", "x.html?y"]
    assert values(urls.safe_key, ["a/b.html", "a_b.html", "x.html?y"]) == ["a_b", "a_b", "x?y"]
    assert values(urls.chapter_id, ["a/b.html"]) == ["essay_a_b"]


def test_image_names(values):
    cases = {"http://x/a.PNG": ".png", "http://x/a.png?x": ".jpg", "b.gif": ".gif", "c.webp": ".webp"}
    expected = [hashlib.md5(u.encode()).hexdigest() + e for u, e in cases.items()]
    assert values(urls.image_file_name, list(cases)) == expected
    assert values(urls.media_type, ["q.webp", "q.jpeg"]) == ["image/webp", "image/jpeg"]
