"""Rule parameters.

Every word list, limit and format the operators use is a field here, so that a different site is a different
``Rules`` value and not a code change. Site names and addresses have no default.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- Fixed values: word lists, limits and formats that results depend on -------------------------------------

MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

SKIP_HREFS = ("index.html", "rss.html", "faq.html", "raq.html", "bio.html", "quo.html")

LINK_SUFFIXES = (".html", ".txt")

NAV_KEYWORDS = (
    "home", "essays", "h&p", "books", "yc", "arc", "bel", "lisp", "spam", "responses", "faqs", "raqs",
    "quotes", "rss", "bio", "twitter", "mastodon", "x.com",
)

NAV_PHRASES = (
    "want to start a startup? get funded by y combinator", "home", "essays", "faq", "raq", "subscribe",
    "twitter", "x.com", "rss", "mastodon", "books", "arc", "bel", "lisp",
)

AD_PHRASES = ("get funded by", "y combinator", "want to start a startup")

RELATED_MARKERS = ("related:", "related links:", "see also:")

LINK_TITLE_HINTS = (" re: ", "translation")

DECORATIVE_IMAGES = (
    "spacer.gif", "pixel.gif", "1x1.", "blank.gif", "essays-hierarchical.gif", "rss-hierarchical.gif",
    "dot.gif", "bullet.gif", "clear.gif",
)

IMAGE_SUFFIXES = {".png": "image/png", ".gif": "image/gif", ".webp": "image/webp"}
DEFAULT_IMAGE_SUFFIX = ".jpg"
DEFAULT_IMAGE_TYPE = "image/jpeg"

UNKNOWN_DATE = "Unknown date"

CONTENT_CLASS = "essay-content"
DATE_CLASS = "essay-date"
CHAPTER_PREFIX = "essay_"
STYLESHEET = "style.css"
TOC_SECTION = "Essays"

ORDERS = ("asc", "desc")

# --- HTML vocabulary -----------------------------------------------------------------------------------------

VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
)

BLOCK_TAGS = ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br")

# Block elements that end a bold passage nobody closed.
HEADER_ENDS = ("p", "li", "td", "tr", "table", "div", "article", "section", "blockquote", "body")

# An opening tag ends an open element of the same name unless one of these was opened in between.
SELF_CLOSING_SCOPES = {
    "p": ("table", "td", "th", "li", "div", "ul", "ol", "dl", "article", "section", "nav", "blockquote", "body"),
    "li": ("ul", "ol", "table"),
    "td": ("table", "tr"),
    "th": ("table", "tr"),
    "tr": ("table",),
    "dt": ("dl",),
    "dd": ("dl",),
    "option": ("select",),
    "a": ("table", "td", "th"),
}


@dataclass(frozen=True)
class Rules:
    """One set of curation rules; ``compat=True`` switches on the documented historical quirks."""

    # links
    site_base: str = ""
    skip_hrefs: tuple[str, ...] = SKIP_HREFS
    external_allow: tuple[str, ...] = ()
    link_suffixes: tuple[str, ...] = LINK_SUFFIXES
    min_link_text: int = 3
    # titles
    site_names: tuple[str, ...] = ()
    # regions
    nav_tags: tuple[str, ...] = ("table",)
    nav_keywords: tuple[str, ...] = NAV_KEYWORDS
    nav_text_below: int = 500
    nav_min_hits: int = 3
    nav_min_links: int = 5
    region_tags: tuple[str, ...] = ("table",)
    region_text_above: int = 500
    link_containers: tuple[str, ...] = ("li", "td", "font")
    lone_link_below: int = 80
    lone_link_slack: int = 10
    header_tags: tuple[str, ...] = ("b", "strong")
    header_between: tuple[int, int] = (3, 100)
    block_tags: tuple[str, ...] = BLOCK_TAGS
    # paragraphs
    min_paragraph: int = 10
    related_markers: tuple[str, ...] = RELATED_MARKERS
    nav_phrases: tuple[str, ...] = NAV_PHRASES
    nav_phrase_below: int = 100
    ad_phrases: tuple[str, ...] = AD_PHRASES
    ad_phrase_below: int = 50
    link_title_hints: tuple[str, ...] = LINK_TITLE_HINTS
    link_title_below: int = 60
    link_title_spaces: int = 8
    lone_marks: tuple[str, ...] = (".", ",")
    keyword_match: str = "substring"
    # chapters
    min_chapter: int = 100
    # images
    decorative: tuple[str, ...] = DECORATIVE_IMAGES
    min_image_side: int = 50
    # collections
    language: str = "en"
    author: str = ""
    publisher: str = ""
    identifier_prefix: str = "collection"
    collection_title: str = "Collection"
    # behaviour
    compat: bool = False

    def but(self, **changes) -> "Rules":
        return replace(self, **changes)


DEFAULT = Rules()
