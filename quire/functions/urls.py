"""Link targets: absolute URLs, document ids, file-safe keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.rules import CHAPTER_PREFIX, DEFAULT_IMAGE_SUFFIX, DEFAULT_IMAGE_TYPE, IMAGE_SUFFIXES

# scheme, authority, path, query, fragment of a URL reference (RFC 3986, appendix B)
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, "(?s)" + _PARTS, group)


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments with one fold over the path segments."""
    segments = F.split(path, "/", -1)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, seg: F.when(seg == ".", kept)
        .when(seg == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
        .otherwise(F.concat(kept, F.array(seg))),
    )
    ends_in_dot = path.rlike(r"/\.\.?$")
    resolved = F.array_join(folded, "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.when(
        ends_in_dot & ~F.endswith(resolved, F.lit("/")), F.concat(resolved, F.lit("/"))
    ).otherwise(resolved)).otherwise(path)


def resolve_url(base: Column, ref: Column) -> Column:
    """Join a reference with a base URL by the RFC 3986 rules, natively."""
    scheme, authority, path, query = (_part(base, g) for g in (1, 2, 3, 4))
    folder = F.regexp_replace(path, F.lit(r"[^/]*$"), F.lit(""))
    folder = F.when((folder == "") & (authority != ""), F.lit("/")).otherwise(folder)
    root = F.concat(scheme, F.lit(":"), authority)
    ref_path, ref_tail = _part(ref, 3), F.concat(_part(ref, 4), _part(ref, 5))
    return (
        F.when(ref == "", base)
        .when(_part(ref, 1) != "", ref)
        .when(scheme == "", ref)
        .when(_part(ref, 2) != "", F.concat(scheme, F.lit(":"), ref))
        .when(F.startswith(ref_path, F.lit("/")), F.concat(root, _without_dots(ref_path), ref_tail))
        .when(ref_path != "", F.concat(root, _without_dots(F.concat(folder, ref_path)), ref_tail))
        .when(_part(ref, 4) != "", F.concat(root, path, ref_tail))
        .otherwise(F.concat(root, path, query, ref_tail))
    )


def is_external(href: Column) -> Column:
    return F.startswith(href, F.lit("http"))


def before_query(href: Column) -> Column:
    return F.substring_index(href, "?", 1)


def document_id(href: Column) -> Column:
    """A relative link is its own id (query included); an external one is the last path segment."""
    return F.when(is_external(href), F.substring_index(before_query(href), "/", -1)).otherwise(href)


def absolute_url(site_base: Column, href: Column) -> Column:
    """L6 as used for index links: external targets stay untouched."""
    return F.when(is_external(href), href).otherwise(resolve_url(site_base, href))


def safe_key(doc_id: Column) -> Column:
    """Slashes become underscores and every '.html' goes."""
    return F.replace(F.replace(doc_id, F.lit("/"), F.lit("_")), F.lit(".html"), F.lit(""))


def chapter_id(doc_id: Column, prefix: str = CHAPTER_PREFIX) -> Column:
    return F.concat(F.lit(prefix), safe_key(doc_id))


def _by_suffix(name: Column, values: dict[str, str], default: str) -> Column:
    low = F.lower(name)
    out = F.lit(default)
    for suffix, value in values.items():
        out = F.when(F.endswith(low, F.lit(suffix)), F.lit(value)).otherwise(out)
    return out


def image_file_name(url: Column) -> Column:
    """I4: md5 of the URL plus the extension its end names; anything else, queries included, is .jpg."""
    return F.concat(F.md5(url), _by_suffix(url, {s: s for s in IMAGE_SUFFIXES}, DEFAULT_IMAGE_SUFFIX))


def media_type(file_name: Column) -> Column:
    """Media type from the extension."""
    return _by_suffix(file_name, IMAGE_SUFFIXES, DEFAULT_IMAGE_TYPE)

