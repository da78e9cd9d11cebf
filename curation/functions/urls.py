"""URL expressions: canonical forms, shapes, names and links."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from curation.functions import vocabulary as V

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
SUFFIX_LABELS = ["edu", "ac", "com", "org", "net", "gov"]


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _PARTS, 1))


def host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _PARTS, 2))


def path(u: Column) -> Column:
    return F.regexp_extract(u, _PARTS, 3)


def canonical(u: Column) -> Column:
    """Lower-case scheme and host, path without trailing slashes, no query or fragment; null if not absolute."""
    t = F.trim(F.coalesce(u, F.lit("")))
    return F.when(host(t) != "", F.concat(scheme(t), F.lit("://"), host(t), F.regexp_replace(path(t), "/+$", "")))


def segments(u: Column) -> Column:
    return F.filter(F.split(path(u), "/"), lambda s: s != "")


def shape(u: Column) -> Column:
    """Host and path with numeric segments replaced, for telling pages of one listing from another page."""
    parts = F.transform(segments(u), lambda s: F.when(s.rlike(r"^[0-9]+$"), F.lit("{N}")).otherwise(F.lower(s)))
    return F.concat(F.regexp_replace(host(u), ":.*$", ""), F.lit("/"), F.concat_ws("/", parts))


def name_signal(u: Column) -> Column:
    """Words of the path, without segments that look like course codes."""
    decoded = F.transform(segments(u), lambda s: F.trim(F.coalesce(F.try_url_decode(F.regexp_replace(s, r"\+", "%2B")), s)))
    words = F.filter(decoded, lambda s: ~((F.length(s) <= 6) & s.rlike("[0-9]") & ~s.rlike("[-_ ]")))
    clean = F.transform(words, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-zA-Z0-9]+", " "), " +", " ")))
    return F.concat_ws(" ", F.filter(clean, lambda s: s != ""))


def university_slug(u: Column) -> Column:
    """The host's label left of at most one country and one second-level suffix."""
    labels = F.filter(F.split(F.regexp_replace(host(u), ":.*$", ""), r"\."), lambda s: s != "")
    last = F.element_at(labels, -1)
    one = F.when((F.size(labels) > 1) & last.rlike("^[a-z]{2}$"), F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels)
    suffix = F.element_at(one, -1).isin(SUFFIX_LABELS) & (F.size(one) > 1)
    two = F.when(suffix, F.slice(one, 1, F.size(one) - 1)).otherwise(one)
    return F.when(F.size(labels) == 0, F.lit("")).otherwise(F.element_at(two, -1))


def page_pattern(u: Column) -> Column:
    """Last two path segments, digits replaced."""
    s = segments(u)
    return F.regexp_replace(F.concat_ws("/", F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), F.lit(2))), "[0-9]+", "{N}")


def noise(u: Column) -> Column:
    return F.lower(F.coalesce(u, F.lit(""))).rlike(V.NOISE_URL)


def same_section(u: Column, base: Column) -> Column:
    """Same host, and the path is the base's or lies below it; a base without a path owns its whole host."""
    below = F.regexp_replace(path(base), "/+$", "")
    return (host(u) == host(base)) & (host(u) != "") & ((below == "") | (path(u) == below) | F.startswith(path(u), F.concat(below, F.lit("/"))))


def sub_link_weight(u: Column) -> Column:
    low, total = F.lower(F.coalesce(u, F.lit(""))), F.lit(0)
    for pattern, weight in V.SUB_LINKS:
        total = total + F.when(low.rlike(pattern), weight).otherwise(0)
    return total


def link_score(u: Column, text: Column, base: Column, detail: str, listing: str, degree: str, nav: str) -> Column:
    """Eight for a detail path or else three for a course path, four for a degree, minus four for navigation, one for the same host."""
    low, words = F.lower(F.coalesce(u, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    at = F.when(low.rlike(detail), 8).when(low.rlike(listing), 3).otherwise(0)
    own = F.when((host(low) != "") & (host(low) == host(base)), 1).otherwise(0)
    return at + F.when(words.rlike(degree), 4).otherwise(0) - F.when(words.rlike(nav), 4).otherwise(0) + own


def with_query_param(u: Column, name: str, value: Column) -> Column:
    """The URL with one query parameter set, others kept in order."""
    base, query = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"\?([^#]*)", 1)
    others = F.filter(F.split(query, "&"), lambda p: (p != "") & (F.lower(F.regexp_extract(p, "^([^=]*)", 1)) != name.lower()))
    return F.concat(base, F.lit("?"), F.concat_ws("&", F.concat(others, F.array(F.concat(F.lit(f"{name}="), value.cast("string"))))), F.regexp_extract(u, r"(#.*)$", 1))


def with_param(u: Column, name: Column, value: Column) -> Column:
    """The URL with one query parameter set behind the others; a parameter of that name in any case goes."""
    others = F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & (F.lower(F.regexp_extract(p, "^([^=]*)", 1)) != F.lower(name)))
    query = F.concat(others, F.array(F.concat(name, F.lit("="), value.cast("string"))))
    return F.concat(F.regexp_extract(u, r"^([^?#]*)", 1), F.lit("?"), F.concat_ws("&", query), F.regexp_extract(u, r"(#.*)$", 1))


def next_page(u: Column, page: Column, markdown: Column, param: Column, start: Column) -> Column:
    """The next page's URL after ``page`` pages: by a given parameter and its first value, else by the one the URL has, else
    by a link that says next; null if there is none."""
    own, value = F.regexp_extract(u, r"(?i)[?&](page|pg|p)=[0-9]+", 1), F.regexp_extract(u, r"(?i)[?&](?:page|pg|p)=([0-9]+)", 1).try_cast("int")
    link = F.regexp_extract(F.coalesce(markdown, F.lit("")), r"(?i)\[[^\]]*(?:next|下一页|›|»)[^\]]*\]\(\s*([^)\s]+)", 1)
    return F.when(param.isNotNull(), with_param(u, param, F.coalesce(start, F.lit(1)) + page)).when(value.isNotNull(), with_param(u, own, value + 1)).when(link != "", resolved(link, u))


def target_path(link: Column) -> Column:
    """The path of an absolute or relative link."""
    return F.regexp_extract(F.regexp_replace(link, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), r"^(?://[^/?#]*)?([^?#]*)", 1)


def without_dots(path_: Column) -> Column:
    """A path with its dot segments resolved; those above the root go."""
    parts = F.split(path_, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.concat_ws("/", closed)
    return F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))


def resolved(link: Column, base: Column) -> Column:
    """A link against the page it stands on, as RFC 3986 has it: absolute, scheme-relative, rooted and relative links,
    dot segments, a query or a fragment alone."""
    root = F.concat(scheme(base), F.lit("://"), host(base))
    own, tail = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"[?#].*$", 0)
    query = F.regexp_extract(base, r"^[^#]*", 0)
    return (
        F.when(link.isNull() | link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme(base), F.lit(":"), link))
        .when(own != "", F.concat(root, without_dots(F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.regexp_replace(path(base), "[^/]*$", ""), own))), tail))
        .when(F.startswith(tail, F.lit("#")), F.concat(query, tail))
        .when(tail != "", F.concat(root, path(base), tail))
        .otherwise(base)
    )


def query_value(link: Column, name: Column) -> Column:
    """The first value of a query parameter, null if there is none."""
    parts = F.split(F.regexp_extract(link, r"\?([^#]*)", 1), "&")
    hit = F.try_element_at(F.filter(parts, lambda p: F.startswith(p, F.concat(name, F.lit("=")))), F.lit(1))
    return F.substring(hit, F.length(name) + 2, F.length(hit))


def with_query_value(link: Column, name: Column, value: Column) -> Column:
    """The link with a query parameter that it has set to another value, in its place."""
    parts = F.split(F.regexp_extract(link, r"\?([^#]*)", 1), "&")
    new = F.transform(parts, lambda p: F.when(F.startswith(p, F.concat(name, F.lit("="))), F.concat(name, F.lit("="), value.cast("string"))).otherwise(p))
    return F.concat(F.regexp_extract(link, r"^([^?#]*)", 1), F.lit("?"), F.concat_ws("&", new))


def unescaped(c: Column) -> Column:
    """Text with its HTML entities resolved."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(t))

    return plain(c)


def html_links(page: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r'<a href="([^"]*)"'), F.lit(1))


def html_link_texts(page: Column) -> Column:
    """Texts of the links of ``html_links``, place for place: up to the end of the link, or the next one or the end of the page."""
    texts = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r'(?s)<a href="[^"]*"(?:[^>]*>(.*?)(?=</a>|<a |\z))?'), F.lit(1))
    return F.transform(texts, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " ")))


def markdown_links(text: Column) -> Column:
    """Targets of markdown links; a label may hold one level of brackets."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(?:[^\[\]]|\[[^\[\]]*\])*\]\(([^) ]+)"), F.lit(1))


def dug(body: Column, path_: str) -> Column:
    """The items at a dotted path of a JSON text, as an array of variants; null where it isn't JSON or has no array there."""
    return F.try_variant_get(F.try_parse_json(body), f"$.{path_}", "array<variant>")


def dug_value(item: Column, path_: str, kind: str) -> Column:
    """The value at a dotted path of an item; null where there is none of that kind."""
    return F.try_variant_get(item, f"$.{path_}", kind)
