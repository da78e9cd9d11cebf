"""Names, tokens, headings and boilerplate, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from curation.functions import vocabulary as V


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8, else as GB18030, else as Latin-1, each decoded strictly; only bytes that aren't UTF-8 reach Python."""

    @F.pandas_udf("string")
    def ladder(rows: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            try:
                return bytes(b).decode("gb18030")
            except UnicodeDecodeError:
                return bytes(b).decode("latin-1")

        return pd.Series([one(b) for b in rows], dtype=object)

    utf8 = F.try_validate_utf8(raw.cast("string"))
    return F.coalesce(utf8, ladder(F.when(utf8.isNull(), raw)))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def programme_key(c: Column) -> Column:
    """Compact name: tokens but for stopwords; if only those, all of them; ``unknown`` if none."""
    t = tokens(c)
    strong = F.concat_ws("", F.filter(t, lambda x: ~x.isin(V.STOPWORDS)))
    return F.coalesce(F.nullif(strong, F.lit("")), F.nullif(F.concat_ws("", t), F.lit("")), F.lit("unknown"))


def group_code(slug: Column, name: Column) -> Column:
    return F.concat(slug, F.lit("#"), programme_key(name))


def squashed(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "")


def slug(c: Column, prefix: str = "") -> Column:
    """Hyphenated key; the prefix where nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(key == "", F.lit(prefix)).otherwise(key)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def name_likeness(a: Column, b: Column) -> Column:
    """1 if equal when squashed, 0.85 if one contains the other, else the share of common tokens; 0 if one is blank."""
    x, y = squashed(a), squashed(b)
    inside = F.contains(x, y) | F.contains(y, x)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(inside, 0.85).otherwise(jaccard(tokens(a), tokens(b)))


def noise_name(c: Column) -> Column:
    """Blank, or navigation, page furniture or requirement prose. Headings are searched anywhere in the name."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    patterns = V.NOISE_HEADINGS, f"^(?:{V.NOISE_NAMES})$", V.REQUIREMENT_PROSE
    hit = F.lit(False)
    for p in patterns:
        hit = hit | t.rlike(p)
    return (t == "") | hit


def degree_conflict(name: Column, path: Column) -> Column:
    """The degree in the URL path and the one that leads the name are both there and differ."""
    listed = "|".join(V.DEGREES)
    in_url = F.regexp_extract(F.lower(F.coalesce(path, F.lit(""))), f"(?:^|/)({listed})-", 1)
    in_name = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), rf"^({listed})\b", 1)
    return (in_url != "") & (in_name != "") & (in_url != in_name)


def html_text(c: Column) -> Column:
    """Scripts, styles and tags off, white space collapsed."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def without_blocks(c: Column) -> Column:
    """HTML without navigation, header, footer, aside, script and style blocks."""
    out = c
    for tag in ("nav", "header", "footer", "aside", "script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return out


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6}) +\S", 1))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"^#{1,6} +", ""), r"[ #]+$", ""))


def plain_inline(c: Column) -> Column:
    """Markdown links to their labels, emphasis and code marks off."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\[([^\]]+)\]\(([^)]+)\)", "$1"), r"[*_`]+", ""))


def usable_content(c: Column, least: int = 200, links: int = 5) -> Column:
    """Long enough, no bot wall, and enough markdown links."""
    text = F.coalesce(c, F.lit(""))
    wall = F.lower(text).rlike("captcha|access denied|verify you are human|just a moment|enable javascript")
    return (F.length(text) >= least) & ~wall & (F.regexp_count(text, F.lit(r"\]\(")) >= links)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)
