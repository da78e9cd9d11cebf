"""Markdown pages: links, page types, and the items that each layout of an index page offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.functions import text as T
from curation.functions import urls as U
from curation.functions import vocabulary as V

#: Hits of a layout from which on it is trusted, and the layouts in order of preference.
CONFIDENT, LAYOUTS = 5, ["blob", "heading_link", "inline_degree", "merged_columns", "text_heading"]


def from_html(html: Column) -> Column:
    """Links, headings and list items of HTML as markdown lines; other tags go."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r'(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<h1[^>]*>", "\n# "), r"(?i)</?(?:h1|p|li|ul|ol|div|br|tr|table|body)[^>]*>", "\n")
    return F.regexp_replace(out, r"<[^>]+>", " ")


def all_links(md: Column) -> Column:
    """(label, target) of every markdown link in order."""
    md = F.coalesce(md, F.lit(""))
    return F.arrays_zip(F.regexp_extract_all(md, F.lit(V.LINK), F.lit(1)).alias("label"), F.regexp_extract_all(md, F.lit(V.LINK), F.lit(2)).alias("target"))


def page_links(pages: DataFrame, key: str, md: str = "markdown", url: str = "url") -> DataFrame:
    """key, pos, link, text: the absolute links of each page but assets, account pages and the page itself; the first of equal ones."""
    rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(all_links(F.col(md))).alias("pos", "l")).where(~F.col("l.target").rlike("^(#|mailto:)"))
    rows = rows.select(key, "pos", "_base", U.resolved(F.col("l.target"), F.col("_base")).alias("link"), F.trim("l.label").alias("text"))
    low = F.lower("link")
    barred = F.exists(F.array(*map(F.lit, V.ASSETS + V.ACCOUNTS)), lambda x: F.contains(low, x))
    own = F.regexp_replace("link", "/+$", "") == F.regexp_replace("_base", "/+$", "")
    return rows.where(~barred & ~own).groupBy(key, "link").agg(F.min(F.struct("pos", "text")).alias("f")).select(key, "f.pos", "link", "f.text")


def page_type(md: Column, links: Column, url: Column) -> Column:
    """The ladder of nine rules; their order is the rule."""
    low, path = F.lower(F.coalesce(md, F.lit(""))), F.lower(U.path(F.coalesce(url, F.lit(""))))
    details, listed, degree = F.regexp_count(low, F.lit(V.DETAIL_SIGNAL)), F.regexp_count(low, F.lit(V.INDEX_SIGNAL)), low.rlike(V.DEGREE_HEADING)
    index_path, detail_path = path.rlike(V.INDEX_PATH), path.rlike(V.DETAIL_PATH)
    return (
        F.when((details >= 2) & (degree | detail_path), "detail")
        .when((details >= 1) & degree, "detail")
        .when((listed >= 2) & (links >= 5) & ~detail_path, "index")
        .when(detail_path & ~index_path, "detail")
        .when(index_path & (listed >= 1) & (links >= 3), "index")
        .when((links >= 45) & (details == 0) & ~detail_path, "index")
        .when(degree & (links <= 12), "detail")
        .when(links >= 20, "index")
        .otherwise("detail")
    )


def ranked_links(links: DataFrame, key: str) -> DataFrame:
    """Of (key, pos, link, text, url) the links with a positive score, ranked by score and place."""
    score = U.link_score(F.col("link"), F.col("text"), F.col("url"), V.COURSE_DETAIL, V.COURSE_PATH, V.DEGREE_TEXT, V.NAV_TEXT)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "pos"))
    return links.withColumn("score", score).where("score > 0").withColumn("rank", rank)


def clean_label(c: Column) -> Column:
    """A label without emphasis, trailing hash and duration."""
    out = F.trim(F.regexp_replace(F.regexp_replace(c, r"\*+", ""), r"\s+", " "))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(out, r"\s*#\s*$", "")), V.DURATION_SUFFIX, ""))


def like_programme(c: Column) -> Column:
    return F.trim(c).rlike(V.DEGREE_SUFFIX) | F.trim(c).rlike(V.DEGREE_PREFIX)


def index_items(pages: DataFrame, key: str, md: str = "markdown", url: str = "url") -> DataFrame:
    """key, kind, pos, name, url: what each layout finds on a page, before repeats go. Noise names are no items.

    Lines are exploded once; a heading's detail link is the first fitting link before the next heading.
    """
    lines = pages.select(key, F.col(url).alias("_base"), F.posexplode(F.split(F.coalesce(F.col(md), F.lit("")), "\n")).alias("line", "t"))
    heading_link = F.regexp_extract("t", rf"^\s{{0,3}}#{{1,4}}\s+{V.LINK}", 0)
    at = F.col("line") * 1000
    first = lines.where(heading_link != "").select(
        key, "_base", F.lit("heading_link").alias("kind"), at.alias("pos"), clean_label(F.regexp_extract(heading_link, V.LINK, 1)).alias("name"), F.regexp_extract(heading_link, V.LINK, 2).alias("target")
    )
    links = lines.select(key, "_base", "line", F.posexplode(all_links(F.col("t"))).alias("n", "l")).select(key, "_base", (at + F.col("n")).alias("pos"), "l.label", "l.target")
    degrees = links.where(like_programme(F.col("label"))).withColumn("name", clean_label(F.col("label")))
    degrees = degrees.withColumn("kind", F.explode(F.array(F.lit("inline_degree"), F.lit("merged_columns")))).select(key, "_base", "kind", "pos", "name", "target")
    blob = F.concat_ws(" ", F.trim(F.regexp_replace(F.regexp_extract("label", V.BLOB, 1), r"\s+", " ")), F.regexp_extract("label", V.BLOB, 2))
    blobs = links.where(F.col("label").rlike(V.BLOB)).select(key, "_base", F.lit("blob").alias("kind"), "pos", blob.alias("name"), "target")
    english = F.trim(F.regexp_replace(F.trim(F.split("label", r"[\n一-鿿　-〿＀-￯]")[0]), V.TABLE_CODE, ""))
    tabled = links.where(F.col("target").rlike(V.TABLE_PATH) & english.rlike(V.TABLE_DEGREE)).select(key, "_base", F.lit("table").alias("kind"), "pos", english.alias("name"), "target")

    heading = F.regexp_extract("t", r"^\s{0,3}#{2,4}\s+(.+?)\s*$", 1)
    found = F.filter(all_links(F.col("t")), lambda x: U.target_path(x["target"]).rlike(V.DETAIL_LINK) & ~U.target_path(x["target"]).rlike(V.OTHER_LINK))
    marked = lines.withColumn("h", F.when(heading != "", F.struct("line", clean_label(heading).alias("name")))).withColumn("target", F.when(heading == "", F.try_element_at(found, F.lit(1))["target"]))
    marked = marked.withColumn("h", F.last("h", ignorenulls=True).over(W.partitionBy(key).orderBy("line"))).where("h is not null")
    texts = marked.groupBy(key, "_base", "h").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("line"))).alias("target"))
    named = F.col("h.name")
    texts = texts.where((named != "") & (named.rlike(V.PROGRAM_PREFIX) | named.rlike(V.DEGREE_SUFFIX))).select(key, "_base", F.lit("text_heading").alias("kind"), (F.col("h.line") * 1000).alias("pos"), named.alias("name"), "target")

    rows = first.unionByName(degrees).unionByName(blobs).unionByName(tabled).unionByName(texts)
    return rows.where(~T.noise_name(F.col("name"))).select(key, "kind", "pos", "name", U.resolved(F.col("target"), F.col("_base")).alias("url"))


def layout(counts: DataFrame, key: str) -> DataFrame:
    """Of (key, kind, n) the layout with most hits, the preferred of equals; named only if confident."""
    preference = F.array_position(F.array(*map(F.lit, LAYOUTS)), F.col("kind"))
    best = counts.where(F.col("kind").isin(LAYOUTS)).groupBy(key).agg(F.max(F.struct("n", (-preference).alias("p"), "kind")).alias("b"))
    sure = F.col("b.n") >= CONFIDENT
    return best.select(key, F.when(sure, F.col("b.kind")).alias("kind"), sure.alias("confident"), F.col("b.n").alias("n"))
