"""Queries of the URL functions and of page structure."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.functions import urls as U
from curation.functions import vocabulary as V
from curation.operators import joins
from curation.operators.extractors import BUILT_IN, Extractors
from curation.plans.registry import Rows, query, table
from curation.plans.text import quoted

P = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def host(c: str) -> str:
    return f"lower(regexp_extract({c}, '{P}', 2))"


def path(c: str) -> str:
    return f"regexp_extract({c}, '{P}', 3)"


def canonical(c: str) -> str:
    return f"CASE WHEN {host(f'trim({c})')} <> '' THEN lower(regexp_extract(trim({c}), '{P}', 1)) || '://' || {host(f'trim({c})')} || regexp_replace({path(f'trim({c})')}, '/+$', '') END"


def segs(c: str) -> str:
    return f"list_filter(string_split({path(c)}, '/'), lambda s: s <> '')"


URLS = Rows("url string", [
    ("HTTPS://WWW.Hku.HK/Prog/12/?page=2#x",), ("https://gs.cuhk.edu.hk/tpg/2024/msc-data%20science/",), ("https://www.ln.edu.hk",), ("https://ox.ac.uk/courses/f921/msc-law/",), ("mailto:a@b.c",),
    ("/relative/path",), ("https://x.edu/a/fees-2024?p=1&page=3&z=9",), ("https://x.edu/admission-requirements/",), ("https://x.edu/file.pdf?dl=1",), ("https://apply.x.edu/",), ("https://www.facebook.com/x",),
    ("https://ntu.edu.sg/list/1",), ("https://localhost:8080/a",), ("",),
])


@query("f16_canonical_urls", f"SELECT page_id, {canonical('url')} AS canonical FROM pages")
def canonical_urls(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query("f16_canonical_cases", f"SELECT url, {canonical('url')} AS canonical FROM {URLS.sql}")
def canonical_cases(spark, d):
    return URLS.df(spark).select("url", U.canonical(F.col("url")).alias("canonical"))


@query("f19_p15_url_shapes", f"""
WITH s AS (SELECT page_id, regexp_replace({host('url')}, ':.*$', '') || '/' || array_to_string(list_transform({segs('url')}, lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{{N}}' ELSE lower(s) END), '/') AS shape FROM pages)
SELECT page_id, shape, shape <> (SELECT shape FROM s ORDER BY page_id LIMIT 1) AS diverged FROM s""")
def url_shapes(spark, d):
    s = table(spark, d, "pages").select("page_id", U.shape(F.col("url")).alias("shape"))
    first = s.agg(F.min_by("shape", "page_id").alias("index_shape"))
    return s.crossJoin(F.broadcast(first)).select("page_id", "shape", (F.col("shape") != F.col("index_shape")).alias("diverged"))


@query("f17_url_name_signal", f"""
SELECT page_id, array_to_string(list_filter(list_transform(list_filter(list_transform({segs('url')}, lambda s: trim(url_decode(s))), lambda s: NOT (length(s) <= 6 AND regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '[-_ ]'))),
 lambda s: trim(regexp_replace(regexp_replace(s, '[^a-zA-Z0-9]+', ' ', 'g'), ' +', ' ', 'g'))), lambda s: s <> ''), ' ') AS signal FROM pages""")
def url_name_signal(spark, d):
    return table(spark, d, "pages").select("page_id", U.name_signal(F.col("url")).alias("signal"))


@query("f21_f22_page_patterns", f"""
WITH r AS (SELECT * FROM (VALUES ('hku.hk', 'merged'), ('x.edu', 'table')) v(domain, kind)), s AS (SELECT url, {host('url')} AS h, {segs('url')} AS s FROM {URLS.sql})
SELECT url, regexp_replace(array_to_string(list_slice(s, greatest(len(s) - 1, 1), len(s)), '/'), '[0-9]+', '{{N}}', 'g') AS pattern, kind AS strategy FROM s LEFT JOIN r ON regexp_replace(h, '^www\\.', '') = domain""")
def page_patterns(spark, d):
    registry = spark.createDataFrame([("hku.hk", "merged"), ("x.edu", "table")], "domain string, strategy string")
    u = URLS.df(spark).withColumn("domain", F.regexp_replace(U.host(F.col("url")), r"^www\.", ""))
    return u.join(F.broadcast(registry), "domain", "left").select("url", U.page_pattern(F.col("url")).alias("pattern"), "strategy")


@query("p11_t11_sub_links", f"""
SELECT url, regexp_matches(lower(url), {quoted(V.NOISE_URL)}) AS noise, {' + '.join(f"CASE WHEN regexp_matches(lower(url), {quoted(p)}) THEN {w} ELSE 0 END" for p, w in V.SUB_LINKS)} AS weight FROM {URLS.sql}""")
def sub_links(spark, d):
    return URLS.df(spark).select("url", U.noise(F.col("url")).alias("noise"), U.sub_link_weight(F.col("url")).alias("weight"))


@query("p12_same_section", f"SELECT url, {host('url')} = 'x.edu' AND ({path('url')} = '/a' OR starts_with({path('url')}, '/a/')) AS same FROM {URLS.sql}")
def same_section(spark, d):
    return URLS.df(spark).select("url", U.same_section(F.col("url"), F.lit("https://x.edu/a/")).alias("same"))


ANCHORS = Rows("anchor string", [("Visit website",), ("Visit the page",), ("MSc Finance",), ("More details",), ("here",), ("Click here",), ("Homepage",), ("official site",), ("hereafter",)])


@query("p16_generic_anchor", f"SELECT anchor, regexp_matches(lower(trim(anchor)), {quoted(V.GENERIC_ANCHOR)}) AS generic FROM {ANCHORS.sql}")
def generic_anchor(spark, d):
    return ANCHORS.df(spark).select("anchor", F.lower(F.trim("anchor")).rlike(V.GENERIC_ANCHOR).alias("generic"))


LINKS = f"""
l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
a AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN starts_with(href, '/') THEN lower(regexp_extract(url, '{P}', 1)) || '://' || {host('url')} || href ELSE href END AS link FROM l)"""


def page_links(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.posexplode(U.html_links(F.col("html"))).alias("pos", "href"))
    return pages.select("page_id", "pos", U.resolved(F.col("href"), F.col("url")).alias("link"))


@query("f37_f38_links", f"WITH {LINKS} SELECT page_id, pos, link FROM a")
def links(spark, d):
    return page_links(spark, d)


@query("f37_f38_registered_extractors", f"""WITH {LINKS} SELECT e AS extractor, page_id, pos, link FROM a, (VALUES ('anchors'), ('html_links')) x(e)""")
def registered_extractors(spark, d):
    """The same links by two extractors of a registry: an expression, and a Python function that a caller adds."""
    own = Extractors()
    own.expressions |= BUILT_IN.expressions

    @own.scan("anchors")
    def anchors(content, base):
        return [(None, href) for href in re.findall(r'<a href="([^"]*)"', content)]

    found = own.extracted(table(spark, d, "pages").select("page_id", "url", "html").withColumnRenamed("url", "base"), "html", "base")
    return found.select("extractor", "page_id", "pos", F.col("url").alias("link"))


@query("u6_first_link_text", f"WITH {LINKS} SELECT page_id, link, min(pos) AS pos FROM a GROUP BY page_id, link")
def first_link(spark, d):
    return page_links(spark, d).groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


LINK_TEXTS = r"""regexp_extract_all(html, '(?s)<a href="([^"]*)"(?:[^>]*>([^<]*))?', {g})"""
SCORE = f"""CASE WHEN regexp_matches(lower(link), {quoted(V.COURSE_DETAIL)}) THEN 8 WHEN regexp_matches(lower(link), {quoted(V.COURSE_PATH)}) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, {quoted(V.DEGREE_TEXT)}) THEN 4 ELSE 0 END
 - CASE WHEN regexp_matches(text, {quoted(V.NAV_TEXT)}) THEN 4 ELSE 0 END + CASE WHEN {host('lower(link)')} <> '' AND {host('lower(link)')} = {host('url')} THEN 1 ELSE 0 END"""


@query("t10_f23_ranked_links", f"""
WITH l AS (SELECT page_id, url, unnest({LINK_TEXTS.format(g=1)}) AS href, unnest({LINK_TEXTS.format(g=2)}) AS text, generate_subscripts({LINK_TEXTS.format(g=1)}, 1) - 1 AS pos FROM pages),
a AS (SELECT page_id, url, pos, CASE WHEN starts_with(href, '/') THEN lower(regexp_extract(url, '{P}', 1)) || '://' || {host('url')} || href ELSE href END AS link, lower(trim(regexp_replace(text, '[[:space:]]+', ' ', 'g'))) AS text FROM l),
s AS (SELECT page_id, link, pos, {SCORE} AS score FROM a), b AS (SELECT page_id, link, max(score) AS score, arg_min(pos, (-score, pos)) AS pos FROM s WHERE score > 0 GROUP BY 1, 2)
SELECT page_id, link, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM b""")
def ranked_links(spark, d):
    """All links of a page with a positive score, by score and position, each URL once."""
    html = F.col("html")
    rows = table(spark, d, "pages").select("page_id", "url", F.posexplode(F.arrays_zip(U.html_links(html).alias("href"), U.html_link_texts(html).alias("text"))).alias("pos", "a"))
    return with_link_ranks(rows.select("page_id", "pos", U.resolved(F.col("a.href"), F.col("url")).alias("link"), F.col("a.text").alias("text"), "url"))


def with_link_ranks(links):
    score = U.link_score(F.col("link"), F.col("text"), F.col("url"), V.COURSE_DETAIL, V.COURSE_PATH, V.DEGREE_TEXT, V.NAV_TEXT)
    s = links.withColumn("score", score).where("score > 0")
    s = s.groupBy("page_id", "link").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("best"))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("best.score"), F.desc("best.back")))
    return s.select("page_id", "link", F.col("best.score").alias("score"), rank.alias("rank"))


KNOWN = f"(SELECT url FROM pages WHERE page_id % 3 = 0)"


@query("j7_known_urls", f"SELECT page_id, url, coalesce({canonical('url')} IN (SELECT {canonical('url')} FROM {KNOWN}), false) AS known FROM pages ORDER BY page_id")
def known_urls(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return joins.split_by_known(pages, pages.where("page_id % 3 = 0").select("url"), U.canonical).select("page_id", "url", "known").orderBy("page_id")


@query("j9_fallback_lookup", f"""
WITH e AS (SELECT url, page_id AS val FROM pages WHERE page_id % 2 = 0), p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)
SELECT p.page_id, coalesce(r.val, c.val) AS val FROM p LEFT JOIN (SELECT url, min(val) AS val FROM e GROUP BY 1) r ON p.url = r.url
LEFT JOIN (SELECT {canonical('url')} AS k, min(val) AS val FROM e GROUP BY 1) c ON {canonical('p.url')} = c.k""")
def fallback_lookup(spark, d):
    pages = table(spark, d, "pages")
    entries = pages.where("page_id % 2 = 0").select("url", F.col("page_id").alias("val"), F.col("page_id").alias("pos"))
    rows = pages.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return joins.lookup_with_fallback(rows, entries, U.canonical, "url", "val", "pos").select("page_id", "val")


@query("j11_siblings", f"""
WITH {LINKS}, r AS (SELECT DISTINCT page_id, pos // 2 AS line, link FROM a)
SELECT x.link, string_agg(DISTINCT y.link, ' ' ORDER BY y.link) AS siblings FROM r x JOIN r y ON x.page_id = y.page_id AND x.line = y.line AND x.link <> y.link GROUP BY x.link""")
def siblings(spark, d):
    rows = page_links(spark, d).select("page_id", F.floor(F.col("pos") / 2).alias("line"), "link").distinct()
    return joins.siblings(rows, ["page_id", "line"], "link").select("link", F.concat_ws(" ", "siblings").alias("siblings"))


@query("a19_page_params", """
WITH p AS (SELECT regexp_extract(url, '[?&]([a-z_]+)=([0-9]+)', 1) AS param, TRY_CAST(regexp_extract(url, '[?&]([a-z_]+)=([0-9]+)', 2) AS INTEGER) AS v FROM pages)
SELECT param, min(v) AS low, max(v) AS high, count(DISTINCT v) AS n FROM p WHERE param <> '' GROUP BY param HAVING count(DISTINCT v) >= 2""")
def page_params(spark, d):
    pattern = r"[?&]([a-z_]+)=([0-9]+)"
    p = table(spark, d, "pages").select(F.regexp_extract("url", pattern, 1).alias("param"), F.regexp_extract("url", pattern, 2).try_cast("int").alias("v")).where("param <> ''")
    return p.groupBy("param").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_distinct("v").alias("n")).where("n >= 2")


@query("f45_s9_json_dig", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_dig(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("f45_s9_dug_items", "SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1 AS INT) AS pos, l_linenumber AS n, l_returnflag AS flag FROM lineitem")
def dug_items(spark, d):
    """A JSON answer per order, its items at a dotted path, one row each; an answer without that path has none."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.struct(F.col("l_returnflag").alias("flag")).alias("attributes")).alias("item"))
    answers = rows.groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list("item")).alias("items")).alias("data"))).alias("body"))
    bare = spark.createDataFrame([(-1, '{"data": {}}'), (-2, "not JSON"), (-3, '{"items": [1]}')], "l_orderkey long, body string")
    items = answers.unionByName(bare).select("l_orderkey", F.posexplode(U.dug(F.col("body"), "data.items")).alias("pos", "i"))
    return items.select("l_orderkey", "pos", U.dug_value(F.col("i"), "n", "int").alias("n"), U.dug_value(F.col("i"), "attributes.flag", "string").alias("flag"))


VARIANTS = Rows("page int, level int, body string", [(1, 1, "short"), (1, 2, "x" * 220), (1, 3, "y" * 300), (2, 1, "z" * 210), (3, 1, "no"), (3, 2, "captcha " + "q" * 300)])


@query("s7_fetch_ladder", f"SELECT page, min(level) FILTER (length(body) >= 200 AND NOT contains(body, 'captcha')) AS level FROM {VARIANTS.sql} GROUP BY page")
def fetch_ladder(spark, d):
    """The first usable of the fetched variants of a page."""
    usable = (F.length("body") >= 200) & ~F.contains("body", F.lit("captcha"))
    return VARIANTS.df(spark).groupBy("page").agg(F.min(F.when(usable, F.col("level"))).alias("level"))
