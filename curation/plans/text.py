"""Queries of the name and text functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.functions import text as T
from curation.functions import urls as U
from curation.functions import vocabulary as V
from curation.plans.registry import Rows, query, table


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = ", ".join(map(quoted, V.STOPWORDS))
NAMES = Rows("name string, url string", [
    ("Master of Science (Business Analytics)", "https://x.edu/msc-business"), ("MA in Translation & Interpretation", "https://x.edu/a/phd-translation"), ("of the", None), ("", "https://x.edu/"),
    (None, None), ("  ", ""), ("Research Methods", "https://x.edu/ma-research"), ("News", "u"), ("Newspaper Studies", "u"), ("MPhil Physics", "https://x.edu/mphil-physics"), ("About us", "u"),
    ("Faculty of Arts", "u"), ("A bachelor degree with a 2:1 (hons)", "u"), ("BSc (Hons) Computer Science", "u"), ("Welcome to the SEIM Programme", "u"), ("Applicants must apply", "u"), ("IELTS 6.5", "u"),
    ("Follow us on social", "u"), ("PhD Law", "https://x.edu/x/llm-law"), ("Tuition Fees, Scholarships", "u"), ("Lingua Site", "u"), ("AB", "u"), ("Doctor of Education", "u"), ("Course Search", "u"),
])
TOKENS = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
KEY = f"coalesce(nullif(array_to_string(list_filter({TOKENS}, lambda x: NOT list_contains([{STOP}], x)), ''), ''), nullif(array_to_string({TOKENS}, ''), ''), 'unknown')"
SQUASHED = "regexp_replace(lower(trim(coalesce({c}, ''))), '[^a-z0-9]+', '', 'g')"
NOISE_SQL = (
    "(trim(coalesce({c}, '')) = '' OR regexp_matches(lower(trim({c})), " + quoted(V.NOISE_HEADINGS) + ") OR regexp_matches(lower(trim({c})), "
    + quoted(f"^(?:{V.NOISE_NAMES})$") + ") OR regexp_matches(lower(trim({c})), " + quoted(V.REQUIREMENT_PROSE) + "))"
)


@query("f1_f2_programme_key", f"SELECT name, {KEY.replace('{c}', 'name')} AS key, 'hku#' || {KEY.replace('{c}', 'name')} AS code FROM {NAMES.sql}")
def programme_key(spark, d):
    return NAMES.df(spark).select("name", T.programme_key(F.col("name")).alias("key"), T.group_code(F.lit("hku"), F.col("name")).alias("code"))


@query("f1_part_keys", f"SELECT DISTINCT p_name, {KEY.replace('{c}', 'p_name')} AS key FROM part")
def part_keys(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", T.programme_key(F.col("p_name")).alias("key"))


@query("f3_f4_slugs", f"SELECT name, {SQUASHED.replace('{c}', 'name')} AS squashed, coalesce(nullif(trim(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'subject') AS slug, len({TOKENS.replace('{c}', 'name')}) AS n FROM {NAMES.sql}")
def slugs(spark, d):
    n = F.col("name")
    return NAMES.df(spark).select("name", T.squashed(n).alias("squashed"), T.slug(n, "subject").alias("slug"), F.size(T.tokens(n)).cast("long").alias("n"))


@query("f5_name_likeness", f"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON split_part(a.name, ' ', 1) = split_part(b.name, ' ', 1)),
s AS (SELECT a, b, {SQUASHED.replace('{c}', 'a')} AS x, {SQUASHED.replace('{c}', 'b')} AS y, list_distinct({TOKENS.replace('{c}', 'a')}) AS t, list_distinct({TOKENS.replace('{c}', 'b')}) AS u FROM p)
SELECT a, b, round(CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.85
 ELSE len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) END, 4) AS likeness FROM s""")
def name_likeness(spark, d):
    """Likeness of names that start with the same word: pairs come from an equi-join on it."""
    n = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("k", F.split("name", " ")[0])
    pairs = n.select(F.col("name").alias("a"), "k").join(n.select(F.col("name").alias("b"), "k"), "k")
    return pairs.select("a", "b", F.round(T.name_likeness(F.col("a"), F.col("b")), 4).alias("likeness"))


@query("p7_noise_names", f"SELECT name, {NOISE_SQL.replace('{c}', 'name')} AS noise FROM {NAMES.sql}")
def noise_names(spark, d):
    return NAMES.df(spark).select("name", T.noise_name(F.col("name")).alias("noise"))


DEG = "|".join(V.DEGREES)


@query("p6_degree_conflict", f"""
SELECT name, url, regexp_extract(lower(coalesce(url, '')), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, u <> '' AND n <> '' AND u <> n AS conflict FROM (
SELECT *, regexp_extract(regexp_extract(lower(coalesce(url, '')), '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?:^|/)({DEG})-', 1) AS u, regexp_extract(lower(coalesce(name, '')), '^({DEG})\\b', 1) AS n FROM {NAMES.sql})""")
def degree_conflict(spark, d):
    path = F.lower(U.path(F.coalesce("url", F.lit(""))))
    return NAMES.df(spark).select("name", "url", path.alias("path"), T.degree_conflict(F.col("name"), path).alias("conflict"))


@query("s14_html_to_text", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


_STRIPPED = "html"
for _tag in ("nav", "header", "footer", "aside", "script", "style"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"


@query("f10_boilerplate_blocks", f"SELECT page_id, length(html) AS before, length({_STRIPPED}) AS after, sha256({_STRIPPED}) AS digest FROM pages")
def boilerplate_blocks(spark, d):
    left = T.without_blocks(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("before"), F.length(left).cast("long").alias("after"), F.sha2(left, 256).alias("digest"))


@query("s8_p10_usable_content", r"""
WITH t AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS md FROM pages)
SELECT page_id, length(md) >= 200 AND NOT regexp_matches(lower(md), 'captcha|access denied|verify you are human|just a moment|enable javascript') AND len(regexp_extract_all(md, '\]\(')) >= 5 AS usable,
 length(html) > 1000 AND length(md) < 0.05 * length(html) AS insufficient FROM t""")
def usable_content(spark, d):
    md = T.html_text(F.col("html"))
    thin = (F.length("html") > 1000) & (F.length(md) < 0.05 * F.length("html"))
    return table(spark, d, "pages").select("page_id", T.usable_content(md).alias("usable"), thin.alias("insufficient"))


LINES = Rows("page int, pos int, line string", [(1, 0, "Skip"), (1, 1, "# MSc *Data* Science ##"), (1, 2, "text [label](http://x.y/z) and `code`"), (1, 3, "####### no"), (1, 4, "## "), (1, 5, "### Fees"), (2, 0, "plain"), (2, 1, "#nospace")])


@query("f7_headings", f"""
SELECT page, pos, length(regexp_extract(line, '^(#{{1,6}}) +\\S', 1)) AS level, trim(regexp_replace(regexp_replace(line, '^#{{1,6}} +', ''), '[ #]+$', '')) AS title,
 trim(regexp_replace(regexp_replace(line, '\\[([^\\]]+)\\]\\(([^)]+)\\)', '\\1', 'g'), '[*_`]+', '', 'g')) AS plain FROM {LINES.sql}""")
def headings(spark, d):
    c = F.col("line")
    return LINES.df(spark).select("page", "pos", T.heading_level(c).cast("long").alias("level"), T.heading_text(c).alias("title"), T.plain_inline(c).alias("plain"))


@query("f8_name_ladder", f"""
WITH h AS (SELECT page, pos, length(regexp_extract(line, '^(#{{1,6}}) +\\S', 1)) AS level, trim(regexp_replace(regexp_replace(regexp_replace(line, '^#{{1,6}} +', ''), '[ #]+$', ''), '[*_`]+', '', 'g')) AS title FROM {LINES.sql}),
r AS (SELECT page, title, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN level <= 3 AND regexp_matches(lower(title), '(^|[^a-z])(msc|ma|mba|phd|master|bachelor|doctor)([^a-z]|$)') THEN 0 WHEN level = 1 THEN 1 WHEN level = 2 THEN 2 ELSE 3 END, pos) AS n FROM h WHERE level > 0)
SELECT page, title AS name FROM r WHERE n = 1""")
def name_ladder(spark, d):
    """A page's name: its first heading with a degree, else the first of level one, two, any."""
    c = F.col("line")
    h = LINES.df(spark).select("page", "pos", T.heading_level(c).alias("level"), T.plain_inline(T.heading_text(c)).alias("title")).where("level > 0")
    degree = (F.col("level") <= 3) & F.lower("title").rlike("(^|[^a-z])(msc|ma|mba|phd|master|bachelor|doctor)([^a-z]|$)")
    rank = F.when(degree, 0).when(F.col("level") == 1, 1).when(F.col("level") == 2, 2).otherwise(3)
    return h.groupBy("page").agg(F.min_by("title", F.struct(rank, "pos")).alias("name"))


@query("f9_title_names", r"""
SELECT page_id, trim(split_part(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&middot;', '·'), '|', 1)) AS name FROM pages""")
def title_names(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", F.trim(F.split(F.replace(F.replace(title, F.lit("&amp;"), F.lit("&")), F.lit("&middot;"), F.lit("·")), r"\|")[0]).alias("name"))


@query("f14_token_estimate", "SELECT conv_id, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_estimate(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.floor(F.sum(F.length("text")) / 4).alias("tokens"))


HINTS = Rows("raw string", [("Index ",), ("列表",), ("DETAIL",), ("详情",), ("auto",), (None,), ("x",)])
HINT_MAP = {"index": "index", "list": "index", "列表": "index", "目录": "index", "detail": "detail", "详情": "detail", "single": "detail"}


@query("f15_page_hint", f"SELECT raw, CASE trim(lower(raw)) {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in HINT_MAP.items())} END AS hint FROM {HINTS.sql}")
def page_hint(spark, d):
    pairs = [F.lit(x) for kv in HINT_MAP.items() for x in kv]
    return HINTS.df(spark).select("raw", F.try_element_at(F.create_map(*pairs), F.lower(F.trim("raw"))).alias("hint"))


SUGGEST = Rows("id int, hints array<string>", [(1, ["News|0.99", "MSc Data|0.95", "MA|0.9"]), (2, ["About us|0.9"]), (3, [])])


@query("f53_first_good_hint", f"""
SELECT id, list_filter(list_transform(hints, lambda h: split_part(h, '|', 1)), lambda n: NOT {NOISE_SQL.replace('{c}', 'n')})[1] AS name FROM {SUGGEST.sql}""")
def first_good_hint(spark, d):
    names = F.transform("hints", lambda h: F.split(h, r"\|")[0])
    return SUGGEST.df(spark).select("id", F.try_element_at(F.filter(names, lambda n: ~T.noise_name(n)), F.lit(1)).alias("name"))


@query("f54_clean_labels", f"SELECT page, pos, trim(regexp_replace(regexp_replace(regexp_replace(line, '[*_]+', '', 'g'), '[ #]+$', ''), ' *\\(?[0-9]+ (?:years?|months?)\\)?$', '')) AS label FROM {LINES.sql}")
def clean_labels(spark, d):
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", "[*_]+", ""), "[ #]+$", ""), r" *\(?[0-9]+ (?:years?|months?)\)?$", "")
    return LINES.df(spark).select("page", "pos", F.trim(c).alias("label"))


@query("t12_f50_ranked_names", """
WITH c AS (SELECT p_partkey AS id, s.source, s.w, CASE s.source WHEN 'anchor' THEN p_name WHEN 'title' THEN upper(p_name) ELSE p_brand END AS name FROM part, (VALUES ('anchor', 0.98), ('title', 0.82), ('slug', 0.76)) s(source, w)),
f AS (SELECT id, lower(name) AS k, arg_min(name, (-w, source)) AS name, max(w) AS w FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, k) AS n, lead(w) OVER (PARTITION BY id ORDER BY w DESC, k) AS second FROM f)
SELECT id, name, CAST(w AS DOUBLE) AS score, w >= 0.80 AND coalesce(w - second, 1) >= 0.05 AS resolved FROM r WHERE n = 1""")
def ranked_names(spark, d):
    """Candidates weighted by source, equal names merged, the best one resolved if it is good and clearly ahead."""
    weights = {"anchor": 0.98, "title": 0.82, "slug": 0.76}
    p = table(spark, d, "part")
    values = {"anchor": F.col("p_name"), "title": F.upper("p_name"), "slug": F.col("p_brand")}
    c = p.select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(w).alias("w"), values[s].alias("name")) for s, w in weights.items()])).alias("c")).select("id", "c.*")
    f = c.groupBy("id", F.lower("name").alias("k")).agg(F.min_by("name", F.struct(-F.col("w"), "source")).alias("name"), F.max("w").alias("w"))
    order = W.partitionBy("id").orderBy(F.desc("w"), "k")
    r = f.withColumn("n", F.row_number().over(order)).withColumn("second", F.lead("w").over(order)).where("n = 1")
    ahead = F.round(F.coalesce(F.col("w") - F.col("second"), F.lit(1.0)), 6) >= 0.05
    return r.select("id", "name", F.col("w").alias("score"), ((F.col("w") >= 0.80) & ahead).alias("resolved"))
