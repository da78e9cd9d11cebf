"""Queries of page analysis: links, page types, layouts, rows of an index page, selectors and supplements."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.functions import markdown as MD
from curation.functions import money as M
from curation.functions import text as T
from curation.functions import urls as U
from curation.functions import vocabulary as V
from curation.operators import fuzzy
from curation.plans.registry import Rows, query, table
from curation.plans.text import quoted

BASE = "https://x.edu/a/b/c.html?q=1#f"
HREFS = Rows("id int, href string", [
    (1, "d"), (2, "../d"), (3, "../../../d"), (4, "./"), (5, ".."), (6, "/e/../f"), (7, "//y.org/z/../w"), (8, "?p=2"), (9, "#g"), (10, ""), (11, "https://z/../k"), (12, "mailto:a@b"), (13, "d?x=../y"), (14, "g/./h/../i/"),
])


@query("f38_resolved_links", """SELECT * FROM (VALUES (1, 'https://x.edu/a/b/d'), (2, 'https://x.edu/a/d'), (3, 'https://x.edu/d'), (4, 'https://x.edu/a/b/'), (5, 'https://x.edu/a/'), (6, 'https://x.edu/f'),
 (7, 'https://y.org/z/../w'), (8, 'https://x.edu/a/b/c.html?p=2'), (9, 'https://x.edu/a/b/c.html?q=1#g'), (10, 'https://x.edu/a/b/c.html?q=1#f'), (11, 'https://z/../k'), (12, 'mailto:a@b'),
 (13, 'https://x.edu/a/b/d?x=../y'), (14, 'https://x.edu/a/b/g/i/')) v(id, link)""")
def resolved_links(spark, d):
    return HREFS.df(spark).select("id", U.resolved(F.col("href"), F.lit(BASE)).alias("link"))


def many(n: int) -> str:
    return "\n".join(f"[p{i}](/p{i})" for i in range(n))


PAGES = Rows("page int, url string, hint string, markdown string", [
    (1, "https://x.edu/find-your-programmes", None, "# Find your course\nCourse search and filters\n[MSc Data](/programmes/msc-data-science)\n[MA History](https://x.edu/programmes/ma-history)\n[Home](/)\n[Logo](/logo.png)\n[Sign in](/login)\n"
     "[MA again](https://x.edu/programmes/ma-history)\n[Mail](mailto:a@x.edu)\n[News](/news)\n[Here](/find-your-programmes/)"),
    (2, "https://x.edu/programmes/msc-data-science", None, "# MSc Data Science\nTuition fees HKD 300,000\nEntry requirements IELTS 6.5\n[Apply](/apply)"),
    (3, "https://x.edu/programs/abcdef-ghij", None, "[a](/1)"),
    (4, "https://x.edu/", None, many(20)),
    (5, "https://x.edu/list", None, many(45)),
    (6, "https://x.edu/film", None, "# MA Film\n[x](/x)"),
    (7, "https://x.edu/hello", None, "hello"),
    (8, "https://x.edu/mba", None, "# MBA\nDuration 1 year"),
    (9, "https://x.edu/all", None, "list of courses, a to z\n" + many(5)),
    (10, "https://x.edu/programmes/ba-arts-and-letters", "index", "[BA Arts](../programme/ba-arts)\n[Contact](/contact)"),
    (11, "https://x.edu/all", "detail", "list of courses, a to z\n" + many(5)),
    (12, None, None, None),
])
KINDS = "(1, 'index', 4), (2, 'detail', 1), (3, 'detail', 1), (4, 'index', 20), (5, 'index', 45), (6, 'detail', 1), (7, 'detail', 0), (8, 'detail', 0), (9, 'index', 5), (10, 'detail', 2), (11, 'index', 5), (12, 'detail', 0)"


def counted(pages):
    links = MD.page_links(pages, "page").groupBy("page").agg(F.count(F.lit(1)).alias("links"))
    return pages.join(links, "page", "left").fillna(0, "links").withColumn("kind", MD.page_type(F.col("markdown"), F.col("links"), F.col("url")))


@query("p14_page_type_rules", f"SELECT page, kind, CAST(links AS BIGINT) AS links FROM (VALUES {KINDS}) v(page, kind, links)")
def page_type_rules(spark, d):
    """Each of the nine rules once, on the links that count."""
    return counted(PAGES.df(spark)).select("page", "kind", "links")


MD_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', '[\2](\1)', 'g'), '(?i)<h1[^>]*>', chr(10) || '# ', 'g'),
 '(?i)</?(?:h1|p|li|ul|ol|div|br|tr|table|body)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"""
PATH_SQL = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)', 3))"


@query("p14_page_type", f"""
WITH m AS (SELECT page_id, lower({MD_SQL}) AS md, {PATH_SQL} AS path FROM pages),
c AS (SELECT page_id, path, len(regexp_extract_all(md, {quoted(V.LINK)})) AS links, len(regexp_extract_all(md, {quoted(V.DETAIL_SIGNAL)})) AS details, len(regexp_extract_all(md, {quoted(V.INDEX_SIGNAL)})) AS listed,
 regexp_matches(md, {quoted(V.DEGREE_HEADING)}) AS degree, regexp_matches(path, {quoted(V.INDEX_PATH)}) AS ip, regexp_matches(path, {quoted(V.DETAIL_PATH)}) AS dp FROM m)
SELECT page_id, links, CASE WHEN details >= 2 AND (degree OR dp) THEN 'detail' WHEN details >= 1 AND degree THEN 'detail' WHEN listed >= 2 AND links >= 5 AND NOT dp THEN 'index' WHEN dp AND NOT ip THEN 'detail'
 WHEN ip AND listed >= 1 AND links >= 3 THEN 'index' WHEN links >= 45 AND details = 0 AND NOT dp THEN 'index' WHEN degree AND links <= 12 THEN 'detail' WHEN links >= 20 THEN 'index' ELSE 'detail' END AS kind FROM c""")
def page_type(spark, d):
    """The ladder over all pages, their HTML taken to markdown; every link of a page counts."""
    md = MD.from_html(F.col("html"))
    rows = table(spark, d, "pages").select("page_id", "url", md.alias("markdown"))
    links = F.regexp_count(F.lower("markdown"), F.lit(V.LINK)).cast("long")
    return rows.select("page_id", links.alias("links"), MD.page_type(F.col("markdown"), links, F.col("url")).alias("kind"))


@query("s15_page_analysis", """SELECT page, kind, CAST(total_found AS BIGINT) AS total_found, links FROM (VALUES (1, 'index', 4, 'https://x.edu/programmes/msc-data-science MSc Data|https://x.edu/programmes/ma-history MA History'), (2, 'detail', 0, ''), (3, 'detail', 0, ''),
 (6, 'detail', 0, ''), (7, 'detail', 0, ''), (8, 'detail', 0, ''), (9, 'index', 5, 'https://x.edu/p0 p0|https://x.edu/p1 p1|https://x.edu/p2 p2|https://x.edu/p3 p3|https://x.edu/p4 p4'), (10, 'index', 2, 'https://x.edu/programme/ba-arts BA Arts'),
 (11, 'detail', 0, ''), (12, 'detail', 0, '')) v(page, kind, total_found, links)""")
def page_analysis(spark, d):
    """A hint, else the ladder; index pages give their links by score with the texts, details give none."""
    pages = PAGES.df(spark).where("page not in (4, 5)")  # their twenty and more links are in p14
    kinds = counted(pages).withColumn("kind", F.coalesce("hint", "kind"))
    rows = MD.page_links(pages, "page").join(kinds.where("kind = 'index'").select("page", "url"), "page")
    best = MD.ranked_links(rows, "page").groupBy("page").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("rank", "link", "text"))), lambda x: F.concat_ws(" ", x["link"], x["text"]))).alias("links"))
    found = F.when(F.col("kind") == "index", F.col("n")).otherwise(0)
    return kinds.withColumnRenamed("links", "n").join(best, "page", "left").select("page", "kind", found.alias("total_found"), F.coalesce("links", F.lit("")).alias("links"))


INDEX = Rows("page int, url string, markdown string", [
    (1, "https://x.edu/list/", "### [MSc Data (1 year)](msc-data)\n### [MSc Data again](https://x.edu/list/msc-data/)\n### [News](n)\n# [**Doctor of Law** #](/law)\n##### [MA Deep](deep)"),
    (2, "https://x.edu/list/", "| [MSc Law [LLM]](law) | [Visit site](s) |\n[Master of Arts in Film](film)\n[master of arts in film](film2)\n[History MA (Hons)](h)\n[Fees](fees)"),
    (3, "https://x.edu/list/", "[Full time 2 years  Data Science - MSc - Master of Science](ds)\n[(term)  Finance - MBA - Master](fin)\n[plain](p)"),
    (4, "https://x.edu/list/", "## Master of Design\nabout\n[See](/resource/x)\n[See](/programme/design) [b](/course/b)\n### Graduate Diploma in Law\n## News\n[x](/course/news)\n## Applied Physics BSc\n[x](/course/physics)"),
    (5, "https://x.edu/en/", "[P79 MSc Computing 理學碩士](/en/programme/program-list/2026/c/p79)\n[p01a Master of Arts](/en/programme/program-list/2026/a/p01a)\n[P80 Campus](/en/programme/program-list/2026/x)\n[MA Elsewhere](/ma)"),
    (6, "https://x.edu/list/", "\n".join(f"### [Bachelor of Things {i}](t{i})" for i in range(5))),
])


@query("f39_index_items", """SELECT page, kind, name, url FROM (VALUES (1, 'heading_link', 'MSc Data', 'https://x.edu/list/msc-data'), (1, 'heading_link', 'Doctor of Law', 'https://x.edu/law'),
 (1, 'inline_degree', 'MSc Data', 'https://x.edu/list/msc-data'), (1, 'merged_columns', 'MSc Data', 'https://x.edu/list/msc-data'), (1, 'inline_degree', 'MA Deep', 'https://x.edu/list/deep'), (1, 'merged_columns', 'MA Deep', 'https://x.edu/list/deep'),
 (2, 'inline_degree', 'MSc Law [LLM]', 'https://x.edu/list/law'), (2, 'inline_degree', 'Master of Arts in Film', 'https://x.edu/list/film'), (2, 'inline_degree', 'History MA (Hons)', 'https://x.edu/list/h'),
 (2, 'merged_columns', 'MSc Law [LLM]', 'https://x.edu/list/law'), (2, 'merged_columns', 'Master of Arts in Film', 'https://x.edu/list/film'), (2, 'merged_columns', 'History MA (Hons)', 'https://x.edu/list/h'),
 (3, 'blob', 'Data Science MSc', 'https://x.edu/list/ds'), (3, 'blob', 'Finance MBA', 'https://x.edu/list/fin'),
 (4, 'text_heading', 'Master of Design', 'https://x.edu/programme/design'), (4, 'text_heading', 'Graduate Diploma in Law', NULL), (4, 'text_heading', 'Applied Physics BSc', 'https://x.edu/course/physics'),
 (5, 'table', 'MSc Computing', 'https://x.edu/en/programme/program-list/2026/c/p79'), (5, 'table', 'Master of Arts', 'https://x.edu/en/programme/program-list/2026/a/p01a'),
 (5, 'inline_degree', 'MA Elsewhere', 'https://x.edu/ma'), (5, 'merged_columns', 'MA Elsewhere', 'https://x.edu/ma'), (6, 'heading_link', 'Bachelor of Things 0', 'https://x.edu/list/t0'), (6, 'heading_link', 'Bachelor of Things 1', 'https://x.edu/list/t1'),
 (6, 'heading_link', 'Bachelor of Things 2', 'https://x.edu/list/t2'), (6, 'heading_link', 'Bachelor of Things 3', 'https://x.edu/list/t3'), (6, 'heading_link', 'Bachelor of Things 4', 'https://x.edu/list/t4')) v(page, kind, name, url)""")
def index_items(spark, d):
    """Items of every layout, each URL and each name once in order."""
    return distinct_items(MD.index_items(INDEX.df(spark), "page")).select("page", "kind", "name", "url")


def distinct_items(items):
    keyed = items.withColumns({"g": F.concat_ws(" ", F.col("page"), "kind"), "k": F.lower("name"), "u": U.canonical(F.col("url"))})
    return fuzzy.greedy_distinct(keyed, "g", "pos", ["u", "k"])


@query("a11_layout_argmax", """SELECT page, kind, confident, CAST(n AS BIGINT) AS n FROM (VALUES (1, NULL, false, 2), (2, NULL, false, 3), (3, NULL, false, 2), (4, NULL, false, 3), (5, NULL, false, 1), (6, 'heading_link', true, 5)) v(page, kind, confident, n)""")
def layout_argmax(spark, d):
    """The layout with most items, the preferred one of equals, named from five items on."""
    return MD.layout(distinct_items(MD.index_items(INDEX.df(spark), "page")).groupBy("page", "kind").agg(F.count(F.lit(1)).alias("n")), "page")


ROWS = Rows("page int, pos int, line string", [
    (1, 1, "[MA Arts](https://x.edu/ma) [Visit Website](https://arts.x.edu/)"), (1, 2, "[MSc A](https://x.edu/a) [MSc B](https://x.edu/b)"), (1, 3, "[Details](https://x.edu/d) [More](https://x.edu/m)"),
    (1, 4, "[MBA](https://X.edu/mba/) [Click here](https://x.edu/mba) [Here](https://x.edu/h)"), (1, 5, "[LLM](https://x.edu/llm) [Website](https://x.edu/unselected)"), (2, 1, "[Visit Website](https://arts.x.edu/)"),
])
SELECTED = Rows("page int, ord int, url string, anchor string", [
    (1, 1, "https://arts.x.edu", "Visit Website"), (1, 2, "https://x.edu/ma", "MA Arts"), (1, 3, "https://x.edu/a", "MSc A"), (1, 4, "https://x.edu/b", "MSc B"), (1, 5, "https://x.edu/d", "Details"), (1, 6, "https://x.edu/m", "More"),
    (1, 7, "https://x.edu/mba", "MBA"), (1, 8, "https://x.edu/h", "Here"), (1, 9, "https://x.edu/llm", "LLM"), (2, 1, "https://arts.x.edu", "Visit Website"),
])


@query("u7_same_row_collapse", """SELECT * FROM (VALUES (1, 1, 'https://arts.x.edu', 'https://x.edu/ma'), (1, 2, 'https://x.edu/ma', NULL), (1, 3, 'https://x.edu/a', NULL), (1, 4, 'https://x.edu/b', NULL), (1, 5, 'https://x.edu/d', NULL), (1, 6, 'https://x.edu/m', NULL),
 (1, 7, 'https://x.edu/mba', NULL), (1, 8, 'https://x.edu/h', 'https://x.edu/mba'), (1, 9, 'https://x.edu/llm', NULL), (2, 1, 'https://arts.x.edu', NULL)) v(page, ord, url, duplicate_of)""")
def same_row_collapse(spark, d):
    """Selected links of one index row: if it has a name-bearing and a generic anchor, the generic ones are duplicates of
    the first name-bearing one; rows of names alone and rows of generic anchors alone stay."""
    chosen = SELECTED.df(spark).withColumns({"key": U.canonical(F.col("url")), "generic": T.blank(F.col("anchor")) | F.lower(F.trim("anchor")).rlike(V.GENERIC_ANCHOR) | T.noise_name(F.col("anchor"))})
    rows = ROWS.df(spark).select("page", "pos", F.posexplode(MD.all_links(F.col("line"))).alias("n", "l")).select("page", "pos", "n", U.canonical(F.col("l.target")).alias("key"))
    held = rows.groupBy("page", "pos", "key").agg(F.min("n").alias("n")).join(chosen, ["page", "key"])
    keeper = held.groupBy("page", "pos").agg(F.min_by(F.when(~F.col("generic"), F.col("url")), F.when(~F.col("generic"), F.col("n"))).alias("keeper"))
    gone = held.where("generic").join(keeper.where("keeper is not null"), ["page", "pos"]).groupBy("page", "ord").agg(F.min_by("keeper", "pos").alias("duplicate_of"))
    return chosen.join(gone, ["page", "ord"], "left").select("page", "ord", "url", "duplicate_of")


FIELDS = Rows("id int, raw string", [(1, "£12,500.50 per year"), (2, "Full-time | 1 year"), (3, "Online, 18 months"), (4, "Closes 1 March 2025 (round 1)"), (5, "  IELTS \n 6.5 "), (6, " "), (7, "part time"), (8, ",")])


@query("f36_selector_fields", """SELECT * FROM (VALUES (1, 12500.50, 'Unknown', 0, NULL, '£12,500.50 per year'), (2, 1, 'FullTime', 12, NULL, 'Full-time | 1 year'), (3, NULL, 'PartTime', 18, NULL, 'Online, 18 months'), (4, 1, 'Unknown', 0, DATE '2025-03-01', 'Closes 1 March 2025 (round 1)'),
 (5, 6.5, 'Unknown', 0, NULL, 'IELTS 6.5'), (6, NULL, NULL, NULL, NULL, ''), (7, NULL, 'PartTime', 0, NULL, 'part time'), (8, NULL, 'Unknown', 0, NULL, ',')) v(id, number, mode, months, cutoff, requirement)""")
def selector_fields(spark, d):
    """What each post-processor makes of a selected text: first number, study option, date of a deadline, clean requirement."""
    raw = F.col("raw")
    return FIELDS.df(spark).select("id", M.first_number(raw).alias("number"), M.option_mode(raw).alias("mode"), M.option_months(raw).alias("months"), M.deadline_date(raw).alias("cutoff"), F.trim(F.regexp_replace(raw, r"\s+", " ")).alias("requirement"))


DETAILS = Rows("url string, markdown string", [("d1", "See https://x.edu/fees/1 now"), ("d2", "no link"), ("d3", "Fees: HTTPS://x.edu/FEES/9"), ("d4", "https://x.edu/fees/2"), ("d5", None)])
SUBPAGES = Rows("url string, markdown string", [("https://x.edu/fees/1", "HKD 1"), ("https://x.edu/fees/2", ""), ("https://x.edu/fees/7", "HKD 7")])


@query("f49_supplemented_pages", """SELECT url, markdown, CAST(length(markdown) AS INTEGER) AS n_chars FROM (VALUES ('d1', 'See https://x.edu/fees/1 now' || chr(10) || chr(10) || '## Supplemental Detail' || chr(10) || 'HKD 1'), ('d2', 'no link'),
 ('d3', 'Fees: HTTPS://x.edu/FEES/9'), ('d4', 'https://x.edu/fees/2'), ('d5', NULL)) v(url, markdown)""")
def supplemented_pages(spark, d):
    """A page whose markdown names a supplement by the site's pattern gets that page's markdown appended, if it has any."""
    sub = SUBPAGES.df(spark).where("markdown <> ''").select(F.col("url").alias("sub"), F.col("markdown").alias("more"))
    rows = DETAILS.df(spark).withColumn("sub", F.regexp_extract(F.coalesce("markdown", F.lit("")), r"(?i)(https://x\.edu/fees/\d+)", 1)).join(sub, "sub", "left")
    full = F.when(F.col("more").isNull(), F.col("markdown")).otherwise(F.concat("markdown", F.lit("\n\n## Supplemental Detail\n"), "more"))
    return rows.select("url", full.alias("markdown"), F.length(full).alias("n_chars"))


OBSERVED = Rows("page int, url string, markdown string", [
    (1, "u1", "# MSc Data Science\nTuition fee\nHKD 300,000 or US$ 40,000\nper year of study\nDeposit HKD 900,000\nFull-time 1 year\nPart-time 24 months\nFull-time 1 year\nApplication deadline: 2025-03-01\nDeadline 15 June 2025\nIELTS 6.5 required\nGRE 320\n  IELTS   6.5 required"),
    (2, "u2", "nothing here\nthe fee is 100"), (3, "u3", "Costs\nGBP 9,250 deposit"),
])


@query("f41_observation", """SELECT page, name, tuition, options, deadlines, requirements, url FROM (VALUES (1, 'MSc Data Science', '300000.0 HKD', 'FullTime 12|PartTime 24', '1 2025-03-01|2 2025-06-15', 'language IELTS 6.5 required|standardized_test GRE 320', 'u1'), (2, NULL, NULL, '', '', '', 'u2'), (3, NULL, '9250.0 GBP', '', '', '', 'u3')) v(page, name, tuition, options, deadlines, requirements, url)""")
def observation(spark, d):
    """A page's name, best fee by the priority of its line and neighbours (else the page's first amount), options, rounds of deadlines and requirement
    signals (twelve at most), in one pass over its lines."""
    lines = OBSERVED.df(spark).select("page", "url", F.posexplode(F.split("markdown", "\n")).alias("pos", "t")).withColumn("t", F.trim("t")).where("t <> ''")
    w = W.partitionBy("page").orderBy("pos")
    c, low = F.col("t"), F.lower("t")
    near = F.concat_ws(" ", F.lag("t").over(w), "t", F.lead("t").over(w))
    rows = lines.withColumns({"priority": M.tuition_priority(near, ["deposit", "scholarship"]), "fees": M.tuition_candidates(c)})
    named = F.when(T.heading_level(c) > 0, T.heading_text(c))

    def said(words):
        return F.exists(F.array(*map(F.lit, words)), lambda x: F.contains(low, x))

    best = F.array_max(F.transform("fees", lambda x: F.struct(F.col("priority").alias("p"), (x["currency"] != "OTHER").alias("k"), x["amount"].alias("amount"), x["currency"].alias("currency"))))
    kind = F.coalesce(*[F.when(low.rlike(p), k) for k, p in V.REQUIREMENT_KINDS], F.lit("other"))
    clean = F.regexp_replace(c, r"\s+", " ")
    rows = rows.select(
        "page", "url", "pos", named.alias("named"), F.when(M.tuition_amount(c).isNotNull(), F.struct("pos", M.tuition_amount(c).cast("double").alias("amount"), M.tuition_currency(c).alias("currency"))).alias("any"), F.when((F.col("priority") >= 0) & (F.size("fees") > 0), best).alias("best"), F.when(said(V.OPTION_WORDS) & (M.duration_months(c) > 0), F.struct(M.duration_mode(c).alias("mode"), M.duration_months(c).alias("months"))).alias("option"),
        F.when(said(V.DEADLINE_WORDS), M.dates_in(c)).alias("dates"), F.when(said(V.REQUIREMENT_WORDS), F.struct(kind.alias("kind"), F.substring(clean, 1, 240).alias("text"))).alias("need"),
    )
    g = rows.groupBy("page", "url").agg(
        F.min_by("named", F.when(F.col("named").isNotNull(), F.col("pos"))).alias("name"), F.max("best").alias("b"), F.min("any").alias("any"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("option").isNotNull(), F.struct("pos", "option")))), lambda x: x["option"])).alias("o"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("dates")))).alias("d"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("need").isNotNull(), F.struct("pos", "need")))), lambda x: x["need"])).alias("r"),
    )
    return g.select(
        "page", "name", F.nullif(F.concat_ws(" ", F.coalesce("b.amount", "any.amount").cast("string"), F.coalesce("b.currency", "any.currency")), F.lit("")).alias("tuition"), F.concat_ws("|", F.transform("o", lambda x: F.concat_ws(" ", x["mode"], x["months"]))).alias("options"),
        F.concat_ws("|", F.transform("d", lambda x, i: F.concat_ws(" ", i + 1, x.cast("string")))).alias("deadlines"), F.concat_ws("|", F.transform(F.slice("r", 1, 12), lambda x: F.concat_ws(" ", x["kind"], x["text"]))).alias("requirements"), "url",
    )


@query("t16_detail_links", """SELECT * FROM (VALUES (1, 'https://x.edu/list/msc-a', 1), (1, 'https://x.edu/list/programme/b', 3), (2, 'https://y.edu/programmes/a', 1), (2, 'https://y.edu/course/b', 2), (3, 'https://z.edu/ma-arts', 2)) v(page, link, pos)""")
def detail_links(spark, d):
    """Links of the page's host but not the page itself, with a word of detail pages; those below the page's path alone
    if there are any; eight at most."""
    rows = spark.createDataFrame([
        (1, "https://x.edu/list", 1, "https://x.edu/list/msc-a"), (1, "https://x.edu/list", 2, "https://x.edu/programme/elsewhere"), (1, "https://x.edu/list", 3, "https://x.edu/list/programme/b"), (1, "https://x.edu/list", 4, "https://x.edu/list/about"),
        (1, "https://x.edu/list", 5, "https://other.edu/list/msc-c"), (2, "https://y.edu/all", 1, "https://y.edu/programmes/a"), (2, "https://y.edu/all", 2, "https://y.edu/course/b"), (2, "https://y.edu/all", 3, "https://y.edu/all#course"),
        (3, "https://z.edu/", 1, "https://z.edu/"), (3, "https://z.edu/", 2, "https://z.edu/ma-arts"),
    ], "page int, base string, pos int, link string")
    base, link = F.col("base"), F.col("link")
    own, below = F.regexp_replace(link, "#.*$", "") == F.regexp_replace(base, "#.*$", ""), F.regexp_replace(U.path(base), "/+$", "")
    c = rows.where((U.host(link) == U.host(base)) & ~own & F.lower(link).rlike(V.DETAIL_WORDS)).withColumn("nested", (U.path(link) == below) | F.startswith(U.path(link), F.concat(below, F.lit("/"))))
    m = c.withColumn("some", F.bool_or("nested").over(W.partitionBy("page"))).where("nested or not some")
    return m.withColumn("n", F.row_number().over(W.partitionBy("page").orderBy("pos"))).where("n <= 8").select("page", "link", "pos")


@query("t14_first_urls", "SELECT page_id, url FROM pages WHERE trim(coalesce(url, '')) <> '' ORDER BY page_id LIMIT 5")
def first_urls(spark, d):
    """The first k candidates that have a URL."""
    return table(spark, d, "pages").where(~T.blank(F.col("url"))).orderBy("page_id").limit(5).select("page_id", "url")


STUBS = Rows("page int, src string, sibling string, links array<string>", [
    (1, "https://x.edu/stub", "https://arts.x.edu/dept;https://x.edu/a.pdf;https://b.x.edu/d;https://c.x.edu/d", ["https://x.edu/admission/fees"]),
    (2, "https://x.edu/dept/", None, ["https://x.edu/dept/tuition-fees", "https://x.edu/dept/admission", "https://x.edu/admission-fees", "https://x.edu/dept/overview", "https://x.edu/dept/curriculum", "https://x.edu/dept/contact"]),
    (3, "https://x.edu/bare", None, ["https://x.edu/admission/fees"]),
])
FETCHED = Rows("url string, chars int, links array<string>", [
    ("https://arts.x.edu/dept", 50000, ["https://arts.x.edu/dept/requirements", "https://arts.x.edu/contact", "https://x.edu/fees"]), ("https://b.x.edu/d", 90000, ["https://b.x.edu/d/scholarship", "https://b.x.edu/d/overview"]),
    ("https://arts.x.edu/dept/requirements", 70000, []), ("https://b.x.edu/d/scholarship", 60000, []), ("https://b.x.edu/d/overview", 10, []), ("https://x.edu/dept/tuition-fees", 100, []), ("https://x.edu/dept/admission", 100, []), ("https://x.edu/dept/curriculum", 100, []),
])


@query("f52_thin_page_expansion", """SELECT * FROM (VALUES (1, 'https://arts.x.edu/dept', 1, 50000), (1, 'https://b.x.edu/d', 1, 60000), (1, 'https://arts.x.edu/dept/requirements', 2, 60000), (1, 'https://b.x.edu/d/scholarship', 2, 30000), (1, 'https://b.x.edu/d/overview', 2, 0),
 (2, 'https://x.edu/dept/tuition-fees', 2, 100), (2, 'https://x.edu/dept/admission', 2, 100), (2, 'https://x.edu/dept/curriculum', 2, 100)) v(page, url, hop, chars)""")
def thin_page_expansion(spark, d):
    """Up to two siblings of a thin page, then up to three pages that it or they link to within their own section, by
    keyword weight; 60,000 characters of a page and 200,000 in all are taken, in that order."""
    stubs = STUBS.df(spark)
    first = stubs.select("page", "src", F.posexplode(F.split("sibling", ";")).alias("pos", "url")).where(~U.noise(F.col("url")) & (U.canonical(F.col("url")) != U.canonical(F.col("src"))))
    first = first.withColumn("n", F.row_number().over(W.partitionBy("page").orderBy("pos"))).where("n <= 2").select("page", "url", F.col("n").alias("ord"))
    sources = stubs.select("page", F.lit(0).alias("ord"), F.col("src").alias("from"), "links").unionByName(first.join(FETCHED.df(spark), "url").select("page", "ord", F.col("url").alias("from"), "links"))
    c = sources.select("page", "ord", "from", F.posexplode("links").alias("pos", "url")).withColumn("weight", U.sub_link_weight(F.col("url"))).where("weight > 0").where(U.same_section(F.col("url"), F.col("from")))
    c = c.groupBy("page", "url").agg(F.min(F.struct("ord", (-F.col("weight")).alias("w"), "pos")).alias("k"))
    seen = first.select("page", "url").unionByName(stubs.select("page", F.col("src").alias("url")))
    second = c.join(seen, ["page", "url"], "left_anti").withColumn("n", F.row_number().over(W.partitionBy("page").orderBy("k"))).where("n <= 3")
    both = first.select("page", "url", F.lit(1).alias("hop"), "ord").unionByName(second.select("page", "url", F.lit(2).alias("hop"), F.col("n").alias("ord"))).join(FETCHED.df(spark).select("url", "chars"), "url", "left").fillna(0, "chars")
    before = F.coalesce(F.sum(F.least("chars", F.lit(60000))).over(W.partitionBy("page").orderBy("hop", "ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = F.least(F.least("chars", F.lit(60000)), F.greatest(F.lit(200000) - before, F.lit(0)))
    return both.select("page", "url", "hop", taken.cast("int").alias("chars"))
