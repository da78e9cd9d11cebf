"""Queries whose expected rows are typed out case by case, so that no pattern is shared with what is checked."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curation.functions import money as M
from curation.functions import text as T
from curation.functions import urls as U
from curation.operators import fuzzy
from curation.plans.registry import Rows, query

NOISE = [
    "A bachelor degree with a 2:1 (hons) in any subject.", "A good Bachelor degree plus management work experience", "Applicants must hold a 2:1 honours degree", "We require an IELTS score of 6.5", "Entry requirements: a relevant undergraduate degree",
    "You will need a 2:2 honours degree or equivalent", "Faculty of Business", "Department of Mathematics", "About the University", "Apply Now", "Contact Us", "Course Search", "Postgraduate Programmes", "Browse by Faculty", "A to Z of Programmes", "Visit Website", "", " ",
]
VALID = ["AI for Business MSc", "Master of Arts in Film", "MSc Data Science", "PhD in Law", "Juris Doctor", "Bachelor of Science (Hons)", "Executive MBA", "MA Applied Linguistics", "Doctor of Education", "MSc Engineering (2 years)"]
NAMES = Rows("name string", [(n,) for n in NOISE + VALID])


@query("p7_noise_cases", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(n in NOISE).lower()})" for n in NOISE + VALID) + ") v(name, noise)")
def noise_cases(spark, d):
    """Names that are known to be noise, and names that must survive."""
    return NAMES.df(spark).select("name", T.noise_name(F.col("name")).alias("noise"))


SCOPED = [
    ("Local students", "local"), ("Home", "local"), ("UK/EU", "local"), ("Home and EU", "local"), ("domestic", "local"), ("本地学生", "local"), ("Non-local students", "non_local"), ("International", "non_local"), ("Overseas applicants", "non_local"), ("EU", "non_local"), ("非本地生", "non_local"), ("nonlocal", "non_local"),
    ("Local and non-local", "all"), ("Home/International", "all"), ("Home / International", "non_local"), ("All students", "all"), ("Self-financed", "all"), ("UGC-funded", "all"), ("self-financed, local", "local"), ("Martian residents", "all"), ("", "all"),
]


@query("f32_scope_cases", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SCOPED) + ") v(label, scope)")
def scope_cases(spark, d):
    rows = spark.createDataFrame([(a,) for a, _ in SCOPED], "label string")
    return rows.select("label", M.applicant_scope(F.col("label")).alias("scope"))


EXAMS = [
    ("IELTS 6.5 overall", "IELTS", "language"), ("TOEFL iBT: 80", "TOEFL", "language"), ("a satisfactory degree", None, None), ("practical activity", None, None), ("SAT (1200)", "SAT", "standardized"), ("ACT, or SAT", "SAT", "standardized"), ("GRE/GMAT", "GRE", "standardized"),
    ("A level Maths", "A-Level", "curriculum"), ("bib", None, None), ("IB: 38", "IB", "curriculum"), ("ielts_score", None, None), ("apply by May", None, None), ("AP.", "AP", "curriculum"),
]


@query("w9_exam_cases", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)}, {'NULL' if c is None else repr(c)})" for a, b, c in EXAMS) + ") v(raw, exam, family)")
def exam_cases(spark, d):
    """Tokens stand alone in the text; the first of the list wins."""
    e = M.inferred_exam(F.col("raw"))
    return spark.createDataFrame([(a,) for a, *_ in EXAMS], "raw string").select("raw", e["name"].alias("exam"), e["family"].alias("family"))


HOSTS = Rows("url string", [(u,) for u in ("https://www.ln.edu.hk/a", "https://gs.cuhk.edu.hk", "https://ox.ac.uk/x", "https://mit.edu", "https://localhost:80/", "https://a.b.com.cn", "https://uni.de", "mailto:x", "", "https://edu.hk/")])


@query("f18_university_slug", "SELECT * FROM (VALUES ('https://www.ln.edu.hk/a', 'ln'), ('https://gs.cuhk.edu.hk', 'cuhk'), ('https://ox.ac.uk/x', 'ox'), ('https://mit.edu', 'mit'), ('https://localhost:80/', 'localhost'), ('https://a.b.com.cn', 'b'), ('https://uni.de', 'uni'), ('mailto:x', ''), ('', ''), ('https://edu.hk/', 'edu')) v(url, slug)")
def university_slug(spark, d):
    return HOSTS.df(spark).select("url", U.university_slug(F.col("url")).alias("slug"))


NEXT = Rows("id int, url string, page int, markdown string, param string, start int", [
    (1, "https://x.edu/l?page=3&s=a", 1, "[Next](?page=9)", None, None), (2, "https://x.edu/l?s=a#f", 2, None, "pg", 1), (3, "https://x.edu/l/", 1, "[1](a) [Next page »](../m?n=2)", None, None), (4, "https://x.edu/l", 1, "[more](a)", None, None), (5, "https://x.edu/l?PG=4", 1, None, None, None),
    (6, "https://x.edu/l?page=3", 3, None, "offset", 0), (7, "https://x.edu/l", 1, "[下一页](/n)", None, None), (8, "https://x.edu/l?xpage=2", 1, "", None, None),
])


@query("f20_next_page_url", """SELECT * FROM (VALUES (1, 'https://x.edu/l?s=a&page=4'), (2, 'https://x.edu/l?s=a&pg=3#f'), (3, 'https://x.edu/m?n=2'), (4, NULL), (5, 'https://x.edu/l?PG=5'), (6, 'https://x.edu/l?page=3&offset=3'), (7, 'https://x.edu/n'), (8, NULL)) v(id, next_url)""")
def next_page_url(spark, d):
    """By the site's page parameter, else by the one the URL has, else by a link that says next."""
    return NEXT.df(spark).select("id", U.next_page(F.col("url"), F.col("page"), F.col("markdown"), F.col("param"), F.col("start")).alias("next_url"))


SIGNALS = Rows("id int, url string, markdown string, anchor string, names array<string>, scores array<double>", [
    (1, "https://x.edu/p/msc-data/", "# MSc Data", "MSc Data", ["MSc Data", "", "MA"], [0.951, 0.9, 0.5]), (2, "https://x.edu/msc-law", "# MSc Law", " ", [], []), (3, "https://x.edu/", "text", "Law", ["A", "B", "C", "D"], [1.0, 0.876, 0.5, 0.4]),
])


@query("f48_taxonomy_signals", """SELECT * FROM (VALUES (1, 'MSc Data;p msc data', 'MSc Data|0.95;MA|0.50'), (2, 'msc law;MSc Law', ''), (3, 'Law', 'A|1.00;B|0.88;C|0.50')) v(id, signals, hints)""")
def taxonomy_signals(spark, d):
    """Anchor, words of the URL and heading, each once in order; hints are the first three matches with two decimals."""
    heading = T.heading_text(F.regexp_extract("markdown", r"(?m)^(#{1,3} .+)$", 1))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    signals = F.array_distinct(F.array_compact(F.array(blank(F.col("anchor")), blank(U.name_signal(F.col("url"))), blank(heading))))
    top = F.filter(F.slice(F.arrays_zip("names", "scores"), 1, 3), lambda m: F.trim(m["names"]) != "")
    hints = F.transform(top, lambda m: F.concat(F.trim(m["names"]), F.lit("|"), F.format_string("%.2f", m["scores"])))
    return SIGNALS.df(spark).select("id", F.concat_ws(";", signals).alias("signals"), F.concat_ws(";", hints).alias("hints"))


ENTRIES = Rows("entry string, names array<string>", [("MSc Data Science", ["MSc Data Science", "Data Science MSc"]), ("MSc Data", ["MSc Data"]), ("MA Law", ["MA Law"]), ("MSc Law", ["MSc Law", "!"]), ("BA Film", ["BA Film"])])
WANTED = Rows("signal string", [("msc data science",), ("law",), ("Physics",), ("MSc of Data",)])


@query("f6_t8_taxonomy_cases", """SELECT * FROM (VALUES ('msc data science', 'MSc Data Science', 1.0, 1), ('msc data science', 'MSc Data', 0.9, 2), ('msc data science', 'MSc Law', 0.4, 3), ('law', 'MA Law', 0.9, 1), ('law', 'MSc Law', 0.9, 2), ('MSc of Data', 'MSc Data', 0.875, 1), ('MSc of Data', 'MSc Data Science', 0.6087, 2), ('MSc of Data', 'MSc Law', 0.5333, 3)) v(signal, entry, score, n)""")
def taxonomy_cases(spark, d):
    """An entry's score is the best of its names: one if equal, else the greatest of likeness, containment and shared tokens."""
    names = ENTRIES.df(spark).select("entry", F.explode("names").alias("name"))
    right = names.select("entry", F.explode(F.array_distinct(T.tokens(F.col("name")))).alias("tok")).distinct()
    left = WANTED.df(spark).select("signal", F.explode(F.array_distinct(T.tokens(F.col("signal")))).alias("tok"))
    pairs = left.join(right, "tok").select("signal", "entry").distinct().join(names, "entry")
    scored = pairs.withColumn("score", fuzzy.taxonomy_score(F.col("signal"), F.col("name"))).groupBy("signal", "entry").agg(F.bround(F.max("score"), 4).alias("score"))
    n = F.row_number().over(W.partitionBy("signal").orderBy(F.desc("score"), "entry"))
    return scored.withColumn("n", n).where("n <= 3")


TEXTS = Rows("id int, text string", [(1, "short"), (2, "a" * 12), (3, "aaaa\n\nbbbbbb\ncc"), (4, "aaaaaa\nbb\nccccc"), (5, "ab\n" + "c" * 9), (6, ""), (7, None)])


@query("f11_chunk_cases", """SELECT id, chunk, replace(part, '/', chr(10)) AS part FROM (VALUES (1, 0, 'short'), (2, 0, 'aaaaaaaaaa'), (2, 1, 'aaaa'), (3, 0, 'aaaa/'), (3, 1, 'a//bbbbbb'), (3, 2, 'bb/cc'), (4, 0, 'aaaaaa/bb'), (4, 1, 'bb/ccccc'), (5, 0, 'ab/ccccccc'), (5, 1, 'cccc'), (6, 0, '')) v(id, chunk, part)""")
def chunk_cases(spark, d):
    """Ten characters at most, cut at the last paragraph or line break in the second half, two carried over; nothing is left out."""
    return TEXTS.df(spark).select("id", F.posexplode(fuzzy.chunks(F.col("text"), 10)).alias("chunk", "part"))


PAGE = '<div id="main" class="c box"><h1>Title <b>x</b></h1><p class="fee big">HKD <i>1</i></p><p>no</p><ul><li><a href="/a?x=1&amp;y=2" rel="n">A</a></li><li><p class="fee">2</p></li></ul><br><img src="i.png"></div><p>out</p>'
SELECTORS = ["h1", "p.fee", "#main > p", "div p", "li a[rel=n]", "a[href]", "img", ".box.c h1 b", "ul > p", "table"]


@query("f44_selector_cases", """SELECT * FROM (VALUES ('h1', 'Title x', NULL), ('p.fee', 'HKD 1|2', NULL), ('#main > p', 'HKD 1|no', NULL), ('div p', 'HKD 1|no|2', NULL), ('li a[rel=n]', 'A', '/a?x=1&y=2'), ('a[href]', 'A', '/a?x=1&y=2'), ('img', '', NULL), ('.box.c h1 b', 'x', NULL), ('ul > p', '', NULL), ('table', '', NULL)) v(selector, texts, href)""")
def selector_cases(spark, d):
    """Tags, classes, ids, attributes, descendants and children; texts of the elements and the first one's link."""
    rows = spark.createDataFrame([(PAGE,)], "html string")
    out = [rows.select(F.lit(s).alias("selector"), F.concat_ws("|", fuzzy.selected_text(F.col("html"), s)).alias("texts"), F.try_element_at(fuzzy.selected_text(F.col("html"), s, "href"), F.lit(1)).alias("href")) for s in SELECTORS]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
