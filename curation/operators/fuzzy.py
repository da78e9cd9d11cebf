"""Order-dependent and edit-based operators that built-in functions can't express; pandas runs inside bounded groups."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curation.functions import text as T
from curation.functions import vocabulary as V


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """``difflib`` ratio of two strings, with its asymmetry."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(left, right)])

    return ratio(a, b)


def taxonomy_score(signal: Column, name: Column) -> Column:
    """1 if equal when squashed; else the best of the sequence ratio, 0.9 for containment, 0.95 of the token overlap."""
    a, b = T.squashed(signal), T.squashed(name)
    inside = F.when((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), 0.9).otherwise(0.0)
    return F.when(b == "", 0.0).when(a == b, 1.0).otherwise(F.greatest(sequence_ratio(a, b), inside, 0.95 * T.jaccard(T.tokens(signal), T.tokens(name))))


def greedy_distinct(rows: DataFrame, group: str, position: str, keys: list[str]) -> DataFrame:
    """Rows kept in order if none of their keys was seen in the group before; the keys of kept rows count as seen.

    A group is one page's items.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: list[set] = [set() for _ in keys]
        kept = []
        for row in pdf.sort_values(position).itertuples(index=False):
            values = [getattr(row, k) for k in keys]
            if any(v is not None and v == v and v in s for v, s in zip(values, seen)):
                kept.append(False)
                continue
            for v, s in zip(values, seen):
                s.add(v)
            kept.append(True)
        return pdf.sort_values(position)[kept]

    return rows.groupBy(group).applyInPandas(keep, rows.schema)


def near_distinct_requirements(rows: DataFrame, group: str, position: str, likeness: float = 0.82) -> DataFrame:
    """Requirements (category, subject, minimum, text) of a group without repeats; a group is one programme's list.

    Equal texts of a category, but for case and signs, go by a window. What depends on the order goes through the group
    in turn: a requirement with the test and threshold of a kept one, or with a sequence ratio of ``likeness`` to one
    (unless their thresholds differ), takes its place if it is longer and else goes; one whose text stands inside any
    other text goes.
    """
    loose = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
    least = F.trim(F.coalesce("minimum", F.lit("")))
    family = F.replace(F.regexp_extract(F.lower(F.concat_ws(" ", "subject", "text")), V.TESTS, 1), F.lit("-"), F.lit(""))
    test = F.when((least != "") & (family != ""), F.concat_ws(":", family, F.coalesce(least.try_cast("double").cast("string"), F.lower(least))))
    keyed = rows.withColumns({"loose_": loose, "least_": least, "test_": test})
    once = Window.partitionBy(group, F.lower(F.trim("category")), "loose_").orderBy(position)
    keyed = keyed.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")

    def alike(a: pd.Series, b: pd.Series) -> bool:
        if a.least_ and b.least_ and a.least_ != b.least_:
            return False
        return bool(a.loose_ and b.loose_) and SequenceMatcher(None, a.loose_, b.loose_).ratio() >= likeness

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        items = list(pdf.sort_values(position).itertuples())
        kept: list = []
        tests: list = []  # of the requirements that first took each place
        for item in items:
            twin = next((k for k, test in enumerate(tests) if item.test_ and item.test_ == test), None)
            if twin is None:
                if item.loose_ and any(item.loose_ != o.loose_ and item.loose_ in o.loose_ for o in items):
                    continue
                twin = next((k for k, other in enumerate(kept) if alike(item, other)), None)
            if twin is None:
                kept.append(item)
                tests.append(item.test_)
            elif len(item.loose_) > len(kept[twin].loose_):
                kept[twin] = item
        return pdf.loc[[item.Index for item in kept]]

    return keyed.groupBy(group).applyInPandas(reduced, keyed.schema).drop("loose_", "least_", "test_")


def chunks(text: Column, most: int, overlap: float = 0.2) -> Column:
    """Overlapping chunks of at most ``most`` characters that leave no gap: cut at the last paragraph break, else the last
    line break, if it is in the second half. The next chunk starts so much before the cut."""
    carried = int(most * max(0.0, min(0.5, overlap)))

    def cut_at(t: str, start: int, end: int) -> int:
        breaks = (t.rfind(mark, start, end) for mark in ("\n\n", "\n"))
        return next((at for at in breaks if at - start >= (end - start) // 2), end)

    def parts(t: str) -> list[str]:
        out, start = [], 0
        while len(t) - start > most:
            cut = cut_at(t, start, start + most)
            out.append(t[start:cut])
            start = cut - carried if cut - carried > start else cut
        return [*out, t[start:]]

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else parts(t))

    return cut(text)


def selected_text(html: Column, selector: str, attribute: str | None = None) -> Column:
    """Texts, or values of ``attribute``, of the elements that a selector finds: tags, ``.class``, ``#id``, ``[name]`` and
    ``[name=value]``, combined, within others (blank) or directly below them (``>``)."""
    steps = [(part, i > 0 and below) for i, (below, part) in enumerate(re.findall(r"(>?)\s*([^\s>]+)", selector))]
    tests = [(re.match(r"[\w-]*", part)[0].lower(), re.findall(r"\.([\w-]+)", part), re.findall(r"#([\w-]+)", part), re.findall(r"\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]", part), bool(below)) for part, below in steps]

    def fits(test: tuple, element: tuple[str, dict]) -> bool:
        tag, classes, ids, named, _ = test
        name, attrs = element
        own = (attrs.get("class") or "").split()
        return (not tag or tag == name) and all(c in own for c in classes) and all(i == attrs.get("id") for i in ids) and all(k in attrs and v in ("", attrs[k]) for k, v in named)

    def found(path: list, k: int) -> bool:
        """The last of ``path`` is what the first k tests select."""
        if not fits(tests[k - 1], path[-1]):
            return False
        if k == 1:
            return True
        above = path[:-1]
        ends = [len(above)] if tests[k - 1][4] else range(len(above), 0, -1)
        return any(end and found(above[:end], k - 1) for end in ends)

    @F.pandas_udf("array<string>")
    def select(pages: pd.Series) -> pd.Series:
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__()
                self.path, self.open, self.texts, self.values = [], [], [], []

            def handle_starttag(self, name, attrs):
                self.path.append((name, dict(attrs)))
                if found(self.path, len(tests)):
                    self.open.append((len(self.path), len(self.texts)))
                    self.texts.append("")
                    self.values.append(dict(attrs).get(attribute))
                if name in ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"):
                    self.handle_endtag(name)

            def handle_endtag(self, name):
                at = next((k for k in range(len(self.path) - 1, -1, -1) if self.path[k][0] == name), None)
                if at is not None:
                    del self.path[at:]
                    self.open = [o for o in self.open if o[0] <= at]

            def handle_data(self, data):
                for _, k in self.open:
                    self.texts[k] += data

        def one(page: str | None) -> list[str]:
            reader = Reader()
            reader.feed(page or "")
            return reader.values if attribute else [" ".join(t.split()) for t in reader.texts]

        return pages.map(one)

    return select(html)


def pagination_containers(page: Column) -> Column:
    """Each navigation or list element that is marked as pagination, to its own closing tag; without one, 2,000 characters."""
    tags = re.compile(r"<(/?)(nav|ul|ol)\b([^>]*)>", re.IGNORECASE)

    def slices(html: str) -> list[str]:
        found, out = list(tags.finditer(html)), []
        for k, opening in enumerate(found):
            marks = opening[3].lower()
            if opening[1] or "pagination" not in marks or "swiper-pagination" in marks or "page-nav" in marks:
                continue
            depth = 0
            for tag in found[k:]:
                if tag[2].lower() == opening[2].lower():
                    depth += -1 if tag[1] else 1
                if not depth:
                    out.append(html[opening.start() : tag.end()])
                    break
            else:
                out.append(html[opening.start() : opening.start() + 2000])
        return out

    @F.pandas_udf("array<string>")
    def cut(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: slices(p or ""))

    return cut(page)
