"""A registry of extractors: what takes items out of a page is looked up by name, so adding one touches no plan.

An extractor is an expression, (content, base) -> array<struct<text, url>>, which stays in the JVM, or, where built-in
functions can't say it, a Python table function with the same arguments and the columns ``pos, text, url``, which is joined
laterally to the pages in Arrow batches. Links are resolved against the page's own address in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curation.functions import urls as U

ITEMS = "array<struct<text:string,url:string>>"
ROWS = "pos int, text string, url string"
Expression = Callable[[Column, Column], Column]
Scan = Callable[[str, str], Iterable[tuple[str | None, str | None]]]


class Extractors:
    """Named extractors; a later one of a name replaces an earlier one."""

    def __init__(self) -> None:
        self.expressions: dict[str, Expression] = {}
        self.scans: dict[str, Scan] = {}

    def expression(self, name: str) -> Callable[[Expression], Expression]:
        """Register a column expression."""

        def add(extract: Expression) -> Expression:
            self.scans.pop(name, None)
            self.expressions[name] = extract
            return extract

        return add

    def scan(self, name: str) -> Callable[[Scan], Scan]:
        """Register a plain function, (content, base) -> (text, url) pairs; it runs inside a table function."""

        def add(extract: Scan) -> Scan:
            self.expressions.pop(name, None)
            self.scans[name] = extract
            return extract

        return add

    @property
    def names(self) -> list[str]:
        return sorted([*self.expressions, *self.scans])

    def extracted(self, pages: DataFrame, content: str, base: str, names: list[str] | None = None) -> DataFrame:
        """The columns of ``pages`` but ``content``, then ``extractor, pos, text, url`` for each item.

        All expressions share one scan of the pages, each table function has its own. Null content has no items; columns named
        like those of an item are refused.
        """
        wanted = self.names if names is None else names
        unknown = sorted({*wanted} - {*self.names})
        if unknown:
            raise ValueError(f"unknown extractors: {', '.join(unknown)}; known: {', '.join(self.names)}")
        own = [c for c in pages.columns if c != content]
        clash = sorted({*own} & {"extractor", "pos", "text", "url"})
        if clash:
            raise ValueError(f"columns that items would hide: {', '.join(clash)}")
        parts = []
        inside = [n for n in wanted if n in self.expressions]
        if inside:
            found = [F.struct(F.lit(n).alias("extractor"), self.expressions[n](F.col(content), F.col(base)).cast(ITEMS).alias("items")) for n in inside]
            by_name = pages.select(*own, F.explode(F.array(*found)).alias("_x")).select(*own, "_x.extractor", F.posexplode("_x.items").alias("pos", "_i"))
            parts.append(by_name.select(*own, "extractor", "pos", "_i.text", "_i.url"))
        parts += [self._scanned(pages, content, base, own, n) for n in wanted if n in self.scans]
        rows = reduce(lambda a, b: a.unionByName(b), parts) if parts else pages.where("false").select(*own, F.lit("").alias("extractor"), F.lit(0).alias("pos"), F.lit("").alias("text"), F.lit("").alias("url"))
        return rows.withColumn("url", U.resolved(F.col("url"), F.col(base)))

    def _scanned(self, pages: DataFrame, content: str, base: str, own: list[str], name: str) -> DataFrame:
        extract = self.scans[name]

        class Items:
            def eval(self, page: str | None, address: str | None) -> Iterator[tuple[int, str | None, str | None]]:
                for pos, (text, url) in enumerate(extract(page, address or "") if page is not None else ()):
                    yield pos, text, url

        function = F.udtf(Items, returnType=ROWS, useArrow=True)
        items = function(F.col(content).outer(), F.col(base).outer())
        return pages.lateralJoin(items).select(*own, F.lit(name).alias("extractor"), "pos", "text", "url")


#: The extractors that come with the library.
BUILT_IN = Extractors()


@BUILT_IN.expression("html_links")
def html_links(content: Column, base: Column) -> Column:
    return F.transform(U.html_links(content), lambda href: F.struct(F.lit(None).cast("string").alias("text"), href.alias("url")))
