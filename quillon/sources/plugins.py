"""Search providers as a Spark data source: pages of recorded responses, dealt out by size, each provider's records brought to one form."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: The one form of all providers' records.
RECORD = "provider string, page int, place int, id string, title string, year int, doi string, arxiv_id string, cited_by int, abstract string"

#: A provider's page as (id, title, year, doi, arxiv_id, cited_by, abstract), by its name.
Normaliser = Callable[[str], Iterator[tuple[Any, ...]]]
CONNECTORS: dict[str, Normaliser] = {}


def connector(name: str) -> Callable[[Normaliser], Normaliser]:
    """Adds a provider: what it decorates reads one response. Add providers before `register`."""

    def add(read: Normaliser) -> Normaliser:
        CONNECTORS[name] = read
        return read

    return add


def number(x: Any) -> int | None:
    """An integer of a number or its digits, else null."""
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


@connector("openalex")
def works(body: str) -> Iterator[tuple[Any, ...]]:
    """`results` of works; a map from word to places becomes the abstract. Works without a title are no records."""
    for w in json.loads(body).get("results") or []:
        if w.get("title"):
            at = sorted((p, word) for word, places in (w.get("abstract_inverted_index") or {}).items() for p in places)
            yield w.get("id"), w["title"], number(w.get("publication_year")), w.get("doi"), None, number(w.get("cited_by_count")), " ".join(word for _, word in at)


@connector("semantic_scholar")
def bulk(body: str) -> Iterator[tuple[Any, ...]]:
    """`data` of a bulk search's page; its token, which leads to the next page, is not needed of recorded pages."""
    for p in json.loads(body).get("data") or []:
        if p.get("paperId") and p.get("title"):
            other = p.get("externalIds") or {}
            yield p["paperId"], p["title"], number(p.get("year")), other.get("DOI"), other.get("ArXiv"), number(p.get("citationCount")), p.get("abstract") or ""


@connector("arxiv")
def feed(body: str) -> Iterator[tuple[Any, ...]]:
    """Entries of an Atom feed; the year is that of `published`, the id the last part of its address."""
    for e in ElementTree.fromstring(body).iter("{http://www.w3.org/2005/Atom}entry"):
        get = lambda tag, e=e: " ".join((e.findtext(f"{{http://www.w3.org/2005/Atom}}{tag}") or "").split())
        if get("title"):
            at = get("id").rsplit("/abs/", 1)[-1]
            yield at, get("title"), number(get("published")[:4]), e.findtext("{http://arxiv.org/schemas/atom}doi"), at, None, get("summary")


class Share(InputPartition):
    """Files that one task reads, as (provider, page or none, path)."""

    def __init__(self, files: list[tuple[str, int | None, str]]) -> None:
        super().__init__(None)
        self.files = files


#: So many files are a task each; more are put together by size, up to so many bytes, where opening a file counts as some.
SINGLE, SHARE, OPENING = 256, 32 << 20, 64 << 10


def shares(files: list[tuple[str, int | None, str, int]]) -> list[Share]:
    """`files` (provider, page or none, path, bytes) in their order, dealt to tasks, whose number grows with the bytes and not with the files."""
    most = min(SHARE, sum(size + OPENING for *_, size in files) / SINGLE) if len(files) > SINGLE else 0
    found, left = [], 0
    for *file, size in files:
        if left <= 0:
            found.append(Share([]))
            left = most
        found[-1].files.append(tuple(file))
        left -= size + OPENING
    return found


class Pages(DataSourceReader):
    """Pages under `root`, in folders provider=/first=/last= (the first and last year of a page's records) a page a line after its number and a
    tab, or in folders provider=/page=/first=/last= a page a file."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["root"].rstrip("/")
        self.wanted = {x for x in re.split(r"\s*,\s*", options.get("providers", "")) if x}
        self.low, self.high, self.dated = None, None, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over comparisons of year and provider with a constant; the rest is Spark's."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "year" and isinstance(f, IsNotNull):
                self.dated = True
            elif name == "year" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                self.dated = True
                if not isinstance(f, LessThan | LessThanOrEqual):
                    least = f.value + isinstance(f, GreaterThan)
                    self.low = least if self.low is None else max(self.low, least)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    most = f.value - isinstance(f, LessThan)
                    self.high = most if self.high is None else min(self.high, most)
            elif name == "provider" and isinstance(f, EqualTo):
                self.wanted = ({f.value} & self.wanted if self.wanted else {f.value}) or {""}
            elif name == "provider" and isinstance(f, IsNotNull):
                pass  # every record has one
            else:
                yield f

    def holds(self, year: int | None) -> bool:
        if year is None:
            return not self.dated
        return (self.low is None or year >= self.low) and (self.high is None or year <= self.high)

    def partitions(self) -> list[Share]:
        """The files whose years can meet the filters."""
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.root)
        found = []
        for f in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
            m = re.search(r"/provider=([^/]+)/(?:page=(\d+)/)?first=([^/]+)/last=([^/]+)/part-[^/]*$", f.path)
            if not m or (self.wanted and m[1] not in self.wanted):
                continue
            first, last = number(m[3]), number(m[4])
            if first is None and self.dated or first is not None and (self.low is not None and last < self.low or self.high is not None and first > self.high) and self.dated:
                continue
            found.append((m[1], number(m[2]), f.path, f.size))
        return shares(sorted(found, key=lambda f: (f[0], f[1] is not None, f[1] or 0, f[2])))

    def read(self, partition: Share | None) -> Iterator[tuple[Any, ...]]:
        from pyarrow import fs

        if partition is None:  # Spark's one partition of a source without any
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        for provider, only, path in partition.files:
            with system.open_input_stream(path) as f:
                for page, body in [(only, f.read())] if only is not None else numbered(f):
                    for place, r in enumerate(CONNECTORS[provider](body.decode())):
                        if self.holds(r[2]):
                            yield provider, page, place, *r


def numbered(f: Any) -> Iterator[tuple[int, bytes]]:
    """The pages of a file that has one a line, a line at a time."""
    for line in io.BufferedReader(f, 1 << 20):
        page, tab, body = line.partition(b"\t")
        if tab:
            yield int(page), body


class RecordedSearch(DataSource):
    """`spark.read.format("recorded_search").option("root", folder)`, and `providers`, a list with commas, if not all."""

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> Pages:
        return Pages(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down. The code travels with the plan, so workers need no package."""
    import sys

    from pyspark import cloudpickle

    module = sys.modules[__name__]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(RecordedSearch)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def escaped(x: Column) -> Column:
    """Text as XML content."""
    x = F.coalesce(x, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def record_pages(papers: DataFrame, root: str, size: int = 100) -> None:
    """Writes `papers` (source, ord, id, title, abstract, year, doi, arxiv_id, cited_by) as their providers' responses, `size` records a page by
    the order of ord; a page's records meet in one task, and nothing else does. A task writes one file for all its pages of a provider and its years,
    so there are not as many files as pages; rows without ord are on no page."""
    index = F.map_from_entries(F.transform(F.array_distinct(F.split("abstract", " ")), lambda w: F.struct(w, F.array(F.array_position(F.split("abstract", " "), w)))))
    work = F.to_json(F.struct("id", "title", F.col("year").alias("publication_year"), "doi", F.col("cited_by").alias("cited_by_count"), F.when(F.length("abstract") < 200, index).alias("abstract_inverted_index")))
    found = F.to_json(F.struct(F.col("id").alias("paperId"), "title", "year", F.col("cited_by").alias("citationCount"), F.struct(F.col("doi").alias("DOI"), F.col("arxiv_id").alias("ArXiv")).alias("externalIds")))
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), "id", F.lit("</id><title>"), escaped(F.col("title")), F.lit("</title>"),
        F.coalesce(F.concat(F.lit("<published>"), F.col("year").cast("string"), F.lit("-01-01</published>")), F.lit("")), F.lit("</entry>"),
    )
    body = F.when(F.col("source") == "openalex", work).when(F.col("source") == "arxiv", entry).otherwise(found)
    page = F.floor(F.col("ord") / (3 * size)).cast("int")
    rows = papers.select(F.col("source").alias("provider"), page.alias("page"), "ord", "year", body.alias("body"))
    pages = rows.groupBy("provider", "page").agg(F.coalesce(F.min("year").cast("string"), F.lit("none")).alias("first"), F.coalesce(F.max("year").cast("string"), F.lit("none")).alias("last"), F.array_sort(F.collect_list(F.struct("ord", "body"))).alias("x"))
    all_ = F.when(F.col("provider") == "arxiv", F.array_join("x.body", "")).otherwise(F.array_join("x.body", ","))
    whole = (
        F.when(F.col("provider") == "arxiv", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), all_, F.lit("</feed>")))
        .when(F.col("provider") == "openalex", F.concat(F.lit('{"results":['), all_, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"data":['), all_, F.lit("]}")))
    )
    line = F.concat(F.col("page").cast("string"), F.lit("\t"), F.regexp_replace(whole, r"[\r\n]", " "))
    pages.where("page IS NOT NULL").select("provider", "first", "last", line.alias("value")).write.partitionBy("provider", "first", "last").text(root)
