"""Provider payloads, logs, event streams and web pages as rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import identity
from quillon.functions import text as tx
from quillon.shared import ship_package

WORK = "id string, doi string, title string, publication_year int, cited_by_count int, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>"
PAPER = "struct<paperId:string,title:string,year:int,citationCount:int,externalIds:struct<DOI:string,ArXiv:string>>"


def works(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Records of JSON search responses with `results`; an inverted index becomes the abstract."""
    each = payloads.select(F.posexplode(F.from_json(column, f"results array<struct<{WORK.replace(' string', ':string').replace(' int', ':int').replace(' map', ':map').replace(' array', ':array')}>>")["results"]).alias("rank", "w"))
    return each.select(
        "rank", F.col("w.id").alias("id"), identity.doi(F.col("w.doi")).alias("doi"), F.col("w.title").alias("title"), F.col("w.publication_year").alias("year"), F.col("w.cited_by_count").alias("cited_by"),
        tx.from_inverted_index(F.col("w.abstract_inverted_index")).alias("abstract"), F.transform("w.authorships", lambda a: a["author"]["display_name"]).alias("authors"),
    )


def title_matches(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One record per payload, which may be {data: [..]}, {data: {..}} or a bare object."""
    v = F.try_parse_json(column)
    data = F.try_variant_get(v, "$.data", "variant")
    first = F.coalesce(F.try_variant_get(v, "$.data[0]", "variant"), F.when(~F.schema_of_variant(data).startswith("ARRAY"), data), v)
    get = lambda path, kind: F.try_variant_get(F.col("_r"), path, kind)
    kept = [c for c in payloads.columns if c != column]
    return payloads.select(*kept, first.alias("_r")).select(*kept, get("$.paperId", "string").alias("paper_id"), get("$.title", "string").alias("title"), get("$.year", "int").alias("year")).where("paper_id IS NOT NULL")


def feed_entries(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Entries of Atom feeds: id, title, year; entries without a title are dropped."""
    get = lambda tag: F.xpath(F.col(column), F.lit(f"//*[local-name()='entry']/*[local-name()='{tag}']/text()"))
    rows = payloads.select(F.posexplode(F.arrays_zip(get("id").alias("id"), get("title").alias("title"), get("published").alias("published"))).alias("rank", "e"))
    return rows.where("coalesce(trim(e.title), '') <> ''").select("rank", F.col("e.id").alias("id"), tx.collapsed(F.col("e.title")).alias("title"), F.substring("e.published", 1, 4).try_cast("int").alias("year"))


def jsonl_events(lines: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """JSON objects of lines; blank and broken lines, and those that hold no object, are skipped."""
    good = lines.where(F.trim(column).startswith("{") & F.try_parse_json(column).isNotNull())
    return good.select(F.from_json(column, schema).alias("e")).select("e.*")


def encoded_events(rows: DataFrame, seq: str, kind: str, body: Column) -> DataFrame:
    """Server-sent event text of each row."""
    return rows.select(seq, F.concat(F.lit("id: "), F.col(seq).cast("string"), F.lit("\nevent: "), F.col(kind), F.lit("\ndata: "), body, F.lit("\n\n")).alias("sse"))


def decoded_events(blocks: DataFrame, column: str = "sse") -> DataFrame:
    """id, event and data of event blocks; data lines are joined, comment lines skipped."""
    lines = F.filter(F.split(column, "\n"), lambda x: ~x.startswith(":") & (x != ""))
    field = lambda name: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", "")), "\n")
    return blocks.select(field("id").alias("id"), field("event").alias("event"), field("data").alias("data"))


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items, quotes and table rows in order; scripts and the like are left out."""

    KINDS = {"p": "paragraph", "li": "item", "blockquote": "quote", "tr": "row", "figcaption": "caption", "title": "title"} | {f"h{i}": "heading" for i in range(1, 7)}
    SKIP = {"script", "style", "noscript", "svg"}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[tuple[str, str]] = []
        self.kind, self.held, self.skip = "text", [], 0

    def flush(self) -> None:
        t = " ".join("".join(self.held).split())
        if t:
            self.out.append((self.kind, t))
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.KINDS:
            self.flush()
            self.kind = self.KINDS[tag]
        elif tag in ("td", "th"):
            self.held.append(" | ")
        elif tag == "br":
            self.held.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.KINDS:
            self.flush()
            self.kind = "text"

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, position, kind, text of each block of each page; a page is parsed where it lies."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, kinds, texts = [], [], [], []
            for i, h in zip(batch.column(0), batch.column(1), strict=True):
                parser = _Blocks()
                parser.feed(h.as_py() or "")
                parser.close()
                parser.flush()
                for n, (k, t) in enumerate(parser.out):
                    ids.append(i.as_py())
                    places.append(n)
                    kinds.append(k)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(places, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], [id_col, "position", "kind", "text"])

    ship_package(pages.sparkSession)
    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, position long, kind string, text string")


def front_matter(docs: DataFrame, schema: str, column: str = "text") -> DataFrame:
    """The JSON between `---` lines at the start of a document, as columns."""
    head = F.regexp_extract(column, r"(?s)^---\s*\n(.*?)\n---", 1)
    return docs.withColumn("_m", F.from_json(F.when(head != "", head), schema)).select(*[c for c in docs.columns if c != column], "_m.*")


#: Flags of a stored chunk that may be missing (fixed values).
FLAGS = ("has_table", "has_math", "has_figure")


def chunk_rows(files: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows of stored chunk files (a JSON object with version and chunks) with their other columns: version, chunk_id,
    content and FLAGS, missing ones false. Chunks without an id or content, and files that don't parse, have no row."""
    fields = ", ".join(f"{c}:boolean" for c in FLAGS)
    parsed = F.from_json(payload, f"version bigint, chunks array<struct<chunk_id:string,content:string,{fields}>>")
    each = files.withColumn("file", parsed).select(*[c for c in files.columns if c != payload], "file.version", F.explode("file.chunks").alias("c"))
    rows = each.where("coalesce(c.chunk_id, '') <> '' AND coalesce(c.content, '') <> ''")
    return rows.select(*[c for c in each.columns if c != "c"], "c.chunk_id", "c.content", *[F.coalesce(f"c.{f}", F.lit(False)).alias(f) for f in FLAGS])


def workspace_papers(files: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows of workspace files (a JSON object whose `papers` maps ids to records) with their other columns: paper_id,
    title, year. A record's own paperId wins over its key; a file that doesn't parse has no row, a bad year is null."""
    parsed = F.from_json(payload, "papers map<string,struct<paperId:string,title:string,year:string>>")
    each = files.withColumn("file", parsed).select(*[c for c in files.columns if c != payload], F.explode("file.papers").alias("key", "p"))
    own = F.when(F.coalesce("p.paperId", F.lit("")) != "", F.col("p.paperId")).otherwise(F.col("key"))
    return each.select(*[c for c in each.columns if c not in ("key", "p")], own.alias("paper_id"), F.coalesce("p.title", F.lit("")).alias("title"), F.col("p.year").try_cast("int").alias("year"))


def cases(rows: DataFrame, payload: str = "payload", holdout: bool = False) -> DataFrame:
    """Evaluation cases of JSON arrays with their other columns: case_id, query, holdout (missing is false); those held
    out only if asked for; cases without an id have no row."""
    parsed = F.from_json(payload, "array<struct<id:string,query:string,holdout:boolean>>")
    each = rows.select(*[c for c in rows.columns if c != payload], F.explode(parsed).alias("c")).where("coalesce(c.id, '') <> ''")
    out = each.select(*[c for c in each.columns if c != "c"], F.col("c.id").alias("case_id"), F.coalesce("c.query", F.lit("")).alias("query"), F.coalesce("c.holdout", F.lit(False)).alias("holdout"))
    return out if holdout else out.where("NOT holdout")


def related_edges(payloads: DataFrame, direction: str, payload: str = "payload") -> DataFrame:
    """(seed, place, paper_id, title) of a citation provider's pages: direction "references" unwraps citedPaper,
    "citations" citingPaper; entries without an id have no row."""
    field = {"references": "citedPaper", "citations": "citingPaper"}[direction]
    parsed = F.from_json(payload, f"data array<struct<{field}:struct<paperId:string,title:string>>>")
    each = payloads.select("seed", F.posexplode(parsed["data"]).alias("place", "e")).select("seed", "place", F.col(f"e.{field}").alias("p"))
    return each.where("coalesce(p.paperId, '') <> ''").select("seed", "place", F.col("p.paperId").alias("paper_id"), F.coalesce("p.title", F.lit("")).alias("title"))
