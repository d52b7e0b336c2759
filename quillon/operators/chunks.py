"""Documents into cleaned, bounded chunks, and look-ups over chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.shared import ship_package


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos (from 0), line."""
    return docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("pos", "line"))


def repeated_margins(pages: DataFrame, doc: str, page: str, first: str, last: str) -> DataFrame:
    """(doc, side, key): lines that are the first or last of at least max(2, half) of a document's pages, with digits
    masked."""
    sides = pages.select(doc, page, F.explode(F.array(F.struct(F.lit("header").alias("side"), tx.margin_key(F.col(first)).alias("key")), F.struct(F.lit("footer").alias("side"), tx.margin_key(F.col(last)).alias("key")))).alias("m")).select(doc, page, "m.*")
    n = pages.groupBy(doc).agg(F.count_distinct(page).alias("n"))
    seen = sides.where("key IS NOT NULL").groupBy(doc, "side", "key").agg(F.count_distinct(page).alias("pages"))
    return seen.join(n, doc).where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") / 2))).select(doc, "side", "key", "pages")


def frequent_margins(pages: DataFrame, doc: str, page: str, first: str, last: str, least: int = 3) -> DataFrame:
    """(doc, key, times): lines that stand at least `least` times first or last on a page, digits masked, in documents of
    at least three pages."""
    sides = pages.select(doc, page, F.explode(F.array(tx.margin_key(F.col(first)), tx.margin_key(F.col(last)))).alias("key")).where("key IS NOT NULL")
    long = pages.groupBy(doc).agg(F.count_distinct(page).alias("n")).where("n >= 3").select(doc)
    return sides.join(long, doc, "left_semi").groupBy(doc, "key").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def body(rows: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """Lines before the references; of them those from an abstract's heading up to the first introduction's after it are left out, if there are both."""
    w = W.partitionBy(doc)
    first = lambda kind, when=F.lit(True): F.min(F.when(tx.is_heading(F.col(line), kind) & when, F.col(pos))).over(w)
    before = rows.withColumns({"_ref": first("references"), "_abs": first("abstract")}).where(F.col("_ref").isNull() | (F.col(pos) < F.col("_ref")))
    marked = before.withColumn("_intro", first("introduction", F.col(pos) > F.col("_abs")))
    front = F.coalesce(F.col(pos).between(F.col("_abs"), F.col("_intro") - 1), F.lit(False))
    return marked.where(~front).drop("_ref", "_abs", "_intro")


def fence_state(rows: DataFrame, key: list[str], pos: str, line: str) -> DataFrame:
    """in_fence: whether a line lies inside `$$` fences, those included."""
    is_fence = (F.trim(line) == "$$").cast("int")
    count = F.sum(is_fence).over(W.partitionBy(*key).orderBy(pos))
    return rows.withColumn("in_fence", (count % 2 == 1) | (is_fence == 1))


def carried_header(rows: DataFrame, key: str, pos: str, header: Column) -> DataFrame:
    """`header` of the nearest row before, for rows without one."""
    return rows.withColumn("header", F.coalesce(header, F.last(header, ignorenulls=True).over(W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, -1))))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1200) -> DataFrame:
    """id, chunk, content, n_lines: lines of each document packed greedily into chunks of at most `most` characters; a
    longer line is a chunk of its own. Each text is packed where it lies."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, chunks, contents, counts = [], [], [], []
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                held: list[str] = []
                size, n = 0, 0

                def flush(i=i):
                    nonlocal held, size, n
                    if held:
                        ids.append(i.as_py())
                        chunks.append(n)
                        contents.append("\n".join(held))
                        counts.append(len(held))
                        held, size, n = [], 0, n + 1

                for line in (t.as_py() or "").split("\n"):
                    if not line.strip():
                        continue
                    if held and size + 1 + len(line) > most:
                        flush()
                    held.append(line)
                    size += len(line) + (len(held) > 1)
                flush()
                if len(ids) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(chunks, pa.int64()), pa.array(contents, pa.string()), pa.array(counts, pa.int64())], [id_col, "chunk", "content", "n_lines"])
                    ids, chunks, contents, counts = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(chunks, pa.int64()), pa.array(contents, pa.string()), pa.array(counts, pa.int64())], [id_col, "chunk", "content", "n_lines"])

    ship_package(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, chunk long, content string, n_lines long")


def block_array(text: Column) -> Column:
    """The blocks of Markdown in order, as structs (page, kind, text): what stands between empty lines, and between marks `<!-- page: 3 -->`, whose
    number is that of the blocks after them; 0 before the first. No rows move: each text's blocks are found where it lies."""
    mark = r"<!--\s*page:\s*\d+\s*-->"
    t = F.coalesce(text, F.lit(""))
    numbers = F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(t, F.lit(r"<!--\s*page:\s*(\d+)\s*-->"), F.lit(1)), lambda n: n.try_cast("int")))
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    page = lambda part, i: F.transform(F.split(part, "\n\n", -1), lambda b: F.struct(F.get(numbers, i).alias("page"), tx.block_kind(b).alias("kind"), bare(b).alias("text")))
    return F.filter(F.flatten(F.transform(F.split(t, mark, -1), page)), lambda b: b["kind"] != "empty")


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, block (from 1, in order), page, kind, text of Markdown. A null or empty text has none."""
    each = docs.select(id_col, F.posexplode(block_array(F.col(text_col))).alias("block", "b"))
    return each.select(id_col, (F.col("block") + 1).cast("long").alias("block"), "b.page", "b.kind", "b.text")


#: A piece cut off with fewer characters than this stays with the one before (fixed value).
TAIL = 50


def _joined(rows: list[str], most: int) -> list[str]:
    """Rows joined by line feeds, as many as fit into `most` characters."""
    out: list[list[str]] = []
    size = 0
    for row in rows:
        if out and size + 1 + len(row) <= most:
            out[-1].append(row)
            size += 1 + len(row)
        else:
            out.append([row])
            size = len(row)
    return ["\n".join(x) for x in out]


def _cut(row: str, most: int) -> list[str]:
    """A row in pieces of `most` characters, a short last one left with the piece before."""
    pieces = [row[i : i + most] for i in range(0, len(row), most)]
    if len(pieces) > 1 and len(pieces[-1]) < TAIL:
        last = pieces.pop()
        pieces[-1] += last
    return pieces


def _table_header(text: str) -> list[str]:
    """The two first rows of a table whose second row is a rule."""
    rows = text.split("\n")[:2]
    return rows if len(rows) == 2 and rows[1].strip(" |:-") == "" and "-" in rows[1] else []


def _parts(kind: str, text: str, most: int, whole: int) -> list[str]:
    """A block of more than `whole` characters in parts: tables by rows under their header, math by lines in fences of
    their own, other text by lines."""
    if kind == "table":
        header = _table_header(text)
        room = most - sum(len(x) + 1 for x in header)
        rows = [y for x in text.split("\n")[len(header) :] for y in _cut(x, max(room, 1))]
        return ["\n".join([*header, x]) for x in _joined(rows, max(room, 1))]
    rows = text.split("\n")
    if kind == "display_formula":
        rows = [x for x in rows if x.strip() != "$$"]
        return [f"$$\n{x}\n$$" for x in _joined([y for x in rows for y in _cut(x, most - 6)], most - 6)]
    return _joined([y for x in rows for y in _cut(x, whole - TAIL)], whole)


def chunked(found: list[tuple[int, str, str]], most: int, whole: int) -> list[tuple[int | None, int | None, str, str]]:
    """(first page, last page, section, content) of a document's chunks, from its blocks (page, kind, text) in order."""
    out: list[tuple[int | None, int | None, str, str]] = []
    held: list[tuple[int, str, str]] = []
    header: list[str] = []

    def close() -> None:
        content = "\n\n".join(t for _, _, t in held)
        if held and (len(content) > 20 or any(c.isalpha() for c in content)):
            pages = [p for p, _, _ in held if p]
            first, last = (pages[0], pages[-1]) if pages else (None, None)
            section = next((t.split("\n")[0][:80] for _, k, t in held if k == "heading"), f"page_{first}" if first else "正文")
            out.append((first, last, section, content))
        held.clear()

    for page, kind, text in found:
        if kind == "heading" and any(k != "heading" for _, k, _ in held):
            close()
        if kind == "table":
            if header and not _table_header(text):
                text = "\n".join([*header, text])
            header = _table_header(text)
        if len(text) > whole:
            close()
            for part in _parts(kind, text, most, whole):
                held.append((page, kind, part))
                close()
            continue
        if held and sum(len(t) + 2 for _, _, t in held) + len(text) + 2 > most:
            close()
        held.append((page, kind, text))
    close()
    return out


#: Texts whose blocks a Python worker holds as Python values at a time.
AT_ONCE = 64


def few_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, AT_ONCE at a time, so that what is made of them doesn't grow with the batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(start, AT_ONCE)


def packed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1200, whole: int = 4000) -> DataFrame:
    """id, chunk (from 0), chunk_id, page_start, page_end, section, content: blocks of each document packed in order into chunks of about `most`
    characters. A heading after other text begins a chunk, whose section it names; without one the section is the page, or 正文. A block up to
    `whole` characters is never split; a table that goes on without its header gets it again; chunks of at most 20 characters without a letter are
    dropped. chunk_id is id:p0003:s0002, the second chunk that begins on page 3, or id:c0004 without pages. Each text is packed where it lies."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, block_array(F.col(text_col)).alias("x")).select(id_col, "x.page", "x.kind", "x.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_once(batches):
            made = [chunked(list(zip(*(c.as_py() for c in one), strict=True)), most, whole) for one in zip(*batch.columns[1:], strict=True)]
            ids = batch.column(0).take(pa.array([i for i, x in enumerate(made) for _ in x], pa.int64()))
            names = []
            for i, x in zip(batch.column(0).to_pylist(), made, strict=True):
                on: dict[int, int] = {}
                for n, (first, _, _, _) in enumerate(x):
                    on[first or 0] = on.get(first or 0, 0) + 1
                    names.append(f"{i}:p{first:04d}:s{on[first]:04d}" if first else f"{i}:c{n:04d}")
            columns = [ids, pa.array([n for x in made for n in range(len(x))], pa.int64()), pa.array(names, pa.string())]
            columns += [pa.array([c[k] for x in made for c in x], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "chunk", "chunk_id", "page_start", "page_end", "section", "content"])

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, f"{id_col} {kind}, chunk long, chunk_id string, page_start int, page_end int, section string, content string")


def batches_within(rows: DataFrame, by: str, order: str, size: Column, most: int = 12_000) -> DataFrame:
    """`rows` with `batch` (from 0): items of a group in order, as many as fit into `most`; a larger item is alone."""
    items = rows.withColumn("batch_size", size)
    sizes = items.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("batch_size").cast("long").alias("s")))).alias("x"))
    start = F.struct(F.array().cast("array<int>").alias("all"), F.lit(-1).alias("n"), F.lit(0).cast("long").alias("held"))

    def step(acc: Column, item: Column) -> Column:
        fits = (acc["n"] >= 0) & (acc["held"] + item["s"] <= most)
        n = F.when(fits, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.array_append(acc["all"], n).alias("all"), n.alias("n"), F.when(fits, acc["held"] + item["s"]).otherwise(item["s"]).alias("held"))

    numbers = sizes.select(by, F.inline(F.arrays_zip(F.col("x.o").alias(order), F.aggregate("x", start, step, lambda acc: acc["all"]).alias("batch"))))
    return items.drop("batch_size").join(numbers, [by, order])


def neighbours(chunks: DataFrame, key: str, pos: str, value: Column) -> DataFrame:
    order = W.partitionBy(key).orderBy(pos)
    return chunks.withColumn("previous", F.lag(value).over(order)).withColumn("next", F.lead(value).over(order))


def top_chunks(chunks: DataFrame, key: str, pos: str, content: str, keywords: Sequence[str], n: int = 6, most: int = 1200) -> DataFrame:
    """The n chunks of each document with most of the keywords, older ones first on ties, content cut."""
    low = F.lower(content)
    score = F.lit(0)
    for k in keywords:
        score = score + low.contains(k.lower()).cast("int")
    ranked = chunks.withColumn("score", score).where("score > 0")
    return ranked.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), pos))).where(F.col("place") <= n).withColumn(content, tx.clipped(F.col(content), most))


def contents(chunks: DataFrame, key: str, pos: str, content: str, n: int = 60, most: int = 60) -> DataFrame:
    """The first n chunks of each document with a preview, and how many there are."""
    w = W.partitionBy(key)
    return chunks.withColumn("place", F.row_number().over(w.orderBy(pos))).withColumn("total", F.count("*").over(w)).where(F.col("place") <= n).select(key, "place", "total", F.substring(content, 1, most).alias("preview"))


def fetched(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each request (request, paper_id, ids): status and the contents found, in the order asked."""
    asked = requests.select("request", "paper_id", F.posexplode_outer("ids").alias("p", "chunk_id"))
    known = chunks.select("paper_id", "chunk_id", "content")
    has = chunks.select("paper_id").distinct().withColumn("has", F.lit(True))
    found = asked.join(known, ["paper_id", "chunk_id"], "left").groupBy("request", "paper_id").agg(
        F.count("chunk_id").alias("asked"), F.count("content").alias("n_found"), F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("p", "content")))).alias("x")
    )
    joined = found.join(has, "paper_id", "left")
    status = F.when(F.col("asked") == 0, "invalid_arguments").when(F.col("has").isNull(), "missing_chunks").when(F.col("n_found") < F.col("asked"), "missing_chunk_ids").otherwise("ok")
    return joined.select("request", "paper_id", status.alias("status"), F.transform("x", lambda s: s["content"]).alias("contents"))


def nearest(left: DataFrame, right: DataFrame, key: list[str], left_id: str, left_at: str, right_id: str, right_at: str) -> DataFrame:
    """Each left row with the right row of its key that is nearest, the one of least id of equally near ones; of left rows that
    share an id, the nearest pair.

    The last right row before each left row and the first after it are windows over one sort of both, so a key's rows
    are never joined with each other. Left rows whose key has no right row, or without a place, don't appear."""
    each = right.where(F.col(right_at).isNotNull()).groupBy(*key, F.col(right_at).alias("at")).agg(F.min(right_id).alias("rid"))
    both = left.where(F.col(left_at).isNotNull()).select(*key, F.col(left_at).alias("at"), F.lit(None).alias("rid"), F.col(left_id).alias("lid"), F.lit(True).alias("asks"))
    both = both.unionByName(each.withColumns({"lid": F.lit(None), "asks": F.lit(False)}))
    known = F.when(~F.col("asks"), F.struct("at", "rid"))
    way = W.partitionBy(key).orderBy("at")
    found = both.withColumns({"before": F.last(known, True).over(way.rangeBetween(W.unboundedPreceding, 0)), "after": F.first(known, True).over(way.rangeBetween(0, W.unboundedFollowing))}).where("asks")
    apart = lambda c: F.abs(F.col("at") - F.col(f"{c}.at"))
    best = F.array_min(F.filter(F.array(*[F.struct(apart(c).alias("d"), F.col(f"{c}.rid").alias("rid")) for c in ("before", "after")]), lambda s: s["d"].isNotNull()))
    least = found.withColumn("best", best).where("best IS NOT NULL").groupBy(*key, F.col("lid").alias(left_id)).agg(F.min("best").alias("best"))
    return least.select(*key, left_id, F.col("best.rid").alias(right_id), F.col("best.d").alias("distance"))


def overlapping(boxes: DataFrame, key: list[str], box: str, least: float, cell: float = 16.0) -> DataFrame:
    """(key, a, b): pairs of boxes of a page whose common area is at least `least` (above 0); a < b.

    Boxes are dealt to the square cells that they touch, and meet only there, in the first cell that both touch, so
    boxes far from each other are never paired."""
    low, high = (lambda c: F.floor(F.col(c) / cell)), F.explode
    spread = boxes.withColumn("cx", high(F.sequence(low("x0"), low("x1")))).withColumn("cy", high(F.sequence(low("y0"), low("y1"))))
    a, b = spread.alias("p"), spread.alias("q")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in (*key, "cx", "cy")]
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col(f"p.{hi}"), F.col(f"q.{hi}")) - F.greatest(F.col(f"p.{lo}"), F.col(f"q.{lo}")))
    first = lambda c, lo: F.col(f"p.{c}") == F.floor(F.greatest(F.col(f"p.{lo}"), F.col(f"q.{lo}")) / cell)
    pairs = a.join(b, [*same, F.col(f"p.{box}") < F.col(f"q.{box}")]).where(first("cx", "x0") & first("cy", "y0"))
    return pairs.where(side("x0", "x1") * side("y0", "y1") >= least).select(*[F.col(f"p.{c}").alias(c) for c in key], F.col(f"p.{box}").alias("a"), F.col(f"q.{box}").alias("b"))
