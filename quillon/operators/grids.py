"""Tables of web pages as grids and as Markdown; cells that span rows and columns push no other cell from its column."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a page shows nothing of, and the tags that end a cell whose own end tag is missing (fixed values).
HIDDEN = "script|style|noscript|svg"
ENDS_CELL = "p|h[1-6]|li|blockquote|div|figure|table"

#: The largest spans that HTML allows (fixed values).
MOST_COLUMNS, MOST_ROWS = 1000, 65534

CELL = "struct<text:string,colspan:int,rowspan:int>"


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def unescaped(x: Column) -> Column:
    """Character references that end with a semicolon as characters: decimal, hexadecimal, and the names of HTML 4. One that stands for no
    character becomes U+FFFD, an unknown name stays."""
    names = F.from_json(F.lit("{" + ",".join(f'"{n}":"\\u{c:04x}"' for n, c in name2codepoint.items()) + "}"), "map<string,string>")

    def character(code: Column) -> Column:
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")

    def one(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 9), 16, 10)).otherwise(F.substring(ref, 2, 9)).try_cast("int")
        known = F.when(ref.startswith("#"), character(code)).otherwise(F.try_element_at(names, ref))
        return F.coalesce(F.concat(known, F.regexp_replace(part, "^[^;]*;", "")), F.concat(F.lit("&"), part))

    return _let(F.split(x, "&", -1), lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, 2, F.size(p)), one), "")))


def cell_text(raw: Column) -> Column:
    """The text of a cell's HTML: formulas as $…$ by their alternative text, other tags left out, a line break as a space, white space single, bars escaped."""
    x = F.regexp_replace(raw, r"(?is)<math\b[^>]*\bdisplay\s*=\s*[\"']?block[^>]*>.*?</math\s*>", "")
    x = F.regexp_replace(x, r"(?is)<math\b[^>]*\balttext=\"\s*([^\"]+?)\s*\"[^>]*>.*?</math\s*>", r"\$$1\$")
    x = F.regexp_replace(F.regexp_replace(x, r"(?is)<math\b[^>]*>\s*(\S.*?)\s*</math\s*>", r"\$$1\$"), r"(?i)<br\b[^>]*>", " ")
    return cleaned(unescaped(F.regexp_replace(x, r"</?[A-Za-z!][^>]*>", "")))


def cleaned(x: Column) -> Column:
    """A cell's value: null is empty, white space single, bars escaped."""
    return F.replace(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "), "^ | $", ""), F.lit("|"), F.lit("\\|"))


def tables(html: Column) -> Column:
    """The tables of a page in order, each an array of rows, which are arrays of cells (text, colspan, rowspan).

    A table ends at the first end tag after it, so the rows of one inside it are its own. Missing end tags of cells and rows are made up for. A
    table that only lays out an equation has no rows; spans that aren't numbers from 1 count as 1. Found without moving the text."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", ""), rf"(?is)<({HIDDEN})\b.*?(?:</\1\s*>|\z)", "")
    begun = F.transform(F.split(plain, r"(?i)</table\s*>", -1), lambda p: F.get(F.split(p, r"(?i)<table\b", 2), F.lit(1)))
    after = lambda x, mark: _let(F.split(x, mark, -1), lambda p: F.slice(p, 2, F.size(p)))
    upto = lambda x, mark: F.get(F.split(x, mark, 2), F.lit(0))

    def cell(c: Column) -> Column:
        tag = F.substring_index(c, ">", 1)
        span = lambda name, most: F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(F.regexp_extract(tag, rf"(?i)(?:^|\s){name}\s*=\s*[\"']?\s*\+?([0-9]+)(?=[\"'\s/]|$)", 1).try_cast("long"), F.lit(1)))).cast("int")
        body = upto(F.regexp_replace(c, "^[^>]*>", ""), rf"(?i)<(?:/t[dh]|{ENDS_CELL})\b")
        return F.struct(cell_text(body).alias("text"), span("colspan", MOST_COLUMNS).alias("colspan"), span("rowspan", MOST_ROWS).alias("rowspan"))

    row = lambda r: F.transform(after(upto(r, r"(?i)</tr\b"), r"(?i)<t[dh]\b"), cell)
    rows = lambda t: F.when(F.substring_index(t, ">", 1).contains("ltx_equation"), F.array().cast(f"array<array<{CELL}>>")).otherwise(F.transform(after(t, r"(?i)<tr\b[^>]*>"), row))
    return F.transform(F.filter(begun, lambda t: t.isNotNull()), rows)


def grid(rows: Column) -> Column:
    """Rows of cells (text, colspan, rowspan) as rows of texts, every cell in its column: places that a cell spans besides its first are empty.

    A fold over the rows, then over their cells. `until` holds the last row in which each column is taken by a cell from above; a cell goes to the
    first column that is free in its row. Rows without cells count, but neither they nor rows of empty texts come out."""
    blank = lambda n: F.array_repeat(F.lit(""), n.cast("int"))

    def free(until: Column, start: Column, r: Column) -> Column:
        places = F.sequence(start, F.greatest(start, F.size(until)))
        return F.array_min(F.filter(places, lambda i: F.coalesce(F.get(until, i), F.lit(-1)) < r))

    def put(state: Column, cell: Column) -> Column:
        def at(c: Column) -> Column:
            end = c + cell["colspan"]
            texts = F.concat(state["texts"], blank(c - F.size(state["texts"])), F.array(F.coalesce(cell["text"], F.lit(""))), blank(cell["colspan"] - 1))
            held = F.transform(F.sequence(F.lit(0), F.greatest(end, F.size(state["until"])) - 1), lambda i: F.when((i >= c) & (i < end), state["r"] + cell["rowspan"] - 1).otherwise(F.coalesce(F.get(state["until"], i), F.lit(-1))))
            return F.struct(texts.alias("texts"), F.when(cell["rowspan"] > 1, held).otherwise(state["until"]).alias("until"), state["r"].alias("r"))

        return _let(free(state["until"], F.size(state["texts"]), state["r"]), at)

    def over(state: Column, cells: Column) -> Column:
        begun = F.struct(F.array().cast("array<string>").alias("texts"), state["until"].alias("until"), state["r"].alias("r"))

        def done(row: Column) -> Column:
            texts = F.concat(row["texts"], blank(free(row["until"], F.size(row["texts"]), row["r"]) - F.size(row["texts"])))
            seen = F.when(F.exists(row["texts"], lambda t: F.trim(t) != ""), F.array_append(state["grid"], texts)).otherwise(state["grid"])
            return F.struct(seen.alias("grid"), row["until"].alias("until"), (row["r"] + 1).alias("r"))

        filled = _let(F.aggregate(cells, begun, put), done)
        return F.when(F.size(cells) > 0, filled).otherwise(F.struct(state["grid"].alias("grid"), state["until"].alias("until"), (state["r"] + 1).alias("r")))

    start = F.struct(F.array().cast("array<array<string>>").alias("grid"), F.array().cast("array<int>").alias("until"), F.lit(0).alias("r"))
    return F.aggregate(rows, start, over, lambda s: s["grid"])


def markdown(rows: Column) -> Column:
    """Rows of texts as a Markdown table: the first is the header, shorter rows are filled up to the longest. No rows, no text (null)."""

    def drawn(width: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
        full = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))))
        return _let(full, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(x, 2, F.size(x))), "\n"))

    return F.when(F.size(rows) > 0, _let(F.array_max(F.transform(rows, lambda r: F.size(r))), drawn))


def plain_markdown(rows: Column) -> Column:
    """Rows of raw cell values as a Markdown table: values cleaned, null rows and rows of empty values left out."""
    good = F.filter(F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, cleaned)), lambda r: F.exists(r, lambda c: c != ""))
    return _let(good, markdown)


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, table (its place among the page's tables, from 1), n_rows, n_columns, markdown. Tables of fewer than two places, such as
    frames that only lay out something else, have no row; nor have pages that are null, empty or without tables."""
    size = lambda g: F.struct(F.size(g).alias("n_rows"), F.array_max(F.transform(g, lambda r: F.size(r))).alias("n_columns"), F.aggregate(g, F.lit(0), lambda n, r: n + F.size(r)).alias("places"), markdown(g).alias("markdown"))
    each = pages.select(id_col, F.posexplode(F.transform(tables(F.col(html_col)), lambda t: _let(grid(t), size))).alias("table", "t"))
    return each.where("t.places >= 2").select(id_col, (F.col("table") + 1).alias("table"), "t.n_rows", "t.n_columns", "t.markdown")
