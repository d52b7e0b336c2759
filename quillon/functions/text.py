"""Text helpers as column expressions: truncation, citations in brackets, headings, captions, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(x: Column, most: int, note: str = "") -> Column:
    """At most `most` characters, with a note where something was cut."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(note))).otherwise(x)


def head_and_tail(x: Column, most: int, mark: str) -> Column:
    """Two thirds of the budget from the start and the rest from the end, around a mark, where a text is longer."""
    head = most * 2 // 3
    tail = most - head
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, head), F.lit(mark), F.right(x, F.lit(tail)))).otherwise(x)


def collapsed(x: Column) -> Column:
    """White space made single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "), r"^ | $", "")


def bracket_citations(x: Column) -> Column:
    """What stands in square brackets and isn't a link: two characters or more, not a number, no note to oneself; each
    once, in order."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\[([^\[\]]+)\](?!\()"), F.lit(1))
    found = F.transform(found, lambda x: F.trim(x))
    shape = lambda c: c.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:/()-]+$")
    good = lambda c: shape(c) & ~c.rlike(r"^\d+$") & ~F.lower(c).isin("todo", "note", "fixme")
    return F.array_distinct(F.filter(found, good))


def token_estimate(chars: Column) -> Column:
    """Tokens of so many characters, about: at least one."""
    return F.greatest(F.lit(1), F.floor(chars / 4.5)).cast("long")


def margin_key(x: Column) -> Column:
    """A page-margin line with digits masked and spaces removed; null unless 3 to 160 characters remain."""
    key = F.regexp_replace(F.regexp_replace(x, r"\d+", "#"), r"\s+", "")
    return F.when(F.length(key).between(3, 160), key)


def is_heading(x: Column, kind: str) -> Column:
    """Whether a line is the heading of an abstract, an introduction or the references: marked with # or not, the last two numbered or not. Text may
    follow an abstract's or an introduction's heading, but not that of the references."""
    number = r"(?:(?:\d+|[ivxlcdm]+)[.)、]?\s*)?"
    rule = {"abstract": r"(?:abstract|摘要)\b.*", "introduction": rf"{number}(?:introduction|引言)\b.*", "references": rf"{number}(?:references?|bibliography|参考文献)\s*"}[kind]
    return F.coalesce(x, F.lit("")).rlike(rf"(?iU)^\s*(?:#{{1,6}}\s*)?{rule}$")


def caption_number(x: Column) -> Column:
    """The number of a figure or table caption, Arabic or Roman, in upper case; '' if there is none."""
    return F.upper(F.regexp_extract(F.coalesce(x, F.lit("")), r"(?i)^\s*(?:fig(?:ure)?|table)\.?\s*([0-9]+|[IVX]+)\b", 1))


def junk_fragment(x: Column) -> Column:
    """At most 20 characters and no letter."""
    t = collapsed(x)
    return (F.length(t) <= 20) & ~t.rlike(r"\p{L}")


def readable(x: Column, least: int = 3000, most_bad: float = 0.01) -> Column:
    """Long enough, and at most a hundredth of it replacement characters."""
    t = F.trim(F.coalesce(x, F.lit("")))
    bad = F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    return (F.length(t) >= least) & (bad / F.greatest(F.length(t), F.lit(1)) <= most_bad)


def content_flags(x: Column) -> list[Column]:
    """has_table, has_math, has_figure of Markdown."""
    return [x.rlike(r"(?m)^\|.*\|\s*$").alias("has_table"), x.rlike(r"\$\$|\\\(|\\\[").alias("has_math"), x.rlike(r"!\[[^\]]*\]\(|(?mi)^fig(ure)?\.? \d").alias("has_figure")]


def safe_name(x: Column, most: int = 160) -> Column:
    """Characters other than letters and digits of any script, `-`, `_` and `.` made `_`; `paper` if nothing is left."""
    name = F.substring(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}._-]", "_"), 1, most)
    return F.when(name == "", "paper").otherwise(name)


def inverted_index(words: Column) -> Column:
    """A map from each word of an array to its positions, from 0. Equal words stand together once the pairs are sorted, so each text is indexed where
    it lies; no word moves."""

    def entries(pairs: Column) -> Column:
        begins = F.filter(F.transform(pairs, lambda x, i: F.when((i == 0) | (x["w"] != F.get(pairs, i - 1)["w"]), i)), lambda i: i.isNotNull())
        return F.get(F.transform(F.array(begins), spans(pairs)), F.lit(0))

    def spans(pairs: Column):
        of = lambda b, e: F.struct(F.get(pairs, b)["w"].alias("w"), F.transform(F.slice(pairs, b + 1, e - b), lambda x: x["p"]).alias("ps"))
        return lambda begins: F.transform(begins, lambda b, k: of(b, F.coalesce(F.get(begins, k + 1), F.size(pairs))))

    pairs = F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    return F.map_from_entries(F.get(F.transform(F.array(pairs), entries), F.lit(0)))


def from_inverted_index(index: Column) -> Column:
    """The text of a map from word to positions: words by position; of several at one, the last word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.sort_array(pairs)  # by its own order: array_sort would evaluate a comparator
    return F.array_join(F.transform(ordered, lambda s: s["w"]), " ")


def lenient_json(x: Column, schema: str) -> Column:
    """An object from model output: code fences stripped, then the whole, then what the outermost braces hold."""
    bare = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(bare.startswith("{"), F.coalesce(F.from_json(bare, schema), F.from_json(inner, schema))).when(inner != "", F.from_json(inner, schema))


def resource_type(kind: Column) -> Column:
    """The letter of a reference's kind, by what words its type holds (fixed values): journal article if none."""
    t = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(t.contains("conference") | t.contains("proceedings"), "C").when(t.contains("thesis") | t.contains("dissertation"), "D")
        .when(t.contains("book"), "M").when(t.contains("arxiv") | t.contains("preprint"), "EB/OL").otherwise("J")
    )


def gbt_reference(
    authors: Column, title: Column, venue: Column, year: Column, doi: Column, volume: Column | None = None, issue: Column | None = None, pages: Column | None = None, kind: Column | None = None, url: Column | None = None
) -> Column:
    """A reference of a numbered list by GB/T 7714: of more than three authors three, then `et al`, or 等 after Chinese names; what is null or
    empty is left out; an address only without a DOI."""
    told = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) if c is not None else F.lit("")
    named = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit("")))), lambda a: a != "")
    more = F.when(F.get(named, F.lit(0)).rlike("[\u4e00-\u9fff]"), "，等").otherwise(", et al")
    names = F.concat(F.array_join(F.slice(named, 1, 3), ", "), F.when(F.size(named) > 3, more).otherwise(""))
    some = lambda before, c, after="": F.when(told(c) != "", F.concat(F.lit(before), told(c), F.lit(after))).otherwise("")
    place = F.when(told(volume) != "", F.concat(F.lit(", "), told(volume), some("(", issue, ")"))).otherwise(some(", (", issue, ")"))
    link = F.when(told(doi) != "", F.concat(F.lit(" DOI: "), told(doi), F.lit("."))).otherwise(some(" ", url, "."))
    return F.concat(F.when(names != "", F.concat(names, F.lit(". "))).otherwise(""), told(title), F.lit("["), resource_type(told(kind)), F.lit("]"), some(". ", venue), some(", ", F.substring(told(year), 1, 4)), place, some(": ", pages), F.lit("."), link)


def bibtex(key: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column) -> Column:
    """A BibTeX entry: an article if there is a venue, else misc."""
    line = lambda name, v: F.when(v != "", F.concat(F.lit(f"  {name} = {{"), v, F.lit("},\n"))).otherwise("")
    kind = F.when(venue != "", "article").otherwise("misc")
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), line("title", title), line("author", F.array_join(authors, " and ")), line("year", F.coalesce(year.cast("string"), F.lit(""))), line("journal", venue), line("doi", doi), F.lit("}"))


#: Characters that are mathematical: Greek, super- and subscripts, letter-like signs, arrays of arrows, operators and their supplements,
#: alphanumeric symbols; and single signs (fixed values).
MATH_RANGES = r"\x{0370}-\x{03FF}\x{2070}-\x{209F}\x{2100}-\x{214F}\x{2190}-\x{21FF}\x{2200}-\x{22FF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}\x{2A00}-\x{2AFF}\x{1D400}-\x{1D7FF}"
MATH_SIGNS = "±·×÷∓∗∘√∞∂∇‖−′″"


def math_share(x: Column) -> Column:
    """Share of a line's visible characters that are mathematical."""
    visible = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s", "")
    signs = F.length(visible) - F.length(F.regexp_replace(visible, f"[{MATH_RANGES}{MATH_SIGNS}]", ""))
    return F.when(F.length(visible) > 0, signs / F.length(visible)).otherwise(0.0)


def is_math_line(x: Column, least: int = 2, share: float = 0.5) -> Column:
    """At least two visible characters, half of them mathematical."""
    return (F.length(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s", "")) >= least) & (math_share(x) >= share)


def plain_title(x: Column) -> Column:
    """A title to ask for exactly: single spaces, no double quotes."""
    return collapsed(F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit("")))


#: What marks a part of an outline that isn't its body (fixed values).
NON_BODY = ("摘要", "abstract", "引言", "绪论", "introduction", "参考文献", "references", "bibliography")


def is_body_part(title: Column, description: Column) -> Column:
    """Whether neither title nor description of an outline's part has a mark of a part outside the body."""
    hay = F.lower(F.concat_ws(" ", title, description))
    return ~F.exists(F.array(*[F.lit(m) for m in NON_BODY]), lambda m: F.contains(hay, m))


def allowed_fields(x: Column, allowed: list[str]) -> Column:
    """Of a list of field names, those that are allowed, trimmed, each once, in order."""
    return F.array_distinct(F.filter(F.transform(x, lambda c: F.trim(c)), lambda c: c.isin(*allowed)))


def block_kind(x: Column) -> Column:
    """What a block of Markdown is: display_formula, table, figure, heading (one line, with a Roman or Arabic number), inline_formula or
    paragraph; empty without text."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")
    return (
        F.when(t == "", "empty").when(t.startswith("$$"), "display_formula").when(t.startswith("|"), "table").when(t.startswith("!["), "figure")
        .when(t.rlike(r"^(?:[IVXLC]{1,8}\.\s+\S|\d+\.\s+[A-Z])") & ~t.rlike(r"[\r\n]"), "heading").when(t.rlike(r"^\$[^$\n]+\$$"), "inline_formula").otherwise("paragraph")
    )


#: A sentence's end: after a Chinese full stop, exclamation or question mark; after a Latin one before white space or the end (fixed values).
SENTENCE_END = r"(?<=[。！？])|(?<=[.!?])(?=\s|$)"


def stripped(x: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")


def neighbour_snippet(x: Column, from_end: bool, sentences: int = 2, most: int = 240) -> Column:
    """The first or last sentences of a text, at most so many characters from that side."""
    parts = F.filter(F.transform(F.split(stripped(x), SENTENCE_END, -1), stripped), lambda s: s != "")
    chosen = F.slice(parts, F.greatest(F.size(parts) - sentences + 1, F.lit(1)), F.lit(sentences)) if from_end else F.slice(parts, 1, sentences)
    joined = F.array_join(chosen, " ")
    return stripped(F.when(F.length(joined) > most, F.right(joined, F.lit(most)) if from_end else F.left(joined, F.lit(most))).otherwise(joined))


#: The place of a chunk, in brackets or bare: an id, then :p0001 or :c0001, and perhaps :s0001 (fixed form).
PLACE = r":[pc]\d{4}(?::s\d{4})?"


def without_markers(x: Column) -> Column:
    """Without the places of chunks, as [1706.03762:p0001:s0003] or bare, and without the spaces before punctuation that they leave behind."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), rf"(?i)\[\s*[^\[\]]*{PLACE}\s*\]", "")
    bare = F.regexp_replace(bare, rf"(?iU)(?<![\w.])[\w.\-]+{PLACE}(?!\w)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[ \t]{2,}", " "), r" +([，。；、,.!！？])", "$1"), r"(?U)^\s+|\s+$", "")


def year_in(x: Column) -> Column:
    """The first year from 1900 to 2099 in a date or a line, or null."""
    y = F.regexp_extract(F.coalesce(x, F.lit("")), r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return F.when(y != "", y.cast("int"))


def collapsed_path(url: Column) -> Column:
    """A web address in which no preprint's id stands twice in a row between slashes; other repeated parts stay."""
    head = F.regexp_extract(url, r"^(.*?://)", 1)
    parts = F.split(F.substring(url, F.length(head) + 1, F.length(url)), "/", -1)
    id_ = lambda p: p.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$")
    kept = F.filter(parts, lambda p, i: (i == 0) | ~id_(p) | (p != F.get(parts, i - 1)))
    return F.concat(head, F.array_join(kept, "/"))


def resolved_url(base: Column, link: Column) -> Column:
    """A link as seen from a page: absolute ones stay, `//host` takes the scheme, `/path` the host, and others the folder;
    `./` and `../` are walked."""
    scheme, origin = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    whole = F.when(link.startswith("/"), link).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link))
    path = F.regexp_extract(whole, r"^([^?#]*)", 1)
    none = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).when(p == ".", acc).otherwise(F.array_append(acc, p))
    parts = F.split(F.substring(path, 2, F.length(path)), "/", -1)
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    walked = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, none, step), "/"))
    walked = F.when(walked == "/", walked).otherwise(F.concat(walked, ends))
    rest = F.substring(whole, F.length(path) + 1, F.length(whole))
    return F.when(link.rlike(r"^[a-zA-Z][\w+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).otherwise(F.concat(origin, walked, rest))


def page_text(x: Column) -> Column:
    """Text of a page without NUL, with line feeds only, no spaces at line ends, and no more than one empty line."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\\x00", ""), r"\r\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def noted_cut(x: Column, most: int) -> Column:
    """A tool's result as shown: cut, with its own length where it is cut."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("… ("), F.length(x).cast("string"), F.lit(" characters)"))).otherwise(x)


#: Text commands whose argument is their text, and escaped signs (fixed values).
LATEX_TEXT = ("textnormal", "textit", "textbf", "texttt", "textrm", "textsf", "textsc", "mbox", "text", "emph")
#: Mathematics between delimiters (fixed form).
LATEX_MATH = r"\$\$[\s\S]+?\$\$|\\\[[\s\S]+?\\\]|\\\([\s\S]+?\\\)|\$(?![\s$])(?:\\.|[^$\\])+?(?<![\s\\])\$"


def plain_latex(x: Column, depth: int = 4) -> Column:
    """Text without bare LaTeX: known text commands give their argument of one line, `depth` deep and up to 200 characters, \\href its label, or
    its address if that is empty, \\url its address, escaped signs themselves, a backslash and space after a full stop the space; mathematics between
    delimiters stays as it is, and so does all else. A text without a backslash is not touched."""
    words = "|".join(LATEX_TEXT)

    def clean(t: Column) -> Column:
        for _ in range(depth):
            t = F.regexp_replace(t, rf"\\(?:{words})(?![A-Za-z]) *\{{([^{{}}\n]{{0,200}})\}}", "$1")
        t = F.regexp_replace(t, r"\\href *\{([^{}]*)\} *\{\}", "$1")
        t = F.regexp_replace(t, r"\\href *\{[^{}]*\} *\{([^{}]*)\}", "$1")
        t = F.regexp_replace(t, r"\\url *\{([^{}]*)\}", "$1")
        return F.regexp_replace(F.regexp_replace(t, r"\\([%&_#])", "$1"), r"(?<=\.)\\ ", " ")

    t = F.coalesce(x, F.lit(""))
    both = F.arrays_zip(F.split(t, LATEX_MATH, -1).alias("text"), F.regexp_extract_all(t, F.lit(LATEX_MATH), F.lit(0)).alias("math"))
    parts = F.transform(both, lambda z: F.concat(clean(z["text"]), F.coalesce(z["math"], F.lit(""))))
    return F.when(F.contains(t, F.lit("\\")), F.array_join(parts, "")).otherwise(t)


def first_url(*choices: Column) -> Column:
    """The first choice that is a web address, or null; what isn't http or https is passed over."""
    return F.coalesce(*[F.when(F.trim(c).rlike(r"(?i)^https?://[^\s/]+"), F.trim(c)) for c in choices])
