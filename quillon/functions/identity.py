"""Identifiers of scholarly records as column expressions: DOIs, preprint numbers, title keys, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shape of preprint numbers, and the prefix of DOIs registered for them.
PREPRINT = r"^(\d{4}\.\d{4,5}(v\d+)?|[a-z-]+(\.[A-Z]{2})?/\d{7}(v\d+)?)$"
PREPRINT_DOI = "10.48550/arxiv."
#: Web addresses before a DOI, each at most once.
DOI_ADDRESS = r"(?:https://doi\.org/)?(?:http://doi\.org/)?(?:https://dx\.doi\.org/)?(?:http://dx\.doi\.org/)?"


def _filled(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def stripped(x: Column) -> Column:
    """Without Unicode white space at both ends; null is empty."""
    return F.regexp_replace(_filled(x), r"(?U)^\s+|\s+$", "")


def doi(x: Column) -> Column:
    """A DOI without its web address, in lower case; '' if there is none."""
    return F.lower(F.regexp_replace(stripped(x), f"^{DOI_ADDRESS}", ""))


def without_version(x: Column) -> Column:
    """A preprint number without its version."""
    return F.regexp_replace(stripped(x), r"v\d+$", "")


def title_key(x: Column) -> Column:
    """title:<lower-case words>, or '' without a word character."""
    bare = F.regexp_replace(F.lower(stripped(x)), r"(?U)[^\w\s]", "")
    bare = stripped(F.regexp_replace(bare, r"(?U)\s+", " "))
    return F.when(bare == "", "").otherwise(F.concat(F.lit("title:"), bare))


def doi_key_of(d: Column) -> Column:
    """doi:<doi> of a DOI in its plain form; a preprint's gives arxiv:<number>; '' without a DOI."""
    number = without_version(F.substring(d, len(PREPRINT_DOI) + 1, 10_000))
    own = F.when(number == "", "").otherwise(F.concat(F.lit("arxiv:"), number))
    return F.when(d == "", "").when(d.startswith(PREPRINT_DOI), own).otherwise(F.concat(F.lit("doi:"), d))


def doi_key(x: Column) -> Column:
    """`doi_key_of` a written DOI."""
    return doi_key_of(doi(x))


def wrapped_preprint(raw: Column) -> Column:
    """What an identifier without white space around it says of a preprint: behind `arxiv:`, or behind the DOI prefix of
    preprints (in lower case, as DOIs are), else the identifier itself."""
    marked = F.lower(raw).startswith("arxiv:")
    registered = F.regexp_extract(raw, f"(?s)^{DOI_ADDRESS}(?i:10\\.48550/arxiv\\.)(.*)$", 1)
    return F.when(marked, stripped(F.regexp_replace(raw, r"^[^:]*:", ""))).when(registered != "", F.lower(registered)).otherwise(raw)


def _numbered(inner: Column) -> Column:
    return F.when(inner.rlike(PREPRINT), F.concat(F.lit("arxiv:"), without_version(inner))).otherwise("")


def preprint_key(x: Column) -> Column:
    """arxiv:<number> if the identifier is, or wraps, a preprint number; else ''."""
    return _numbered(wrapped_preprint(stripped(x)))


def _first_filled(*options: Column) -> Column:
    return F.coalesce(*[F.when(o != "", o) for o in options], F.lit(""))


def paper_key(ids: list[Column], doi_: Column, title: Column, fallback: Column | None = None) -> Column:
    """The one key of a record: its DOI, else a preprint number among its ids, else its title; a record with none of
    them keeps the key `fallback`, so that it merges with no other."""
    key = _first_filled(doi_key(doi_), *[preprint_key(i) for i in ids], title_key(title))
    return key if fallback is None else F.when(key == "", fallback).otherwise(key)


def with_keys(records: DataFrame, ids: list[str], doi_col: str = "doi", title_col: str = "title", fallback: Column | None = None) -> DataFrame:
    """`records` with `key`, as `paper_key` makes it, and its parts doi_norm and title_key. Each part is computed once, in a
    projection of its own, so that no expression holds another's text several times."""
    raw = {f"raw_{c}": stripped(F.col(c)) for c in ids}
    first = records.withColumns({"doi_norm": doi(F.col(doi_col)), "title_key": title_key(F.col(title_col)), **raw})
    second = first.withColumns({"key_doi": doi_key_of(F.col("doi_norm")), **{c: wrapped_preprint(F.col(c)) for c in raw}})
    key = _first_filled(F.col("key_doi"), *[_numbered(F.col(c)) for c in raw], F.col("title_key"))
    third = second.withColumn("key", key)
    return (third if fallback is None else third.withColumn("key", F.when(F.col("key") == "", fallback).otherwise(F.col("key")))).drop("key_doi", *raw)


def aliases(ids: list[Column], doi_: Column, title: Column) -> Column:
    """Every name under which a record may be looked up, sorted."""
    raw = [stripped(x) for x in [*ids, doi_]]
    numbers = [F.when(r.rlike(PREPRINT), F.concat(F.lit("arxiv:"), without_version(r))).otherwise("") for r in raw]
    names = [paper_key(ids, doi_, title), doi_key(doi_), _first_filled(*[preprint_key(x) for x in [*ids, doi_]]), title_key(title), *raw, *[without_version(r) for r in raw], *numbers]
    return F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda x: x != "")))


def bare_citation(x: Column) -> Column:
    """A written reference without web address, `doi:`, `.pdf` and slashes around it."""
    out = stripped(x)
    for pattern in (r"(?i)^https?://(?:dx\.|www\.)?doi\.org/", r"(?i)^https?://arxiv\.org/(?:abs|pdf)/", r"(?i)\.pdf$", r"(?i)^doi:"):
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(out, r"^/+|/+$", "")


def citation_keys(x: Column) -> Column:
    """All spellings under which a written reference may match an identifier, sorted."""
    raw, bare = stripped(x), bare_citation(x)
    d = doi(bare)
    is_doi = d.startswith("10.") & d.contains("/")
    low = F.lower(bare)
    number = without_version(F.when(is_doi & d.startswith(PREPRINT_DOI), F.substring(d, len(PREPRINT_DOI) + 1, 10_000)).when(low.startswith("arxiv:"), F.regexp_replace(low, "^arxiv:", "")).when(low.rlike(PREPRINT), low).otherwise(""))
    named = [F.when(number != "", F.concat(F.lit(p), number)).otherwise("") for p in ("", "arxiv:", PREPRINT_DOI, "doi:" + PREPRINT_DOI)]
    work = F.regexp_extract(raw, r"(?i)openalex\.org/(W\d+)", 1)
    work = F.when(work != "", work).otherwise(F.regexp_extract(bare, r"(?i)^(W\d+)$", 1))
    hexes = F.regexp_extract(raw, r"(?i)semanticscholar\.org/paper/([a-f0-9]{40})", 1)
    hexes = F.lower(F.when(hexes != "", hexes).otherwise(F.regexp_extract(bare, r"(?i)^([a-f0-9]{40})$", 1)))
    names = [raw, F.lower(raw), bare, low, F.when(is_doi, d).otherwise(""), F.when(is_doi, F.concat(F.lit("doi:"), d)).otherwise(""), *named, work, F.upper(work), hexes]
    return F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda k: k != "")))


def year(x: Column) -> Column:
    """A positive whole year, or null for anything else."""
    n = F.trim(x.cast("string")).try_cast("int")
    return F.when(n > 0, n)


def external_ref(doi_: Column, preprint: Column, other: Column) -> Column:
    """The identifier to ask a provider for: DOI, else preprint number, else a numeric or W id."""
    return _first_filled(doi(doi_), without_version(preprint), F.when(_filled(other).rlike(r"^(\d+|[Ww]\d+)$"), _filled(other)).otherwise(""))
