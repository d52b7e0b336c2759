"""Search over scholarly records: predicates, entity resolution, rank fusion, ranking, relaxation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import identity
from quillon.operators.ranks import with_rank

#: Rank fusion adds 1 / (RRF_K + rank) (fixed value).
RRF_K = 60
#: How many times the wanted rows each source is asked for.
OVER_FETCH = 3


def within_years(year: Column, low: int | None = None, high: int | None = None) -> Column:
    """In the range; a record without a year passes."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (year >= low)
    if high is not None:
        ok = ok & (year <= high)
    return year.isNull() | ok


def haystack(title: Column, abstract: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))


def _once(value: Column, made) -> Column:
    """made(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _any(text: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, t: a | text.contains(t.lower()), [t for t in terms if t], F.lit(False))


def _every(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    return reduce(lambda a, g: a & _any(text, g), groups, F.lit(True))


def excludes(title: Column, abstract: Column, terms: Sequence[str]) -> Column:
    """None of the terms occurs in title or abstract, in either case."""
    return _once(haystack(title, abstract), lambda h: ~_any(h, terms))


def matches(title: Column, abstract: Column, groups: Sequence[Sequence[str]], excluded: Sequence[str] = ()) -> Column:
    """Every group has a term that occurs, and none of `excluded` does."""
    return _once(haystack(title, abstract), lambda h: ~_any(h, excluded) & _every(h, groups))


def concept_hits(title: Column, abstract: Column, groups: Sequence[Sequence[str]]) -> Column:
    """How many groups have a term that occurs."""
    return _once(haystack(title, abstract), lambda h: reduce(lambda a, g: a + _any(h, g).cast("int"), groups, F.lit(0)))


def rendered(groups: Sequence[Sequence[str]], excluded: Sequence[str] = ()) -> str:
    """The query as text: OR inside groups, AND between them, phrases quoted."""
    quote = lambda t: f'"{t}"' if " " in t or "-" in t else t
    parts = [f"({' OR '.join(map(quote, g))})" for g in groups if g]
    return " AND ".join(parts) + "".join(f" NOT {quote(t)}" for t in excluded)


def federated(sources: dict[str, DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """UNION ALL of the named sources (all without names); unknown names are skipped."""
    chosen = [sources[n] for n in (names or sources) if n in sources]
    if not chosen:
        raise ValueError("no valid source selected")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)


def merged_duplicates(papers: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """One row per key: the record with most citations (the first of equal ones), the sorted sources, the first place,
    and identifiers and links filled in from the others."""
    own = F.struct(*papers.columns)
    rank = F.struct(F.coalesce("cited_by", F.lit(0)), -F.col(order))
    fill = lambda c: F.min_by(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)), F.when(F.coalesce(c, F.lit("")) != "", F.col(order)))
    grouped = papers.groupBy(key).agg(
        F.max_by(own, rank).alias("best"),
        F.array_sort(F.collect_set(F.when(F.coalesce("source", F.lit("")) != "", F.col("source")))).alias("sources"),
        F.min(order).alias("first_ord"),
        fill("arxiv_id").alias("first_arxiv"),
        fill("pdf_url").alias("first_pdf"),
    )
    return grouped.select(
        key, "sources", "first_ord",
        *[F.col(f"best.{c}") for c in papers.columns if c not in (key, "source", "arxiv_id", "pdf_url")],
        F.coalesce("first_arxiv", F.lit("")).alias("arxiv_id"),
        F.coalesce(F.when(F.coalesce("best.pdf_url", F.lit("")) != "", F.col("best.pdf_url")), "first_pdf", F.lit("")).alias("pdf_url"),
    )


def fused_ranks(papers: DataFrame, key: str = "key", source: str = "source", order: str = "ord") -> DataFrame:
    """(key, rrf): the sum over each record's rank in its source's list."""
    ranked = with_rank(papers.select(key, source, order), [source], order)
    return ranked.groupBy(key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"))


#: What `search` carries of a record besides its key; texts stay where they are.
CARRIED = ("ord", "source", "id", "cited_by", "year", "arxiv_id", "pdf_url")


def search(papers: DataFrame, groups: Sequence[Sequence[str]], limit: int | None, year_from: int | None = None, year_to: int | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """Filter, fuse, merge, rank: by fused rank, number of sources, concept hits, citations, year, then first place.

    The result has key, the columns of CARRIED, rrf, n_sources and hits; `id` finds a record's other columns. Hits are
    those of the record that stands for its key."""
    fit = papers.where(within_years(F.col("year"), year_from, year_to) & matches(F.col("title"), F.col("abstract"), groups, excluded))
    narrow = fit.select("key", *CARRIED, concept_hits(F.col("title"), F.col("abstract"), groups).alias("hits"))
    ranked = merged_duplicates(narrow).join(fused_ranks(fit), "key").withColumn("n_sources", F.size("sources"))
    ordered = ranked.orderBy(F.desc("rrf"), F.desc("n_sources"), F.desc("hits"), F.desc(F.coalesce("cited_by", F.lit(0))), F.desc(F.coalesce("year", F.lit(0))), "first_ord")
    return ordered.limit(limit) if limit is not None else ordered


def relaxed_search(papers: DataFrame, groups: Sequence[Sequence[str]], enough: int = 3, most_drops: int = 2) -> DataFrame:
    """Rows of the strictest query that finds `enough`: the last group is dropped, at most `most_drops` times. All
    variants are counted in one scan; column `dropped` says which one holds."""
    drops = range(min(most_drops, max(len(groups) - 1, 0)) + 1)
    title, abstract = F.col("title"), F.col("abstract")
    marked = papers.withColumn("_fits", F.array(*[matches(title, abstract, groups[: len(groups) - d]) for d in drops]))
    counts = marked.agg(*[F.count_if(F.col("_fits")[d]).alias(f"c{d}") for d in drops])
    pick = F.lit(drops[-1])
    for d in reversed(drops):
        pick = F.when(F.col(f"c{d}") >= enough, d).otherwise(pick)
    chosen = counts.select(pick.alias("dropped"))  # one row
    return marked.join(F.broadcast(chosen), F.element_at("_fits", F.col("dropped") + 1)).drop("_fits")


def duplicate_violations(papers: DataFrame, id_col: str = "id") -> DataFrame:
    """(kind, value, ids): identifiers or titles that more than one record has."""
    kinds = {"doi": identity.doi(F.col("doi")), "arxiv": identity.without_version(F.col("arxiv_id")), "title": identity.title_key(F.col("title"))}
    each = reduce(DataFrame.unionByName, [papers.select(F.lit(k).alias("kind"), v.alias("value"), id_col, "ord") for k, v in kinds.items()])
    found = each.where("value <> ''").groupBy("kind", "value").agg(F.array_sort(F.collect_list(F.struct("ord", id_col))).alias("x"))
    return found.where(F.size("x") > 1).select("kind", "value", F.col(f"x.{id_col}").alias("ids"))


def resolved_aliases(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ref, key): for each written reference, the first record that any of its spellings names."""
    names = papers.select("key", "ord", F.explode(identity.aliases([F.col("id"), F.col("arxiv_id")], F.col("doi"), F.col("title"))).alias("name")).where("NOT startswith(name, 'title:')")
    # A name is written in many ways by many records: each way is worked out once.
    firsts = names.groupBy("name").agg(F.min(F.struct("ord", "key")).alias("first"))
    table = firsts.select("first", F.explode(identity.citation_keys(F.col("name"))).alias("spelling"))
    refs = wanted.select("ref").distinct()
    asked = refs.select("ref", F.explode(identity.citation_keys(F.col("ref"))).alias("spelling"))
    hits = table.join(asked, "spelling").groupBy("ref").agg(F.min("first").alias("first")).select("ref", "first.key")
    return refs.join(hits, "ref", "left")


def expanded(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, node, hop): records within `hops` citation steps of each seed, by the fewest steps."""
    reach = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    front = reach
    for h in range(1, hops + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("seed", F.col("dst").alias("node"), F.lit(h).alias("hop")).distinct()
        front = step.join(reach.select("seed", "node"), ["seed", "node"], "left_anti")
        reach = reach.unionByName(front)
    return reach.where("hop > 0")


def upserted(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Old and new rows by key: what is filled stays, what is empty is filled in; `is_new` marks inserts."""
    kept = [F.coalesce(F.when(F.coalesce(F.col(f"o.{c}").cast("string"), F.lit("")) != "", F.col(f"o.{c}")), F.col(f"n.{c}")).alias(c) for c in fields]
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    marked = both.withColumn("is_new", ~F.coalesce(F.col("o._there"), F.lit(False))) if "_there" in old.columns else both
    return marked.select(key, *kept, *(["is_new"] if "_there" in old.columns else []))
