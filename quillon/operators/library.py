"""The paper library and the session store as tables: matching, look-ups, selections, edits and appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import identity


def alias_hits(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """(wid, wyear, ord, id, year, strong): catalog records that share a name with a wanted one; strong: a name other
    than a title. Both: id, arxiv_id, doi, title, year; catalog: ord. One hash join on names, no pairs of tables."""
    names = lambda: F.explode(identity.aliases([F.col("id"), F.col("arxiv_id")], F.col("doi"), F.col("title"))).alias("name")
    asked = wanted.select(F.col("id").alias("wid"), F.col("year").alias("wyear"), names())
    known = catalog.select("ord", "id", "year", names())
    return asked.join(known, "name").groupBy("wid", "wyear", "ord", "id", "year").agg(F.bool_or(~F.startswith("name", F.lit("title:"))).alias("strong"))


def _named(records: DataFrame, *rest: Column) -> DataFrame:
    """A row for each name of a record: its digest, since a title may be a whole text, whether it is a strong one, and the columns given."""
    names = F.explode(identity.aliases([F.col("id"), F.col("arxiv_id")], F.col("doi"), F.col("title"))).alias("name")
    return records.select(names, *rest).select(F.unhex(F.sha2("name", 256)).alias("name"), (~F.startswith("name", F.lit("title:"))).alias("strong"), *records.select(*rest).columns)


def first_match(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """(wid, id): the first record in order that is the same paper: a strong name, or a title where not both years are
    known and different. Tables as for `alias_hits`, but no pairs of records that share a name: the first record of each name, and of each year of a
    title, is known before names meet."""
    year = lambda y: F.coalesce(F.col(y).cast("string"), F.lit("unknown"))
    known = _named(catalog, F.struct("ord", "id").alias("first"), F.col("year")).where("first.ord IS NOT NULL")
    known = known.select("name", F.explode(F.when(F.col("strong"), F.array(F.lit("any"))).otherwise(F.array(F.lit("any"), year("year")))).alias("at"), "first").groupBy("name", "at").agg(F.min("first").alias("first"))
    asked = _named(wanted, F.col("id").alias("wid"), F.col("year").alias("wyear"))
    asked = asked.select("wid", "name", F.explode(F.when(F.col("strong") | F.col("wyear").isNull(), F.array(F.lit("any"))).otherwise(F.array(year("wyear"), F.lit("unknown")))).alias("at"))
    return asked.join(known, ["name", "at"]).groupBy("wid").agg(F.min("first").alias("first")).select("wid", "first.id")


def best_hit(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """(wid, id): the first strong record, else the first that shares the title, unless both its year and the wanted one
    are known and differ. As in `first_match`, no pairs: each name meets its first record."""
    known = _named(catalog, F.struct("ord", "id", "year").alias("first")).where("first.ord IS NOT NULL").groupBy("name").agg(F.min("first").alias("first"))
    asked = _named(wanted, F.col("id").alias("wid"), F.col("year").alias("wyear"))
    pick = lambda on: F.min(F.when(on, F.col("first")))
    found = asked.join(known, "name").groupBy("wid", "wyear").agg(pick(F.col("strong")).alias("s"), pick(~F.col("strong")).alias("t"))
    other = F.when(F.col("wyear").isNull() | F.col("t.year").isNull() | (F.col("wyear") == F.col("t.year")), F.col("t.id"))
    return found.select("wid", F.coalesce("s.id", other).alias("id")).where("id IS NOT NULL")


def requested_split(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """`requested` with `found`: whether the key is known. Null is never known."""
    there = known.select(key).distinct().withColumn("found_there", F.lit(True))
    return requested.join(there, key, "left").withColumn("found", F.coalesce("found_there", F.lit(False))).drop("found_there")


def selected(requests: DataFrame, entries: DataFrame, request: str, ids: str, key: str) -> DataFrame:
    """The entries of each request's list of ids in the caller's order, `place` from 0; ids without an entry are left
    out, repeated ones repeat."""
    return requests.select(request, F.posexplode(ids).alias("place", key)).join(entries, key)


def first_of(requests: DataFrame, sources: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """`requests` with the value from the first source, in order, that has one for the key, and that source's name. A
    source has at most one row for a key."""
    out = requests
    for name, rows in sources.items():
        out = out.join(rows.select(key, F.col(value).alias(f"from_{name}")), key, "left")
    names = F.coalesce(*[F.when(F.col(f"from_{n}").isNotNull(), F.lit(n)) for n in sources])
    return out.withColumns({value: F.coalesce(*[F.col(f"from_{n}") for n in sources]), "origin": names}).drop(*[f"from_{n}" for n in sources])


def chunk_owner(refs: DataFrame, chunks: DataFrame, ref: str = "ref") -> DataFrame:
    """`refs` with paper_id: of the chunk with this id, else of the first chunk whose id is it but for the ending
    `:s<digits>`, else what stands before the first `:` or `#`; null without any."""
    short = chunks.select(F.regexp_replace("chunk_id", r":s\d+$", "").alias(ref), F.col("paper_id").alias("of_short")).groupBy(ref).agg(F.min("of_short").alias("of_short"))
    full = chunks.select(F.col("chunk_id").alias(ref), F.col("paper_id").alias("of_full")).groupBy(ref).agg(F.min("of_full").alias("of_full"))
    prefix = F.regexp_extract(ref, r"^([^:#]+)[:#]", 1)
    return refs.join(full, ref, "left").join(short, ref, "left").withColumn("paper_id", F.coalesce("of_full", "of_short", F.when(prefix != "", prefix))).drop("of_full", "of_short")


def mentions(figures: DataFrame, paragraphs: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, kind, number, place, paragraph): the first paragraphs of its document that name each figure or table by
    number. figures: doc_id, kind ("figure" or "table"), number; paragraphs: doc_id, pos, paragraph."""
    found = []
    for kind, pattern in (("figure", r"(?i)\bfig(?:ure|\.)?\s*(\d+)"), ("table", r"(?i)\btable\s*(\d+)")):
        numbers = F.array_distinct(F.regexp_extract_all("paragraph", F.lit(pattern), F.lit(1)))
        found.append(paragraphs.select("doc_id", "pos", "paragraph", F.lit(kind).alias("kind"), F.explode(F.transform(numbers, lambda x: x.try_cast("int"))).alias("number")))
    near = figures.select("doc_id", "kind", "number").distinct().join(found[0].unionByName(found[1]), ["doc_id", "kind", "number"])
    place = F.row_number().over(W.partitionBy("doc_id", "kind", "number").orderBy("pos"))
    return near.withColumn("place", place).where(F.col("place") <= most).select("doc_id", "kind", "number", "place", "paragraph")


def folded(figures: DataFrame, regions: DataFrame, key: Sequence[str]) -> DataFrame:
    """Regions with the caption of the figure of the same key, and new regions of figures without one (`made`). A key has
    at most one row on each side."""
    both = regions.withColumn("there", F.lit(True)).join(figures, list(key), "full_outer")
    return both.withColumn("made", F.col("there").isNull()).drop("there")


def assembled_turns(events: DataFrame, messages: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """Events with the turn that shows them: their own where a message has it, else the session's last; null for sessions
    without messages."""
    own = messages.select(session, turn).distinct().withColumn("has", F.lit(True))
    last = messages.groupBy(session).agg(F.max(turn).alias("last_turn"))
    shown = F.when(F.col("has"), F.col(turn)).otherwise(F.col("last_turn"))
    return events.join(own, [session, turn], "left").join(last, session, "left").withColumn("shown_in", shown).drop("has", "last_turn")


def newest(rows: DataFrame, by: list[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each group; ties go by the later columns of `order`."""
    place = F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("from_end", place).where(F.col("from_end") <= n)


def within_budget(rows: DataFrame, by: list[str], order: str, cost: Column, budget: int) -> DataFrame:
    """Rows of each group from the first on while their costs together keep to the budget, with `omitted`, how many
    rows of the group are left out."""
    upto = F.sum("budget_cost").over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("budget_cost", cost).withColumn("kept", upto <= budget)
    left_out = F.count_if(~F.col("kept")).over(W.partitionBy(by))
    return marked.withColumn("omitted", left_out).where("kept").drop("budget_cost", "kept")


def gap_groups(rows: DataFrame, by: list[str], order: str, gap: float) -> DataFrame:
    """`rows` with `run`: a new one starts where the distance to the row before is above `gap`."""
    w = W.partitionBy(by).orderBy(order)
    new = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return rows.withColumn("run_starts", F.coalesce(new, F.lit(0))).withColumn("run", F.sum("run_starts").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("run_starts")


def previous_sections(sections: DataFrame, by: str, order: str, content: str, recent: int, earlier: int, total: int, note: str = "…") -> DataFrame:
    """Sections as a prompt shows them: the last two cut to `recent` characters, others to `earlier`, then the oldest
    dropped until all keep to `total`; the last one always stays, cut to `total` if it alone is longer."""
    back = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    limit = F.when(F.col("back") <= 2, recent).otherwise(earlier)
    cut = lambda n: F.when(F.length(content) > n, F.concat(F.substring(F.col(content), F.lit(1), n), F.lit(note))).otherwise(F.col(content))
    shown = sections.withColumn("back", back).withColumn(content, cut(limit))
    size = F.sum(F.length(content)).over(W.partitionBy(by).orderBy("back").rowsBetween(W.unboundedPreceding, 0))
    kept = shown.withColumn("so_far", size).where((F.col("so_far") <= total) | (F.col("back") == 1))
    return kept.withColumn(content, cut(F.lit(total))).drop("so_far")


def merged_batches(batches: DataFrame, by: str, order: str, ids: str, field: str) -> DataFrame:
    """One row for each group of batches: the distinct ids in the order of their first batch and place, and the
    non-empty fields, each under its batch's number."""
    each = batches.select(by, F.col(order).alias("batch"), F.posexplode(ids).alias("place", "one"))
    first = each.groupBy(by, "one").agg(F.min(F.struct("batch", "place")).alias("at"))
    joined = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "one"))).alias("x")).select(by, F.col("x.one").alias(ids))
    label = F.struct(F.col(order).alias("batch"), F.format_string("【第%d批】%s", F.col(order), F.col(field)).alias("text"))
    texts = batches.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.trim(F.coalesce(field, F.lit(""))) != "", label))).alias("x"))
    return texts.join(joined, by, "left").select(by, F.coalesce(ids, F.array().cast("array<string>")).alias(ids), F.array_join("x.text", "\n").alias(field))


def first_spellings(values: Column) -> Column:
    """Distinct non-empty strings, trimmed and compared without case, each as first spelt, in order."""
    clean = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    lower = F.transform(clean, lambda x: F.lower(x))
    both = F.arrays_zip(clean.alias("x"), lower.alias("l"))
    return F.transform(F.filter(both, lambda z, i: F.array_position(lower, z["l"]) == i + 1), lambda z: z["x"])


def appended(old: DataFrame, new: DataFrame, by: str, key: str, order: str, seq: str = "seq_no") -> DataFrame:
    """`old` and the rows of `new` that it lacks (by `key`), numbered on from each group's last sequence number. Writing
    the result twice changes nothing."""
    last = old.groupBy(by).agg(F.max(seq).alias("last_seq"))
    fresh = new.join(old.select(key), key, "left_anti").dropDuplicates([key])
    number = F.row_number().over(W.partitionBy(by).orderBy(order, key))
    fresh = fresh.join(last, by, "left").withColumn(seq, (F.coalesce("last_seq", F.lit(0)) + number).cast(old.schema[seq].dataType)).drop("last_seq")
    return old.unionByName(fresh.select(old.columns))


def with_summaries(sessions: DataFrame, messages: DataFrame, session: str, order: str, role: str, content: str, most: int = 120) -> DataFrame:
    """Sessions with `summary`, the start of their last message with text (one line, at most `most` characters), and
    `n_messages`; sessions without messages keep null and 0."""
    text = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "))
    told = text != ""
    last = messages.groupBy(session).agg(F.max_by(F.when(told, F.substring(text, 1, most)), F.when(told, F.col(order))).alias("summary"), F.count("*").alias("n_messages"))
    return sessions.join(last, session, "left").fillna(0, ["n_messages"])


def patched(rows: DataFrame, patches: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """`rows` with the non-null fields of the patch of their key; patches without a row do nothing. A key has at most one
    patch."""
    p = patches.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    return rows.join(p, key, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in fields}).drop(*[f"new_{c}" for c in fields])


def purged(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Library rows with `cached` set to whether their files are still there, and the fields that need them emptied: a
    missing report sends `status` back from deep_read to evaluated, or to new without a score."""
    there = requested_split(rows, present, key).withColumnRenamed("found", "cached")
    back = F.when(F.col("score").isNotNull(), "evaluated").otherwise("new")
    return there.withColumn("status", F.when(~F.col("cached") & (F.col("status") == "deep_read"), back).otherwise(F.col("status")))


def status(has_report: Column, score: Column) -> Column:
    """deep_read with a report, else evaluated with a score, else new."""
    return F.when(F.coalesce(has_report, F.lit(False)), "deep_read").when(score.isNotNull(), "evaluated").otherwise("new")


def tool_failed(error: Column, state: Column) -> Column:
    """Whether a call's record says that it failed: an error text, or a failing status."""
    return (F.coalesce(error, F.lit("")) != "") | F.coalesce(state.isin("failed", "download_failed"), F.lit(False))


def panel(rows: DataFrame, state: str | None = None, source: str | None = None, starred: bool | None = None, query: str = "", sort: str = "added") -> DataFrame:
    """The library panel: rows that meet every given filter (the query is looked for in the title and the joined authors,
    in either case), by score, year or time added, newest and highest first; ties by id."""
    out = rows
    if state is not None:
        out = out.where(F.col("status") == state)
    if source is not None:
        out = out.where(F.array_contains("sources", source))
    if starred is not None:
        out = out.where(F.coalesce("starred", F.lit(False)) == starred)
    if query.strip():
        hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join("authors", " ")))
        out = out.where(hay.contains(query.strip().lower()))
    order = {"score": F.desc(F.coalesce("score", F.lit(-1))), "year": F.desc(F.coalesce("year", F.lit(0))), "added": F.desc("added_at")}[sort]
    return out.orderBy(order, "id")


def usable_chunks(chunks: DataFrame, paper: str, content: str, version: str, current: int, most: int = 4000) -> DataFrame:
    """(paper, usable): whether a paper's stored chunks are of the current version, not empty, and none too long."""
    return chunks.groupBy(paper).agg((F.bool_and(F.length(content) <= most) & (F.max(version) == current) & (F.min(version) == current) & (F.count("*") > 0)).alias("usable"))


def suite(cases: DataFrame, assertions: DataFrame) -> DataFrame:
    """An end-to-end run in one row: cases, completed share, share of assertions that hold (each counts once), and means
    of the judged scores over cases that have them. cases: case_id, completed, score; assertions: case_id, name, holds."""
    c = cases.agg(F.count("*").alias("cases"), F.avg(F.col("completed").cast("int")).alias("completed_rate"), F.avg("score").alias("score"))
    a = assertions.join(cases.select("case_id"), "case_id", "left_semi").agg(F.count("*").alias("assertions"), F.avg(F.col("holds").cast("int")).alias("assertion_rate"))
    return c.join(F.broadcast(a))  # one row each


def assertions(cases: DataFrame, checks: dict[str, Column], by: str = "case_id") -> DataFrame:
    """(case_id, name, holds): a row for each check of each case; a check that is null doesn't apply and has none."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.alias("holds")) for k, c in checks.items()])).alias("x")
    return cases.select(by, each).select(by, "x.name", "x.holds").where("holds IS NOT NULL")


def faithfulness(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """(case_id, faithfulness, claims): the mean of the claims' scores from 1 to 5; a claim that cites an unknown paper
    has 1, one without a valid score doesn't count. claims: case_id, paper_id, score."""
    known = requested_split(claims, papers, "paper_id")
    score = F.when(~F.col("found"), F.lit(1.0)).when(F.col("score").between(1, 5), F.col("score").cast("double"))
    return known.withColumn("valid", score).groupBy("case_id").agg(F.avg("valid").alias("faithfulness"), F.count("valid").alias("claims"))


def costs(usage: DataFrame, prices: DataFrame, fallback: tuple[float, float]) -> DataFrame:
    """`usage` (model, input, output tokens) with `cost`, by the model's prices for a million tokens, else the fallback's,
    to four places. prices: model, input_price, output_price; a model has one row."""
    priced = usage.join(prices, "model", "left")
    cost = (F.col("input") * F.coalesce("input_price", F.lit(fallback[0])) + F.col("output") * F.coalesce("output_price", F.lit(fallback[1]))) / 1e6
    return priced.withColumn("cost", F.round(cost, 4)).drop("input_price", "output_price")


def chars_per_token(rounds: DataFrame, by: str) -> DataFrame:
    """(by, ratio): characters sent over tokens billed, to three places, where it lies from 1 to 100; else null."""
    ratio = F.round(F.try_divide(F.sum("chars"), F.sum("prompt_tokens")), 3)
    return rounds.groupBy(by).agg(ratio.alias("ratio")).withColumn("ratio", F.when(F.col("ratio").between(1, 100), F.col("ratio")))


def renumbered(docs: DataFrame, numbers: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text) with each bracketed reference that has a number replaced by `[number]`, and the others taken out with
    the space before them; links `[x](y)` stay. numbers: doc, ref, number. Pieces between brackets are put together in
    order, so no text is replaced inside another."""
    mark = r"\[[^\[\]]+\](?!\()"
    parts = docs.select(doc, F.split(F.coalesce(text, F.lit("")), mark, -1).alias("plain"), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(mark), F.lit(0)).alias("refs"))
    names = numbers.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("ref", F.col("number").cast("string")))).alias("names"))
    both = parts.join(names, doc, "left")
    inner = lambda r: F.substring(r, F.lit(2), F.length(r) - 2)
    number = lambda r: F.try_element_at("names", inner(r))
    piece = lambda p, i: F.when(i == F.size("refs"), p).when(number(F.get("refs", i)).isNotNull(), F.concat(p, F.lit("["), number(F.get("refs", i)), F.lit("]"))).otherwise(F.regexp_replace(p, " $", ""))
    return both.select(doc, F.array_join(F.transform("plain", piece), "").alias(text))


def outline_tasks(outlines: DataFrame, key: str, outline: str) -> DataFrame:
    """A row for each part of an outline, in order: key, chapter, section, place (from 1). outline: an array of structs
    (title, parts), parts an array of titles; chapters without parts are a task themselves."""
    chapters = outlines.select(key, F.posexplode(outline).alias("c", "x"))
    each = chapters.select(key, "c", F.col("x.title").alias("chapter"), F.posexplode_outer("x.parts").alias("s", "section"))
    place = F.row_number().over(W.partitionBy(key).orderBy("c", F.coalesce("s", F.lit(0))))
    return each.select(key, "chapter", "section", place.alias("place"))


def final_markdown(sections: DataFrame, key: str, order: str, title: str, content: str, head: Column) -> DataFrame:
    """(key, markdown): a head, and each non-empty section under its title, in order."""
    some = sections.withColumn("head", head).withColumn("told", F.trim(F.coalesce(content, F.lit(""))))
    part = F.when(F.col("told") != "", F.struct(F.col(order).alias("o"), F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col("told")).alias("t")))
    found = some.groupBy(key).agg(F.min("head").alias("head"), F.array_sort(F.collect_list(part)).alias("x"))
    return found.select(key, F.array_join(F.concat(F.array("head"), F.col("x.t")), "\n\n").alias("markdown"))


#: What stands for a call's row that no answer came to and that says nothing itself (fixed value).
INTERRUPTED = "（这轮的工具调用被中断，未取得结果；如有需要请重新调用对应工具。）"


def call_pairs(messages: DataFrame, by: str, order: str) -> DataFrame:
    """A conversation's rows as a provider accepts them: (by, order, role, call_ids, call_id, content). role, call_ids (of an assistant's row),
    call_id (of a tool's row).

    Of an assistant's calls those stay that any row answers; without any left it is a plain row with its text, or with a note if it has none. A
    tool's row stays, as do repeated answers, if an earlier assistant's row keeps a call of its id.
    """
    answered = messages.where("role = 'tool'").select(by, F.coalesce("call_id", F.lit("")).alias("_call")).distinct()
    calls = messages.where("role = 'assistant'").select(by, order, F.explode("call_ids").alias("_call")).join(answered, [by, "_call"], "left_semi")
    first = calls.groupBy(by, "_call").agg(F.min(order).alias("_asked"))
    have = calls.groupBy(by, order).agg(F.collect_set("_call").alias("_have"))
    rows = messages.join(have, [by, order], "left").withColumn("_call", F.when(F.col("role") == "tool", F.coalesce("call_id", F.lit("")))).join(first, [by, "_call"], "left")
    is_call = (F.col("role") == "assistant") & (F.size("call_ids") > 0)
    kept = F.when(is_call, F.filter("call_ids", lambda c: F.coalesce(F.array_contains("_have", c), F.lit(False)))).otherwise(F.col("call_ids"))
    plain = F.trim(F.coalesce("content", F.lit("")))
    told = F.when(is_call & (F.size(kept) == 0), F.when(plain != "", plain).otherwise(INTERRUPTED)).otherwise(F.col("content"))
    fits = (F.col("role") != "tool") | (F.col("_asked") < F.col(order))
    return rows.where(F.coalesce(fits, F.lit(False))).select(by, order, "role", kept.alias("call_ids"), "call_id", told.alias("content"))
