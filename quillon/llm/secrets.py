"""Secret scans: fixed patterns, and Markov models of random strings and ordinary identifiers. DataFrame
operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_or_empty, unused
from quillon.llm.mixing import row_hash

#: The base patterns (fixed values), in the order in which their kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more characters: a shorter run holds no longer match
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more characters, for the same reason
KINDS = ("assign", "access", "hex", "markov")

#: What the Markov models read: their alphabet, and the strings that they judge and learn from.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
#: Least log-likelihood ratios (nats) of a candidate: for each transition and in all; for each transition of a string of
#: letters only or without letters, which more of ordinary text looks like.
LEAST_MEAN, LEAST_TOTAL, LEAST_MEAN_PLAIN = 0.5, 10.0, 0.9
#: The shortest rest of a candidate, outside the base spans that it overlaps, that is a span of its own.
LEAST_REST = 8
#: Documents, about, that the models learn from.
SAMPLE = 20_000

BLOCK = 256
SPAN = "struct<start:bigint,kind:int,end:bigint>"


def running(values: Column) -> Column:
    """Running sums of an array of longs, in blocks so that a long array costs little more than its length."""

    def sums(part: Column, start: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(
            part,
            F.struct(none.alias("all"), start.alias("s")),
            lambda acc, x: F.struct(F.array_append(acc["all"], acc["s"] + x).alias("all"), (acc["s"] + x).alias("s")),
            lambda acc: acc["all"],
        )

    blocks = F.sequence(F.lit(0), F.call_function("div", F.size(values) - 1, F.lit(BLOCK)).cast("int"))
    part = lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK))
    totals = F.transform(blocks, lambda i: F.aggregate(part(i), F.lit(0).cast("bigint"), lambda a, x: a + x))
    starts = sums(totals, F.lit(0).cast("bigint"))
    each = F.transform(F.arrays_zip(blocks.alias("i"), starts.alias("s"), totals.alias("t")), lambda z: sums(part(z["i"]), z["s"] - z["t"]))
    return F.when(F.size(values) > 0, F.flatten(each)).otherwise(F.array().cast("array<bigint>"))


def spans(text: Column, pattern: str, kind: int, good=None, gate: Column | None = None, inner: int | None = None) -> Column:
    """Places (code points, end exclusive) of a pattern's leftmost non-overlapping matches as an array of SPAN.

    The matches and the pieces between them alternate, so running sums of their lengths are the places. good: a
    condition on the match; others are dropped after matching. gate: a cheap condition that each text with a match
    meets. inner: a group that ends with the match, whose place is wanted instead.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Bound once through a one-element array, as each use inside a lambda would match again.
    both = F.transform(F.array(F.struct(found.alias("m"), F.split(text, pattern, -1).alias("p"))), lambda x: _placed(x["m"], x["p"], kind, good, inner and (lambda m: F.regexp_extract(m, pattern, inner))))
    some = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(some, F.flatten(both)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _placed(matches: Column, pieces: Column, kind: int, good, inner) -> Column:
    length = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))
    gaps = F.slice(length(pieces), F.lit(1), F.size(matches))
    ends = running(F.zip_with(gaps, length(matches), lambda g, m: g + m))
    made = F.zip_with(matches, ends, lambda m, e: F.struct((e - F.length(inner(m) if inner else m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("m")))
    kept = F.filter(made, lambda s: good(s["m"])) if good else made
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def base_spans(text: Column, values_only: bool = False) -> list[Column]:
    """Of each base kind, an array of SPAN; with `values_only`, of an assignment only what is assigned."""
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    lower = F.lower(text)
    named = F.contains(lower, F.lit("passw")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("api"))
    return [spans(text, ASSIGN, 0, long_value, named, 2 if values_only else None), spans(text, ACCESS, 1, gate=F.contains(text, F.lit("AKIA"))), spans(text, HEX, 2)]


def written(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined, by start, then kind, then end."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios, random string over ordinary identifier, of each transition in ALPHABET x ALPHABET.

    The labelled sample is about `sample` documents, by a hash of their id. What a base pattern finds there is
    labelled random, any other string of six or more characters of the alphabet ordinary. Transitions are counted in
    Spark and one is added to each count, so with nothing to learn from random strings are uniform; at most
    len(ALPHABET)**2 counts of each label come to the driver.
    """
    n = docs.count()
    share = min(1.0, sample / max(n, 1))
    text = text_or_empty(text_col)
    some = docs.where(row_hash(id_col) < F.lit(int(share * (1 << 60)))).select(text.alias("t"))
    values = F.concat(
        F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda m: F.length(m) >= 6),
        F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("t", F.lit(HEX), F.lit(0)),
    )
    cleaned = F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    labelled = some.select(F.explode(F.array(F.struct(F.lit(1).alias("y"), values.alias("s")), F.struct(F.lit(0).alias("y"), F.regexp_extract_all(cleaned, F.lit(ORDINARY), F.lit(0)).alias("s")))).alias("x"))
    strings = labelled.select("x.y", F.explode("x.s").alias("s")).groupBy("y", "s").agg(F.count("*").alias("n"))
    pairs = strings.where("length(s) > 1").select("y", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("pair"))
    inside = F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")
    counts = {(r["y"], r["pair"]): r["n"] for r in pairs.where(inside).groupBy("y", "pair").agg(F.sum("n").alias("n")).collect()}
    out = []
    for a in ALPHABET:
        total = [sum(counts.get((y, a + b), 0) for b in ALPHABET) + len(ALPHABET) for y in (0, 1)]
        out += [math.log((counts.get((1, a + b), 0) + 1) / total[1]) - math.log((counts.get((0, a + b), 0) + 1) / total[0]) for b in ALPHABET]
    return out


def looks_random(string: Column, ratios: list[float], least_total: float = LEAST_TOTAL) -> Column:
    """Whether a string is likelier under the model of random strings, in one pass over its characters."""
    k = len(ALPHABET)
    codes = {ord(c): i for i, c in enumerate(ALPHABET)}
    code = F.array(*[F.lit(codes.get(i, 0)) for i in range(128)])
    table = F.array(*[F.lit(x) for x in ratios])
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        now = F.element_at(code, F.ascii(c) + 1)
        return F.struct(now.alias("last"), F.when(acc["last"] < 0, acc["sum"]).otherwise(acc["sum"] + F.element_at(table, acc["last"] * k + now + 1)).alias("sum"))

    total = F.aggregate(F.split(string, ""), start, step, lambda acc: acc["sum"])
    least = F.when(string.rlike("[0-9]") & string.rlike("[A-Za-z]"), LEAST_MEAN).otherwise(LEAST_MEAN_PLAIN)
    enough = F.transform(F.array(total), lambda s: (s >= least_total) & (s >= least * (F.length(string) - 1)))
    return F.element_at(enough, 1)


def outside(found: Column, base: Column, text: Column, ratios: list[float]) -> Column:
    """Candidates (an array of SPAN) as they are, or, of one that overlaps base spans, the rests of LEAST_REST or more
    characters outside them that look random for each transition."""

    def rests(s: Column) -> Column:
        met = F.array_sort(F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        none = F.array().cast(f"array<{SPAN}>")
        gap = lambda a, b: F.struct(a.alias("start"), s["kind"].alias("kind"), b.alias("end"))
        cut = F.aggregate(
            met,
            F.struct(none.alias("all"), s["start"].alias("at")),
            lambda acc, b: F.struct(F.array_append(acc["all"], gap(acc["at"], b["start"])).alias("all"), F.greatest(acc["at"], b["end"]).alias("at")),
            lambda acc: F.array_append(acc["all"], gap(acc["at"], s["end"])),
        )
        inside = lambda r: text.substr((r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int"))
        good = F.filter(cut, lambda r: F.when(r["end"] - r["start"] >= LEAST_REST, looks_random(inside(r), ratios, 0.0)).otherwise(False))
        return F.when(F.size(met) == 0, F.array(s)).otherwise(good)

    return F.when(F.size(found) > 0, F.flatten(F.transform(found, rests))).otherwise(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans.

    The method adds, as kind `markov`, each string of 16 or more characters of the alphabet that looks random; of one
    that overlaps base spans, what lies outside them. Null and empty texts have no spans (the digest is that of the
    empty string); rows that repeat are scanned alike; an empty table gives no rows; other columns are ignored.
    """
    ratios = train(docs, id_col, text_col, sample)
    text = F.col("t")
    base = docs.select(F.col(id_col), text_or_empty(text_col).alias("t")).withColumns(dict(zip(("a", "k", "h"), base_spans(text), strict=True)))
    base = base.withColumn("b", F.concat("a", "k", "h"))
    base = base.withColumn("c", spans(text, CANDIDATE, 3, lambda m: looks_random(m, ratios)))
    return base.withColumn("r", outside(F.col("c"), F.col("b"), text, ratios)).select(
        id_col,
        *[F.size(c).cast("long").alias(f"n_{k}") for c, k in (("a", "assign"), ("k", "access"), ("h", "hex"))],
        F.sha2(written(F.col("b")), 256).alias("base_sha256"),
        written(F.concat("b", "r")).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", sample: int = SAMPLE) -> DataFrame:
    """`docs` with each secret that `scan` finds replaced by `mark` in the text, cut out by its span; of an assignment the
    name stays. Spans that overlap become one mark. Null stays null; an empty table gives no rows; other columns stay.
    """
    ratios = train(docs, id_col, text_col, sample)
    text = text_or_empty(text_col)
    names = {c: unused(docs, f"spans_{c}") for c in ("base", "found")}
    rows = docs.withColumns({names["base"]: F.concat(*base_spans(text, values_only=True))})
    rows = rows.withColumns({names["found"]: spans(text, CANDIDATE, 3, lambda m: looks_random(m, ratios))})
    every = F.array_sort(F.concat(names["base"], outside(F.col(names["found"]), F.col(names["base"]), text, ratios)))
    piece = lambda a, n: text.substr((a + 1).cast("int"), n.cast("int"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        out = F.when(apart, F.concat(acc["out"], piece(acc["at"], s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(every, start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(text).cast("bigint") - acc["at"])))
    return rows.withColumn(text_col, F.when(F.col(text_col).isNotNull(), clean)).drop(*names.values())
