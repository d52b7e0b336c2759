"""Values of any nesting, numbers that skip used ones, and reports with nested blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import eventlog
from quillon.operators.ranks import percentiles
from quillon.shared import shared_folder

#: Keys whose value is an id, and keys whose value is a list of ids (fixed values).
ID_KEYS, LIST_KEYS = ("paperId", "paper_id"), ("paperIds", "paper_ids")


def nested_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, path, name, list_name, value): every value inside a variant, however deep, with its path as numbers, its field's name, and the name of the
    field that holds the list it stands in. Each round of the recursion opens one level of all rows at once."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # rows are bounded by the values there are
    return spark.sql(
        """WITH RECURSIVE r AS (
             SELECT id, array(0) AS path, '' AS name, '' AS list_name, v FROM {given}
             UNION ALL
             SELECT r.id, concat(r.path, array(e.pos)), coalesce(e.key, ''), CASE WHEN e.key IS NULL THEN r.name ELSE '' END, e.value FROM r, LATERAL variant_explode(r.v) AS e)
           SELECT id, path, name, list_name, v FROM r""",
        given=rows.select(F.col(key).alias("id"), F.col(value).alias("v")),
    ).select(F.col("id").alias(key), "path", "name", "list_name", F.col("v").alias("value"))


def ids_in(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ids): the ids inside a variant: of a field named for one, of a list named for some, and what stands in square brackets in any
    other text; trimmed, without quotes at the ends, each once in whatever case, in order. Fields of one object are in the order of their names.
    A null value, or one without ids, has an empty list."""
    found = nested_values(rows, key, value)
    text = F.coalesce(F.try_variant_get("value", "$", "string"), F.lit(""))
    scalar = ~F.coalesce(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"), F.lit(True))
    one = F.col("name").isin(*ID_KEYS) | F.col("name").isin(*LIST_KEYS) | F.col("list_name").isin(*LIST_KEYS)
    whole = F.schema_of_variant("value") == "STRING"
    candidates = F.when(scalar & one, F.array(text)).when(whole, F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), '^"+|"+$', ""), "^'+|'+$", ""))
    here = F.transform(candidates, lambda c, at: F.struct(F.lower(clean(c)).alias("fold"), F.col("path"), at.alias("at"), clean(c).alias("id")))
    lists = found.select(key, F.filter(here, lambda x: x["id"] != "").alias("here")).groupBy(key).agg(F.collect_list(F.when(F.size("here") > 0, F.col("here"))).alias("all"))
    # the value itself is one of those found, so every key has a row; its ids come together once, and equal ones stand together once sorted
    firsts = F.get(F.transform(F.array(F.sort_array(F.flatten("all"))), lambda x: F.filter(x, lambda y, k: (k == 0) | (y["fold"] != F.get(x, k - 1)["fold"]))), F.lit(0))
    ordered = F.sort_array(F.transform(firsts, lambda x: F.struct(x["path"].alias("path"), x["at"].alias("at"), x["id"].alias("id"))))
    return lists.select(key, F.transform(ordered, lambda x: x["id"]).alias("ids"))


def figure_numbers(figures: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """`key`, `order` and `figure`: the number of a figure's caption, unless the caption has none or it is used before; then the first free one from
    the figure's place on. No number stands twice; a document's figures are one fold over their array."""
    entry = F.struct(F.col(order).alias("o"), F.col(number).cast("int").alias("n"))
    grouped = figures.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    start = F.array().cast("array<int>")

    def step(used: Column, f: Column) -> Column:
        place = F.size(used) + 1
        free = F.array_min(F.filter(F.sequence(place, place + F.size(used)), lambda c: ~F.array_contains(used, c)))
        return F.array_append(used, F.when(f["n"].isNotNull() & ~F.array_contains(used, f["n"]), f["n"]).otherwise(free))

    numbered = grouped.select(key, F.explode(F.arrays_zip(F.col("x.o").alias("o"), F.aggregate("x", start, step).alias("figure"))).alias("z"))
    return numbered.select(key, F.col("z.o").alias(order), F.col("z.figure").alias("figure"))


def reliability(log: DataFrame, end_type: str, eval_prefix: str = "eval_") -> DataFrame:
    """The reliability report, one row: turns, statuses (a map), traffic and days (lists of a name, a status and its turns), completed_rate, cancelled_rate, duration_p50,
    duration_p95, stages (name, calls, failed, failure_rate, p95, errors), success. log: session_id, title, turn, seq_no, ts, event_type, status, stage, step_key,
    content, created, completed.

    The log is read once, into a narrow row for each turn that holds the turn's steps; all blocks come from these. Counts of statuses by
    day, by traffic and in all are one aggregation over grouping sets; percentiles come from histograms, not from sorted groups. Blocks are as
    large as there are days, statuses and stages. An empty log gives 0 turns, empty blocks and null rates."""
    spark = log.sparkSession
    end = F.col("event_type") == end_type
    is_step = ~end & (F.coalesce("stage", F.lit("")) != "") & (F.coalesce("step_key", F.lit("")) != "")
    fields = ("seq_no", "stage", "step_key", "status", "content", "created", "completed")
    per_turn = log.groupBy("session_id", "turn").agg(
        F.min_by("ts", "seq_no").alias("started"),
        F.min_by(F.when(end, F.col("ts")), F.when(end, F.col("seq_no"))).alias("ended"),
        F.min_by(F.when(end, F.col("status")), F.when(end, F.col("seq_no"))).alias("status"),
        F.max("title").alias("title"),
        F.collect_list(F.when(is_step, F.struct(*fields))).alias("steps"),
    )
    at = f"{shared_folder(spark)}/quillon-report-{uuid.uuid4().hex}"
    per_turn.write.parquet(at)
    kept = spark.read.schema(per_turn.schema).parquet(at)
    ended = kept.where("ended IS NOT NULL").select(
        "session_id", "turn", F.coalesce("status", F.lit("unknown")).alias("status"), F.to_date("ended").cast("string").alias("day"),
        F.when(F.coalesce(F.startswith("title", F.lit(eval_prefix)), F.lit(False)), "eval").otherwise("real").alias("traffic"), eventlog.seconds_between(F.col("started"), F.col("ended")).alias("duration"),
    )
    sets = ended.groupingSets([["status"], ["status", "day"], ["status", "traffic"]], "status", "day", "traffic").agg(F.count("*").alias("turns"), F.grouping("day").alias("no_day"), F.grouping("traffic").alias("no_traffic"))
    block = lambda when, name: F.array_sort(F.collect_list(F.when(when, F.struct(F.col(name).alias("name"), "status", "turns"))))
    overall = (F.col("no_day") == 1) & (F.col("no_traffic") == 1)
    share = lambda s: F.try_divide(F.sum(F.when(overall & (F.col("status") == s), F.col("turns")).otherwise(0)), F.sum(F.when(overall, F.col("turns"))))
    counts = sets.agg(
        F.coalesce(F.sum(F.when(overall, F.col("turns"))), F.lit(0)).alias("turns"), F.map_from_entries(F.array_sort(F.collect_list(F.when(overall, F.struct("status", "turns"))))).alias("statuses"),
        block(F.col("no_traffic") == 0, "traffic").alias("traffic"), block(F.col("no_day") == 0, "day").alias("days"), share("completed").alias("completed_rate"), share("cancelled").alias("cancelled_rate"),
    )
    times = percentiles(ended, [], {"duration_p50": ("duration", 0.5, "linear"), "duration_p95": ("duration", 0.95, "linear")})
    steps = eventlog.steps(kept.select("session_id", "turn", F.explode("steps").alias("s")).select("session_id", "turn", "s.*"))
    stats = eventlog.stage_stats(steps).select("stage", "calls", "failed", "failure_rate", F.col("duration_p95").alias("p95"))
    errors = eventlog.top_errors(steps).groupBy(F.col("stage").alias("_stage")).agg(F.array_sort(F.collect_list(F.struct("place", "error", "times"))).alias("errors"))
    full = stats.join(errors, F.col("stage") == F.col("_stage"), "left").select("stage", "calls", "failed", "failure_rate", "p95", F.coalesce("errors", F.array().cast("array<struct<place:int,error:string,times:bigint>>")).alias("errors"))
    stages = full.agg(F.array_sort(F.collect_list(F.struct("stage", "calls", "failed", "failure_rate", "p95", "errors"))).alias("stages"), (1 - F.try_divide(F.sum("failed"), F.sum("calls"))).alias("success"))
    both = counts.join(F.broadcast(times), F.lit(True), "left").join(F.broadcast(stages), F.lit(True), "left")  # one row each
    return both.fillna(0.0, ["duration_p50", "duration_p95"])
