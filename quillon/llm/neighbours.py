"""Approximate nearest neighbours by cosine: a forest of random-projection trees whose queue is shared by all trees, and exact
scores of all that its leaves hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import forest as forests
from quillon.llm.common import checked_broadcast, ship_package, stored
from quillon.llm.vectors import matrix, usable

#: Trees, and rows of the table that a leaf is to hold.
TREES, LEAF = 4, 128
#: Bounds of the sample that the trees are fit on, and the fewest sampled rows of a leaf.
SAMPLE, SAMPLE_BYTES, LEAST_SAMPLED = 65_536, 24_000_000, 8
#: Queries that set the number of visits, and the recall aimed at.
PILOTS, RECALL = 192, 0.97
#: Rows of the members of one shard of leaves, and queries that one task compares with them.
SHARD_ROWS, SHARD_QUERIES = 4096, 2048
#: A score from a matrix product is this near to the exact one at least.
SLACK = 1e-12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest entry, so that nothing overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in doubles, every sum taken entry after entry."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1]
    return total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries of each row that may be among its k largest, ties and rounding included."""
    kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    return np.nonzero(scores >= kth[:, None] - SLACK)


def fitted(index: DataFrame, n: int, d: int, trees: int, leaf: int, seed: int) -> forests.Forest:
    """The forest over a sample of at most SAMPLE rows and SAMPLE_BYTES, each tree fit by a task of its own."""
    spark = index.sparkSession
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    share = min(1.0, most / max(n, 1))
    drawn = index.where(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("v").limit(most).toArrow()  # bounded above
    sample = unit(matrix(drawn.column("v").combine_chunks(), d))
    end = max(LEAST_SAMPLED, round(leaf * len(sample) / max(n, 1)))
    sent = spark.sparkContext.broadcast(sample)

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for t in batch.column(0).to_pylist():
                a, b, c, leaves = forests.tree(sent.value, end, seed * 1000 + t)
                yield pa.RecordBatch.from_arrays([pa.array([t]), *(pa.array([x.tobytes()], pa.binary()) for x in (a, b, c)), pa.array([leaves])], ["t", "directions", "cuts", "children", "leaves"])

    found = spark.range(trees).repartition(trees).mapInArrow(fit, "t long, directions binary, cuts binary, children binary, leaves long").collect()  # as large as twice the sample at most
    shaped = [(np.frombuffer(bytes(r.directions)).reshape(-1, d), np.frombuffer(bytes(r.cuts)), np.frombuffer(bytes(r.children), np.int64).reshape(-1, 2), r.leaves) for r in sorted(found)]
    return forests.joined(shaped)


def visits_needed(index: DataFrame, queries: DataFrame, sent, d: int, k: int, recall: float, seed: int) -> int:
    """How many leaves a query must visit so that `recall` of the k nearest are met, by PILOTS of the queries compared with all rows."""
    spark = index.sparkSession
    trees = len(sent.value.roots)
    pilots = queries.orderBy(F.xxhash64(F.lit(seed), "row"), "row").limit(PILOTS).select("row", "v").toArrow()
    if not pilots.num_rows:
        return trees
    own, q = pilots.column("row").to_numpy(), unit(matrix(pilots.column("v").combine_chunks(), d))
    pilot = spark.sparkContext.broadcast((own, q))

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best rows of a task for each pilot, with the leaves that hold them."""
        own, q = pilot.value
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in parts:
            rows, x = batch.column(0).to_numpy(), unit(matrix(batch.column(1), d))
            s = q @ x.T
            s[own[:, None] == rows[None, :]] = -np.inf
            i, j = best(s, k)
            i, j = i[np.isfinite(s[i, j])], j[np.isfinite(s[i, j])]
            leaf = forests.places(sent.value, x[j], rows[j])
            kept.append((i, rows[j], s[i, j], leaf))
            i, r, s, leaf = (np.concatenate(c) for c in zip(*kept, strict=True))
            order = np.lexsort((r, -s, i))
            place = np.arange(len(order)) - np.searchsorted(i[order], i[order])
            order = order[place < k]
            kept = [(i[order], r[order], s[order], leaf[order])]
        for i, r, s, leaf in kept:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(r), pa.array(s), pa.array(list(leaf), pa.list_(pa.int64()))], ["pilot", "row", "score", "leaves"])

    def needed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The visit at which the queue meets each of the true neighbours first."""
        f = sent.value
        children = f.children.tolist()
        for batch in parts:
            out = []
            for i, leaves in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = {leaf: n for n, leaf in enumerate(forests.visits(f, forests.margins(f, pilot.value[1][i : i + 1])[0].tolist(), children, f.leaves), 1)}
                out += [min(place[x] for x in own) for own in leaves]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["visits"])

    near = index.select("row", "v").mapInArrow(nearest, "pilot long, row long, score double, leaves array<long>")
    top = near.withColumn("place", F.row_number().over(W.partitionBy("pilot").orderBy(F.desc("score"), "row"))).where(F.col("place") <= k)
    counted = [r.visits for r in top.groupBy("pilot").agg(F.collect_list("leaves")).mapInArrow(needed, "visits long").collect()]  # PILOTS * k numbers
    if not counted:
        return trees
    return max(trees, int(np.quantile(counted, recall, method="higher")))


def nearest(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, seed: int = 7
) -> DataFrame:
    """(query_id, rank from 1, the neighbour's id, score): for each row whose id is divisible by `every`, its k nearest found among
    all other rows by cosine, nearest first, ties to the smaller id, null ids last.

    Trees are fit on a sample; every row is placed in a leaf of each. A query's visits are as many as let PILOTS of the queries
    find `recall` of their true neighbours, so data without clusters cost more, not recall. All rows of visited leaves are scored by the
    cosine of the original vectors. Of equal vectors the k + 1 rows with the smallest ids are placed: no other can be among k nearest.

    Vectors that are null, empty, zero, hold null or non-finite entries, or are of another length than most, take no part: no query, no
    candidate. A null id is no query. Rows that repeat an id are rows of their own: each is a query, and a candidate of the other.
    Fewer candidates than k: all that were met, which is all if one leaf holds them. No usable rows, no result. Other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[id_col].dataType
    good, d = usable(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "v")
    rows = stored(good.where(F.exists("v", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id()))
    first = F.row_number().over(W.partitionBy("v").orderBy(F.asc_nulls_last("id"), "row"))
    index = stored(rows.withColumn("place", first).where(F.col("place") <= k + 1).drop("place"))
    queries = rows.where(F.col("id") % every == 0)
    n = index.count()
    if not d or not n:
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, rank int, {id_col} {kind.simpleString()}, score double")
    f = fitted(index, n, d, trees, leaf, seed)
    sent = spark.sparkContext.broadcast(f)  # at most twice the sample
    most = visits_needed(index, queries, sent, d, k, recall, seed)
    per = max(1, round(SHARD_ROWS * f.leaves / (n * trees)))
    vec = vectors.schema[vec_col].dataType.simpleString()

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            leaves = forests.places(sent.value, unit(matrix(batch.column(2), d)), batch.column(1).to_numpy())
            again = pa.array(np.repeat(np.arange(len(leaves)), leaves.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel() // per), pa.array(leaves.ravel()), *(c.take(again) for c in batch.columns)], ["shard", "leaf", "id", "row", "v"])

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each query and shard that its visits lead to, with the leaves there."""
        f = sent.value
        children = f.children.tolist()
        at_once = max(1, 4_000_000 // max(len(f.cuts), 1))
        for whole in parts:
            for start in range(0, whole.num_rows, at_once):
                batch = whole.slice(start, at_once)
                shard, leaves, who = [], [], []
                for i, m in enumerate(forests.margins(f, unit(matrix(batch.column(2), d)))):
                    met = np.sort(np.array(forests.visits(f, m.tolist(), children, most)))
                    parts_ = np.split(met, np.flatnonzero(np.diff(met // per)) + 1)
                    shard += [int(x[0]) // per for x in parts_]
                    leaves += [x.tolist() for x in parts_]
                    who += [i] * len(parts_)
                again = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), *(c.take(again) for c in batch.columns)], ["shard", "leaves", "id", "row", "v"])

    members = index.select("id", "row", "v").mapInArrow(place, f"shard long, leaf long, id {kind.simpleString()}, row long, v {vec}")
    probes = stored(queries.select("id", "row", "v").mapInArrow(probe, f"shard long, leaves array<long>, id {kind.simpleString()}, row long, v {vec}"))
    slices = probes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_QUERIES).cast("int").alias("slices"))  # a shard that many queries visit is compared by several tasks
    slices = checked_broadcast(stored(slices))
    members = members.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    probes = probes.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int")).drop("slices")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best members of a shard's visited leaves for each query."""
        left, right = left.sort_by("leaf").combine_chunks(), right.combine_chunks()
        q, x = (matrix(t.column("v").combine_chunks(), d) for t in (right, left))
        uq, ux = unit(q) if len(q) else q, unit(x) if len(x) else x
        mine, theirs, leaf = right.column("row").to_numpy(), left.column("row").to_numpy(), left.column("leaf").to_numpy()
        visited = right.column("leaves").combine_chunks()
        owner, wanted = np.repeat(np.arange(len(q)), visited.value_lengths().to_numpy()), visited.flatten().to_numpy()
        order = np.argsort(wanted, kind="stable")
        owner, wanted = owner[order], wanted[order]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for one in np.unique(leaf):
            a, b = np.searchsorted(leaf, [one, one + 1])
            who = owner[slice(*np.searchsorted(wanted, [one, one + 1]))]
            if not len(who):
                continue
            s = uq[who] @ ux[a:b].T
            s[mine[who][:, None] == theirs[None, a:b]] = -np.inf
            i, j = best(s, k)
            good = np.isfinite(s[i, j])
            found.append((who[i[good]], a + j[good]))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        _, first = np.unique(np.stack([i, theirs[j]]), axis=1, return_index=True)  # a shard may hold leaves of two trees
        i, j = i[first], j[first]
        score = np.concatenate([cosines(q[i[c : c + 50_000]], x[j[c : c + 50_000]]) for c in range(0, len(i), 50_000)] or [np.zeros(0)])
        ids = left.column("id").combine_chunks()
        by_id = np.empty(len(ids), np.int64)
        by_id[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((by_id[j], -score, i))
        order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
        i, j = i[order], j[order]
        return pa.table([right.column("id").combine_chunks().take(pa.array(i)), pa.array(mine[i]), ids.take(pa.array(j)), pa.array(theirs[j]), pa.array(score[order])], names=["query_id", "query", "id", "row", "score"])

    pairs = members.groupBy("shard", "slice").cogroup(probes.groupBy("shard", "slice")).applyInArrow(compare, f"query_id {kind.simpleString()}, query long, id {kind.simpleString()}, row long, score double")
    once = pairs.dropDuplicates(["query", "row"])  # a row may be met in several trees
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
