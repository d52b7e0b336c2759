"""Quality classifier: a sparse ensemble of rules. Paths of small trees over text statistics are conjunctive rules;
a lasso logistic regression weighs them; what it keeps is compiled into one Spark column expression."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, checked_broadcast, stored, text_or_empty
from quillon.llm.mixing import row_hash

#: Labelled rows, about, that the model learns from.
SAMPLE = 20_000
#: Trees, their depth, and the weight of the lasso penalty.
TREES, DEPTH, PENALTY = 24, 3, 0.0005
#: Probability at and above which a document is predicted good.
CUT = 0.7

STATISTICS = (
    "log_words", "chars_per_word", "upper_share", "digit_share", "symbols_per_word", "marks_per_word", "stops_per_word",
    "distinct_words", "log_lines", "distinct_lines", "space_share", "long_share",
)


def with_statistics(docs: DataFrame, text_col: str, carry: list[Column]) -> DataFrame:
    """`carry` and the STATISTICS of each text, all built-in expressions over the whole text; an empty text has zeros."""
    removed = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    dropped = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = docs.select(*carry, text_or_empty(text_col).alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).withColumn("l", F.split("t", "\n", -1))
    n, chars = F.size("w"), F.length("t")
    values = {
        "log_words": F.log1p(n),
        "chars_per_word": per(F.aggregate("w", F.lit(0), lambda s, x: s + F.length(x)), n),
        "upper_share": per(removed(r"\p{Lu}+"), chars),
        "digit_share": per(dropped("0123456789"), chars),
        "symbols_per_word": per(dropped("#*$%&|<>~^=_{}[]@"), n),
        "marks_per_word": per(dropped("!?"), n),
        "stops_per_word": per(dropped("."), n),
        "distinct_words": per(F.size(F.array_distinct("w")), n),
        "log_lines": F.log1p(F.size("l")),
        "distinct_lines": per(F.size(F.array_distinct("l")), F.size("l")),
        "space_share": per(dropped(" \t\n\r"), chars),
        "long_share": per(F.size(F.filter("w", lambda x: F.length(x) > 15)), n),
    }
    kept = [c for c in rows.columns if c not in ("t", "w", "l")]
    return rows.select(*kept, *[values[k].cast("double").alias(k) for k in STATISTICS])


@dataclass
class RuleModel:
    """bias + sum of weights of the rules that hold, through the logistic function. A rule is a tuple of
    (statistic, '<=' or '>', bound)."""

    bias: float = 0.0
    rules: list[tuple[float, tuple[tuple[str, str, float], ...]]] = field(default_factory=list)

    def score(self) -> Column:
        """The model as one expression over the STATISTICS columns."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def condition(rule) -> Column:
    out = F.lit(True)
    for name, op, bound in rule:
        out = out & ((F.col(name) <= bound) if op == "<=" else (F.col(name) > bound))
    return out


def paths(debug: str) -> list[tuple[tuple[str, str, float], ...]]:
    """Every path from a root to a node of the trees that a tree model prints, each bound once per statistic and side."""
    found: dict[tuple, None] = {}
    stack: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.split("\n"):
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if "Tree" in line:
                stack = []
            continue
        depth = len(m[1])
        stack = [x for x in stack if x[0] < depth] + [(depth, (STATISTICS[int(m[2])], m[3], float(m[4])))]
        tight: dict[tuple[str, str], float] = {}
        for _, (name, op, bound) in stack:
            key = (name, op)
            tight[key] = bound if key not in tight else (min if op == "<=" else max)(tight[key], bound)
        found[tuple(sorted((n, o, b) for (n, o), b in tight.items()))] = None
    return list(found)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Learn from about `sample` labelled rows for whose id `learn` holds, chosen by a hash of the id.

    Labels that are null are left out; a document labelled more than once counts by the mean. With no labelled rows
    the score is 0.5 everywhere, with one class it is that class's smoothed share.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    marked = stored(labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("double").alias("label")))
    total = marked.count()
    chosen = marked.where(row_hash(id_col) < F.lit(int(min(1.0, sample / max(total, 1)) * (1 << 60)))).select(F.col(id_col).alias("_id"), "label")
    some = docs.join(checked_broadcast(chosen), F.col(id_col) == F.col("_id")).select(F.col(text_col).alias("text"), "label")
    data = stored(with_statistics(some, "text", [F.col("label")]).repartition(6))
    seen = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    if len(seen) < 2:
        good, n = seen.get(1.0, 0), sum(seen.values())
        return RuleModel(math.log((good + 0.5) / (n - good + 0.5)))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(data).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.8, featureSubsetStrategy="onethird", seed=11).fit(vectors)
    rules = paths(forest.toDebugString)
    if not rules:
        return RuleModel(math.log(seen[1.0] / seen[0.0]))
    from pyspark.ml.functions import array_to_vector

    held = F.array(*[F.when(condition(r), 1.0).otherwise(0.0) for r in rules])
    matrix = data.select("label", array_to_vector(held).alias("features")).persist()
    fit = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(matrix)
    matrix.unpersist()
    return RuleModel(float(fit.intercept), [(float(w), r) for w, r in zip(fit.coefficients, rules, strict=True) if w != 0.0])


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and score; no shuffle, no Python."""
    return with_statistics(docs, text_col, [F.col(id_col)]).select(id_col, model.score().alias("score"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score, predicted; learned from the labels of ids that aren't held out.

    Held out are ids whose CRC-32 as text is 2 modulo 4 (a null id is not). Null and empty texts have the score of
    all-zero statistics. Rows that repeat are scored alike; an empty table gives no rows; other columns are ignored.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, labels, ~out, id_col, text_col, label_col, sample)
    return score(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).cast("int").alias("predicted"))


def keep_predicted(docs: DataFrame, labels: DataFrame, **options: Callable) -> DataFrame:
    """The rows of `docs` predicted good, with their columns, whatever their names; null, empty and repeated rows are scored
    as `classify` scores them; an empty table stays empty."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, labels, ~out, id_col, text_col)
    carried = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return with_statistics(carried, "text", [F.col("row")]).where(model.score() >= CUT).select("row.*")
