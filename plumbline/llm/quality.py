"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled statistics; every path from a root to a node is a conjunction of
thresholds. A logistic model with an L1 penalty keeps few of these rules. What is left is compiled into
one Spark column expression, so that scoring is a projection and runs without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import UPPER, written

#: Labelled rows a model is fitted on, at most: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
TREES, DEPTH, PENALTY, SEED = 12, 3, 0.0005, 7

STATISTICS = ("words", "word_length", "distinct", "upper", "digit", "stop", "symbol", "short")


def text_statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; all 0 where there are no words. None depends on id, source or language."""
    text = F.coalesce(text, F.lit(""))
    said = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chars = F.greatest(F.length(text), F.lit(1))

    def share(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))) / chars

    return {
        "said": F.struct(F.size(said).alias("n"), F.size(F.array_distinct(said)).alias("distinct"),
                         F.size(F.filter(said, lambda w: F.length(w) < 2)).alias("short")),
        "chars": chars,
        "upper": share(UPPER),
        "digit": share("0123456789"),
        "stop": share(".,;:!?"),
        "symbol": share("#$%&*+<=>@\\^_`{|}~/[]()"),
    }


def with_statistics(df: DataFrame) -> DataFrame:
    """Adds a column ``stats`` with all STATISTICS of ``text``."""
    found = text_statistics(F.col("text"))
    n = F.greatest(F.col("_s.said.n"), F.lit(1))
    stats = F.struct(
        F.col("_s.said.n").cast("double").alias("words"),
        (F.col("_s.chars") / n).alias("word_length"),
        (F.col("_s.said.distinct") / n).alias("distinct"),
        *(F.col(f"_s.{s}").alias(s) for s in ("upper", "digit", "stop", "symbol")),
        (F.col("_s.said.short") / n).alias("short"),
    )
    empty = F.struct(*(F.lit(0.0).alias(s) for s in STATISTICS))
    measured = df.withColumn("_s", F.struct(*(c.alias(n) for n, c in found.items())))
    return measured.withColumn("stats", F.when(F.col("_s.said.n") > 0, stats).otherwise(empty)).drop("_s")


@dataclass(frozen=True)
class Rule:
    """All of (statistic, upper end, value): statistic <= value, or > value where it is a lower end."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, is_upper, value in self.terms:
            out = out & ((stats[name] <= value) if is_upper else (stats[name] > value))
        return out


@dataclass
class RuleModel:
    intercept: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def score(self, stats: Column) -> Column:
        """Probability of label 1, from 0 to 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(rule.holds(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(node, terms: tuple = ()):
    """The paths to all nodes below ``node``, thresholds of one statistic and side merged."""
    if node.getClass().getSimpleName() != "InternalNode":
        return
    name, value = STATISTICS[node.split().featureIndex()], node.split().threshold()
    for child, is_upper in ((node.leftChild(), True), (node.rightChild(), False)):
        ends = {(n, u): v for n, u, v in terms}
        old = ends.get((name, is_upper), value)
        ends[name, is_upper] = min(old, value) if is_upper else max(old, value)
        path = tuple(sorted((n, u, v) for (n, u), v in ends.items()))
        yield Rule(path)
        yield from _paths(child, path)


def fit_rules(labelled: DataFrame) -> RuleModel:
    """A model from (stats, label); ``label`` is 0.0 or 1.0.

    Without rows the score is 0.5; with one label only it is that label's smoothed rate.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    count, ones = labelled.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, count):
        import math

        return RuleModel(math.log((ones + 1) / (count - ones + 1)))
    vector = array_to_vector(F.array(*(F.col(f"stats.{s}") for s in STATISTICS)))
    data = labelled.withColumn("features", vector)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", subsamplingRate=0.7
    ).fit(data)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in _paths(tree._java_obj.rootNode())))
    if not rules:
        import math

        return RuleModel(math.log((ones + 1) / (count - ones + 1)))
    holds = array_to_vector(F.array(*(r.holds(F.col("stats")).cast("double") for r in rules)))
    lasso = LogisticRegression(
        featuresCol="rules", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60
    ).fit(labelled.withColumn("rules", holds))
    kept = {r: float(w) for r, w in zip(rules, lasso.coefficients.toArray()) if w}
    return RuleModel(float(lasso.intercept), kept)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """Learns ``labels.quality`` from the texts of labelled documents that are not held out.

    Rows with null ids or labels teach nothing. Repeated ids are all used.
    """
    known = labels.select("doc_id", F.col("quality").cast("double").alias("label")).dropna()
    known = known.filter(~held_out(F.col("doc_id")) & F.col("label").isin(0.0, 1.0))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return fit_rules(written(with_statistics(rows).select("stats", "label"), "quality-train"))


def with_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` and ``held_out``, ``score``, ``predicted`` (1 where score >= threshold).

    Null and empty texts are scored like any text, by statistics that are all 0. Columns of these names
    are replaced.
    """
    own = docs.drop("held_out", "score", "predicted", "stats", "_s")
    scored = with_statistics(own).withColumn("score", model.score(F.col("stats"))).drop("stats")
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
