"""A supervised risk classifier, and explanations of scores by deviation and variance."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, stored


class EntityRiskClassifier:
    """A random forest over entity features, classes weighted by their inverse frequency."""

    def __init__(self, trees: int = 100, depth: int = 8, seed: int = 42):
        self.trees, self.depth, self.seed = trees, depth, seed
        self.columns: list[str] = []
        self.model = None

    def _vector(self, df: DataFrame):
        own = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in self.columns]
        return array_to_vector(F.array(*own))

    def fit(self, features: DataFrame, label: str, columns: list[str]) -> dict[str, float]:
        """Precision, recall and F1 on the training rows; {} where there are fewer than two classes."""
        self.columns = list(columns)
        counts = {r[0]: r[1] for r in features.groupBy(F.col(label).cast("int")).count().collect()}
        if len(counts) < 2:
            return {}
        total = sum(counts.values())
        weight = F.when(F.col(label).cast("int") == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0]))
        rows = cut(features.select(self._vector(features).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("weight")))
        # the copy has no training summary, which holds the session: that can't be sent to tasks once it has observed a table
        self.model = RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, seed=self.seed, weightCol="weight").fit(rows).copy()
        hit = F.col("prediction") == 1
        r = self.model.transform(rows).agg(F.count_if(hit & (F.col("label") == 1)), F.count_if(hit), F.count_if(F.col("label") == 1)).first()
        precision, recall = (r[0] / r[1] if r[1] else 0.0), (r[0] / r[2] if r[2] else 0.0)
        return {"precision": round(precision, 4), "recall": round(recall, 4), "f1": round(2 * precision * recall / (precision + recall), 4) if r[0] else 0.0}

    def predict(self, features: DataFrame, key: str) -> DataFrame:
        """(key, probability): 0 before a fit; columns that are missing count as 0."""
        if self.model is None:
            return features.select(key, F.lit(0.0).alias("probability"))
        rows = features.select(key, self._vector(features).alias("features"))
        return self.model.transform(rows).select(key, vector_to_array("probability")[1].alias("probability"))


def zscore_explanations(features: DataFrame, key: str, columns: list[str], top: int = 5, least: float = 0.1) -> DataFrame:
    """(key, feature, contribution, rank): standard scores beyond least, the largest first, ties by name."""
    features = stored(features.select(key, *columns))
    row = features.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"s_{c}") for c in columns)).first()
    scale = {c: 1.0 if (row[f"s_{c}"] or 0.0) <= 1e-6 else row[f"s_{c}"] for c in columns}
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.round((F.col(c) - (row[f"m_{c}"] or 0.0)) / scale[c], 3).alias("z")) for c in columns))
    kept = F.filter(pairs, lambda x: F.abs(x["z"]) > least)
    ranked = F.array_sort(F.transform(kept, lambda x: F.struct((-F.abs(x["z"])).alias("by"), x["feature"].alias("feature"), x["z"].alias("z"))))
    out = features.select(key, F.posexplode(F.slice(ranked, 1, top)).alias("at", "x"))
    return out.select(key, "x.feature", F.col("x.z").alias("contribution"), (F.col("at") + 1).alias("rank"))


def variance_importance(features: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, importance): shares of the features' summed variance."""
    row = features.agg(*(F.var_samp(c).alias(c) for c in columns))
    pairs = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("v")) for c in columns))).alias("x")).select("x.*")
    total = "sum(v) OVER ()"
    return pairs.select("feature", F.expr(f"if({total} > 0, v / {total}, 0D)").alias("importance"))
