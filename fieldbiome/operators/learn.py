"""Classification and projection with the built-in learners."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbiome.functions.scratch import cut
from fieldbiome.operators.metrics import weighted_metrics
from fieldbiome.operators.selection import stratified_split


def labelled(rows: DataFrame, labels: DataFrame, least: int = 10) -> DataFrame:
    """rows (row_index, embedding) with labels (row_index, label): blanks and unknown rows are skipped; too few raise."""
    out = rows.join(labels.where("trim(label) <> ''"), "row_index")
    if out.limit(least).count() < least:
        raise ValueError(f"under {least} labelled rows")
    return out


def forest_metrics(rows: DataFrame, key: str, vector: str, label: str, trees: int = 300, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Weighted precision, recall and F1 of a random forest on a stratified held-out part."""
    split = stratified_split(rows.select(key, F.col(label).cast("string").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")), "label", key, test, seed)
    split = split.persist()
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(split)
    known = index.transform(split)
    model = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, seed=seed).fit(known.where("not in_test"))
    out = cut(model.transform(known.where("in_test")).select("y", F.col("prediction").alias("p")), "predicted")
    split.unpersist()
    return weighted_metrics(out, "y", "p")


def pca_2d(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pc1, pc2): the scores on the first two principal components; each component's largest loading is positive."""
    v = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="x").fit(v).transform(v)
    model = PCA(k=2, inputCol="x", outputCol="s").fit(centred)
    loads = model.pc.toArray()
    signs = [1.0 if loads[abs(loads[:, k]).argmax(), k] >= 0 else -1.0 for k in range(2)]
    s = vector_to_array("s")
    return model.transform(centred).select(key, (s[0] * signs[0]).alias("pc1"), (s[1] * signs[1]).alias("pc2"))
