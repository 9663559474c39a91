"""Failure clusters by what the failed texts say: TF-IDF and bisecting k-means.

Texts become unit vectors of TF-IDF weights over at most TERMS words; the largest clusters are halved until there
are k, and each text then goes to the centre nearest by angle. Each cluster gets its share of all failures, the case nearest to its centre, and the words that weigh most
in the centre, so that a report can name it. The vocabulary and the centres are all that the driver holds.

Defined results: a text without words is a zero vector and goes to the first centre; fewer different texts
than k give fewer clusters; no failures give an empty result; failures without any word are one cluster.
Clusters are numbered by size, then by the id of their representative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, BisectingKMeansModel
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TERMS, SEED, NAMED = 1 << 13, 7, 5
CLUSTERS = "cluster int, failures long, share double, representative string, terms array<string>"


def vectors(failures: DataFrame, terms: int = TERMS) -> tuple[DataFrame, list[str]]:
    """(id, features: unit vectors) of rows (id, text), and the words that the features stand for."""
    texts = failures.select(F.col("id").cast("string").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+", toLowercase=True).transform(texts).select("id", "words")
    # The commonest words, equal ones by their letters: the same words in the same order each time.
    common = words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(terms)
    vocabulary = [r["term"] for r in common.collect()]
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="counts").transform(words)
    weighted = IDF(inputCol="counts", outputCol="weights").fit(counts).transform(counts)
    return Normalizer(inputCol="weights", outputCol="features").transform(weighted).select("id", "features"), vocabulary


def cluster_texts(failures: DataFrame, k: int, *, seed: int = SEED, terms: int = TERMS) -> tuple[DataFrame, BisectingKMeansModel | None, list[str]]:
    """(id, cluster, nearness to its centre) of every failure; the model; the words. Without any word no model."""
    has_word = failures.filter(F.col("text").rlike(r"[\p{L}\p{N}]"))
    if has_word.isEmpty():
        return failures.select(F.col("id").cast("string").alias("id"), F.lit(0).alias("cluster"), F.lit(0.0).alias("nearness")), None, []
    rows, words = vectors(failures, terms)
    rows = rows.persist()
    try:
        model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    finally:
        rows.unpersist()
    centres = np.array(model.clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = np.array([centres[:, v["indices"]] @ v["values"] for v in batch["features"]])
            best = sums.argmax(axis=1)
            yield pd.DataFrame({"id": batch["id"], "cluster": best, "nearness": sums[np.arange(len(best)), best]})

    return rows.mapInPandas(near, "id string, cluster int, nearness double"), model, words


def failure_text_clusters(failures: DataFrame, k: int = 12, *, seed: int = SEED, terms: int = TERMS, named: int = NAMED) -> DataFrame:
    """A row for each cluster of failures (id, text)."""
    spark = failures.sparkSession
    members, model, words = cluster_texts(failures, k, seed=seed, terms=terms)
    best = F.min_by("id", F.struct(-F.round("nearness", 9), F.col("id")))
    found = members.groupBy("cluster").agg(F.count("*").alias("failures"), best.alias("representative"))
    heads = []
    for i, centre in enumerate(model.clusterCenters() if model is not None else ()):
        top = sorted(np.flatnonzero(centre > 0).tolist(), key=lambda t: (-round(float(centre[t]), 9), words[t]))[:named]
        heads.append((i, [words[t] for t in top]))
    named_by = spark.createDataFrame(heads or [(0, [])], "cluster int, terms array<string>")
    # One row for each cluster from here on, k at most.
    order = F.row_number().over(Window.orderBy(F.desc("failures"), "representative")) - 1
    share = F.col("failures") / F.sum("failures").over(Window.partitionBy())
    return found.join(named_by, "cluster", "left").select(order.alias("cluster"), "failures", share.alias("share"), "representative", "terms")
