"""Item embeddings from walks, similar items, projection."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.joins import attach_features
from ledgerloom.operators.neighbours import nearest
from ledgerloom.operators.sequence import with_row_id
from ledgerloom.operators.skipgram import fit_skipgram
from ledgerloom.session import materialize

def cooccurrences(walks: DataFrame, window: int = 10) -> DataFrame:
    """(a, b, n): how often ``b`` follows ``a`` within the window, in both directions."""
    size = F.size("path")
    near = F.flatten(
        F.transform(
            "path",
            lambda a, i: F.transform(
                F.slice("path", i + 2, F.least(F.lit(window), size - i - 1)),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
    ahead = walks.select(F.inline(near)).groupBy("a", "b").agg(F.count("*").alias("n"))
    back = ahead.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    return ahead.union(back).groupBy("a", "b").agg(F.sum("n").alias("n"))


def factor_embeddings(walks: DataFrame, size: int = 64, window: int = 10, iterations: int = 10, seed: int = 1) -> DataFrame:
    """(pid, embedding_vector) for any number of items; no vector is held on the driver.

    Skip-gram factorises the mutual information of items and their contexts;
    here its positive part is factorised by alternating least squares, whose
    factors stay in partitions.
    """
    pairs = materialize(cooccurrences(walks, window), "pairs")
    totals = materialize(pairs.groupBy("a").agg(F.sum("n").alias("total")), "totals")
    numbered = materialize(with_row_id(totals, ["a"], "no"), "items")
    everything = totals.agg(F.sum("total")).first()[0]
    left = numbered.select("a", F.col("no").cast("int").alias("item"), F.col("total").alias("of_a"))
    right = numbered.select(F.col("a").alias("b"), F.col("no").cast("int").alias("context"), F.col("total").alias("of_b"))
    share = F.col("n") * F.lit(float(everything)) / (F.col("of_a").cast("double") * F.col("of_b"))
    weighed = pairs.join(left, "a").join(right, "b").withColumn("weight", F.log(share)).where("weight > 0")
    als = ALS(
        rank=size, maxIter=iterations, implicitPrefs=True, alpha=1.0, seed=seed, checkpointInterval=-1,
        userCol="item", itemCol="context", ratingCol="weight",
    )
    factors = als.fit(materialize(weighed.select("item", "context", "weight"), "weights")).userFactors
    return factors.join(numbered.select(F.col("no").cast("int").alias("id"), F.col("a").alias("pid")), "id").select(
        "pid", F.col("features").alias("embedding_vector")
    )


def embed_walks(walks: DataFrame, size: int = 64, window: int = 10, seed: int = 1, method: str = "skipgram", epochs: int = 5) -> DataFrame:
    """(pid, embedding_vector) by skip-gram with negative sampling, or by the factorisation it stands for (``"factors"``).

    Both keep their vectors in partitions.
    """
    if method == "skipgram":
        return fit_skipgram(materialize(cooccurrences(walks, window), "pairs"), size, epochs, seed=seed)
    if method != "factors":
        raise ValueError(f"unknown method {method!r}")
    return factor_embeddings(walks, size, window, seed=seed)


def similar_items(embeddings: DataFrame, ids: DataFrame | None = None, k: int = 1, **options) -> DataFrame:
    """(pid, similar, cosine, rank) for the ids asked for, or for all items.

    ``ids`` has one column of ids; an id without a vector gives no row.
    """
    points = embeddings.select(F.col("pid"), F.col("embedding_vector").alias("vec"))
    asked = points.withColumnRenamed("pid", "qid")
    if ids is not None:
        asked = asked.join(ids.select(F.col(ids.columns[0]).alias("qid")).distinct(), "qid", "left_semi")
    return nearest(asked, points, k, cosine=True, **options).select(
        F.col("qid").alias("pid"), F.col("pid").alias("similar"), F.col("score").alias("cosine"), "rank"
    )


def project_embeddings(embeddings: DataFrame, k: int = 2, vector: str = "embedding_vector") -> DataFrame:
    """Input plus ``k`` coordinates ``x0..``: principal axes of the unit vectors (a linear map)."""
    size = F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(F.col(vector).cast("array<double>"), lambda x: F.try_divide(x, F.col("_size")))
    scaled = (
        embeddings.withColumn("_size", size).where(F.col("_size") > 0).withColumn("_unit", array_to_vector(unit))
    )
    fitted = PCA(k=k, inputCol="_unit", outputCol="_axes").fit(scaled)
    placed = vector_to_array("_axes")
    return (
        fitted.transform(scaled)
        .select(*embeddings.columns, *[placed[i].alias(f"x{i}") for i in range(k)])
    )


def with_category(rows: DataFrame, key: str, categories: DataFrame) -> DataFrame:
    """Rows with the category of the product ``key``; categories have one row per product_id."""
    named = categories.select(F.col("product_id").alias(key), "category_code")
    return attach_features(rows, named, key)
