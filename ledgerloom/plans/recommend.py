"""Item embeddings from the co-view graph, recommendation, embedding map."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.columns import category_levels
from ledgerloom.operators.embeddings import (
    embed_walks,
    project_embeddings,
    similar_items,
    with_category,
)
from ledgerloom.operators.walks import random_walks
from ledgerloom.session import materialize


def item_embeddings(edges: DataFrame, num_walks: int = 10, length: int = 50, p: float = 2.0, q: float = 1.0,
                    size: int = 64, seed: int = 1, method: str = "skipgram") -> DataFrame:
    """(pid, embedding_vector) of every product of the co-view graph."""
    walks = materialize(random_walks(edges, num_walks, length, p, q, seed), "walks")
    return embed_walks(walks, size=size, seed=seed, method=method)


def first_categories(products: DataFrame, order: str | None = None) -> DataFrame:
    """(product_id, category_code): the category seen first in ``order``, else the smallest.

    Products without any category keep a row with NULL.
    """
    code = F.col("category_code")
    pick = F.min_by(code, F.struct(F.col(order), code)) if order else F.min(code)
    return products.groupBy("product_id").agg(pick.alias("category_code"))


def recommend(embeddings: DataFrame, products: DataFrame, ids: DataFrame | None = None, k: int = 1) -> DataFrame:
    """(product_id, prod_id, category_code, rank): the ``k`` most similar products.

    ``prod_id`` is text, as the embedding tokens are. An unknown id gives no row.
    """
    similar = similar_items(embeddings, ids, k).withColumnsRenamed({"pid": "query_id", "similar": "product_id"})
    named = with_category(similar, "product_id", first_categories(products))
    return named.select(
        F.col("query_id").alias("product_id"),
        F.col("product_id").cast("string").alias("prod_id"),
        "category_code",
        "rank",
    )


def embedding_maps(embeddings: DataFrame, products: DataFrame) -> DataFrame:
    """Plane and space map in one: ``x0, x1`` are the plane's coordinates and the first two of the space's ``x0..x2``.

    Principal axes do not change when one more is taken, so one fit serves both.
    """
    return embedding_map(embeddings, products, 3)


def embedding_map(embeddings: DataFrame, products: DataFrame, dims: int = 2) -> DataFrame:
    """Every categorised item with its levels L1..L3 and coordinates x0.."""
    named = with_category(
        embeddings.withColumnRenamed("pid", "product_id"), "product_id", first_categories(products)
    )
    leveled = named.select("*", *category_levels(F.col("category_code"))).where(F.col("L1").isNotNull())
    return project_embeddings(leveled, dims).withColumnRenamed("product_id", "pid").drop("embedding_vector")
