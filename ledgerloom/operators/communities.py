"""Placement of graph nodes: communities of bounded size, packed into parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.columns import unit_interval
from ledgerloom.operators.sequence import running_total
from ledgerloom.session import materialize

LEVELS, ROUNDS = 5, 4


def _propagated(links: DataFrame, sizes: DataFrame, cap: float, seed: int) -> DataFrame:
    """(group, label): every group takes the label that most of its links lead to, while labels stay below ``cap``.

    A round moves about half of the groups, so two groups do not swap labels for
    ever. A label with more room asked for than it has takes each group with the
    chance that fills it; sums alone decide, so no task sees all that ask.
    """
    labels = sizes.select("group", F.col("group").alias("label"), "load")
    for turn in range(ROUNDS):
        seen = labels.select(F.col("group").alias("other"), "label")
        votes = links.join(seen, "other").groupBy("group", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("group").agg(F.max_by("label", F.struct("w", F.xxhash64("label", F.lit(seed)))).alias("wish"))
        filled = labels.groupBy(F.col("label").alias("wish")).agg(F.sum("load").alias("filled"))
        coin = F.pmod(F.xxhash64("group", F.lit(seed), F.lit(turn)), F.lit(2)) == 0
        asking = labels.where(coin).join(best, "group").where("wish <> label").join(filled, "wish")
        asking = materialize(asking.where(F.col("filled") + F.col("load") <= cap).select("group", "wish", "load", "filled"), "asking")
        asked = asking.groupBy("wish").agg(F.sum("load").alias("asked"))
        chance = (F.lit(float(cap)) - F.col("filled")) / F.col("asked")
        taken = asking.join(asked, "wish").where(unit_interval(F.col("group"), F.lit(seed), F.lit(turn), F.lit("in")) < chance)
        labels = labels.join(taken.select("group", "wish"), "group", "left")
        labels = materialize(labels.select("group", F.coalesce("wish", "label").alias("label"), "load"), "labels")
    return labels.select("group", "label")


def place_nodes(links: DataFrame, loads: DataFrame, cap: float) -> DataFrame:
    """(node, part): nodes that are linked lie together, and a part's load is about ``cap``, at most twice that.

    ``links`` has (node, nbr, w) both ways, ``loads`` (node, load) with one row
    a node and no load above ``cap``. Labels are propagated, communities become
    the groups of the next level, and so on until few merge; communities are
    then packed in the order of their labels.
    """
    members = loads.select("node", F.col("node").alias("group"))
    graph = links.select(F.col("node").alias("group"), F.col("nbr").alias("other"), "w")
    sizes = loads.select(F.col("node").alias("group"), "load")
    count = sizes.count()
    for level in range(LEVELS):
        named = _propagated(graph, sizes, cap, level)
        members = materialize(members.join(named, "group").select("node", F.col("label").alias("group")), "members")
        sizes = materialize(
            sizes.join(named, "group").groupBy(F.col("label").alias("group")).agg(F.sum("load").alias("load")), "sizes"
        )
        now = sizes.count()
        if now > 0.9 * count:
            break
        count = now
        a, b = named.withColumnRenamed("label", "ga"), named.select(F.col("group").alias("other"), F.col("label").alias("gb"))
        graph = materialize(
            graph.join(a, "group").join(b, "other").where("ga <> gb").groupBy(F.col("ga").alias("group"), F.col("gb").alias("other"))
            .agg(F.sum("w").alias("w")),
            "graph",
        )
    packed = running_total(sizes, ["group"], "load", "upto")
    part = F.floor((F.col("upto") - F.col("load")) / F.lit(float(cap))).cast("long")
    return members.join(packed.select("group", part.alias("part")), "group").select("node", "part")
