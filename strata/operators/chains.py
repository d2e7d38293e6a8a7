"""The commit graph as chains of first parents, and what is reached on them.

A chain goes from a commit to the one child that continues it (of the children whose first parent it is, the
one of the smallest sha). Each commit has a chain and a position on it, so that all ancestors along first
parents within a chain are the smaller positions, and the ancestors of any commit are one number for each chain
that they touch. Questions about ancestry take rounds over chains that branch off chains, not over generations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.storage import keep


def rank(pointers: DataFrame, where: str, name: str = "rank") -> DataFrame:
    """(node, root, distance): follow ``next`` (null at an end) to the end of each chain and count the steps,
    in log2 rounds of joins. ``pointers``: (node, next), node unique, no cycle. Nodes that have arrived take no
    part in later rounds but as what others reach."""
    end = F.col("next").isNull()
    at = keep(pointers.select("node", F.coalesce("next", "node").alias("root"), F.when(end, 0).otherwise(1).cast("long").alias("distance"), end.alias("done")), where, f"{name}-0")
    k = 0
    while not at.where("not done").isEmpty():
        k += 1
        far = at.select(F.col("node").alias("root"), F.col("root").alias("_root"), F.col("distance").alias("_more"), F.col("done").alias("_done"))
        moved = at.where("not done").join(far, "root").select("node", F.col("_root").alias("root"), (F.col("distance") + F.col("_more")).alias("distance"), F.col("_done").alias("done"))
        at = keep(at.where("done").unionByName(moved), where, f"{name}-{k}")
    return at.select("node", "root", "distance")


def chains(commits: DataFrame, parents: DataFrame, where: str) -> DataFrame:
    """(sha, chain, pos, fork): ``chain`` is the sha of its first commit, ``fork`` that commit's first parent, the
    commit that the chain branches off (null for one that begins at a root). ``commits``: (sha); ``parents``:
    (sha, parent_position, parent_sha); parents that are no commits (of a shallow history) count as none."""
    have = commits.select(F.col("sha").alias("parent_sha"))
    first = parents.where("parent_position = 0").join(have, "parent_sha", "left_semi").select("sha", "parent_sha")
    heir = first.groupBy(F.col("parent_sha").alias("next")).agg(F.min("sha").alias("node"))
    ranked = rank(commits.select(F.col("sha").alias("node")).distinct().join(heir, "node", "left"), where, "chains")
    fork = first.select(F.col("sha").alias("root"), F.col("parent_sha").alias("fork"))
    return keep(ranked.join(fork, "root", "left").select(F.col("node").alias("sha"), F.col("root").alias("chain"), F.col("distance").alias("pos"), "fork"), where, "chains")


def crossings(chained: DataFrame, parents: DataFrame) -> DataFrame:
    """(chain, pos, to_chain, to_pos): the parent links that leave a chain."""
    a = chained.select("sha", "chain", "pos")
    b = chained.select(F.col("sha").alias("parent_sha"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    return parents.select("sha", "parent_sha").join(a, "sha").join(b, "parent_sha").where("chain <> to_chain").select("chain", "pos", "to_chain", "to_pos")


def reach(roots: DataFrame, chained: DataFrame, parents: DataFrame, where: str, name: str = "reach") -> DataFrame:
    """(root, chain, upto): the ancestors of each root's commits, themselves included, are the positions up to
    ``upto`` of these chains. ``roots``: (root, sha), several rows for one root allowed.

    A round follows the links that leave what was new in the round before, and keeps the largest position
    for each root and chain. It takes as many rounds as chains are nested, whatever their length.
    """
    cross = keep(crossings(chained, parents), where, f"{name}-cross")
    new = roots.join(chained.select("sha", "chain", "pos"), "sha").groupBy("root", "chain").agg(F.max("pos").alias("upto")).withColumn("low", F.lit(-1).cast("long"))
    new = keep(new, where, f"{name}-0")
    known, k = new.drop("low"), 0
    while not new.isEmpty():
        k += 1
        met = new.join(cross, "chain").where("pos > low and pos <= upto").groupBy("root", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("met"))
        both = keep(known.join(met, ["root", "chain"], "full_outer").select("root", "chain", F.greatest("upto", "met").alias("upto"), F.coalesce("upto", F.lit(-1).cast("long")).alias("low")), where, f"{name}-{k}")
        known, new = both.drop("low"), both.where("upto > low")
    return known


def ancestors(labels: DataFrame, chained: DataFrame) -> DataFrame:
    """(root, sha) of all commits that the labels of ``reach`` stand for."""
    return labels.join(chained.select("sha", "chain", "pos"), "chain").where("pos <= upto").select("root", "sha")


def merge_bases(a, b, chained: DataFrame, parents: DataFrame, where: str) -> DataFrame:
    """(sha): common ancestors of two commits that are no proper ancestor of another one.

    On each chain only the last common commit can be one; it is none if a child of it is common, too.
    """
    spark = chained.sparkSession
    roots = spark.range(1).select(F.explode(F.array_distinct(F.array(F.lit(a), F.lit(b)))).alias("sha")).select(F.col("sha").alias("root"), "sha")
    labels = reach(roots, chained, parents, where, "bases")
    common = labels.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.min("upto").alias("upto")).where(F.col("n") == (1 if a == b else 2)).select("chain", "upto")
    common = keep(common, where, "bases-common")
    tips = chained.join(common, "chain").where("pos = upto").select("sha")
    children = parents.select("sha", "parent_sha").join(tips.withColumnRenamed("sha", "parent_sha"), "parent_sha", "left_semi")
    inner = children.join(chained.select("sha", "chain", "pos"), "sha").join(common, "chain").where("pos <= upto").select(F.col("parent_sha").alias("sha"))
    return tips.join(inner, "sha", "left_anti")
