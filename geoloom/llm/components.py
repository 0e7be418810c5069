"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of `edges` (a, b).

    Each round hangs every node's larger neighbours, then its smaller ones, on the
    smallest neighbour, and is written to the shared folder; the driver sees only
    a count and a checksum. Rounds grow with the logarithm of a component's width.
    Null ends and loops are left out.
    """
    spark = edges.sparkSession
    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = fingerprint(current)
    for _ in range(max_rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = splittable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # every node of `large` now hangs on smaller ones; bring those together
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(splittable(lowest, "a"), "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        following = materialise(small, "edges")
        new_mark = fingerprint(following)
        discard(spark, current)
        current = following
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def splittable(grouped: DataFrame, key: str) -> DataFrame:
    """The same rows with a key whose partitioning the planner does not know.

    A join with them then shuffles both sides by itself, so that adaptive execution
    can split a hot key of the other side; straight after the aggregate it could not.
    """
    same = F.concat(F.col(key), F.lit("")) if dict(grouped.dtypes)[key] == "string" else F.col(key).bitwiseXOR(F.lit(0))
    return grouped.withColumn(key, same)


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)))).first())
