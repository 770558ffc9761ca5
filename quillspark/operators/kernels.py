"""String kernels over character n-grams, for given pairs of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, low: int, high: int) -> Column:
    """All n-grams of the text for n from low to high."""
    one = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[one(n) for n in range(low, high + 1)]))


def counted(rows: DataFrame, key: str, text: str, low: int, high: int, clusters: DataFrame | None = None) -> DataFrame:
    """key, gram, n. With clusters(gram, cluster), grams count under their cluster's name."""
    out = rows.select(key, F.explode(grams(F.col(text), low, high)).alias("gram"))
    if clusters is not None:
        out = out.join(clusters, "gram", "left").select(key, F.coalesce("cluster", "gram").alias("gram"))
    return out.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))


def kernels(pairs: DataFrame, strings: DataFrame, low: int = 1, high: int = 3, clusters: DataFrame | None = None) -> DataFrame:
    """a, b, intersection, presence, spectrum, normalized: kernels of each pair (a, b) of ids of strings(id, text).

    intersection sums the smaller counts of shared grams, presence counts them, spectrum multiplies counts; normalized
    is the intersection over the root of both strings' own, 0 if that is 0. Each string is cut into grams once, and pairs
    meet on (pair, gram), so the work is that of the pairs' grams and no more.
    """
    c = counted(strings, "id", "text", low, high, clusters)
    total = c.groupBy("id").agg(F.sum("n").alias("own"))
    left = pairs.join(c.select(F.col("id").alias("a"), "gram", F.col("n").alias("na")), "a")
    right = pairs.join(c.select(F.col("id").alias("b"), "gram", F.col("n").alias("nb")), "b")
    shared = left.join(right, ["a", "b", "gram"]).groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("intersection"), F.count(F.lit(1)).alias("presence"), F.sum(F.col("na") * F.col("nb")).alias("spectrum"))
    out = pairs.join(shared, ["a", "b"], "left").na.fill(0, ["intersection", "presence", "spectrum"])
    out = out.join(total.select(F.col("id").alias("a"), F.col("own").alias("oa")), "a", "left").join(total.select(F.col("id").alias("b"), F.col("own").alias("ob")), "b", "left")
    root = F.sqrt(F.col("oa").cast("double") * F.col("ob"))
    return out.select("a", "b", "intersection", "presence", "spectrum", F.coalesce(F.when(root > 0, F.col("intersection") / root), F.lit(0.0)).alias("normalized"))


def accuracy(found: DataFrame, labels: DataFrame, by: str = "normalized") -> DataFrame:
    """strings, right: of how many strings the nearest other one by a kernel has the same label; ties to the smaller id. labels: id, label."""
    both = found.select("a", "b", by).union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), by))
    best = both.groupBy("a").agg(F.max_by("b", F.struct(F.round(by, 9), -F.col("b"))).alias("b"))
    rows = best.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
    return rows.agg(F.count(F.lit(1)).alias("strings"), F.count_if(F.col("x") == F.col("y")).alias("right"))
