"""Ward, complete-link and Birch clusters of tables of any size.

Each partition folds its rows into clustering features: number, sum and sum of squares of rows that lie within a radius. Two features merge by
adding up, so partitions' features are merged in rounds, few partitions at a time, and stay at most MOST in all; where there are more, the radius grows.
The features left are clustered exactly, by a chain of nearest neighbours with Lance-Williams updates, and each row belongs to the cluster of its nearest feature. As long as there are at
most MOST different rows a feature is one row, and the result is that of the exact algorithm over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Features of a table, and partitions whose features are merged by one task.
MOST, FAN_IN = 1000, 8
LINKAGES = ("ward", "complete")


class Features:
    """Clustering features: n rows each, with their sum and sum of squared lengths; radius is the root mean squared distance to the centre that a feature may have."""

    def __init__(self, dims: int, most: int = MOST, radius: float = 0.0) -> None:
        self.most, self.radius, self.size = most, radius, 0
        self.n, self.sums, self.squares = np.zeros(2 * most + 2), np.zeros((2 * most + 2, dims)), np.zeros(2 * most + 2)

    def add(self, n: float, total: np.ndarray, square: float) -> None:
        """Into the nearest feature if that stays within the radius, else as a new one."""
        k = self.size
        if k:
            away = ((self.sums[:k] / self.n[:k, None] - total / n) ** 2).sum(1)
            i = int(away.argmin())
            m, s = self.n[i] + n, self.sums[i] + total
            spread = (self.squares[i] + square) / m - ((s / m) ** 2).sum()
            if away[i] == 0 or spread <= self.radius**2:
                self.n[i], self.sums[i], self.squares[i] = m, s, self.squares[i] + square
                return
        self.n[k], self.sums[k], self.squares[k], self.size = n, total, square, k + 1
        if self.size > self.most:
            self.grow()

    def grow(self) -> None:
        """A larger radius, until at most half of the features are left: that within which the nearest half of them meet their neighbours."""
        while self.size > self.most // 2 + 1:
            k = self.size
            centre = self.sums[:k] / self.n[:k, None]
            away = (centre**2).sum(1)[:, None] + (centre**2).sum(1)[None] - 2 * centre @ centre.T
            np.fill_diagonal(away, np.inf)
            self.radius = max(1.1 * self.radius, float(np.sqrt(max(np.median(away.min(1)), 0.0)) / 2), 1e-12)
            old = list(zip(self.n[:k].copy(), self.sums[:k].copy(), self.squares[:k].copy(), strict=True))
            self.size, most = 0, self.most
            self.most = k + 1  # what is added again is at most what there was
            for f in old:
                self.add(*f)
            self.most = most

    def frame(self) -> pd.DataFrame:
        k = self.size
        return pd.DataFrame({"n": self.n[:k], "total": list(self.sums[:k]), "square": self.squares[:k], "radius": self.radius})


def merges(centre: np.ndarray, n: np.ndarray, linkage: str) -> list[tuple[float, int, int]]:
    """Heights and ends (any members) of the merges that join all, lowest first; a chain of nearest neighbours needs no search over all pairs."""
    d = np.maximum((centre**2).sum(1)[:, None] + (centre**2).sum(1)[None] - 2 * centre @ centre.T, 0.0)
    n = n.astype(float)
    d = np.sqrt(d) if linkage == "complete" else d * (n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(d, np.inf)
    alive, chain, out = np.ones(len(n), bool), [], []
    for _ in range(len(n) - 1):
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        a, b = sorted(chain[-2:])
        del chain[-2:]
        out.append((float(d[a, b]), a, b))
        if linkage == "complete":
            row = np.maximum(d[a], d[b])
        else:  # Lance-Williams for the growth of the squared deviation
            total = n[a] + n[b] + n
            row = ((n[a] + n) * d[a] + (n[b] + n) * d[b] - n * d[a, b]) / total
        alive[b] = False
        row[~alive] = np.inf
        row[a] = np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        n[a] += n[b]
    return sorted(out, key=lambda m: m[0])


def cut(centre: np.ndarray, n: np.ndarray, k: int, linkage: str) -> np.ndarray:
    """Cluster numbers of features: k clusters, numbered by their first feature."""
    root = list(range(len(n)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for _, a, b in merges(centre, n, linkage)[: max(0, len(n) - k)]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(i), len(names)) for i in range(len(n))])


_SCHEMA = "n double, total array<double>, square double, radius double"


def features(rows: DataFrame, dims: int, most: int = MOST, radius: float = 0.0) -> pd.DataFrame:
    """Clustering features of rows (id, x), at most most of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Features(dims, most, radius)
        for b in batches:
            for x in b["x"]:
                found.add(1.0, np.asarray(x), float(np.dot(x, x)))
        if found.size:  # an empty frame's list column has no type that Arrow can convert
            yield found.frame()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Features(dims, most, radius)
        for b in batches:
            found.radius = max([found.radius, *b["radius"]])
            for f in b[["n", "total", "square"]].itertuples(index=False, name=None):
                found.add(f[0], np.asarray(f[1]), f[2])
        if found.size:
            yield found.frame()

    now = rows.repartition(parts, "id").sortWithinPartitions("id").mapInPandas(fold, _SCHEMA)
    while parts > 1:
        now = stored(now.withColumn("part", F.spark_partition_id()), "features")
        parts = -(-parts // FAN_IN)
        now = now.repartition(parts, F.floor(F.col("part") / FAN_IN)).sortWithinPartitions("total", "n").drop("part").mapInPandas(merge, _SCHEMA)
    found = now.toPandas()  # at most most a task of the last round, which is one
    total = Features(dims, most, radius)
    for f in found.itertuples(index=False):
        total.radius = max(total.radius, f.radius)
        total.add(f.n, np.asarray(f.total), f.square)
    return total.frame()


def clusters(rows: DataFrame, k: int, linkage: str = "ward", most: int = MOST, radius: float = 0.0, key: str = "id", vector: str = "x") -> DataFrame:
    """key, cluster: k clusters (fewer, if there aren't as many different rows) of rows (key, vector), numbered by the order of their centres.

    linkage is ward or complete. With a radius above 0 or more than most different rows this is Birch: features first, and clusters of them. Rows without a vector, or with null or non-finite numbers, take no part.
    Vectors must be of one length. An empty table gives an empty result.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    x = F.col(vector).cast("array<double>")
    valid = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = stored(rows.filter(x.isNotNull() & valid).select(F.col(key).alias("id"), x.alias("x")), "clusters")
    kind = rows.schema["id"].dataType.simpleString()
    first = rows.select(F.size("x").alias("n")).first()
    if not first:
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, cluster int")
    found = features(rows, first.n, most, radius)
    n = found["n"].to_numpy()
    centre = np.stack(found["total"].to_list()) / n[:, None]
    order = np.lexsort(centre.T[::-1])
    centre, n = centre[order], n[order]
    label = cut(centre, n, k, linkage)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack(b["x"].to_list())
                near = np.concatenate([((centre**2).sum(1)[None] - 2 * part @ centre.T).argmin(1) for part in np.array_split(v, -(-len(v) // 1000))])
                yield pd.DataFrame({key: b["id"], "cluster": label[near].astype("int32")})

    return rows.mapInPandas(assign, f"{key} {kind}, cluster int")
