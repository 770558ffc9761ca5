"""Vectors as array<double>: cosine, sum pooling, sign-hash buckets and nearest rows."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, stored

#: Queries and rows whose similarities one task compares at a time.
QUERY_TILE, ROW_TILE = 4096, 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is missing or zero."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def unit(a: Column) -> Column:
    """a scaled to length 1; null for a zero or missing vector."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a)))


def pooled(rows: DataFrame, keys: list[str], dims: int, vector: str = "vec") -> DataFrame:
    """keys, vec: sum of vectors by element, combined before the shuffle; null where no row has a vector."""
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col(vector)[i]).alias(f"__{i}") for i in range(dims)])
    return sums.select(*keys, F.when(F.col("__0").isNotNull(), F.array(*[F.col(f"__{i}") for i in range(dims)])).alias("vec"))


def sign_hash(vector: Column, planes: list[list[float]]) -> Column:
    """Bit i, most significant first, is 1 if the vector is on the positive side of plane i."""
    out = F.lit(0)
    for p in planes:
        side = dot(vector, F.array(*[F.lit(float(x)) for x in p])) >= 0
        out = out * 2 + side.cast("int")
    return out


def buckets_near(bucket: Column, bits: int, flips: int) -> Column:
    """Buckets up to flips (0 to 2) bits away."""
    masks = [0, *[1 << i for i in range(bits)]] if flips else [0]
    if flips > 1:
        masks += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return F.array(*[bucket.bitwiseXOR(F.lit(m)) for m in masks])


def _units(column: pd.Series, dims: int) -> np.ndarray:
    """Rows of length 1; of zeros where a vector is missing, zero or of another length."""
    m = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        if isinstance(v, (list, np.ndarray)) and len(v) == dims:
            m[i] = v
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=(size > 0) | np.isnan(size))


def _tiled_top(queries: DataFrame, rows: DataFrame, k: int, least: float | None) -> DataFrame:
    """query, id, sim: of each tile of up to about QUERY_TILE queries and ROW_TILE rows the k nearest of each query, in the order of top_k."""
    kind = rows.schema["id"].dataType.simpleString()
    across, down = (-(-max(x.count(), 1) // size) for x, size in ((queries, QUERY_TILE), (rows, ROW_TILE)))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c)).alias("vec")
    own = queries.filter("query is not null").select(cell("query", across).alias("__q"), every(down).alias("__r"), F.lit(True).alias("__own"), F.col("query").cast(kind).alias("id"), whole("qvec"))
    others = rows.filter("id is not null").select(every(across).alias("__q"), cell("id", down).alias("__r"), F.lit(False).alias("__own"), "id", whole("vec"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        q, r = g[g["__own"]], g[~g["__own"]].sort_values("id")  # so that a stable order leaves ties to the smaller id
        dims = {len(v) for v in q["vec"] if isinstance(v, (list, np.ndarray))}
        ids, out = r["id"].to_numpy(), []
        for d in dims or {0}:
            right = _units(r["vec"], d)
            same = q[[isinstance(v, (list, np.ndarray)) and len(v) == d or (not isinstance(v, (list, np.ndarray)) and d == min(dims, default=0)) for v in q["vec"]]]
            for at in range(0, len(same) if len(ids) else 0, 256):
                part = same.iloc[at : at + 256]
                names = part["id"].to_numpy()
                s = _units(part["vec"], d) @ right.T
                valid = names[:, None] != ids[None, :]
                if least is not None:
                    valid &= ~(s <= least)
                order = -np.round(np.where(np.isnan(s), np.inf, s), 9)
                order[~valid] = np.inf
                top = min(k, len(ids))
                last = np.partition(order, top - 1, axis=1)[:, top - 1]
                for i in range(len(part)):
                    near = np.flatnonzero(valid[i] & (order[i] <= last[i]))
                    near = near[np.argsort(order[i][near], kind="stable")[:k]]
                    out.append(pd.DataFrame({"query": names[i], "id": ids[near], "sim": s[i][near]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "sim": []})

    return own.unionByName(others).groupBy("__q", "__r").applyInPandas(run, f"query {kind}, id {kind}, sim double")


def top_k(queries: DataFrame, rows: DataFrame, k: int, least: float | None = None, planes: list[list[float]] | None = None, flips: int = 0) -> DataFrame:
    """query, rank, id, sim: the k rows nearest by cosine to each query, above least if given; ties to the smaller id.

    queries(query, qvec) against rows(id, vec). With planes, only rows whose bucket is up to flips bits
    from the query's are compared (an equi-join), and the rank is limited before the shuffle by window group limits; without, every query meets every row, so the queries
    must be a stated set: they meet in tiles of matrices, and only a tile's k nearest leave it.
    """
    if planes:
        q = queries.withColumn("__b", F.explode(buckets_near(sign_hash(F.col("qvec"), planes), len(planes), flips)))
        pairs = q.join(rows.withColumn("__b", sign_hash(F.col("vec"), planes)), "__b")
        scored = pairs.filter("query <> id").select("query", "id", cosine(F.col("qvec"), F.col("vec")).alias("sim"))
        scored = scored if least is None else scored.filter(F.col("sim") > least)
    else:
        scored = _tiled_top(queries, rows, k, least)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("sim", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "id", "sim")


def random_planes(count: int, dims: int, seed: int = 0) -> list[list[float]]:
    """Normal directions of hyperplanes through the origin, the same for a seed."""
    import numpy as np

    return np.round(np.random.default_rng(seed).normal(size=(count, dims)), 6).tolist()


class BucketIndex:
    """Vectors by sign-hash bucket in a table below folder, clustered and sorted by bucket: searches join it where it lies, and add() extends it in place.

    The planes are written beside it, so that another session that opens the folder gets the same buckets.
    """

    SCHEMA = "id bigint, vec array<double>, __b int"

    def __init__(self, spark: SparkSession, folder: str, planes: list[list[float]], parts: int) -> None:
        self.spark, self.folder, self.planes, self.parts = spark, folder, planes, parts
        self.name = f"bucket_index_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}"

    @classmethod
    def build(cls, rows: DataFrame, planes: list[list[float]], folder: str | None = None, parts: int | None = None) -> BucketIndex:
        """Of rows (id, vec)."""
        spark = rows.sparkSession
        index = cls(spark, folder or f"{shared_dir(spark)}/bucket-index-{uuid.uuid4().hex}", planes, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.createDataFrame([(json.dumps({"planes": planes, "parts": index.parts}),)], "state string").coalesce(1).write.parquet(f"{index.folder}/planes")
        index._declare()
        index.add(rows)
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> BucketIndex:
        state = json.loads(spark.read.parquet(f"{folder}/planes").first().state)
        index = cls(spark, folder, state["planes"], state["parts"])
        index._declare()
        return index

    def _declare(self) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.SCHEMA}) USING parquet CLUSTERED BY (__b) SORTED BY (__b) INTO {self.parts} BUCKETS LOCATION '{self.folder}/vectors'")

    def add(self, rows: DataFrame) -> None:
        """More rows (id, vec); those of an id that is there already stand beside it. A null vector is in no bucket."""
        dealt = rows.filter("vec is not null").select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        dealt = dealt.withColumn("__b", sign_hash(F.col("vec"), self.planes)).repartition(self.parts, "__b")
        dealt.write.mode("append").bucketBy(self.parts, "__b").sortBy("__b").format("parquet").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def most_similar(self, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
        """As most_similar() of all rows that are in the index."""
        return _most_similar(queries, self.rows(), k, self.planes, least)

    def close(self) -> None:
        """Takes the table out of this session's catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def most_similar(queries: DataFrame, rows: DataFrame, k: int, planes: list[list[float]], least: float | None = None) -> DataFrame:
    """query, rank, id, sim: the k rows nearest by cosine among the buckets nearest to each query's own, above least if given; ties to the smaller id.

    Buckets are taken in order of how many bits they are away: the query's own first, further ones only for queries that have fewer than k hits
    so far, down to the last bucket, so that nobody gets fewer hits than there are. queries(query, qvec) are a stated set against rows(id, vec).
    """
    return _most_similar(queries, rows.withColumn("__b", sign_hash(F.col("vec"), planes)), k, planes, least)


def _most_similar(queries: DataFrame, dealt: DataFrame, k: int, planes: list[list[float]], least: float | None) -> DataFrame:
    """dealt: id, vec and bucket __b."""
    bits = len(planes)
    own = queries.withColumn("__own", sign_hash(F.col("qvec"), planes))
    found, open_ = None, own
    for away in range(bits + 1):
        masks = [m for m in range(1 << bits) if bin(m).count("1") == away]
        near = open_.withColumn("__b", F.explode(F.array(*[F.col("__own").bitwiseXOR(F.lit(m)) for m in masks])))
        hits = near.join(dealt, "__b").filter("query <> id").select("query", "id", cosine(F.col("qvec"), F.col("vec")).alias("sim"))
        hits = stored(hits if least is None else hits.filter(F.col("sim") > least), "most-similar")
        found = hits if found is None else found.union(hits)
        enough = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("query")
        open_ = stored(open_.join(enough, "query", "left_anti"), "most-similar-open")
        if open_.isEmpty():
            break
    w = Window.partitionBy("query").orderBy(F.desc(F.round("sim", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "id", "sim")


def attached(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """tokens with vec of table(word, vec): that of the form, else of the lemma, else null; by_lemma tells the second case."""
    out = tokens.join(table.select(F.col("word").alias("text"), F.col("vec").alias("__form")), "text", "left")
    out = out.join(table.select(F.col("word").alias("lemma"), F.col("vec").alias("__lemma")), "lemma", "left")
    return out.withColumns({"vec": F.coalesce("__form", "__lemma"), "by_lemma": F.col("__form").isNull() & F.col("__lemma").isNotNull()}).drop("__form", "__lemma")


def mean_similarity(same: Column, pairs: list[tuple[Column, Column]]) -> Column:
    """Mean cosine over models, each a pair of vectors; equal elements are 1 alike, whatever their vectors."""
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + cosine(a, b)
    return F.when(same, 1.0).otherwise(total / len(pairs))
