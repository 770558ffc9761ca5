"""Nearest neighbours by additive quantisation: beam-search encoding, lookup-table scoring, exact reranking.

A vector is stored as the sum of one codeword from each of CODEBOOKS codebooks of full dimension, each learned on
the residuals that the codebooks before it leave; a beam search keeps the BEAM best partial sums. Codes and the squared norm of the sum are the index.
A query's inner products with all codewords make a lookup table, so that a candidate's score is a sum of
table entries; for Euclidean distance the stored norm joins it. The best SHORTLIST of a block are then scored exactly, in double precision.

Codebooks are fitted on the driver on at most SAMPLE_ROWS vectors in hash order of their ids; every vector is indexed.
Equal vectors are one index entry with the smallest ids that can be asked for, so that a
vector that a third of all rows repeat neither crowds out a shortlist nor makes a hot group.

Queries meet candidates in blocks: the index is dealt into blocks of at most about INDEX_ROWS rows (codes and vectors), the queries into blocks of about
QUERY_ROWS; each pair of blocks is one bounded task, which scores, reranks and leaves only the exact best of each query. Blocks of the index are
at least as many as shuffle partitions, so that small tables are worked on in parallel too.

Defined cases: null and empty vectors, those with null or non-finite components and zero vectors take no part; vectors meet those of their own length
only, as no inner product is defined between lengths; lengths other than the most frequent (the greatest of equally frequent) one have no codebooks and are
compared exactly, in the same blocks; a query id that occurs in several rows asks once for each of its distinct vectors, and never finds its own id; ties go to
the smaller id; fewer candidates than asked for are all returned; without vectors the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .common import hash_sample

SAMPLE_ROWS, CODEBOOKS, CODEWORDS, BEAM, ROUNDS = 4096, 24, 256, 4, 8
SHORTLIST, TOP = 400, 20
QUERY_ROWS, INDEX_ROWS = 8192, 65_536
#: Rows below which a block of the index isn't split for the sake of parallel work.
LEAST_ROWS = 2048
EVERY = 20


@dataclass
class Quantizer:
    """books [codebook, codeword, dimension], in the precision that scores are computed in."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes [rows, codebooks] and squared norms of the sums they stand for."""
        codes, norms = [np.zeros((0, len(self.books)), np.uint8)], [np.zeros(0, np.float32)]
        for i in range(0, len(x), 1024):
            c, n = self._encode(x[i : i + 1024].astype(np.float32), beam)
            codes.append(c)
            norms.append(n)
        return np.concatenate(codes), np.concatenate(norms)

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        left, path = x[:, None, :], np.zeros((len(x), 1, 0), np.uint8)
        for book in self.books:
            # squared residual after each codeword: |r|^2 - 2 r.c + |c|^2
            cost = (left**2).sum(-1)[..., None] - 2 * left @ book.T + (book**2).sum(-1)
            flat = cost.reshape(len(x), -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            parent, word = best // len(book), best % len(book)
            left = np.take_along_axis(left, parent[..., None], 1) - book[word]
            path = np.concatenate([np.take_along_axis(path, parent[..., None], 1), word[..., None].astype(np.uint8)], axis=2)
        which = (left**2).sum(-1).argmin(axis=1)
        rows = np.arange(len(x))
        return path[rows, which], ((x - left[rows, which]) ** 2).sum(-1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products [queries, codebook, codeword]."""
        return np.einsum("qd,mkd->qmk", queries.astype(np.float32), self.books)


def fit(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = ROUNDS) -> Quantizer:
    """Codebooks by k-means on residuals, one after the other, from a fixed seed."""
    rng, left, books = np.random.default_rng(0), x.astype(np.float32), []
    k = min(codewords, len(x))
    for _ in range(codebooks):
        book = left[rng.choice(len(left), k, replace=False)].copy()
        for _ in range(rounds):
            near = ((book**2).sum(-1) - 2 * left @ book.T).argmin(axis=1)
            count = np.bincount(near, minlength=k)
            sums = np.zeros_like(book)
            np.add.at(sums, near, left)
            book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], left[rng.choice(len(left), k)])
        left = left - book[((book**2).sum(-1) - 2 * left @ book.T).argmin(axis=1)]
        books.append(book)
    return Quantizer(np.stack(books).astype(np.float32))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, dims of the vectors that take part; embedding stays single precision if it is."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("embedding")
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), F.size("embedding").alias("dims")).filter("vec_id is not null and dims > 0")
    return rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def exact(x: np.ndarray, q: np.ndarray, euclidean: bool = False) -> np.ndarray:
    """The measure of each row of x, added up from the first component to the last: inner product, or the squared distance as a negative number."""
    return -((x - q) ** 2).cumsum(axis=1)[:, -1] if euclidean else (x * q).cumsum(axis=1)[:, -1]


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP, shortlist: int = SHORTLIST, euclidean: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the top nearest by inner product of each row whose id is divisible by every.

    With euclidean, nearest by distance instead, score being the squared distance as a negative number. A shortlist as long as a block (INDEX_ROWS) makes the search exact.
    """
    spark = vectors.sparkSession
    rows = valid(vectors).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    rows = stored(rows, "ann-vectors")
    one = ["h1", "h2", "embedding"]
    entries = stored(rows.groupBy("dims", *one).agg(F.min("vec_id").alias("entry"), F.count(F.lit(1)).alias("n")), "ann-entries")
    queries = stored(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "dims", "embedding").distinct(), "ann-queries")
    lengths = entries.groupBy("dims").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("rows"), F.desc("dims")).first()
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, n_entries, n_queries = lengths.dims, entries.count(), queries.count()
    usual = entries.filter(F.col("dims") == dims)
    sample = hash_sample(usual, F.col("entry"), SAMPLE_ROWS, lengths.n).orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE_ROWS).select("embedding").collect()
    if not sample:  # so few that none falls below the threshold
        sample = usual.orderBy("entry").limit(SAMPLE_ROWS).select("embedding").collect()
    shared = spark.sparkContext.broadcast(fit(np.array([r.embedding for r in sample])))  # codebooks only: a fixed size

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits = (b["dims"] == dims).to_numpy()
            codes, norms = shared.value.encode(np.stack(b["embedding"][fits].to_list()) if fits.any() else np.zeros((0, dims)))
            b["codes"], b["norm"] = None, np.float32(0)
            b.loc[fits, "codes"] = pd.Series([c.tobytes() for c in codes], b.index[fits], dtype=object)
            b.loc[fits, "norm"] = norms
            yield b

    kind = entries.schema["embedding"].dataType.simpleString()
    index = stored(entries.select("dims", "entry", "embedding").mapInPandas(encoded, f"dims int, entry bigint, embedding {kind}, codes binary, norm float"), "ann-index")

    def scored(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "entry": [], "score": []}
        if len(q) and len(c):
            c = c.sort_values("entry")
            ids, x = c["entry"].to_numpy(), np.stack(c["embedding"].to_list()).astype(np.float64)
            coded = key[0] == dims and len(x) > shortlist
            codes = np.frombuffer(b"".join(c["codes"]), np.uint8).reshape(len(c), -1).T.astype(np.int64) if coded else None
            norm = c["norm"].to_numpy()
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                v = np.stack(part["embedding"].to_list()).astype(np.float64)
                luts = shared.value.tables(v) if coded else [None] * len(v)
                for query, y, lut in zip(part["query_id"].to_numpy(), v, luts, strict=True):
                    best = np.arange(len(x))
                    if coded:
                        s = lut[0][codes[0]]
                        for m in range(1, len(codes)):
                            s += lut[m][codes[m]]
                        best = np.argpartition(norm - 2 * s if euclidean else -s, shortlist - 1)[:shortlist]
                    score = exact(x[best], y, euclidean)
                    order = np.lexsort((ids[best], -score))[: top + 1]
                    out["query_id"].append(np.full(len(order), query))
                    out["entry"].append(ids[best][order])
                    out["score"].append(score[order])
        return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}).astype({"query_id": "int64", "entry": "int64", "score": "float64"})

    index_blocks = max(-(-n_entries // INDEX_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_entries // LEAST_ROWS)))
    query_blocks = max(1, -(-n_queries // QUERY_ROWS))
    deal = lambda df, key, name, n: df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["dims", "qb", "ib"]
    q = deal(queries, "query_id", "qb", query_blocks).withColumn("ib", all_of(index_blocks))
    c = deal(index, "entry", "ib", index_blocks).withColumn("qb", all_of(query_blocks))
    found = q.groupBy(*cell).cogroup(c.groupBy(*cell)).applyInPandas(scored, "query_id bigint, entry bigint, score double")

    # entries beyond the top by score can't hold an answer: each has at least one id, and one of them may be the query's own
    by_entry = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    kept = found.groupBy("query_id", "entry").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(by_entry)).filter(F.col("r") <= top + 1).drop("r")
    # an entry of several rows stands for its smallest ids: one more than asked for, as a query may be among them
    several = rows.join(entries.filter("n > 1").select(*one, "entry"), one).select("entry", "vec_id")
    several = several.withColumn("k", F.row_number().over(Window.partitionBy("entry").orderBy("vec_id"))).filter(F.col("k") <= top + 1).drop("k")
    pairs = kept.join(several, "entry", "left").withColumn("vec_id", F.coalesce("vec_id", "entry")).filter("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
