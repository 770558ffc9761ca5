"""Product codes of vectors by delta-maintained Lloyd rounds in whole numbers.

A vector's components become floor(SCALE * x) and are cut into PARTS equal consecutive parts; each part position has a codebook of up
to ENTRIES entries. A round assigns every part to the nearest entry and moves each entry to the floored mean of its parts.

What lasts between rounds is kept below one folder: the vectors (bucketed by row, written once), the assignments of the last
round (bucketed likewise, so that they meet their vectors without a shuffle) and, for each entry, the running count and sum of its parts,
as whole numbers. A round reads vectors and previous assignments, and writes the new assignments together with what has changed:
a part that moves from entry a to entry b counts as minus in a and plus in b. Tasks add these contributions up before they are written, so
the only shuffle of a round carries at most PARTS * ENTRIES rows a task, and none for what stays. Whole-number sums don't depend on the order of additions,
so they equal those of a full recount. A fit can be opened again by its folder and gone on with.

Distances are exact: in doubles while every partial sum is below 2^52, else in 64-bit integers.

Defined cases: a vector that is null or holds null or non-finite components takes no part; nor does one with a component of magnitude LIMIT or more, whose
squared distances needn't fit a long, nor one whose length isn't that of the vector of smallest id or isn't a positive multiple of PARTS. Rows of
equal ids have a row each in the result; where ids are equal, the lesser components come first into the codebook; rows without id come
last. Fewer vectors than ENTRIES make a smaller codebook. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components from this magnitude on take no part.
LIMIT = 65_536
#: Vectors compared with a codebook at a time.
BLOCK = 2048


def whole(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label, v (floored whole numbers) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    ok = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LIMIT), F.lit(False))) & (F.size(x) > 0) & (F.size(x) % parts == 0)
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    return vectors.filter(x.isNotNull() & ok).select("vec_id", label.alias("label"), F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of whole-number rows: index of the nearest row of book (the lower one of equals) and the squared distance to it."""
    widest = int(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0))) + 1
    index, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    exact = 4 * widest * widest * parts.shape[1] < 1 << 52
    for at in range(0, len(parts), BLOCK):
        p = parts[at : at + BLOCK]
        if exact:
            x, c = p.astype(np.float64), book.astype(np.float64)
            d = (c * c).sum(1)[None] - 2 * (x @ c.T)
            best = d.argmin(1)
            own = (x * x).sum(1) + d[np.arange(len(p)), best]
        else:
            d = np.stack([((p - c) ** 2).sum(1) for c in book], 1)
            best = d.argmin(1)
            own = d[np.arange(len(p)), best]
        index[at : at + BLOCK], error[at : at + BLOCK] = best, own
    return index, error


class DeltaLloyd:
    """A fit below folder: vectors, the last assignments, counts and sums of entries, codebooks. Rounds go on from what is there."""

    def __init__(self, spark: SparkSession, folder: str, parts: int, books: np.ndarray, counts: np.ndarray, sums: np.ndarray, step: int, buckets: int) -> None:
        #: books and sums: parts x entries x width; counts: parts x entries
        self.spark, self.folder, self.parts, self.books, self.counts, self.sums, self.step, self.buckets = spark, folder, parts, books, counts, sums, step, buckets

    @classmethod
    def start(cls, vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, buckets: int | None = None, folder: str | None = None) -> DeltaLloyd | None:
        """Writes vectors (vec_id, label, v), those of the ruling length, with a row number each; None if there are none."""
        spark = vectors.sparkSession
        numbered = stored(vectors.withColumn("row", F.monotonically_increasing_id()), "lloyd-rows")  # numbered once, whoever reads them
        order = [F.col("vec_id").asc_nulls_last(), "v"]
        first = numbered.orderBy(*order).select(F.size("v").alias("n")).first()
        if not first:
            return None
        numbered = numbered.filter(F.size("v") == first.n)
        seeds = np.array([r.v for r in numbered.orderBy(*order).limit(entries).select("v").collect()], np.int64)  # at most so many vectors as a codebook has entries
        folder = folder or f"{shared_dir(spark)}/lloyd-{uuid.uuid4().hex}"
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        books = np.stack(np.split(seeds, parts, 1))
        fit = cls(spark, folder, parts, books, np.zeros(books.shape[:2], np.int64), np.zeros_like(books), 0, buckets)
        fit._write(numbered.repartition(buckets, "row"), "vectors")
        return fit

    def _table(self, name: str) -> str:
        return f"lloyd_{hashlib.md5(self.folder.encode()).hexdigest()}_{name}"

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.bucketBy(self.buckets, "row").sortBy("row").option("path", f"{self.folder}/{name}").saveAsTable(self._table(name))

    def _read(self, name: str, schema: str) -> DataFrame:
        """A bucketed table below the folder, declared again where this session doesn't know it."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(name)} ({schema}) USING parquet CLUSTERED BY (row) SORTED BY (row) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(self._table(name))

    VECTORS = "vec_id bigint, label string, v array<bigint>, row bigint"
    ASSIGNED = "row bigint, codes array<smallint>, at array<smallint>, n bigint, total array<bigint>"

    def vectors(self) -> DataFrame:
        return self._read("vectors", self.VECTORS)

    def _joined(self) -> DataFrame:
        """Vectors with their last codes (null before the first round), without a shuffle."""
        rows = self.vectors()
        if not self.step:
            return rows.select("row", "v", F.lit(None).cast("array<smallint>").alias("codes"))
        last = self._read(f"round_{self.step}", self.ASSIGNED).filter("row is not null").select("row", "codes")
        return rows.select("row", "v").join(last, "row")

    def assign(self) -> None:
        """Assigns all parts, writes the new codes and the contributions of those that moved, and brings counts and sums up to date."""
        shared, parts = self.spark.sparkContext.broadcast(self.books), self.parts  # parts x entries x width numbers
        schema = self.ASSIGNED
        arrow = pa.schema([("row", pa.int64()), ("codes", pa.list_(pa.int16())), ("at", pa.list_(pa.int16())), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            _, entries, width = books.shape
            counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                v = b.column("v").flatten().to_numpy().reshape(b.num_rows, parts, width)
                codes = np.stack([nearest(v[:, p], books[p])[0] for p in range(parts)], 1)
                old = b.column("codes")
                before = np.full_like(codes, -1) if old.null_count else old.flatten().to_numpy().reshape(codes.shape)
                for p in range(parts):
                    moved = np.flatnonzero(codes[:, p] != before[:, p])
                    for sign, entry in ((1, codes[moved, p]), (-1, before[moved, p])):
                        known = entry >= 0
                        np.add.at(counts[p], entry[known], sign)
                        np.add.at(sums[p], entry[known], sign * v[moved[known], p])
                codes = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * parts, pa.int32()), pa.array(codes.astype(np.int16).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("row"), codes, pa.nulls(b.num_rows, arrow.field(2).type), pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, arrow.field(4).type)], schema=arrow)
            p, e = np.nonzero((counts != 0) | (sums != 0).any(2))
            if len(p):
                rows = [[None] * len(p), [None] * len(p), [list(x) for x in zip(p.tolist(), e.tolist(), strict=True)], counts[p, e].tolist(), sums[p, e].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, arrow.types, strict=True)], schema=arrow)

        self._write(self._joined().mapInArrow(run, schema), f"round_{self.step + 1}")
        self.step += 1
        moved = self._read(f"round_{self.step}", schema).filter("row is null").select("at", F.posexplode(F.concat(F.array("n"), "total")).alias("i", "x"))
        for r in moved.groupBy("at", "i").agg(F.sum("x").alias("x")).collect():  # at most the numbers of a codebook
            part, entry = r["at"]
            if r.i:
                self.sums[part, entry, r.i - 1] += r.x
            else:
                self.counts[part, entry] += r.x

    def move(self) -> None:
        """Each entry goes to the floored mean of its parts; unused ones stay."""
        used = self.counts > 0
        self.books = self.books.copy()
        self.books[used] = self.sums[used] // self.counts[used][:, None]

    def save(self) -> str:
        """Writes down what isn't in tables; open() takes the folder that this returns."""
        state = {"parts": self.parts, "step": self.step, "buckets": self.buckets} | {k: getattr(self, k).tolist() for k in ("books", "counts", "sums")}
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state")
        return self.folder

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> DeltaLloyd:
        state = json.loads(spark.read.parquet(f"{folder}/state").first().state)
        arrays = {k: np.array(state.pop(k), np.int64) for k in ("books", "counts", "sums")}
        return cls(spark, folder, **state, **arrays)

    def coded(self) -> DataFrame:
        """vec_id, label, code (two hexadecimal digits a part), error (squared distances to the entries, summed over parts), of the last assignment."""
        shared, parts = self.spark.sparkContext.broadcast(self.books), self.parts
        schema = "vec_id bigint, label string, code string, error bigint"
        rows = self.vectors().join(self._read(f"round_{self.step}", self.ASSIGNED).filter("row is not null").select("row", "codes"), "row")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            for b in batches:
                if b.num_rows:
                    v = b.column("v").flatten().to_numpy().reshape(b.num_rows, parts, -1)
                    codes = b.column("codes").flatten().to_numpy().reshape(b.num_rows, parts).astype(np.int64)
                    error = ((v - books[np.arange(parts)[None], codes]) ** 2).sum((1, 2))
                    text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text), pa.array(error)], names=["vec_id", "label", "code", "error"])

        return rows.select("vec_id", "label", "v", "codes").mapInArrow(run, schema)

    def codebooks_sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def discard(self) -> None:
        """Takes the fit's tables out of the catalogue (files stay in the folder)."""
        for name in ("vectors", *(f"round_{i}" for i in range(1, self.step + 1))):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error (error summed over rows of equal label, nulls together), codebooks_sha256 of each vector that takes part."""
    spark = vectors.sparkSession
    fit = DeltaLloyd.start(whole(vectors, vector, scale, parts), entries, parts)
    if fit is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    for _ in range(rounds):
        fit.assign()
        fit.move()
    fit.assign()
    coded = stored(fit.coded(), "lloyd-codes")
    fit.discard()
    named = coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")))  # a null label is the empty name
    sums = stored(named.groupBy("__label").agg(F.sum("error").alias("label_error")), "lloyd-labels")
    return named.join(sums, "__label").select("vec_id", "code", "error", "label_error", F.lit(fit.codebooks_sha256()).alias("codebooks_sha256"))
