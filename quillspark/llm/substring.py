"""Removal of passages that an earlier document has already, by a log-structured fingerprint index.

A window is WINDOW consecutive words. Every word that is covered by a window whose word sequence also starts in a
document of smaller id goes. The index doesn't hold all windows but their anchors: of each window the least hash of
its GRAM-word grams. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so some 7 % of the
windows are left to index, and no shared window is missed.

The index is log-structured. Documents come in batches of ascending ids; the anchors of a batch, with their
first and last document, are written as one sorted immutable run, hashed into buckets. Each new batch is merge-joined with
the runs before it, bucket by bucket, without shuffling history again; anchors found there, or twice in the
batch, are hits. Once there are FAN_IN runs they are merged into one, which the batches after it are joined with. An index can be saved, opened
in another session and gone on with. Hits are verified: the windows under a hit, in
the documents that have it, are compared by 128-bit hashes of their fifty words, and the first document of each
window is found exactly, among all of them.

Documents with equal word sequences are settled before: all but the first go as a whole (if they have a window).

Hot passages: firsts are found by aggregations that combine before the shuffle, and handed back by joins that Spark
can split. Lists are gathered by document as sets, so they are bounded by the document's length, however many equal rows it has.

Defined cases: null, empty and blank texts have no words and keep none (the digest of nothing); a document shorter than
a window keeps all; a repetition inside one document, or between rows of equal id, is no repetition of an earlier document; a
row without id neither loses words nor makes others lose any; equal rows get equal results, one each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, stored
from .common import map_batches
from .windows import BASES, SEEDS, anchors, rolling, word_hashes, words_of

WINDOW, GRAM = 50, 25
BATCHES, FAN_IN = 3, 2
NOTHING = hashlib.sha256(b"").hexdigest()


class FingerprintIndex:
    """Sorted immutable runs of (anchor, first, last): the ids of the first and last document that have an anchor.

    Runs are bucketed tables below folder (by default one of its own in the shared folder). Batches must come in ascending order of ids.
    """

    COLUMNS = "anchor bigint, first bigint, last bigint"

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = FAN_IN, folder: str | None = None) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or f"{shared_dir(spark)}/fingerprint-index-{uuid.uuid4().hex}"
        self.names: list[str] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for n in self.names]

    def _write(self, run: DataFrame) -> str:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        run.repartition(self.buckets, "anchor").write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        """Takes runs out of the catalogue and deletes their files."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
            path.getFileSystem(conf).delete(path, True)

    def add(self, batch: DataFrame, compact: bool = True) -> DataFrame:
        """Adds the anchors of a batch (doc_id, anchor); gives those that an earlier document has too, or two of the batch: anchor, first."""
        before = self.runs
        name = self._write(batch.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
        run = self.spark.table(name)
        out = run.filter("first < last").select("anchor", "first")
        for old in before:
            out = out.union(run.join(old.select("anchor", F.col("first").alias("old")), "anchor").select("anchor", F.col("old").alias("first")))
        self.names.append(name)
        out = stored(out, "fingerprint-hits")
        if compact and len(self.names) >= self.fan_in:
            self.compact()
        return out

    def compact(self) -> None:
        """Merges all runs into one, by full outer merge joins of the sorted buckets where they lie; the old runs go.

        Not by an aggregation over their union: Spark 4.1 plans none of the shuffles that it needs over bucketed scans, and leaves equal anchors apart.
        """
        merged, *rest = self.runs
        for r in rest:
            r = r.toDF("anchor", "__first", "__last")
            merged = merged.join(r, "anchor", "full_outer").select("anchor", F.least("first", "__first").alias("first"), F.greatest("last", "__last").alias("last"))
        old, self.names = self.names, [self._write(merged)]
        self._drop(old)

    def save(self) -> str:
        """Writes down which runs the index has; open() takes the folder that this returns."""
        self.spark.createDataFrame([(n, self.buckets) for n in self.names], "run string, buckets int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/runs")
        return self.folder

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fan_in: int = FAN_IN) -> FingerprintIndex:
        """A saved index, also of a session that is gone."""
        found = spark.read.json(f"{folder}/runs", schema="run string, buckets int").orderBy("run").collect()  # one row for each run
        index = cls(spark, found[0].buckets if found else None, fan_in, folder)
        for r in found:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {r.run} ({cls.COLUMNS}) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {r.buckets} BUCKETS LOCATION '{folder}/{r.run}'")
            index.names.append(r.run)
        return index

    def discard(self) -> None:
        self._drop(self.names)
        self.names = []


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text, which tells rows of one id apart), n_words, sha256 of the words, distinct anchors."""

    def row(doc_id: int, key: int, text: str | None) -> Iterator[tuple]:
        words = words_of(text)
        found = np.unique(anchors(word_hashes(words), WINDOW, GRAM)).view(np.int64) if len(words) >= WINDOW else np.zeros(0, np.int64)
        yield doc_id, key, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), found

    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    return map_batches(rows, "doc_id bigint, row bigint, n_words bigint, sha string, anchors array<bigint>", lambda: row, lambda r: 128 + r[-1].nbytes)


def _windows(texts: DataFrame) -> DataFrame:
    """Windows under a hit: their 128-bit hash (w1, w2), where they start, and whether an earlier document has their anchor."""

    def row(doc_id: int, key: int, text: str, hits: np.ndarray, earlier: np.ndarray) -> Iterator[tuple]:
        words = words_of(text)
        x = word_hashes(words, SEEDS[0])
        if len(x) < WINDOW:
            return
        order = np.argsort(hits)
        hits, earlier = hits[order], earlier[order].astype(bool)
        a = anchors(x, WINDOW, GRAM).view(np.int64)
        place = np.minimum(np.searchsorted(hits, a), len(hits) - 1)
        at = np.flatnonzero(hits[place] == a)
        w1, w2 = rolling(x, WINDOW, BASES[0]).view(np.int64)[at].tolist(), rolling(word_hashes(words, SEEDS[1]), WINDOW, BASES[1]).view(np.int64)[at].tolist()
        yield from ((p, q, doc_id, key, i, e) for p, q, i, e in zip(w1, w2, at.tolist(), earlier[place[at]].tolist(), strict=True))

    return map_batches(texts, "w1 bigint, w2 bigint, doc_id bigint, row bigint, at int, earlier boolean", lambda: row)


def covered(n: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words a window that starts at one of starts covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + window, n), -1)
    return np.cumsum(d[:-1]) > 0


def repeated_passages(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, row, n_words, n_removed, kept_sha256, kept of each row; kept is the words left, joined by one space, of rows that lost some, else null."""
    spark = docs.sparkSession
    all_ = stored(profiles(docs), "substring-profiles", compression="zstd")
    long = all_.filter((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    copies = long.groupBy("sha").agg(F.min("doc_id").alias("original"), F.max("doc_id").alias("last_copy")).filter("original < last_copy").select("sha", "original")
    copies = stored(copies, "substring-copies")  # read again, so that the joins have shuffles of their own, which AQE can split
    known = all_.drop("anchors").join(copies, "sha", "left").withColumn("copy", F.coalesce((F.col("original") < F.col("doc_id")) & (F.col("n_words") >= WINDOW), F.lit(False)))
    known = stored(known.select("doc_id", "row", "n_words", "sha", "copy"), "substring-known")
    single = long.join(copies, "sha", "left").filter("original is null or original = doc_id").select("doc_id", "row", F.explode("anchors").alias("anchor"))

    cuts = known.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or [] if batches > 1 else []
    bounds = [None, *sorted(set(cuts)), None]
    hits, index = None, FingerprintIndex(spark)
    try:
        for at, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
            batch = single
            batch = batch if low is None else batch.filter(F.col("doc_id") > low)
            batch = batch if high is None else batch.filter(F.col("doc_id") <= high)
            found = index.add(batch, compact=at + 2 < len(bounds))
            hits = found if hits is None else hits.union(found)
    finally:
        index.discard()  # hits are written; nothing below reads the runs

    hits = stored(hits.groupBy("anchor").agg(F.min("first").alias("first")), "substring-hits")
    # sets, since equal rows of one id bring the same anchors: what is gathered is bounded by one document
    of_row = single.join(hits, "anchor").groupBy("doc_id", "row").agg(F.collect_set(F.struct("anchor", (F.col("first") < F.col("doc_id")).alias("earlier"))).alias("found"))
    of_row = of_row.select("doc_id", "row", F.col("found.anchor").alias("hits"), F.col("found.earlier").alias("earlier"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.col("text").cast("string"))
    texts = stored(rows.join(of_row, ["doc_id", "row"]), "substring-texts", compression="zstd")
    windows = _windows(texts.dropDuplicates(["doc_id", "row"]).select("doc_id", "row", "text", "hits", "earlier"))
    firsts = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("w1", "w2", "first")
    firsts = stored(firsts, "substring-firsts")
    starts = windows.filter("earlier").join(firsts, ["w1", "w2"]).filter("first < doc_id").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("starts"))

    def cut(doc_id: int, key: int, text: str, starts: np.ndarray) -> Iterator[tuple]:
        words = words_of(text)
        gone = covered(len(words), starts)
        kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
        yield doc_id, key, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8")

    schema = "doc_id bigint, row bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    changed = map_batches(texts.select("doc_id", "row", "text").join(starts, ["doc_id", "row"]), schema, lambda: cut, lambda r: 128 + len(r[-1]))
    changed = stored(changed, "substring-changed", compression="zstd")
    whole = known.filter("copy").select("doc_id", "row", "n_words", F.col("n_words").alias("n_removed"), F.lit(NOTHING).alias("kept_sha256"), F.lit("").alias("kept"))
    same = known.filter("not copy").join(changed.select("doc_id", "row").distinct(), ["doc_id", "row"], "left_anti")
    same = known.filter("not copy and doc_id is null").unionByName(same.filter("doc_id is not null"))
    return changed.unionByName(whole).unionByName(same.select("doc_id", "row", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept")))


def deduplicated(docs: DataFrame, **options: int) -> DataFrame:
    """docs with repeated passages cut out of their texts; documents of which nothing is left go. Columns unchanged."""
    found = repeated_passages(docs, **options).filter("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("kept").alias("__kept")).distinct()
    joined = docs.join(found, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__row")), "left").filter("__kept is null or __kept <> ''")
    out = joined.withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
