"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact budgets.

Every document gets a random key (the MD5 of seed and id). Documents are range-sorted by (source, key) and written with the number of
their range; each range sums its sizes per source, these few sums are added up over the ranges before it, and a running
sum inside each (source, range) gives every document the place [before, before + size) in its source. A source with
S words and a budget of B words is read B // S whole times and then up to word B % S of its random order.

Nothing here depends on how many rows one source has: the range sort splits a source over many ranges, and equal rows, which have a place
each in the written sizes. All is DataFrame code; the driver sees one row for each source, to share the targets among them.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last
in order; equal ids get equal keys and are put in order by size and a hash of the row; equal rows are interchangeable; an empty table gives
an empty result; other columns are ignored; sources without words have target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .common import WORD

WEIGHTS = (1, 2, 3)
#: No source, and so no document, is repeated more often than this.
MOST_EPOCHS = 3
#: Copies of one row that are made in one go.
SHARE = 1000


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS, share: float = 1.0) -> dict[str | None, float]:
    """Target words of each source: weights repeat over the sources in code point order, null last.

    The total is shared by weight; a source above most times its size stays there and what it can't use is
    shared again among the others, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    left, open_, out = share * sum(n for _, n in order), dict(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s, n in open_.items() if left * weight[s] / total > most * n]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * open_.pop(s))
        left -= sum(out[s] for s in over)
    return out


def row_hash(docs: DataFrame) -> Column:
    """Tells rows of one id (or without id) apart, unless they are equal."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t != "variant"])


def mix(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS, partitions: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, row (hash of the whole row): how many words of each document the mix takes, repeats counted."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = F.col("source").cast("string")
    named = F.coalesce(F.concat(F.lit("="), source), F.lit(""))  # a null source is the empty name
    sized = stored(docs.select("doc_id", named.alias("source"), text_size(F.col("text")).alias("size"), row_hash(docs).alias("row"), F.monotonically_increasing_id().alias("place")), "mix-sizes")
    totals = {r.source[1:] if r.source else None: int(r.n) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(list(totals.items()), weights, most)
    plan = spark.createDataFrame([("" if s is None else f"={s}", k, float(goal[s]), int(round(goal[s]))) for s, k in totals.items()], "source string, source_size bigint, target double, budget bigint")

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")
    ranges = sized.select("doc_id", "source", "size", "row", "place", key).repartitionByRange(n, "source", "key", "size", "row", "place")
    ranges = stored(ranges.withColumn("part", F.spark_partition_id()), "mix-ranges")  # written, so that a range stays the same whoever reads it
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("source", "part").agg(F.sum("size").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(plan, "source").drop("n")
    inside = Window.partitionBy("source", "part").orderBy("key", "size", "row", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["source", "part"])
    last = F.expr("budget % source_size") - F.col("start") - F.col("inside")
    taken = F.expr("size * (budget div source_size)") + F.greatest(F.lit(0), F.least("size", last))
    name = F.when(F.col("source") != "", F.substr("source", F.lit(2)))
    return placed.select("doc_id", name.alias("source"), "size", "source_size", "target", F.when(F.col("source_size") > 0, taken).otherwise(0).cast("bigint").alias("taken"), "row")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: docs with the rows of each document repeated as often as the mix reads it, columns unchanged.

    The last reading of the document in which a source's budget ends is cut behind its last word taken. Rows meet their plan by id and row hash, so
    the texts are shuffled once. Equal rows are interchangeable and share one plan, which has the few different numbers of words taken and how many of the rows have
    each; one of the rows is kept, dealt out in shares of SHARE copies and repeated.
    """
    ident = lambda row: F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), row.cast("string"))).alias("__key")
    keys = ["__key", "__row"]
    plan = mix(docs, **options).select(ident(F.col("row")), F.col("row").alias("__row"), "size", "taken")
    plan = plan.groupBy(*keys, "size", "taken").agg(F.count(F.lit(1)).alias("n"))
    plan = plan.groupBy(*keys).agg(F.sum("n").alias("__rows"), F.collect_list(F.struct("taken", "size", "n")).alias("__plan")).filter(F.exists("__plan", lambda x: x["taken"] > 0))
    rows = docs.withColumn("__row", row_hash(docs)).withColumn("__key", ident(F.col("__row")))
    joined = rows.join(plan, keys)
    alone = joined.filter("__rows = 1").withColumn("__own", F.col("__plan")[0])
    several = joined.filter("__rows > 1").dropDuplicates(keys).withColumn("__own", F.explode("__plan"))
    shares = F.sequence(F.lit(0), F.floor((F.col("__own.n") - 1) / SHARE).cast("int"))
    several = several.withColumn("__share", F.explode(shares)).repartition(*keys, "__share")
    copies = F.least(F.lit(SHARE), F.col("__own.n") - SHARE * F.col("__share")).cast("int")
    several = several.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__copy", "__share")
    taken, size = F.col("__own.taken"), F.col("__own.size")
    readings = F.transform(F.sequence(F.lit(1), F.ceil(taken / size).cast("int")), lambda k: F.least(size, taken - (k - 1) * size))
    cut = F.when(F.col("__take") == size, F.col("text")).otherwise(F.expr(r"array_join(slice(regexp_extract_all(text, r'" + WORD + r"', 0), 1, cast(__take as int)), ' ')"))
    out = alone.unionByName(several).filter(taken > 0).withColumn("__take", F.explode(readings)).withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
