"""Cohesion of a document's parts, and the cohesion graph: its edges, their filter and the nodes' importance.

Similarities of elements are cosines of summed word vectors; an element without a vector has similarity 0 with others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import cosine, dot, pooled, unit

SMOOTHING = 1e-5
OVERLAPS = {"content": ("ADJ", "ADV", "NOUN", "VERB"), "topic": ("NOUN", "VERB"), "argument": ("NOUN", "PRON")}


def adjacent(children: DataFrame, parent: list[str], place: str) -> DataFrame:
    """parent, place, next, sim of each child and the one after it. children: parent, place, vec."""
    w = Window.partitionBy(*parent).orderBy(place)
    rows = children.select(*parent, F.col(place).alias("place"), F.lead(place).over(w).alias("next"), "vec", F.lead("vec").over(w).alias("next_vec"))
    return rows.filter("next is not null").select(*parent, "place", "next", cosine(F.col("vec"), F.col("next_vec")).alias("sim"))


def adjacent_cohesion(children: DataFrame, parent: list[str], place: str) -> DataFrame:
    """Mean similarity of neighbours; 0 with fewer than two children."""
    every = children.select(*parent).distinct()
    found = adjacent(children, parent, place).groupBy(*parent).agg(F.avg("sim").alias("cohesion"))
    return every.join(found, parent, "left").na.fill(0.0, ["cohesion"])


def mutual_cohesion(children: DataFrame, parent: list[str], dims: int) -> DataFrame:
    """Mean similarity over all pairs of children; 1 with fewer than two.

    The sum over pairs is that of unit vectors: (|sum u|^2 - m) / 2 with m the children that have a vector, so no pair is ever formed.
    """
    u = children.select(*parent, unit(F.col("vec")).alias("vec"))
    n = u.groupBy(*parent).agg(F.count(F.lit(1)).alias("n"), F.count("vec").alias("m"))
    sums = pooled(u, parent, dims)
    both = (F.coalesce(dot(F.col("vec"), F.col("vec")), F.lit(0.0)) - F.col("m")) / 2
    return n.join(sums, parent).select(*parent, F.when(F.col("n") < 2, 1.0).otherwise(both / (F.col("n") * (F.col("n") - 1) / 2)).alias("cohesion"))


def end_cohesion(children: DataFrame, parent: list[str], place: str) -> DataFrame:
    """start_end: first against last child; start_mid and mid_end: first (last) against the others, weighted by 1 / distance.

    start_end is null with fewer than two children, the others with fewer than three. Children are numbered without gaps first.
    """
    w = Window.partitionBy(*parent).orderBy(place)
    rows = children.withColumn("k", F.row_number().over(w))
    ends = rows.groupBy(*parent).agg(F.count(F.lit(1)).alias("n"), F.min_by("vec", "k").alias("first"), F.max_by("vec", "k").alias("last"))
    j = rows.join(ends, parent)
    weighted = lambda vec, far: F.sum(F.when(far > 0, cosine(F.col(vec), F.col("vec")) / far)) / F.sum(F.when(far > 0, 1 / far))
    later, earlier = F.col("k") - 1, F.col("n") - F.col("k")
    out = j.groupBy(*parent).agg(F.max("n").alias("n"), F.max(F.when(F.col("k") == F.col("n"), cosine(F.col("first"), F.col("vec")))).alias("se"), weighted("first", later).alias("sm"), weighted("last", earlier).alias("me"))
    return out.select(*parent, F.when(F.col("n") >= 2, F.col("se")).alias("start_end"), F.when(F.col("n") >= 3, F.col("sm")).alias("start_mid"), F.when(F.col("n") >= 3, F.col("me")).alias("mid_end"))


def transition_cohesion(sentences: DataFrame) -> DataFrame:
    """doc_id, block_ix, cohesion: the block's last sentence against the first of the next block.

    Null for the last block and for blocks with fewer than two sentences. sentences: doc_id, block_ix, sent_ix, vec.
    """
    ends = sentences.groupBy("doc_id", "block_ix").agg(F.count(F.lit(1)).alias("n"), F.min_by("vec", "sent_ix").alias("first"), F.max_by("vec", "sent_ix").alias("last"))
    w = Window.partitionBy("doc_id").orderBy("block_ix")
    rows = ends.withColumn("next", F.lead("first").over(w)).withColumn("following", F.lead("block_ix").over(w))
    return rows.select("doc_id", "block_ix", F.when(F.col("following").isNotNull() & (F.col("n") >= 2), cosine(F.col("last"), F.col("next"))).alias("cohesion"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / (SMOOTHING + F.size(F.array_union(a, b)))


def lexical_overlap(annotated: DataFrame, kind: str, window: int = 1) -> DataFrame:
    """doc_id, a, b, overlap: smoothed Jaccard of the lemma sets of sentences up to window places apart in their document.

    annotated: tokens with pos; kind names the parts of speech that count.
    """
    keep = F.when(F.col("pos").isin(*OVERLAPS[kind]), F.col("lemma"))
    sets = annotated.groupBy("doc_id", "block_ix", "sent_ix").agg(F.collect_set(keep).alias("lemmas"))
    w = Window.partitionBy("doc_id").orderBy("block_ix", "sent_ix")
    rows = sets.withColumn("place", F.row_number().over(w))
    near = F.array(*[F.struct((F.col("place") + d).alias("b"), F.lead("lemmas", d).over(w).alias("other")) for d in range(1, window + 1)])
    pairs = rows.withColumn("near", near).select("doc_id", F.col("place").alias("a"), "lemmas", F.explode("near").alias("o")).filter("o.other is not null")
    return pairs.select("doc_id", "a", F.col("o.b").alias("b"), jaccard(F.col("lemmas"), F.col("o.other")).alias("overlap"))


def semantic_edges(elements: DataFrame, window: int) -> DataFrame:
    """doc_id, level, a, b, value: similarity of elements of a level up to window places apart in their document.

    elements: doc_id, level, place (without gaps), vec. Both directions of an edge are one row.
    """
    w = Window.partitionBy("doc_id", "level").orderBy("place")
    near = F.array(*[F.struct(F.lead("place", d).over(w).alias("b"), F.lead("vec", d).over(w).alias("other")) for d in range(1, window + 1)])
    pairs = elements.withColumn("near", near).select("doc_id", "level", F.col("place").alias("a"), "vec", F.explode("near").alias("o")).filter("o.b is not null")
    return pairs.select("doc_id", "level", "a", F.col("o.b").alias("b"), cosine(F.col("vec"), F.col("o.other")).alias("value"))


def filtered_edges(edges: DataFrame, keys: list[str], margin: float = 0.0) -> DataFrame:
    """Edges whose value is above mean + deviation (population) of their keys' edges, plus a margin against rounding.

    Statistics are one small aggregate by keys, joined back; the fact rows shuffle at most once.
    """
    stats = edges.groupBy(*keys).agg((F.avg("value") + F.stddev_pop("value") + margin).alias("limit"))
    return edges.join(stats, keys).filter("value > limit").drop("limit")


def containment_edges(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Similarity of each child with its parent: keys, place, value."""
    return children.join(parents.select(*keys, F.col("vec").alias("parent_vec")), keys).select(*keys, "place", cosine(F.col("vec"), F.col("parent_vec")).alias("value"))


def page_rank(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int, damping: float = 0.85, tolerance: float = 1e-4, most: int = 10_000, start: np.ndarray | None = None) -> np.ndarray:
    """Weighted PageRank of nodes 0..n-1 by power iteration; the mass of nodes without edges is spread evenly."""
    out = np.bincount(src, weight, n)
    share = weight / out[src]
    rank = np.full(n, 1 / n) if start is None else start / start.sum()
    for _ in range(most):
        new = damping * np.bincount(dst, share * rank[src], n)
        new += (damping * rank[out == 0].sum() + 1 - damping) / n
        if np.abs(new - rank).sum() < n * tolerance:
            return new
        rank = new
    raise RuntimeError("PageRank didn't converge")


def importance(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """doc_id, node, importance: PageRank within each document's graph, times its number of nodes.

    A document's graph is one group (bounded by the document), in numpy. nodes: doc_id, node (long); edges: doc_id, u, v, weight, undirected.
    """
    nodes = nodes.toDF(*nodes.columns)

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(n["node"].unique())
        if not len(ids):
            return pd.DataFrame({"doc_id": [], "node": [], "importance": []})
        u, v, w = np.searchsorted(ids, e["u"]), np.searchsorted(ids, e["v"]), e["weight"].to_numpy(float)
        rank = page_rank(np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w]), len(ids), tolerance=tolerance)
        return pd.DataFrame({"doc_id": key[0], "node": ids, "importance": rank * len(ids)})

    return nodes.groupBy("doc_id").cogroup(edges.toDF(*edges.columns).groupBy("doc_id")).applyInPandas(run, "doc_id bigint, node bigint, importance double")
