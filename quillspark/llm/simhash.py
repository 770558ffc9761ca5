"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: the four-word shingles of a text, repeats included, are hashed to 64 bits; a bit of the fingerprint
is 1 if it is set in over half of the hashes. Equal fingerprints are one node from here on, represented by their
smallest id. Nodes are then compared exactly, in tiles of numpy arrays, by exclusive-or and bit count; a pair of
tiles whose population counts differ by more than the radius is skipped, as are such tile pairs already when rows are
dealt out.

Which tiles meet: two fingerprints within radius r agree in at least one of r + 1 disjoint bit blocks, so each node
is dealt to r + 1 groups, one for each block and the value of its bits there, and only nodes of one group are
compared. This loses no pair. A group of more than TILE_ROWS nodes is split into tiles in order of population count (and by hash, where one
count has more nodes than a tile), each pair of its tiles within the radius is a cell of its own, and a node goes to every cell its tile is part of.

Inside a cell, linked nodes are joined at once and only a forest of links (fewer than its nodes) leaves it, however
many pairs are linked. The forests' union has the same components as all links; these are found by
distributed star contraction. Nothing is collected on the driver.

Defined cases: null, empty and blank texts have fingerprint 0 and are linked like any other; fewer words than a shingle
make one shingle of all of them; rows with equal ids keep a row each and aren't linked by their id, only by their fingerprints; a null id
stands in no component of its own (component_id is the smallest id of rows with its fingerprint's links, or null); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.tables import stored
from .common import map_batches

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE_ROWS, TILE = 4096, 1024
#: A-Z to a-z, and ASCII white space to spaces.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
#: For each byte, its bits spread over the eight bytes of a word: sums of up to 255 of them don't overflow.
SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - k] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """As an unsigned number."""
    h = shingle_hashes(text, k)
    if not len(h):
        return 0
    chunks = np.arange(0, len(h), 255)
    columns = h.view(np.uint8).reshape(-1, 8)
    out = 0
    for i in range(8):
        counts = np.add.reduceat(SPREAD[columns[:, i]], chunks).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for bit in np.flatnonzero(counts * 2 > len(h)).tolist():
            out |= 1 << 8 * i + bit
    return out


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def row(doc_id: int, text: str | None) -> Iterator[tuple]:
        f = fingerprint(text, k)
        yield doc_id, f - (1 << 64) if f >> 63 else f

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), "doc_id bigint, fp bigint", lambda: row)


def forest(fps: np.ndarray, side: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """Index pairs that join what is linked among fps: one for each merge, so fewer than there are fps.

    side tells the two tiles of a cell apart; only pairs across are compared then.
    """
    ones = np.bitwise_count(fps).astype(np.int16)
    order = np.argsort(ones, kind="stable")
    fps, ones, root = fps[order], ones[order], np.arange(len(fps))
    side = None if side is None else side[order]
    for a in range(0, len(fps), TILE):
        for b in range(a, len(fps), TILE):
            if ones[b] - ones[min(a + TILE, len(fps)) - 1] > radius:
                break  # population counts differ beyond the radius, here and in all later tiles
            near = np.bitwise_count(fps[a : a + TILE, None] ^ fps[None, b : b + TILE]) <= radius
            if side is not None:
                near &= side[a : a + TILE, None] != side[None, b : b + TILE]
            elif a == b:
                near = np.triu(near, 1)
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                js = b + np.flatnonzero(near[i])
                i += a
                js = js[root[js] != root[i]]
                while len(js):
                    j = js[0]
                    yield int(order[i]), int(order[j])
                    root[root == root[j]] = root[i]
                    js = js[root[js] != root[i]]


def heavy_tiles(dealt: DataFrame, tile_rows: int) -> DataFrame:
    """b, v, counts (ones, tile, parts) and tiles (tile, low, high, parts) of the groups of dealt(b, v, ones) with more than tile_rows nodes.

    Nodes are put in order of population count; each tile_rows of them begin a tile, which then spans the counts low to high. A count with more
    nodes than that is split by hash into parts. Both lists are bounded: 65 counts, and as many tiles.
    """
    group = Window.partitionBy("b", "v")
    n = dealt.groupBy("b", "v", "ones").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(group)).filter(F.col("all") > tile_rows)
    before = F.coalesce(F.sum("n").over(group.orderBy("ones").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select("b", "v", "ones", F.floor(before / tile_rows).alias("tile"), F.ceil(F.col("n") / tile_rows).cast("int").alias("parts"))
    spans = n.groupBy("b", "v", "tile").agg(F.min("ones").alias("low"), F.max("ones").alias("high"), F.max("parts").alias("parts"), F.collect_list(F.struct("ones", "tile", "parts")).alias("counts"))
    return spans.groupBy("b", "v").agg(F.flatten(F.collect_list("counts")).alias("counts"), F.collect_list(F.struct("tile", "low", "high", "parts")).alias("tiles"))


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """u, v: a forest over the ids of nodes(fp, rep) with the same components as all links."""
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    value = lambda i: F.shiftrightunsigned(F.shiftleft("fp", 64 - edges[i + 1]), 64 - edges[i + 1] + edges[i])
    dealt = nodes.withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("b"), value(i).alias("v")) for i in range(blocks)]))).select("fp", "rep", F.bit_count("fp").alias("ones"), "k.b", "k.v")
    tiles = heavy_tiles(dealt, tile_rows)
    tiled = dealt.join(tiles, ["b", "v"], "left")
    mine = F.filter("counts", lambda x: x["ones"] == F.col("ones"))[0]
    own = F.struct(mine["tile"].alias("tile"), F.pmod(F.xxhash64("fp"), mine["parts"]).cast("int").alias("part"))
    span = F.filter("tiles", lambda x: x["tile"] == mine["tile"])[0]
    # the cells of a tile: itself with every tile that has a population count within the radius of one of its own, the lesser tile first
    near = F.filter("tiles", lambda x: (x["low"] - span["high"] <= radius) & (span["low"] - x["high"] <= radius))
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda p: F.struct(x["tile"].alias("tile"), p.alias("part")))))
    cells = F.when(F.col("tiles").isNull(), F.array(F.struct(F.lit("").alias("cell"), F.lit(None).cast("int").alias("side")))).otherwise(
        F.transform(others, lambda t: F.struct(F.concat_ws(",", F.least(t, own)["tile"], F.least(t, own)["part"], F.greatest(t, own)["tile"], F.greatest(t, own)["part"]).alias("cell"), F.when(t == own, None).otherwise((t < own).cast("int")).alias("side")))
    )
    rows = tiled.withColumn("c", F.explode(cells)).select("b", "v", "c.cell", "c.side", "fp", "rep").repartition("b", "v", "cell").sortWithinPartitions("b", "v", "cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def joined(t: pa.Table) -> pa.RecordBatch:
            b, v, fp, rep = (t.column(c).to_numpy() for c in ("b", "v", "fp", "rep"))
            cell = t.column("cell").combine_chunks().dictionary_encode().indices.to_numpy()
            side = t.column("side").fill_null(-1).to_numpy()
            cuts = np.flatnonzero((b[1:] != b[:-1]) | (v[1:] != v[:-1]) | (cell[1:] != cell[:-1])) + 1
            us, vs = [], []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                if j - i > 1:
                    for x, y in forest(fp[i:j].view(np.uint64), None if side[i] < 0 else side[i:j], radius):
                        us.append(rep[i + x])
                        vs.append(rep[i + y])
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        key = lambda t, i: tuple(t.column(c)[i].as_py() for c in ("b", "v", "cell"))
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if held and key(held[-1], held[-1].num_rows - 1) != key(t, 0):
                yield joined(pa.concat_tables(held))
                held = []
            if key(t, 0) != key(t, t.num_rows - 1):  # all but the last cell of this batch is complete
                last, k = t.num_rows - 1, key(t, t.num_rows - 1)
                low = 0
                while low < last:  # the first row of the last cell
                    mid = (low + last) // 2
                    low, last = (low, mid) if key(t, mid) == k else (mid + 1, last)
                yield joined(pa.concat_tables([*held, t.slice(0, low)]))
                held, t = [], t.slice(low)
            held.append(t)
        if held:
            yield joined(pa.concat_tables(held))

    return rows.mapInArrow(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row."""
    marked = stored(fingerprints(docs), "simhash")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = connected_components(links(nodes.filter("rep is not null"), radius))
    of = nodes.join(found, nodes["rep"] == found["node"], "left").select(nodes["fp"].alias("fp_"), F.coalesce("component", "rep").alias("component_id"))
    out = marked.join(of, F.col("fp") == F.col("fp_"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
