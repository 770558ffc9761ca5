"""Near-duplicates by HyperMinHash registers, banding, collision-corrected estimates and verification on full sets.

A document's set is its distinct shingles. Each shingle's 64-bit hash falls into one of BUCKETS buckets by its first
bits; of a bucket's least hash the register keeps the number of leading zeros and the MANTISSA bits behind the first one bit, 16 bits
in all. Equal sets are one node from here on, so copies cost nothing. Four neighbouring registers are a band, kept as one long; nodes that
agree in a band (with at least one element in it) are candidates. Two sets of similarity 0.8 agree in a given band with
probability 0.8^4 at least, and so in none of 32 with 0.59^32, or 5 in 100 million.

A candidate pair's similarity is estimated from its registers: of those that either has, the share that is equal, less the collisions expected of
sets of these sizes. Pairs whose estimate is MARGIN standard deviations below the threshold go; all others are verified by the
size of the intersection of their full sets.

No group is expanded into all its pairs. First each member of a band's group meets one node of it, that of least
hash; what is found linked is contracted to components. Only groups of three and more that still hold several components are compared further, and
only across components: a group's nodes are dealt to tiles, those of its most frequent component to tiles of their own, which never meet each
other, and each other pair of tiles is a cell. A pair is looked at in the first band that it shares. A cell first tells which of its nodes
have a partner by the estimate; only those get their full sets, and inside the cell pairs are verified until
they are joined, so that a forest of links leaves it, however many pairs are linked.

Defined cases: documents without words or text have an empty set, are linked with nothing and stand alone (component_id their own id); fewer words than a shingle make one
shingle of all of them; rows of equal ids keep a row each and are linked by their sets only, except that empty ones of one id share its component_id; a
row without id links others as any row does and has component_id the smallest id that it reaches, or null; kept is false for it; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..sources.tables import stored
from .common import map_batches
from .simhash import LOWER
from .windows import BASES, mixed, rolling, word_hashes

SHINGLE, THRESHOLD = 4, 80
#: 2^7 buckets, registers of 6 bits for zeros and 10 of mantissa, 4 registers a band.
BUCKET_BITS, MANTISSA, BAND = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND
#: Standard deviations that an estimate may lie below the threshold before its pair goes unverified.
MARGIN = 6.0
#: Nodes, and elements of their sets, after which a group is split into tiles.
TILE_ROWS, TILE_ELEMENTS = 512, 1 << 20
#: Values compared at a time inside a cell, and nodes up to which cells are compared many at a time.
CHUNK, SMALL_CELL = 1 << 22, 32
#: Words of 64 bits of the map that tells which texts may be wanted.
FILTER_WORDS = 1 << 17


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles, made of their words' hashes."""
    words = text.encode("utf-8").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    x = word_hashes(words)
    return np.unique(rolling(x, k, BASES[0]) if len(x) >= k else mixed(rolling(x, len(x), BASES[0]) + np.uint64(len(x))))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Of ascending distinct 64-bit hashes: for each bucket (zeros + 1) << MANTISSA | mantissa of its least hash, 0 if it has none."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = hashes[first] << np.uint64(BUCKET_BITS)
        # the position of the first one bit, exactly: halves of 32 bits are exact as doubles
        high, low = (rest >> np.uint64(32)).astype(np.float64), (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
        length = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
        zeros = np.minimum(64 - length, 62)
        mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[bucket[first]] = ((zeros + 1).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many registers of disjoint sets of n and m elements are equal by chance.

    The two least values of a bucket have equal zeros with the probability summed up here, and then equal mantissas in one of 2^MANTISSA cases.
    """
    n, m = (np.asarray(x, np.float64)[..., None] for x in (n, m))
    i = np.arange(1, 63)
    low, high = 2.0 ** -(BUCKET_BITS + i), 2.0 ** -(BUCKET_BITS + i - 1)
    falls = lambda k: np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-high))
    return BUCKETS * (falls(n) * falls(m)).sum(-1) * 2.0**-MANTISSA


def estimate(equal: np.ndarray, filled: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity by how many of the filled registers are equal."""
    filled = np.maximum(filled, 1)
    return np.clip((equal - np.minimum(expected_collisions(n, m), filled - equal)) / filled, 0, 1)


def plausible(equal: np.ndarray, filled: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold (0 to 1) by sizes and estimate."""
    spread = MARGIN * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))
    return (estimate(equal, filled, n, m) >= threshold - spread) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)


def profiles(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, d1 and d2 (a digest of the set), bands (BANDS longs of BAND registers each)."""

    def row(doc_id: int, text_hash: int, text: str | None) -> Iterator[tuple]:
        h = shingle_set(text, k)
        digest = xxhash.xxh3_128_digest(h.tobytes())
        d1, d2 = np.frombuffer(digest, np.int64).tolist()
        yield doc_id, text_hash, len(h), d1, d2, registers(h).view(np.int64)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return map_batches(rows, "doc_id bigint, text_hash bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>", lambda: row, lambda _: 8 * BANDS)


def _among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of texts whose hash may be one of wanted's: by a bit map of FILTER_WORDS words, so that few texts are shuffled where few are wanted. The join that follows decides."""
    word = lambda h: F.pmod(F.shiftright(h, 6), F.lit(FILTER_WORDS)).alias("__word")
    bit = lambda h: F.expr(f"shiftleft(1L, cast({h} & 63 AS int))")
    bits = wanted.select(word(F.col("text_hash")), bit("text_hash").alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    met = texts.withColumn("__word", word(F.col("__hash"))).join(F.broadcast(bits), "__word")  # at most FILTER_WORDS rows of two numbers
    return met.filter(F.col("__bits").bitwiseAND(bit("__hash")) != 0).drop("__word", "__bits")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """node, hashes (ascending) of wanted (node, doc_id, text_hash, rows), each of which is a row of docs, or several equal ones if rows is above 1."""

    def row(node: int, text: str | None) -> Iterator[tuple]:
        yield node, shingle_set(text, k).view(np.int64)

    texts = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"), F.col("text").cast("string").alias("text"))
    found = wanted.join(_among(texts, wanted), (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    sets = lambda rows: map_batches(rows.select("node", "text"), "node bigint, hashes array<bigint>", lambda: row, lambda r: 64 + r[1].nbytes)
    return sets(found.filter("rows = 1")).union(sets(found.filter("rows > 1")).dropDuplicates(["node"]))


def _matrix(column: pa.Array, kind: type = np.uint16) -> np.ndarray:
    """A list column of equal lengths as rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1).view(kind)


def plausible_pairs(pairs: DataFrame, threshold: int) -> DataFrame:
    """x, y of pairs (x, y, n, bands, n_, bands_) that the estimate leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p, q = _matrix(b.column("bands")), _matrix(b.column("bands_"))
                filled = ((p | q) > 0).sum(1)
                equal = ((p == q) & (p > 0)).sum(1)
                yield b.select(["x", "y"]).filter(pa.array(plausible(equal, filled, b.column("n").to_numpy(), b.column("n_").to_numpy(), threshold / 100)))

    return pairs.select("x", "y", "n", "bands", "n_", "bands_").mapInArrow(run, "x bigint, y bigint")


class Cell:
    """The nodes of one cell, or of several; side tells a cell's two tiles apart (-1: one tile, all of whose pairs are compared)."""

    def __init__(self, t: pa.Table) -> None:
        number = lambda c: t.column(c).to_numpy()
        self.band, self.node, self.component, self.n = number("band"), number("node"), number("component"), number("n")
        self.side = t.column("side").fill_null(-1).to_numpy()
        bands = _matrix(t.column("bands").combine_chunks(), np.int64)
        self.bands, self.registers = bands.view(np.uint64), bands.view(np.uint16)

    def among(self, i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of index pairs those of different components and tiles, in the first band that they share, that the estimate leaves."""
        for cut in range(0, len(i), CHUNK // BUCKETS):
            x, y = i[cut : cut + CHUNK // BUCKETS], j[cut : cut + CHUNK // BUCKETS]
            apart = (self.component[x] != self.component[y]) & ((self.side[x] < 0) | (self.side[x] != self.side[y]))
            x, y = x[apart], y[apart]
            p, q = self.registers[x], self.registers[y]
            filled, equal = ((p | q) > 0).sum(1), ((p == q) & (p > 0)).sum(1)
            ok = plausible(equal, filled, self.n[x], self.n[y], threshold)
            x, y = x[ok], y[ok]
            same = (self.bands[x] == self.bands[y]) & (self.bands[x] > 0)
            first = same.argmax(1) == self.band[x]
            if first.any():
                yield x[first], y[first]

    def candidates(self, threshold: float, start: int = 0, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All of them in a cell (rows start to end), some rows with all others at a time."""
        index = np.arange(start, len(self.node) if end is None else end)
        left, right = (index, index) if self.side[start] < 0 else (index[self.side[index] == 0], index[self.side[index] == 1])
        step = max(1, CHUNK // BUCKETS // max(1, len(right)))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            i, j = np.repeat(rows, len(right)), np.tile(right, len(rows))
            once = i < j if self.side[start] < 0 else slice(None)
            yield from self.among(i[once], j[once], threshold)

    def of_many(self, starts: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of all cells, which lie one after the other; small ones of equal size are compared together."""
        for size in np.unique(sizes[sizes > 1]).tolist():
            own = starts[sizes == size]
            if size > SMALL_CELL:
                for a in own.tolist():
                    yield from self.candidates(threshold, a, a + size)
            else:
                i, j = np.triu_indices(size, 1)
                yield from self.among((own[:, None] + i[None]).ravel(), (own[:, None] + j[None]).ravel(), threshold)


CELL = ("band", "value", "cell")


def cells(batches: Iterator[pa.RecordBatch], done: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Sends rows sorted by cell through done, whole cells at a time, with the row at which each begins."""
    held: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        codes = [t.column("band").to_numpy(), t.column("value").to_numpy(), t.column("cell").combine_chunks().dictionary_encode().indices.to_numpy()]
        return np.append(0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1)

    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            at = starts(t)
            if at[-1]:
                yield from done(t.slice(0, int(at[-1])), at[:-1])
            held = t.slice(int(at[-1]))
    if held is not None:
        yield from done(held, np.zeros(1, np.int64))


def with_partner(rows: DataFrame, threshold: int) -> DataFrame:
    """band, value, cell, side, node, component of those rows that have a candidate in their cell; one row each, no pairs."""
    columns = ["band", "value", "cell", "side", "node", "component"]

    def found(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ours = np.zeros(t.num_rows, bool)
        for x, y in Cell(t).of_many(starts, np.diff(np.append(starts, t.num_rows)), threshold / 100):
            ours[x] = ours[y] = True
        if ours.any():
            yield from t.select(columns).filter(pa.array(ours)).combine_chunks().to_batches()

    dealt = rows.repartition(*CELL).sortWithinPartitions(*CELL)
    return dealt.mapInArrow(lambda batches: cells(batches, found), "band int, value bigint, cell string, side int, node bigint, component bigint")


def verified(rows: DataFrame, threshold: int) -> DataFrame:
    """u, v: a forest of links between the components of each cell of rows, which have their full sets (hashes)."""

    def found(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell, us, vs = Cell(t), [], []
        column = t.column("hashes").combine_chunks()
        sets = [column[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for i in range(len(column))]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
            _, root = np.unique(cell.component[a:b], return_inverse=True)
            for xs, ys in cell.candidates(threshold / 100, a, b):
                for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                    if root[x - a] != root[y - a] and linked(sets[x], sets[y], threshold):
                        root[root == root[y - a]] = root[x - a]
                        us.append(cell.component[x])
                        vs.append(cell.component[y])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    dealt = rows.repartition(*CELL).sortWithinPartitions(*CELL)
    return dealt.mapInArrow(lambda batches: cells(batches, found), "u bigint, v bigint")


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether 100 * intersection >= threshold * union, of ascending distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def tiled(members: DataFrame) -> DataFrame:
    """Rows of members (node, band, value, component, n) in groups of several components, once for each cell: cell and side added."""
    group = ["band", "value"]
    counts = members.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements"))
    tiles = lambda rows, elements: F.greatest(F.ceil(rows / TILE_ROWS), F.ceil(elements / TILE_ELEMENTS), F.lit(1)).cast("int")
    top = F.max(F.struct("rows", "component", "elements")).alias("top")
    groups = counts.groupBy(*group).agg(top, F.sum("rows").alias("rows"), F.sum("elements").alias("elements"), F.count(F.lit(1)).alias("components")).filter("components > 1 and rows > 2")  # two have met
    groups = groups.select(*group, F.col("top.component").alias("main"), tiles(F.col("top.rows"), F.col("top.elements")).alias("mains"), tiles(F.col("rows") - F.col("top.rows"), F.col("elements") - F.col("top.elements")).alias("others"))
    rows = members.join(stored(groups, "minhash-groups"), group)
    tile = lambda n: F.pmod(F.xxhash64("node", F.lit("tile")), n).cast("int")
    own, each = tile(F.col("others")), lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, a, b, side: F.struct(F.concat_ws(",", F.lit(kind), a, b).alias("cell"), side.cast("int").alias("side"))
    of_main = F.transform(each(F.col("others")), lambda o: cell("m", o, tile(F.col("mains")), F.lit(1)))
    among = F.transform(each(F.col("others")), lambda o: cell("o", F.least(o, own), F.greatest(o, own), F.when(o != own, F.when(own < o, 0).otherwise(1))))
    across = F.transform(each(F.col("mains")), lambda m: cell("m", own, m, F.lit(0)))
    dealt = rows.withColumn("c", F.explode(F.when(F.col("component") == F.col("main"), of_main).otherwise(F.concat(among, across))))
    return dealt.select("node", *group, "component", "n", "c.cell", "c.side")


def set_links(docs: DataFrame, nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """node, component (of nodes; the least node of it) of all nodes that are linked with another."""
    band = ["band", "value"]
    rows = nodes.select("node", F.posexplode("bands").alias(*band)).filter("value <> 0")
    first = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("pivot")
    groups = stored(rows.groupBy(*band).agg(first, F.count(F.lit(1)).alias("members")).filter("members > 1"), "minhash-bands")
    members = stored(rows.join(groups, band), "minhash-members")

    sketches = nodes.select("node", "n", "bands")
    pairs = members.filter("node <> pivot").select(F.col("node").alias("x"), F.col("pivot").alias("y")).distinct()
    pairs = pairs.join(sketches.withColumnRenamed("node", "x"), "x").join(sketches.toDF("y", "n_", "bands_"), "y")
    pairs = stored(plausible_pairs(pairs, threshold), "minhash-plausible")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = stored(nodes.join(wanted.distinct(), "node", "left_semi").select("node", "doc_id", "text_hash", "rows"), "minhash-wanted")
        return stored(full_sets(docs, wanted), "minhash-sets")

    sets = sets_of(pairs.select(F.col("x").alias("node")).union(pairs.select("y")))
    pairs = pairs.join(sets.toDF("x", "a"), "x").join(sets.toDF("y", "b"), "y")
    both = F.size(F.array_intersect("a", "b"))
    links = pairs.filter(100 * both >= threshold * (F.size("a") + F.size("b") - both)).select(F.col("x").alias("u"), F.col("y").alias("v"))
    joined = stored(connected_components(stored(links, "minhash-links")), "minhash-joined")

    own = members.filter("members > 2").select("node", *band).join(nodes.select("node", "n"), "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    dealt = tiled(stored(own, "minhash-components"))
    left = stored(with_partner(dealt.join(sketches.select("node", "bands"), "node"), threshold), "minhash-partners")
    further = sets_of(left.select("node").join(sets.select("node"), "node", "left_anti"))
    more = verified(left.join(sketches, "node").join(sets.union(further), "node"), threshold)
    return connected_components(more.union(joined.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    marked = stored(profiles(docs, k), "minhash-profiles")
    digest = ["d1", "d2"]
    # doc_id and text_hash of one row that has the set: of the smallest id, if any has one
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = marked.filter("n_shingles > 0").groupBy(*digest).agg(F.min(place).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), *digest, "at.doc_id", "at.text_hash", "n", "bands", "rows"), "minhash-nodes")
    found = stored(set_links(docs, nodes, threshold), "minhash-found")
    smallest = nodes.join(found, "node").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    of = found.join(smallest, "component").select("node", "smallest")
    of = nodes.select("node", *digest, "doc_id").join(of, "node", "left").select(*digest, F.coalesce("smallest", "doc_id").alias("component_id"))
    out = marked.select("doc_id", "n_shingles", *digest).join(stored(of, "minhash-ids"), digest, "left")
    component: Column = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
