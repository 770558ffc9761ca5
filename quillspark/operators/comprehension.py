"""Comprehension of a text sentence by sentence: a concept graph that keeps growing, with activation spread over it.

A document is one group: its sentences are read in order and the graph is carried along, which no aggregate can
express. Groups are bounded by one document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAMPING, TOLERANCE = 0.85, 1e-4
#: Edges of the documents that are read side by side, and rows of a batch that is handed on.
READ_EDGES, OUT_ROWS = 200_000, 50_000
#: Shapes of graphs whose metrics are remembered.
MOST_SHAPES = 20_000


def concept_edges(tokens: DataFrame, sentence: tuple[str, ...] = ("step",)) -> DataFrame:
    """doc_id, sentence columns, a, b: pairs of content words next to each other in their sentence, other words passed over; a < b.

    tokens: doc_id, the columns that tell sentences apart, tok_ix, lemma, content (boolean). Where an annotator supplies dependencies, those with the words between collapsed take its place.
    """
    w = Window.partitionBy("doc_id", *sentence).orderBy("tok_ix")
    rows = tokens.filter("content").withColumn("next", F.lead("lemma").over(w)).filter("next is not null and next <> lemma")
    return rows.select("doc_id", *sentence, F.least("lemma", "next").alias("a"), F.greatest("lemma", "next").alias("b")).distinct()


def collapsed_edges(tokens: DataFrame, sentence: tuple[str, ...] = ("step",)) -> DataFrame:
    """doc_id, sentence columns, a, b: content words joined in their sentence's dependency tree directly or by a way over other words only; a < b.

    tokens: doc_id, the columns that tell sentences apart, tok_ix (from 0, without gaps), lemma, content (boolean), head_ix (a root heads itself). Words passed over that hang together are contracted to their topmost
    one, by doubling pointers inside the sentence's array; content words next to one such contracted word meet under it. Heads outside the sentence make a token a root.
    """
    keys = ["doc_id", *sentence]
    s = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tok_ix", "lemma", "content", "head_ix"))).alias("t"))
    s = s.filter(F.size(F.filter("t", lambda x: x["content"])) > 1)  # others have no pair
    s = s.select(*keys, F.col("t.lemma").alias("lemma"), F.col("t.content").alias("content"), F.col("t.head_ix").alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, left, right = [], [], []
            for i, t in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lemma", "content", "head")), strict=True)):
                for a, b in met_in(*t):
                    at.append(i)
                    left.append(a)
                    right.append(b)
                if len(at) >= OUT_ROWS:
                    yield pairs(batch, at, left, right)
                    at, left, right = [], [], []
            yield pairs(batch, at, left, right)

    def pairs(batch: pa.RecordBatch, at: list[int], left: list[str], right: list[str]) -> pa.RecordBatch:
        own = batch.select(keys).take(pa.array(at, pa.int32()))
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(left, pa.string()), pa.array(right, pa.string())], names=[*keys, "a", "b"])

    kinds = ", ".join(f"{c} {t}" for c, t in s.select(*keys).dtypes)
    return s.mapInArrow(run, f"{kinds}, a string, b string")


def met_in(lemmas: list[str | None], content: list[bool | None], heads: list[int | None]) -> set[tuple[str, str]]:
    """Pairs of different lemmas of one sentence's content words that its tree joins over other words only, the smaller first."""
    n = len(lemmas)
    heads = [h if h is not None and 0 <= h < n else i for i, h in enumerate(heads)]
    # a word that is passed over points to its head while that is passed over too
    top = [h if not content[i] and not content[h] else i for i, h in enumerate(heads)]
    for _ in range(n.bit_length() + 1):
        further = [top[x] for x in top]
        if further == top:
            break
        top = further
    under: dict[int, set[str]] = defaultdict(set)
    out = set()
    for i, h in enumerate(heads):
        if h == i or not (content[i] or content[h]):
            continue
        if content[i] and content[h]:
            if lemmas[i] is not None and lemmas[h] is not None and lemmas[i] != lemmas[h]:
                out.add((min(lemmas[i], lemmas[h]), max(lemmas[i], lemmas[h])))
        else:
            word, over = (lemmas[i], top[h]) if content[i] else (lemmas[h], top[i])
            if word is not None:
                under[over].add(word)
    for words in under.values():
        own = sorted(words)
        out.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    return out


def spread(nodes: list[str], edges: dict[tuple[str, str], float], start: dict[str, float]) -> dict[str, float]:
    """PageRank from the nodes' activation, divided by the greatest."""
    at, n = {x: i for i, x in enumerate(nodes)}, len(nodes)
    ends = np.array([(at[a], at[b]) for a, b in edges if a in at and b in at], np.int64).reshape(-1, 2)
    weight = np.array([w for (a, b), w in edges.items() if a in at and b in at], float)
    src, dst, weight = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]]), np.concatenate([weight, weight])
    out = np.bincount(src, weight, n)
    rank = np.array([max(start.get(x, 0.0), 0.0) for x in nodes])
    rank = rank / rank.sum() if rank.sum() else np.full(n, 1 / n)
    for _ in range(1000):
        share = np.divide(rank, out, out=np.zeros_like(rank), where=out > 0)
        new = DAMPING * np.bincount(dst, weight * share[src], n) + (DAMPING * rank[out == 0].sum() + 1 - DAMPING) / n
        done = (np.abs(new - rank) <= TOLERANCE * np.maximum(rank, 1e-12)).all()
        rank = new
        if done:
            break
    top = rank.max()
    return {x: float(r / top) for x, r in zip(nodes, rank, strict=True)}


def read_document(steps: dict[int, list[tuple[str, str]]], threshold: float, most_active: int) -> list[tuple[int, str, float, bool]]:
    """step, lemma, activation, active for each sentence: its edges join the graph, its words get their activation raised, and it spreads."""
    edges: dict[tuple[str, str], float] = defaultdict(float)
    score: dict[str, float] = {}
    out = []
    for step in sorted(steps):
        for a, b in steps[step]:
            edges[a, b] += 1.0
            for n in (a, b):
                score[n] = score.get(n, 0.0) + 1.0
        score = spread(sorted(score), edges, score)
        kept = {n for n in sorted(score, key=lambda n: (-round(score[n], 9), n))[:most_active] if score[n] >= threshold}
        out += [(step, n, score[n], n in kept) for n in sorted(score)]
    return out


def read_together(docs: list[list[tuple[int, str, str]]], threshold: float, most_active: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What read_document gives of each of docs (step, a, b of its edges, a < b), one step of all of them at a time: arrays of a step's rows and of its edges.

    Rows: place in docs, step, how many steps the document has from here on, lemma, activation, active; then the known edges' place in docs, the rows of their two ends, and their weight. Graphs of
    different documents don't touch, so that they spread in the same sums; a document whose activation has settled takes no further part.
    """
    docs = [sorted(d) for d in docs]
    steps = [sorted({e[0] for e in d}) for d in docs]
    order = sorted((i for i in range(len(docs)) if docs[i]), key=lambda i: -len(steps[i]))
    names, owner, ea, eb, first, when, which, edges_to, nodes_to = [], [], [], [], [], [], [], [], []
    for k, i in enumerate(order):
        number = {s: t for t, s in enumerate(steps[i])}
        lemmas = sorted({x for e in docs[i] for x in e[1:]})
        at = {x: len(names) + j for j, x in enumerate(lemmas)}
        names += lemmas
        owner += [k] * len(lemmas)
        known: dict[tuple[str, str], int] = {}
        for s, a, b in docs[i]:
            e = known.setdefault((a, b), len(ea))
            if e == len(ea):
                ea.append(at[a])
                eb.append(at[b])
                first.append(number[s])
            when.append(number[s])
            which.append(e)
        edges_to.append(len(ea))
        nodes_to.append(len(names))
    if not order:
        return
    lemma, owner, ea, eb, first, when, which = np.array(names, object), np.array(owner), np.array(ea), np.array(eb), np.array(first), np.array(when), np.array(which)
    place, last = np.array(order), np.array([len(steps[i]) for i in order])
    which = which[np.argsort(when, kind="stable")]
    until = np.concatenate([[0], np.cumsum(np.bincount(when))])
    since = np.full(len(names), last[0])
    np.minimum.at(since, ea, first)
    np.minimum.at(since, eb, first)
    weight, score = np.zeros(len(ea)), np.zeros(len(names))
    for t in range(last[0]):
        going = int((last > t).sum())  # those with most steps come first
        new = which[until[t] : until[t + 1]]
        for table, ix in ((weight, new), (score, ea[new]), (score, eb[new])):
            np.add.at(table, ix, 1.0)
        e = np.flatnonzero(first[: edges_to[going - 1]] <= t)
        nodes = np.flatnonzero(since[: nodes_to[going - 1]] <= t)
        row = np.empty(nodes_to[going - 1], np.int64)
        row[nodes] = np.arange(len(nodes))
        u, v, d = row[ea[e]], row[eb[e]], owner[nodes]
        found = _spread_all(u, v, weight[e], d, score[nodes], going)
        starts = np.searchsorted(d, np.arange(going))
        found /= np.maximum.reduceat(found, starts)[d]
        score[nodes] = found
        best = np.lexsort((np.arange(len(nodes)), -np.round(found, 9), d))
        nth = np.empty(len(nodes), np.int64)
        nth[best] = np.arange(len(nodes))
        active = (nth - starts[d] < most_active) & (found >= threshold)
        number = np.array([steps[i][t] for i in order[:going]])
        yield place[d], number[d], last[d] - t, lemma[nodes], found, active, place[owner[ea[e]]], u, v, weight[e]


def _spread_all(u: np.ndarray, v: np.ndarray, weight: np.ndarray, doc: np.ndarray, start: np.ndarray, docs: int) -> np.ndarray:
    """PageRank of graphs side by side from their nodes' activation; doc (sorted) tells whose a node is, and each node has an edge."""
    n = len(doc)
    src, dst, weight = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([weight, weight])
    rank = start / np.bincount(doc, start, docs)[doc]
    rest = ((1 - DAMPING) / np.bincount(doc, minlength=docs))[doc]
    weight = DAMPING * weight / np.bincount(src, weight, n)[src]
    out, nodes, settled = rank.copy(), np.arange(n), np.zeros(docs, bool)
    for _ in range(1000):
        new = np.bincount(dst, weight * rank[src], len(nodes)) + rest
        moving = np.zeros(docs, bool)
        moving[doc[np.abs(new - rank) > TOLERANCE * np.maximum(rank, 1e-12)]] = True
        rank = new
        now = ~(moving | settled)[doc]
        out[nodes[now]] = rank[now]
        settled |= ~moving
        left = ~settled[doc]
        if not left.any():
            return out
        if 2 * left.sum() < len(nodes):  # go on with those that are left
            at = np.cumsum(left) - 1
            kept = left[src]
            src, dst, weight = at[src[kept]], at[dst[kept]], weight[kept]
            nodes, doc, rank, rest = nodes[left], doc[left], rank[left], rest[left]
    left = ~settled[doc]
    out[nodes[left]] = rank[left]
    return out


def _texts(edges: DataFrame) -> DataFrame:
    """doc_id with arrays step, a, b: a row for each document."""
    rows = edges.groupBy("doc_id").agg(F.collect_list(F.struct("step", "a", "b")).alias("e"))
    return rows.select("doc_id", F.col("e.step").alias("step"), F.col("e.a").alias("a"), F.col("e.b").alias("b"))


def _side_by_side(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[list[tuple[int, str, str]]]]]:
    """Documents' ids and edges, as many as are read side by side."""
    for batch in batches:
        ids, docs, n = [], [], 0
        for i, *e in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "step", "a", "b")), strict=True):
            ids.append(i)
            docs.append(list(zip(*e, strict=True)))
            n += len(docs[-1])
            if n >= READ_EDGES:
                yield ids, docs
                ids, docs, n = [], [], 0
        if ids:
            yield ids, docs


def activation(edges: DataFrame, threshold: float = 0.3, most_active: int = 10, last_only: bool = True) -> DataFrame:
    """doc_id, step, lemma, activation, active after each sentence (or the last one alone)."""
    names = ["doc_id", "step", "lemma", "activation", "active"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _side_by_side(batches):
            held: list[list[np.ndarray]] = []
            ids = pa.array(ids, pa.int64())
            for doc, step, left, lemma, value, active, *_ in read_together(docs, threshold, most_active):
                own = left == 1 if last_only else np.ones(len(doc), bool)
                if own.any():
                    held.append([x[own] for x in (doc, step, lemma, value, active)])
                if sum(len(x[0]) for x in held) >= OUT_ROWS:
                    yield batch(ids, held)
                    held = []
            if held:
                yield batch(ids, held)

    def batch(ids: pa.Array, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        doc, step, lemma, value, active = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(step, pa.int32()), pa.array(lemma, pa.string()), pa.array(value), pa.array(active)], names=names)

    return _texts(edges).mapInArrow(run, "doc_id bigint, step int, lemma string, activation double, active boolean")


def history(states: DataFrame) -> DataFrame:
    """doc_id, steps, nodes, active (means over steps), activation (mean of the steps' means)."""
    by = states.groupBy("doc_id", "step").agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("k"), F.avg("activation").alias("v"))
    return by.groupBy("doc_id").agg(F.count(F.lit(1)).alias("steps"), F.avg("n").alias("nodes"), F.avg("k").alias("active"), F.avg("v").alias("activation"))


def thresholded(distances: DataFrame) -> DataFrame:
    """Word pairs nearer than mean - deviation (population) of their document's. distances: doc_id, a, b, distance."""
    s = distances.groupBy("doc_id").agg((F.avg("distance") - F.stddev_pop("distance")).alias("limit"))
    return distances.join(s, "doc_id").filter("distance < limit").drop("limit")


# --- distances, expansion, metrics ---


def word_distances(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """doc_id, a, b, distance of all concept pairs of edges(doc_id, a, b) that meet in a sentence: 0 if they are linked, else 1 - cosine of vectors(word, vec)."""
    from .vectors import cosine

    side = lambda c: vectors.select(F.col("word").alias(c), F.col("vec").alias(f"v{c}"))
    pairs = edges.select("doc_id", "a", "b").distinct()
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("doc_id", "a", "b", F.greatest(F.lit(0.0), 1 - cosine(F.col("va"), F.col("vb"))).alias("distance"))


def expanded(concepts: DataFrame, related: DataFrame, ages: DataFrame, vectors: DataFrame, sentence_vectors: DataFrame, least: float = 0.33, oldest: float = 9.0, top: int = 3) -> DataFrame:
    """doc_id, step, word, similarity: words related(word, other) to a sentence's nouns and verbs that fit it and are learned early.

    concepts: doc_id, step, lemma, pos. A word stays if its cosine with the sentence is above least and its age (unknown counts as 0) below oldest;
    of those the top by similarity, and the word itself is none.
    """
    from .vectors import cosine

    own = concepts.filter(F.col("pos").isin("NOUN", "VERB")).select("doc_id", "step", "lemma").distinct()
    new = own.join(related.select(F.col("word").alias("lemma"), "other"), "lemma").select("doc_id", "step", F.col("other").alias("word")).distinct()
    new = new.join(own.withColumnRenamed("lemma", "word"), ["doc_id", "step", "word"], "left_anti").join(ages.select("word", "age"), "word", "left").filter(F.coalesce("age", F.lit(0.0)) < oldest)
    rows = new.join(vectors, "word").join(sentence_vectors.withColumnRenamed("vec", "svec"), ["doc_id", "step"])
    rows = rows.select("doc_id", "step", "word", cosine(F.col("vec"), F.col("svec")).alias("similarity")).filter(F.col("similarity") > least)
    w = Window.partitionBy("doc_id", "step").orderBy(F.desc(F.round("similarity", 9)), "word")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("doc_id", "step", "rank", "word", "similarity")


def graph_metrics(n: int, edges: list[tuple[int, int, float]], known: dict[tuple, dict[str, float]] | None = None) -> dict[str, float]:
    """Means of degree, closeness, betweenness and harmonic centrality, density, and how many communities greedy modularity finds, of an undirected graph of nodes 0..n-1 (edges u, v, weight).

    known remembers what doesn't depend on weights, by the graph's shape.
    """
    known = {} if known is None else known
    shape = (n, *((u, v) for u, v, _ in edges))
    if shape not in known:
        if len(known) >= MOST_SHAPES:
            known.clear()
        known[shape] = _shape_metrics(n, shape[1:])
    return {**known[shape], "communities": float(communities(n, edges)) if n > 1 else 0.0}


def _shape_metrics(n: int, links: Iterable[tuple[int, int]]) -> dict[str, float]:
    """Those of graph_metrics that weights don't matter to."""
    near: list[set[int]] = [set() for _ in range(n)]
    for u, v in links:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    m = sum(map(len, near)) / 2
    close, harmonic, between = np.zeros(n), np.zeros(n), np.zeros(n)
    for s in range(n):
        far, order, paths, behind = {s: 0}, [s], defaultdict(float, {s: 1.0}), defaultdict(list)
        for u in order:
            for v in sorted(near[u]):
                if v not in far:
                    far[v] = far[u] + 1
                    order.append(v)
                if far[v] == far[u] + 1:
                    paths[v] += paths[u]
                    behind[v].append(u)
        total = sum(far.values())
        close[s] = (len(far) - 1) / total * (len(far) - 1) / (n - 1) if total and n > 1 else 0.0
        harmonic[s] = sum(1 / d for d in far.values() if d)
        owed: dict[int, float] = defaultdict(float)
        for v in reversed(order[1:]):
            for u in behind[v]:
                owed[u] += paths[u] / paths[v] * (1 + owed[v])
            between[v] += owed[v]
    between = between / ((n - 1) * (n - 2)) if n > 2 else between
    return {
        "degree": 2 * m / n / (n - 1) if n > 1 else float(n), "closeness": float(close.mean()) if n else 0.0, "betweenness": float(between.mean()) if n else 0.0,
        "harmonic": float(harmonic.mean()) if n else 0.0, "density": 2 * m / (n * (n - 1)) if n > 1 else 0.0,
    }


def communities(n: int, edges: list[tuple[int, int, float]]) -> int:
    """Number of communities left when the pair whose merge raises modularity most (ties: smallest numbers) is merged until none does."""
    weight: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    for u, v, w in edges:
        if u != v:
            weight[u][v] = weight[u].get(v, 0.0) + w
            weight[v][u] = weight[v].get(u, 0.0) + w
    total = sum(sum(x.values()) for x in weight.values())
    if not total:
        return n
    share = {i: sum(x.values()) / total for i, x in weight.items()}
    links = {i: {j: w / total for j, w in x.items()} for i, x in weight.items()}
    while True:
        best = max(((2 * (e - share[i] * share[j]), -i, -j) for i, x in links.items() for j, e in x.items() if i < j), default=None)
        if best is None or best[0] <= 1e-12:
            return len(share)
        i, j = -best[1], -best[2]
        for k, e in links.pop(j).items():
            links[k].pop(j)
            if k != i:
                links[i][k] = links[k][i] = links[i].get(k, 0.0) + e
        share[i] += share.pop(j)


def full_history(edges: DataFrame, threshold: float = 0.3, most_active: int = 10) -> DataFrame:
    """doc_id, steps and nine means over a document's steps: activation of all and of active concepts, active ones, and the metrics of the graph of active concepts."""
    names = ["activation", "active_activation", "active", "degree", "closeness", "betweenness", "harmonic", "density", "communities"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[tuple, dict[str, float]] = {}
        for ids, docs in _side_by_side(batches):
            total, steps = np.zeros((len(docs), len(names))), np.zeros(len(docs), np.int64)
            for doc, _, _, _, value, active, of, u, v, weight in read_together(docs, threshold, most_active):
                there, n, live = np.unique(doc), np.bincount(doc, minlength=len(docs)), np.bincount(doc, active, len(docs))
                steps[there] += 1
                total[there, 0] += (np.bincount(doc, value, len(docs)) / np.maximum(n, 1))[there]
                total[there, 1] += (np.bincount(doc, value * active, len(docs)) / np.maximum(live, 1))[there]
                total[there, 2] += live[there]
                place = np.zeros(len(doc), np.int64)
                on = np.flatnonzero(active)
                starts = np.flatnonzero(np.diff(doc[on], prepend=-1))  # a document's rows lie together
                place[on] = np.arange(len(on)) - np.repeat(starts, np.diff(starts, append=len(on)))
                inner = active[u] & active[v]
                graphs: dict[int, list[tuple[int, int, float]]] = {k: [] for k in there.tolist()}
                for k, a, b, w in zip(of[inner].tolist(), place[u[inner]].tolist(), place[v[inner]].tolist(), weight[inner].tolist(), strict=True):
                    graphs[k].append((a, b, w))
                for k, edges in graphs.items():
                    total[k, 3:] += list(graph_metrics(int(live[k]), edges, shapes).values())
            own = np.flatnonzero(steps)
            mean = total[own] / steps[own, None]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(own)), pa.array(steps[own]), *[pa.array(mean[:, j]) for j in range(len(names))]], names=["doc_id", "steps", *names])

    return _texts(edges).mapInArrow(run, "doc_id bigint, steps bigint, " + ", ".join(f"{n} double" for n in names))
