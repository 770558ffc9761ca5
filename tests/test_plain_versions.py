"""Operators without SQL, or in blocks, against plain versions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import biblio, cna, comprehension, indices, segment, threads, vectors
from quillspark.plans import community, readings


def test_runs_of_blanks_and_letters_cost_no_more_than_their_length(spark):
    docs = spark.createDataFrame([(1, " " * 100_000 + "a. b"), (2, "x" * 100_000), (3, "A. . b...  . ...c")], "doc_id bigint, text string")
    began = time.perf_counter()
    got = {(r.doc_id, r.sent_ix): r.text.strip(" ") for r in segment.sentences(docs).collect()}
    assert time.perf_counter() - began < 20
    assert [got[1, 0], got[1, 1], len(got[2, 0])] == ["a.", "b", 100_000]
    assert [got[3, i] for i in range(4)] == ["A.", "b...", " .", "c"]


def elements(spark, n=37, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(1 + i % 2, "sent", i, rng.normal(size=3).tolist() if i % 9 else None, rng.normal(size=2).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, level string, id bigint, m array<double>, k array<double>")


@pytest.mark.parametrize("block", [1000, 5])
def test_filtered_pairs_and_importance(spark, block, monkeypatch):
    monkeypatch.setattr(cna, "BLOCK_ROWS", block)
    rows, df = elements(spark)
    want = set()
    cos = lambda a, b: 0.0 if a is None or b is None else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    rank = {}
    for d in (1, 2):
        own = [r for r in rows if r[0] == d]
        pairs = {(x[2], y[2]): (cos(x[3], y[3]) + cos(x[4], y[4])) / 2 for i, x in enumerate(own) for y in own[i + 1 :]}
        v = np.array(list(pairs.values()))
        kept = {p: s for p, s in pairs.items() if s > v.mean() + v.std()}
        want |= {(d, *p) for p in kept}
        ids = [r[2] for r in own]
        w = np.zeros((len(ids), len(ids)))
        for (a, b), s in kept.items():
            w[ids.index(a), ids.index(b)] = w[ids.index(b), ids.index(a)] = s
        out, p = w.sum(1), np.full(len(ids), 1 / len(ids))
        for _ in range(500):
            p = 0.85 * (w.T @ np.divide(p, out, out=np.zeros_like(p), where=out > 0)) + (0.85 * p[out == 0].sum() + 0.15) / len(ids)
        rank |= {(d, i): x * len(ids) for i, x in zip(ids, p, strict=True)}
    assert {(r.doc_id, r.a, r.b) for r in cna.filtered_pairs(df, ["m", "k"]).collect()} == want
    got = {(r.doc_id, r.node): r.importance for r in cna.graph_importance(df, ["m", "k"], "sent").collect()}
    assert got.keys() == rank.keys() and max(abs(got[k] - rank[k]) for k in rank) < 0.05


def test_heights_of_trees(spark):
    trees = [([0], 1), ([0, 0, 1, 2, 3], 5), ([1, 1, 1], 2), ([2, 2, 4, 4, 4], 3), ([1, 0], None)]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(trees)], "i int, h array<int>").select("i", indices.height(F.col("h")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: x for i, (_, x) in enumerate(trees)}


def test_metrics_of_a_path_and_two_triangles():
    m = comprehension.graph_metrics(4, [(0, 1, 1), (1, 2, 1), (2, 3, 1)])
    assert m["degree"] == 0.5 and m["density"] == 0.5 and m["communities"] == 2
    assert abs(m["closeness"] - (2 * 0.5 + 2 * 0.75) / 4) < 1e-12 and abs(m["betweenness"] - 1 / 3) < 1e-12 and abs(m["harmonic"] - (2 * (1 + 1 / 2 + 1 / 3) + 2 * 2.5) / 4) < 1e-12
    assert comprehension.communities(6, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 1)]) == 2


def test_one_way_matchings_repeat(spark):
    rows = [(1, 2, 10, 20, 0.1), (1, 2, 11, 20, 0.2), (1, 2, 12, 20, 0.9), (3, 4, 30, 40, 0.95)]
    got = {(r.a, r.b): (round(r.similarity, 6), r.rounds) for r in biblio.author_similarity_one_way(spark.createDataFrame(rows, "a bigint, b bigint, article_a bigint, article_b bigint, distance double"), 0.5).collect()}
    assert got == {(1, 2): (0.85, 2), (3, 4): (0.0, 0)}


def test_further_buckets_until_there_are_enough(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    q = df.filter("id < 4").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    few = vectors.most_similar(q, df, 5, vectors.random_planes(6, 4)).collect()
    assert {r["query"] for r in few} == {0, 1, 2, 3} and len(few) == 20
    every = vectors.most_similar(q, df, 1000, vectors.random_planes(3, 4)).collect()
    assert len(every) == 4 * 59


def test_activation_spreads_as_a_plain_walk_does(spark, sf):
    edges = readings.concepts(spark, sf).collect()
    steps = {}
    for r in edges:
        steps.setdefault(r.doc_id, {}).setdefault(r.step, []).append((r.a, r.b))
    got = {}
    for r in readings.concept_activation(spark, sf).collect():
        got.setdefault(r.doc_id, {})[r.lemma] = (r.step, r.activation, r.active)
    assert set(got) == set(steps)
    for d, by in sorted(steps.items())[:40]:
        weight, score = {}, {}
        for step in sorted(by):
            for a, b in by[step]:
                for x, y in ((a, b), (b, a)):
                    weight[x, y] = weight.get((x, y), 0) + 1
                    score[x] = score.get(x, 0) + 1
            out = {n: sum(w for (x, _), w in weight.items() if x == n) for n in score}
            rank = {n: v / sum(score.values()) for n, v in score.items()}
            for _ in range(300):
                rank = {n: 0.15 / len(rank) + 0.85 * sum(rank[x] * w / out[x] for (x, y), w in weight.items() if y == n) for n in rank}
            score = {n: v / max(rank.values()) for n, v in rank.items()}
        assert all(got[d][n][0] == max(by) and abs(got[d][n][1] - v) < 0.01 for n, v in score.items()) and set(got[d]) == set(score)


def test_centralities_of_conversations(spark, sf):
    p = community.posts(spark, sf)
    graphs = {}
    for r in threads.participant_graph(p, community.edges(p)).collect():
        graphs.setdefault(r.conv_id, {})[r.u, r.v] = r.weight
    got = {(r.conv_id, r.user): r for r in community.network_analysis(spark, sf).collect()}
    seen = 0
    for c, g in graphs.items():
        users = sorted({x for e in g for x in e})
        n = len(users)

        def paths(a, b, g=g, users=users):
            """All shortest ways from a to b."""
            ways = [[a]]
            while ways and not any(w[-1] == b for w in ways):
                ways = [[*w, v] for w in ways for v in users if (w[-1], v) in g and v not in w]
            return [w for w in ways if w[-1] == b]

        for u in users:
            between = sum(sum(u in w[1:-1] for w in ws) / len(ws) for a in users for b in users if a != b and u not in (a, b) and (ws := paths(a, b)))
            far = [len(paths(a, u)[0]) - 1 for a in users if a != u and paths(a, u)]
            assert abs(got[c, u].betweenness - (between / ((n - 1) * (n - 2)) if n > 2 else 0)) < 1e-6
            assert abs(got[c, u].closeness - (len(far) / sum(far) * len(far) / (n - 1) if far else 0)) < 1e-6
            seen += 1
    assert seen == len(got) > 30
