"""Latent dimensions, clusters and collapsed dependency trees against exact and plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import apps, clustering, comprehension, kernel_machines, latent, subwords
from quillspark.plans import further, readings
from quillspark.plans.complexity import annotated_of
from quillspark.sources.tables import table


def matrix_rows(a):
    return [(f"d{i}", f"t{j}", float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]]


def test_latent_dimensions_of_a_known_matrix(spark):
    rng = np.random.default_rng(0)
    u, _ = np.linalg.qr(rng.normal(size=(60, 12)))
    v, _ = np.linalg.qr(rng.normal(size=(90, 12)))
    size = 10.0 * 0.6 ** np.arange(12)
    a = u * size @ v.T
    rows = spark.createDataFrame(matrix_rows(a), "doc_id string, lemma string, weight double")
    got, values = latent.latent_dimensions(rows, 4, extra=5, powers=3)
    found = {r.doc_id: r.latent for r in got.collect()}
    x = np.array([found[f"d{i}"] for i in range(60)])
    assert np.allclose(values, size[:4], rtol=1e-6)
    # the angles between the subspaces: sines below 1e-5
    q = x / np.array(values)
    assert np.linalg.norm(q - u[:, :4] @ (u[:, :4].T @ q), 2) < 1e-5
    assert np.allclose(x.T @ x, np.diag(size[:4] ** 2), atol=1e-6) and (x.sum(0) > 0).all()


def test_latent_dimensions_of_small_and_empty_tables(spark):
    schema = "doc_id bigint, lemma string, weight double"
    got, values = latent.latent_dimensions(spark.createDataFrame([], schema), 3)
    assert got.count() == 0 and values == []
    rows = [(1, "a", 3.0), (2, "a", 4.0), (3, "b", 1.0), (4, "c", 0.0), (5, "d", None)]
    got, values = latent.latent_dimensions(spark.createDataFrame(rows, schema), 5)
    assert np.allclose(values, [5, 1]) and {r.doc_id: [round(v, 6) for v in r.latent] for r in got.collect()} == {1: [3, 0], 2: [4, 0], 3: [0, 1]}


def test_topics_of_documents_are_those_of_an_exact_decomposition(spark, sf):
    c = apps.training_tokens(annotated_of(spark, sf)).groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("n"))
    w = apps.log_entropy(c, table(spark, sf, "documents").count()).toPandas().pivot_table(index="doc_id", columns="lemma", values="weight", fill_value=0.0)
    u, s, _ = np.linalg.svd(w.to_numpy(), full_matrices=False)
    got = {r.doc_id: r.latent for r in further.document_topics_by_svd(spark, sf).collect()}
    assert set(got) == set(w.index)
    x = np.array([got[i] for i in w.index])
    size = np.sqrt((x**2).sum(0))
    assert np.allclose(size, s[:5], rtol=0.01)
    wide = u[:, :10]  # neighbouring singular values lie close, so the found five lie in the ten leading directions
    assert np.linalg.norm(x / size - wide @ (wide.T @ (x / size)), 2) < 0.3
    assert np.linalg.norm(x[:, :1] / size[0] - u[:, :1] * (u[:, 0] @ x[:, 0] / size[0])) < 0.02


def plain_clusters(x, k, linkage):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i):
                a, b = x[groups[i]], x[groups[j]]
                d = max(np.linalg.norm(p - q) for p in a for q in b) if linkage == "complete" else len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or d < best[0] - 1e-12:
                    best = (d, i, j)
        _, i, j = best
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("linkage", ["ward", "complete"])
@pytest.mark.parametrize("k", [1, 3, 7])
def test_clusters_are_those_of_the_exact_algorithm(spark, linkage, k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(45, 3)) + 4 * rng.integers(0, 3, (45, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [None, 1.0, 1.0]), (102, [float("nan")] * 3)]
    got = {}
    for r in clustering.clusters(spark.createDataFrame(rows, "id bigint, x array<double>"), k, linkage).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == plain_clusters(x, k, linkage) and set(got) == set(range(k))


def test_features_merge_and_stay_few(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [30, 0], [0, 30], [30, 30]])
    x = centres[rng.integers(0, 4, 2000)] + rng.normal(size=(2000, 2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>").repartition(9)
    found = clustering.features(rows, 2, most=40)
    assert len(found) <= 40 and found["n"].sum() == 2000 and np.allclose(np.stack(found["total"]).sum(0), x.sum(0)) and np.isclose(found["square"].sum(), (x**2).sum())
    got = {r.id: r.cluster for r in clustering.clusters(rows, 4, most=40).collect()}
    near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert len({(near[i], got[i]) for i in range(2000)}) == 4  # the four heaps
    assert clustering.clusters(rows.limit(0), 3).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "id bigint, x array<double>")
    assert {r.cluster for r in clustering.clusters(same, 3).collect()} == {0}
    with pytest.raises(ValueError):
        clustering.clusters(rows, 3, "single")


def test_clusters_with_partitions_without_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")  # three rounds, most of whose tasks have nothing
    try:
        rows = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(4)], "id bigint, x array<double>")
        for linkage in clustering.LINKAGES:
            assert {r.id: r.cluster for r in clustering.clusters(rows, 2, linkage).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("query", "linkage"), [(readings.clustered_documents, "ward"), (readings.documents_by_complete_link, "complete")])
def test_clusters_of_documents(spark, sf, query, linkage):
    rows = {r.doc_id: r.x for r in readings.standardised(spark, sf).collect()}
    got = {r.doc_id: r.cluster for r in query(spark, sf).collect()}
    assert set(got) == set(rows)
    ids = sorted(rows, key=lambda i: rows[i])
    x = np.array([rows[i] for i in ids])
    # equal rows are one feature; the plain version over these, with their numbers
    different, n = np.unique(x, axis=0, return_counts=True)
    label = clustering.cut(different, n, 3, linkage)
    of = {tuple(d): c for d, c in zip(different.tolist(), label.tolist(), strict=True)}
    assert {frozenset(i for i in ids if got[i] == c) for c in range(3)} == {frozenset(i for i in ids if of[tuple(rows[i])] == c) for c in range(3)}
    birch = {r.doc_id: r.cluster for r in readings.documents_by_birch(spark, sf).collect()}
    assert set(birch) == set(rows) and set(birch.values()) == {0, 1, 2}


def test_trees_are_collapsed_onto_content_words(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for step in range(60):
        n = rng.randrange(1, 14)
        order = list(range(n))
        rng.shuffle(order)  # a tree whose heads point anywhere, also forwards
        heads = [0] * n
        for k, i in enumerate(order):
            heads[i] = i if k == 0 else order[rng.randrange(k)]
        words = [rng.choice("abcdefgh") for _ in range(n)]
        content = [rng.random() < 0.5 for _ in range(n)]
        near = {i: {heads[i]} | {j for j in range(n) if heads[j] == i} for i in range(n)}
        for i in range(n):
            if content[i]:
                seen, open_ = {i}, [i]
                while open_:
                    for j in near[open_.pop()] - seen:
                        seen.add(j)
                        if not content[j]:
                            open_.append(j)
                        elif words[i] < words[j]:
                            want.add((1, step, words[i], words[j]))
        rows += [(1, step, i, words[i], content[i], heads[i] if i != order[0] or step % 2 else None) for i in range(n)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, step int, tok_ix int, lemma string, content boolean, head_ix int")
    got = {tuple(r) for r in comprehension.collapsed_edges(tokens).collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("classify", [True, False])
def test_kernel_machines_are_those_of_the_whole_kernel(spark, classify):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = (np.hypot(*x.T) < 1).astype(float) if classify else np.sin(2 * x[:, 0]) + 0.1 * rng.normal(size=80)
    kernel, c, epsilon, weight = kernel_machines.Kernel("rbf", 0.7), 2.0, 0.05, {1.0: 1.5}
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)] + [(None, 1.0), ([1.0, None], 0.0), ([1.0, 1.0], None)], "x array<double>, y double")
    model = kernel_machines.fit(rows, kernel, c, classify, epsilon, weight if classify else None)
    f = model.decide(x)[:, 0]
    if classify:
        sign = np.where(y == 1, 1.0, -1.0)
        pull = np.array([weight.get(v, 1.0) for v in y]) * sign * np.maximum(1 - sign * f, 0)
    else:
        pull = -np.sign(f - y) * np.maximum(np.abs(f - y) - epsilon, 0)
    # at the optimum the function is what the losses pull, through the whole kernel, and a constant that balances them
    own = 2 * c * kernel(x, x) @ pull
    assert np.ptp(f - own) < 1e-5 and abs(pull.sum()) < 1e-5
    got = [r.prediction for r in model.predict(rows).collect()]
    assert sum(p is None for p in got) == 2
    assert np.mean(np.abs(np.array([p for p in got if p is not None][:80]) - y)) < (0.05 if classify else 0.15)


def test_kernel_machines_on_rows_they_have_not_seen(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    y = np.digitize(np.hypot(*x.T), [0.8, 1.5]).astype(float)
    frame = lambda a, b: spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(a, b, strict=True)], "x array<double>, y double")
    model = kernel_machines.fit(frame(x[:400], y[:400]), kernel_machines.Kernel("rbf", 1.0), 10.0, landmarks=60)
    assert len(model.landmarks) == 60 and model.classes == (0.0, 1.0, 2.0)
    got = model.predict(frame(x[400:], y[400:])).collect()
    assert np.mean([r.prediction == r.y for r in got]) > 0.9
    poly = kernel_machines.fit(frame(x[:400], (y[:400] > 0) + 5.0), kernel_machines.Kernel("poly", 0.5, 2), 10.0)
    assert np.mean([r.prediction == (r.y > 0) + 5.0 for r in poly.predict(frame(x[400:], y[400:])).collect()]) > 0.9
    assert kernel_machines.fit(frame(x[:0], y[:0]), kernel_machines.Kernel()) is None


def test_words_of_one_topic_and_one_stem_lie_near(spark):
    rng = random.Random(1)
    topics = [["paintings", "painter", "canvas", "brushes", "galleries"], ["engines", "engineer", "pistons", "gearbox", "motors"]]
    rows = [(i, [rng.choice(topics[i % 2]) for _ in range(8)] + ["the", None]) for i in range(600)]
    sentences = spark.createDataFrame(rows + [(9000, None), (9001, [])], "key int, words array<string>")
    model = subwords.train(sentences, epochs=6, partitions=3)
    again = subwords.train(sentences.repartition(5), epochs=6, partitions=3)
    assert np.array_equal(model.ngrams, again.ngrams) and np.array_equal(model.contexts, again.contexts)
    unit = lambda w: model.vector(w) / np.linalg.norm(model.vector(w))
    near = lambda a, b: float(unit(a) @ unit(b))
    for t in topics:
        for w in t:
            others = sorted((o for o in topics[0] + topics[1] if o != w), key=lambda o: -near(w, o))
            assert len(set(others[:4]) & set(t)) >= 3
    assert near("painters", "canvas") > near("painters", "pistons")  # never seen
    assert near("engineers", "gearbox") > near("engineers", "galleries")
    got = {r.word: r.vec for r in model.vectors(spark.createDataFrame([("painters",), (None,), ("",), ("日",)], "word string")).collect()}
    assert np.allclose(got["painters"], model.vector("painters")) and got[None] is None and len(got[""]) == len(got["日"]) == subwords.DIMS
