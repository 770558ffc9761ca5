"""Steps that count, match or choose inside a row or tile give what their plain forms do, and don't sort, window or pair what they needn't."""

import numpy as np
import pytest

import __spark_entry__ as entry
from quillspark.operators import apps, measures, rhythm, segment, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [None, 0.0])
def test_nearest_in_tiles(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "QUERY_TILE", 5)
    monkeypatch.setattr(vectors, "ROW_TILE", 7)
    rng = np.random.default_rng(0)
    v = [None if i == 3 else [0.0, 0.0] if i == 4 else [1.0, None] if i == 6 else [1.0, 2.0] if i % 9 == 5 else rng.normal(size=2).round(3).tolist() for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(v)), "id bigint, vec array<double>")
    queries = rows.filter("id % 3 = 0").toDF("query", "qvec")
    df = vectors.top_k(queries, rows, 4, least)
    assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
    whole = lambda x: x is not None and None not in x and any(x)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if whole(a) and whole(b) else 0.0
    want = set()
    for i in range(0, 40, 3):
        s = sorted((-round(cos(v[i], v[j]), 9), j) for j in range(40) if j != i and (least is None or cos(v[i], v[j]) > least))
        want |= {(i, rank + 1, j) for rank, (_, j) in enumerate(s[:4])}
    assert {(r.query, r["rank"], r.id) for r in df.collect()} == want


def test_alliterations_need_no_window(spark, sf):
    assert "Window" not in plan(entry.queries()["alliterations"](spark, sf))


def test_recurring_in_rows_is_recurring(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [str(x) for x in rng.integers(0, 4, n)]) for i, n in enumerate([0, 1, 2, 9, 40])]
    flat = [(i, j + 1, s) for i, w in rows for j, s in enumerate(w)]
    got = rhythm.recurring_in(spark.createDataFrame(rows, "id int, symbols array<string>"), ["id"])
    want = rhythm.recurring(spark.createDataFrame(flat, "id int, place int, symbol string"), ["id"])
    named = lambda d: sorted((r.id, r.symbol, tuple(r.places)) for r in d.collect())
    assert named(got) == named(want) and named(got)


def plain_choice(sim, share=0.2, alpha=3.0, weight=5.0, rounds=20):
    n = len(sim)
    k, size = max(1, -(-n // 10)), int(share * n)
    centres = sim[np.linspace(0, n - 1, k).astype(int)].copy()
    for _ in range(rounds):
        label = np.array([((centres - row) ** 2).sum(-1).argmin() for row in sim])
        centres = np.stack([sim[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
    limit, mean, chosen = alpha / n * sim.sum(1), np.maximum(sim.mean(1), 0), []
    covered, inside = np.zeros(n), np.zeros(k)
    while len(chosen) < size:
        best, gain = -1, -np.inf
        for j in set(range(n)) - set(chosen):
            more = inside.copy()
            more[label[j]] += mean[j]
            value = np.minimum(covered + sim[:, j], limit).sum() + weight * np.sqrt(more).sum()
            if value > gain + 1e-12:
                best, gain = j, value
        chosen.append(best)
        covered += sim[:, best]
        inside[label[best]] += mean[best]
    return sorted(chosen)


def test_submodular_choice_is_the_plain_one_and_quick():
    import time

    rng = np.random.default_rng(3)
    for n in (1, 4, 5, 37, 90):
        x = np.abs(rng.normal(size=(n, 4)))
        x[n // 2 :] = x[: n - n // 2] if n > 5 else x[n // 2 :]  # equal rows
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert apps.submodular_choice(x @ x.T) == plain_choice(x @ x.T)
    x = np.abs(rng.normal(size=(700, 5)))
    began = time.process_time()
    apps.submodular_choice(x @ x.T / 5)
    assert time.process_time() - began < 5


def test_document_counts_are_not_grouped(spark):
    docs = spark.createDataFrame([(1, "A b, b.C d...\n\n. \n?!x, x"), (2, ""), (3, None), (4, "...\n !")], "doc_id bigint, text string")
    out = measures.by_document(docs)
    assert "Aggregate" not in plan(out) and "Exchange" not in plan(out)
    s = measures.by_sentence(docs).filter("sent_ix is not null").groupBy("doc_id").agg(*[measures.F.sum(c).alias(c) for c in ("wd", "punct", "commas")], measures.F.count("sent_ix").alias("sentences"))
    want = s.join(measures.distinct_words(docs, ["doc_id"]), "doc_id")
    key = ["doc_id", "wd", "punct", "commas", "sentences", "unqwd"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_labelled_features_are_read_from_a_table(spark, sf):
    from quillspark.plans import applications, readings

    for df in (applications.labelled_features(spark, sf), readings.standardised(spark, sf)):
        assert "regexp_extract_all" not in plan(df)


def test_graph_queries_take_texts_apart_once_and_small_documents_share_a_task(spark, sf):
    queries = entry.queries()
    for name in ("filtered_graph", "semantic_statistics", "cohesion_graph"):
        p = plan(queries[name](spark, sf))
        assert "regexp_extract_all" not in p and "FlatMapGroupsInPandas" not in p and "MapInArrow" in p


def test_runs_of_keys_cross_batches():
    import pyarrow as pa

    from quillspark.operators import cna

    seen = []

    def of_run(t, key):
        seen.append((t["doc_id"][0].as_py(), t["level"][0].as_py(), key, t["id"].to_pylist()))
        return {"n": np.array([len(t)])} if len(t) != 3 else None

    rows = [(1, "a", 0, 0, 5), (1, "a", 0, 0, 6), (1, "a", 0, 1, 7), (1, "b", 0, 0, 8), (2, "b", 0, 0, 9), (2, "b", 0, 0, 10), (2, "b", 0, 0, 11), (3, "b", 0, 0, 12)]
    whole = pa.table(dict(zip(("doc_id", "level", "i", "j", "id"), map(list, zip(*rows, strict=True)), strict=True)))
    run = cna.in_runs(["doc_id", "level", "i", "j"], ["doc_id", "level", "n"], of_run)
    for size in (1, 2, 3, 100):
        seen.clear()
        out = pa.Table.from_batches(list(run(iter(whole.to_batches(max_chunksize=size))))).to_pylist()
        assert [x[3] for x in seen] == [[5, 6], [7], [8], [9, 10, 11], [12]]
        assert [(x["doc_id"], x["level"], x["n"]) for x in out] == [(1, "a", 2), (1, "a", 1), (1, "b", 1), (3, "b", 1)]
    assert list(run(iter([]))) == []
