"""Readings of many documents at a time, and how tokens meet lexicons."""

import inspect

import numpy as np

from quillspark.operators import comprehension
from quillspark.plans import complexity
from quillspark.sources import lexicons, tables


def test_documents_side_by_side_read_as_each_alone():
    rng = np.random.default_rng(5)
    docs = []
    for n in (0, 1, 3, 40):
        for _ in range(4):
            edges = []
            for step in range(n):
                for _ in range(rng.integers(1, 4)):
                    a, b = sorted(rng.choice(12, 2, replace=False))
                    edges.append((int(step), f"w{a:02}", f"w{b:02}"))
            docs.append(edges)
    got = [[] for _ in docs]
    for doc, step, _, lemma, value, active, *_ in comprehension.read_together(docs, 0.3, 4):
        for d, *row in zip(doc, step, lemma, value, active, strict=True):
            got[d].append((int(row[0]), row[1], float(row[2]), bool(row[3])))
    for edges, rows in zip(docs, got, strict=True):
        steps = {}
        for s, a, b in sorted(edges):
            steps.setdefault(s, []).append((a, b))
        want = comprehension.read_document(steps, 0.3, 4)
        assert [(s, n, x) for s, n, _, x in rows] == [(s, n, x) for s, n, _, x in want] and np.allclose([r[2] for r in rows], [w[2] for w in want], atol=1e-12)


def test_metrics_of_many_documents(spark):
    rows = [(d, s, f"w{(s + d) % 3}", f"w{3 + (s * d) % 4}") for d in (1, 2, 9) for s in range(d)]
    edges = spark.createDataFrame(rows, "doc_id bigint, step int, a string, b string")
    got = {r.doc_id: r for r in comprehension.full_history(edges).collect()}
    for d in (1, 2, 9):
        steps = {s: [(a, b)] for x, s, a, b in rows if x == d}
        states, known, sums = comprehension.read_document(steps, 0.3, 10), {}, []
        for s in range(d):
            for e in steps[s]:
                known[e] = known.get(e, 0) + 1
            on = sorted(n for t, n, _, x in states if t == s and x)
            at = {n: i for i, n in enumerate(on)}
            m = comprehension.graph_metrics(len(on), [(at[a], at[b], w) for (a, b), w in known.items() if a in at and b in at])
            live = [v for t, _, v, x in states if t == s and x]
            sums.append([np.mean([v for t, _, v, _ in states if t == s]), np.mean(live), len(on), *m.values()])
        assert got[d].steps == d and np.allclose(got[d][2:], np.mean(sums, 0))


def test_pairs_of_a_sentence_leave_its_row(spark):
    """No join or shuffle by sentence: pairs are formed where the sentence is."""
    rows = [(1, 0, i, f"w{i % 5}", i % 2 == 0, i // 2) for i in range(40)] + [(1, 1, 0, "a", True, 0), (1, 1, 1, "b", None, 0), (1, 1, 2, "c", True, 1), (1, 1, 3, None, True, 1), (1, 1, 4, "d", True, 99)]
    t = spark.createDataFrame(rows, "doc_id bigint, step int, tok_ix int, lemma string, content boolean, head_ix int")
    out = comprehension.collapsed_edges(t)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in out.filter("step = 1").collect()} == {("a", "c")}
    assert out.count() == out.distinct().count() > 1


def test_tokens_meet_lexicons_without_shuffle(spark, sf):
    plan = complexity.annotated_of(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan
    assert lexicons.local_table(spark, [], "word string").count() == 0


def test_tasks_grow_with_the_texts(spark, sf, monkeypatch):
    few = tables.text_tasks(spark, sf, "documents")
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(tables, "TEXT_MB", 2**-10)
    size = spark.read.format("binaryFile").load(f"{sf}/documents.parquet").selectExpr("sum(length)").first()[0]
    assert tables.text_tasks(spark, sf, "documents") == -(-size // 1024) > few
    assert "text_tasks" in inspect.getsource(complexity.docs_of)
