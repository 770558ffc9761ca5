"""Stored bucket indices, community graphs and agreement of subject and predicate."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import annotate, cna, grammar_ro, indices, vectors
from quillspark.plans import indices as plan
from quillspark.sources import readers


def test_a_stored_index_is_opened_extended_and_gives_the_same_hits(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 12))
    frame = lambda ids: spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], "id bigint, vec array<double>")
    planes = vectors.random_planes(6, 12, 3)
    queries = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(0, 300, 30)], "query bigint, qvec array<double>")
    index = vectors.BucketIndex.build(frame(range(150)), planes, str(tmp_path / "index"), parts=4)
    hits = lambda df: sorted((r.query, r.rank, r.id, round(r.sim, 9)) for r in df.collect())
    assert hits(index.most_similar(queries, 5)) == hits(vectors.most_similar(queries, frame(range(150)), 5, planes))
    index.close()
    again = vectors.BucketIndex.open(spark, str(tmp_path / "index"))
    assert again.planes == planes and again.rows().count() == 150
    again.add(frame(range(150, 300)).union(spark.createDataFrame([(999, None)], "id bigint, vec array<double>")))
    assert again.rows().count() == 300
    assert hits(again.most_similar(queries, 7, 0.1)) == hits(vectors.most_similar(queries, frame(range(300)), 7, planes, 0.1))
    plan = again.rows().groupBy("__b").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # buckets lie together already
    again.close()


def test_communities_join_what_is_said_in_several_conversations(spark, monkeypatch):
    monkeypatch.setattr(cna, "BLOCK_ROWS", 2)
    schema = "doc_id bigint, level string, id bigint, parent_level string, parent bigint, place int, answers bigint, m array<double>"
    posts = [(1, "post", 10, "conversation", 1, 0, None, [1.0, 0.0]), (1, "post", 11, "conversation", 1, 1, 10, [0.0, 1.0]), (1, "post", 20, "conversation", 2, 0, 99, [1.0, 1.0]), (2, "post", 10, "conversation", 3, 0, None, [2.0, 0.0]), (1, "post", 21, "conversation", 2, 1, 20, None)]
    above = [(1, "conversation", 1, "community", 1, 1, None, [1.0, 1.0]), (1, "conversation", 2, "community", 1, 2, None, [1.0, 1.0]), (2, "conversation", 3, "community", 2, 3, None, [2.0, 0.0]), (1, "community", 1, None, None, 1, None, [2.0, 2.0]), (2, "community", 2, None, None, 2, None, [2.0, 0.0])]
    got = {(r.doc_id, r.level, r.type, r.a, r.b, round(r.value, 6)) for r in cna.community_graph(spark.createDataFrame(posts + above, schema), ["m"], ("post",)).collect()}
    half = round(2**-0.5, 6)
    assert {g for g in got if g[2] == "semantic"} == {(1, "post", "semantic", a, b, v) for a, b, v in ((10, 11, 0.0), (10, 20, half), (10, 21, 0.0), (11, 20, half), (11, 21, 0.0), (20, 21, 0.0))}
    assert {g[3:5] for g in got if g[2] == "reply"} == {(11, 10), (21, 20)}  # 99 isn't there
    assert {g[:1] + g[3:5] for g in got if g[2] == "adjacent"} == {(1, 10, 11), (1, 20, 21), (1, 1, 2)}
    assert {g[:2] + g[3:5] for g in got if g[2] == "part_of"} == {(1, "post", 10, 1), (1, "post", 11, 1), (1, "post", 20, 2), (1, "post", 21, 2), (2, "post", 10, 3), (1, "conversation", 1, 1), (1, "conversation", 2, 1), (2, "conversation", 3, 2)}


# (form, lemma, tag, head, label), heads from 1 as CoNLL-U has them, 0 the root; and what is wrong.
GOLD = [
    ("Fata citește", [("Fata", "fată", "Ncfsry", 2, "nsubj"), ("citește", "citi", "Vmip3s", 0, "root")], set()),
    ("Fetele citește", [("Fetele", "fată", "Ncfpry", 2, "nsubj"), ("citește", "citi", "Vmip3s", 0, "root")], {("verb", 1, False, True, False)}),
    ("Eu citești", [("Eu", "eu", "Pp1-sn", 2, "nsubj"), ("citești", "citi", "Vmip2s", 0, "root")], {("verb", 1, True, False, False)}),
    ("Ana și Ion citește", [("Ana", "Ana", "Npfsrn", 4, "nsubj"), ("și", "și", "Crssp", 3, "cc"), ("Ion", "Ion", "Npmsrn", 1, "conj"), ("citește", "citi", "Vmip3s", 0, "root")], {("verb", 3, False, True, False)}),
    ("Eu și tu citim", [("Eu", "eu", "Pp1-sn", 4, "nsubj"), ("și", "și", "Crssp", 3, "cc"), ("tu", "tu", "Pp2-sn", 1, "conj"), ("citim", "citi", "Vmip1p", 0, "root")], set()),
    ("Fata au citit", [("Fata", "fată", "Ncfsry", 3, "nsubj"), ("au", "avea", "Vaip3p", 3, "aux"), ("citit", "citi", "Vmp--sm", 0, "root")], {("verb", 1, False, True, False)}),
    ("Fata este frumos", [("Fata", "fată", "Ncfsry", 3, "nsubj"), ("este", "fi", "Vmip3s", 3, "cop"), ("frumos", "frumos", "Afpms-n", 0, "root")], {("name", 2, False, False, True)}),
    ("Fetele este frumoase", [("Fetele", "fată", "Ncfpry", 3, "nsubj"), ("este", "fi", "Vmip3s", 3, "cop"), ("frumoase", "frumos", "Afpfp-n", 0, "root")], {("copula", 1, False, True, False)}),
    ("Ana și Ion sunt frumoase", [("Ana", "Ana", "Npfsrn", 5, "nsubj"), ("și", "și", "Crssp", 3, "cc"), ("Ion", "Ion", "Npmsrn", 1, "conj"), ("sunt", "fi", "Vmip3p", 5, "cop"), ("frumoase", "frumos", "Afpfp-n", 0, "root")], {("name", 4, False, False, True)}),
    ("Ana este doctor", [("Ana", "Ana", "Npfsrn", 3, "nsubj"), ("este", "fi", "Vmip3s", 3, "cop"), ("doctor", "doctor", "Ncms-n", 0, "root")], set()),
    ("Majoritatea citesc", [("Majoritatea", "majoritate", "Ncfsry", 2, "nsubj"), ("citesc", "citi", "Vmip3p", 0, "root")], set()),
    ("Fata citește și cântă", [("Fata", "fată", "Ncfsry", 2, "nsubj"), ("citește", "citi", "Vmip3s", 0, "root"), ("și", "și", "Crssp", 4, "cc"), ("cântă", "cânta", "Vmip3p", 2, "conj")], {("verb", 3, False, True, False)}),
    ("Fata a fost aleși", [("Fata", "fată", "Ncfsry", 4, "nsubj"), ("am", "avea", "Vaip1s", 4, "aux"), ("fost", "fi", "Vmp--sm", 4, "cop"), ("bună", "bun", "Afpfs-n", 0, "root")], {("copula", 1, True, False, False)}),
]


def test_subjects_and_predicates_of_an_annotated_text(spark, tmp_path):
    lines = []
    for text, words, _ in GOLD:
        lines += [f"# text = {text}", *("\t".join([str(i + 1), w, lemma, "_", tag, "_", str(head), dep, "_", "_"]) for i, (w, lemma, tag, head, dep) in enumerate(words)), ""]
    (tmp_path / "gold.conllu").write_text("\n".join(lines) + "\n", encoding="utf-8")
    tokens = annotate.from_conllu(readers.conllu(spark, str(tmp_path / "gold.conllu")), F.lit(1))
    assert tokens.count() == sum(len(words) for _, words, _ in GOLD)
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    got = {}
    for r in grammar_ro.subject_disagreements(tokens, words("majoritate"), words("doctor", "profesor")).collect():
        got.setdefault(r.sent_ix, set()).add((r.kind, r.at, r.person, r.number, r.gender))
        assert r.tok_ix == 0
    assert got == {i: w for i, (_, _, w) in enumerate(GOLD) if w}
    none = spark.createDataFrame([], "word string")
    assert grammar_ro.subject_disagreements(tokens.limit(0), none, none).count() == 0
    values = indices.element_values(plan.annotated(spark, indices.annotated_rows(tokens)), [m for m in plan.MEASURES if m.category == "syntax"])
    found = {r["index"]: r.value for r in indices.compute_indices(values, [m for m in plan.MEASURES if m.category == "syntax"]).collect()}
    assert found["Max(Dep_nsubj / Doc)"] == len(GOLD) and found["Max(ParseDepth / Sent)"] == 4  # și, Ion, Ana, frumoase


def test_moments_of_pairs_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(d, "sent", i, rng.normal(size=3).tolist() if i % 5 else None, rng.normal(size=3).tolist() if i % 4 else [0.0] * 3) for d, n in ((1, 30), (2, 2), (3, 1)) for i in range(n)]
    rows += [(4, "sent", i, [1.0, 2.0, 3.0], [1.0, 0.0, 0.0]) for i in range(5)]
    e = spark.createDataFrame(rows, "doc_id bigint, level string, id bigint, m array<double>, k array<double>")
    by = lambda df: {r.doc_id: (r.pairs, round(r.mean, 7), round(r.deviation, 7)) for r in df.collect()}
    assert by(cna.pair_moments(e, ["m", "k"], 3)) == by(cna.semantic_statistics(e, ["m", "k"]))
    pairs = lambda **o: sorted(tuple(r) for r in cna.filtered_pairs(e, ["m", "k"], **o).collect())
    assert pairs(dims=3) == pairs() and len(pairs()) > 30
