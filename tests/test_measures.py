"""Hand-computed values of segmentation, measures, reducers and rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import apps, biblio, cohesion, comprehension, grammar_ro, kernels, measures, segment, threads, vectors
from quillspark.operators import reduce as reducers
from quillspark.operators.components import connected_components

TEXT = "This is a text string. Does the parsing work?\nSecond paragraph."


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_levels(spark):
    d = docs(spark, TEXT)
    s = measures.by_sentence(d).filter("sent_ix is not null")
    assert [r.wd for r in s.orderBy("block_ix", "sent_ix").collect()] == [6, 5, 3]
    r = reducers.summary(s, ["doc_id"], ["wd"]).first()
    assert (r.m_wd, r.sd_wd, r.max_wd) == (4.666667, 1.527525, 6.0)
    p = reducers.summary(measures.additive(measures.by_sentence(d), segment.BLOCK, ["wd"]), ["doc_id"], ["wd"]).first()
    assert (p.m_wd, p.sd_wd, p.max_wd) == (7.0, 5.656854, 11.0)
    every = {(r.block_ix, r.sent_ix, r["index"]): r.value for r in reducers.all_levels(s.withColumn("value", F.col("wd")), "Wd", "sent").collect()}
    assert every[None, None, "M(Wd / Sent)"] == 4.666667 and every[1, None, "SD(Wd / Sent)"] == 0 and every[0, 1, "Max(Wd / Sent)"] == 5


def test_empty_blocks_and_texts(spark):
    b = measures.additive(measures.by_sentence(docs(spark, "a\n\n\nb", "", None)), segment.BLOCK, ["wd"])
    assert {(r.doc_id, r.m_wd) for r in reducers.summary(b, ["doc_id"], ["wd"]).collect()} == {(0, 0.666667), (1, 0.0), (2, 0.0)}


def test_missing_space_is_repaired(spark):
    assert segment.sentences(docs(spark, "one.Two three")).count() == 2


def test_entropy(spark):
    rows = {r.doc_id: round(r.wdentr, 6) for r in measures.word_entropy(segment.tokens(docs(spark, "a b a c", "a b c d")), ["doc_id"]).collect()}
    assert rows == {0: 1.039721, 1: 1.386294}
    r = docs(spark, "banana", "x").select(F.round(measures.gram_entropy(F.col("text"), 2), 6).alias("e")).collect()
    assert [x.e for x in r] == [1.054920, 0.0]


@pytest.mark.parametrize(("text", "n"), [("one", 1), ("a b a b", 1), ("b a c a c", 0), ("a b c d a b c d a b", 2), ("a b c d e f g h a", 0)])
def test_repetitions(spark, text, n):
    assert measures.repetitions(docs(spark, text)).first().repetitions == n


def test_parse_depth(spark):
    rows = [(0, 0, 0, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 2, 1), (0, 0, 0, 3, 2), (0, 0, 1, 0, 0), (0, 0, 2, 0, 1), (0, 0, 2, 1, 0)]
    t = spark.createDataFrame(rows, "doc_id bigint, block_ix int, sent_ix int, tok_ix int, head_ix int")
    assert {r.sent_ix: r.depth for r in measures.parse_depth(t).collect()} == {0: 4, 1: 1, 2: None}


def test_overlap_and_kernels(spark):
    r = spark.sql("SELECT array('cat','sit','mat') a, array('cat','mat','dog') b").select(cohesion.jaccard(F.col("a"), F.col("b"))).first()[0]
    assert round(r, 6) == round(2 / (4 + 1e-5), 6)
    s = spark.createDataFrame([(1, "banana"), (2, "bandana")], "id int, text string")
    p = spark.createDataFrame([(1, 2), (1, 1)], "a int, b int")
    k = {(r.a, r.b): r for r in kernels.kernels(p, s, 1, 2).collect()}
    assert (k[1, 2].intersection, k[1, 2].presence, k[1, 2].spectrum, round(k[1, 2].normalized, 6)) == (10, 6, 21, 0.836242)
    assert k[1, 1].intersection == 11 and k[1, 1].normalized == 1
    clusters = spark.createDataFrame([("a", "v"), ("n", "v")], "gram string, cluster string")
    assert kernels.kernels(p, s, 1, 1, clusters).filter("b = 2").first().presence == 2


def test_end_cohesion(spark):
    def at(cosine):
        return [cosine, math.sqrt(1 - cosine**2)]

    rows = [(0, 0, [1.0, 0.0]), (0, 1, at(0.9)), (0, 2, at(0.5)), (0, 3, at(0.3)), (1, 0, [1.0, 0.0]), (1, 1, at(0.5)), (2, 0, None)]
    r = {x.p: x for x in cohesion.end_cohesion(spark.createDataFrame(rows, "p int, place int, vec array<double>"), ["p"], "place").collect()}
    assert round(r[0].start_mid, 6) == 0.681818 and round(r[0].start_end, 6) == 0.3
    assert round(r[1].start_end, 6) == 0.5 and r[1].start_mid is None and r[2].start_end is None


def test_reducers_skip_nulls(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 2.0), (1, null), (1, 4.0), (2, 5.0), (3, cast(null as double)) t(doc_id, v)")
    got = {r.doc_id: (r.m_v, r.sd_v, r.max_v) for r in reducers.summary(rows, ["doc_id"], ["v"]).collect()}
    assert got == {1: (3.0, 1.414214, 4.0), 2: (5.0, 0.0, 5.0), 3: (None, None, None)}


def test_participant_scores(spark):
    posts = spark.createDataFrame([(0, 0, "u1"), (0, 1, "u2"), (0, 2, "u1")], "conv_id int, ix int, user string")
    edges = spark.createDataFrame([(0, 2, 1, 0.4), (0, 1, 0, 0.6), (0, 2, 0, 0.2)], "conv_id int, a int, b int, weight double")
    got = {(r.source, r.target): r.score for r in threads.interaction(posts, edges).collect()}
    assert got == {("u1", "u2"): 0.4, ("u2", "u1"): 0.6, ("u1", "u1"): 0.2}
    social = {r.user: r.social_kb for r in threads.involvement(posts, edges, posts.select("conv_id", "ix", F.lit(1.0).alias("importance"))).collect()}
    assert social == {"u1": 0.4, "u2": 0.6}


def test_time_merge(spark):
    rows = [(0, i, "u", t, str(t)) for i, t in enumerate([0, 20, 40])] + [(1, 0, "u", 0, "a"), (1, 1, "v", 5, "b"), (1, 2, "u", 6, "c")]
    got = threads.merged_posts(spark.createDataFrame(rows, "g int, id bigint, user string, t bigint, text string"), "g").collect()
    assert sorted((r.g, r.id, r.n, r.text) for r in got) == [(0, 0, 2, "0 20"), (0, 2, 1, "40"), (1, 0, 1, "a"), (1, 1, 1, "b"), (1, 2, 1, "c")]


def test_merged_posts_query_against_a_plain_fold(spark, sf):
    from quillspark.plans import community

    open_, want = {}, []
    for r in sorted(community.activity(spark, sf).collect(), key=lambda r: (r.user % 10, r.t, r.id)):
        k = r.user % 10
        if k in open_ and open_[k][1] == r.user and r.t - open_[k][2] <= 1800:
            open_[k][3] += 1
        else:
            if k in open_:
                want.append(tuple(open_[k]))
            open_[k] = [r.id, r.user, r.t, 1]
    want += [tuple(x) for x in open_.values()]
    assert sorted((r.id, r.user, r.t, r.n) for r in community.merged_posts(spark, sf).collect()) == sorted(want)


def test_keyword_threshold(spark):
    t = spark.createDataFrame([(0, "at", [0.3, math.sqrt(1 - 0.09)]), (0, "below", [0.29, math.sqrt(1 - 0.29**2)])], "doc_id bigint, lemma string, vec array<double>")
    assert [r.lemma for r in apps.keywords(t, spark.createDataFrame([(0, [1.0, 0.0])], "doc_id bigint, vec array<double>")).collect()] == ["at"]


def test_mutual_cohesion_is_the_mean_over_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(int(p), [float(x) for x in rng.normal(size=3)] if rng.random() > 0.2 else None) for p in rng.integers(0, 6, 40)]
    got = {r.p: r.cohesion for r in cohesion.mutual_cohesion(spark.createDataFrame(rows, "p int, vec array<double>"), ["p"], 3).collect()}
    for p in {r[0] for r in rows}:
        v = [np.array(x) if x else None for q, x in rows if q == p]
        sims = [0 if v[i] is None or v[j] is None else v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) for i in range(len(v)) for j in range(i)]
        assert abs(got[p] - (np.mean(sims) if sims else 1)) < 1e-9


def test_page_rank_sums_to_one_and_solves_its_equation():
    rng = np.random.default_rng(0)
    src, dst, w = rng.integers(0, 20, 60), rng.integers(0, 20, 60), rng.random(60)
    r = cohesion.page_rank(src, dst, w, 22, tolerance=1e-12)
    a = np.zeros((22, 22))
    np.add.at(a, (src, dst), w)
    out = a.sum(1)
    a[out > 0] /= out[out > 0][:, None]
    a[out == 0] = 1 / 22
    assert abs(r.sum() - 1) < 1e-9 and np.allclose(r, 0.85 * r @ a + 0.15 / 22, atol=1e-9)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_betweenness(n, edges):
    """Over all shortest paths, written out."""
    from itertools import product

    near = {i: [v for u, v, _ in edges if u == i] for i in range(n)}

    def paths(s, t):
        layer, found, seen = [[s]], [], {s}
        while layer and not found:
            nxt, new = [], set()
            for p in layer:
                for v in near[p[-1]]:
                    if v == t:
                        found.append([*p, v])
                    elif v not in seen:
                        nxt.append([*p, v])
                        new.add(v)
            layer, seen = nxt, seen | new
        return found

    out = np.zeros(n)
    for s, t in product(range(n), repeat=2):
        if s != t and (ps := paths(s, t)):
            for p in ps:
                for v in p[1:-1]:
                    out[v] += 1 / len(ps)
    return out / ((n - 1) * (n - 2))


def test_centralities():
    rng = np.random.default_rng(2)
    edges = sorted({(int(a), int(b), 1.0) for a, b in rng.integers(0, 7, (14, 2)) if a != b})
    b, c, e = threads.centralities(7, edges)
    assert np.allclose(b, plain_betweenness(7, edges))
    both = sorted({(min(u, v), max(u, v), 1.0) for u, v, _ in edges})
    close, between = biblio.weighted_centralities(7, both)
    assert np.allclose(between, plain_betweenness(7, [*both, *[(v, u, w) for u, v, w in both]]))
    assert (close >= 0).all() and (close <= 1).all() and abs(np.linalg.norm(e) - 1) < 1e-6 and (c >= 0).all()


def test_assignment_is_the_cheapest():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for shape in ((3, 3), (2, 4), (4, 2), (1, 1)):
        cost = rng.integers(0, 20, shape).astype(float)
        got = sum(cost[i, j] for i, j in biblio.assignment(cost))
        small, wide = sorted(shape)
        c = cost if shape[0] <= shape[1] else cost.T
        assert got == min(sum(c[i, p[i]] for i in range(small)) for p in permutations(range(wide), small))


def test_submodular_choice_is_greedy():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(25, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen = apps.submodular_choice(x @ x.T)
    assert len(chosen) == 5 == len(set(chosen)) and chosen == sorted(chosen)
    assert apps.submodular_choice(np.ones((3, 3))) == []


def test_collinear_drops_the_weaker():
    m = np.array([[1, 0.95, 0.2], [0.95, 1, 0.93], [0.2, 0.93, 1]])
    assert apps.collinear(["a", "b", "c"], {"a": 0.5, "b": 0.4, "c": 0.1}, m) == ["a", "c"]


def test_activation_of_concepts():
    rows = comprehension.read_document({0: [("cat", "sit")], 1: [("cat", "mat"), ("mat", "sit")]}, 0.3, 2)
    assert {r[1] for r in rows if r[0] == 1} == {"cat", "mat", "sit"} and max(r[2] for r in rows) == 1.0
    assert sum(r[3] for r in rows if r[0] == 1) == 2


def test_grammar(spark):
    t = segment.tokens(docs(spark, "Spun la la masă. El vine totuși aici, totuși pleacă. Deci da.")).withColumn("is_stop", F.lit(False))
    assert grammar_ro.cacophonies(t).count() == 1
    assert grammar_ro.without_comma(t).count() == 1
    assert grammar_ro.listed(t, grammar_ro.START_ADVERBS, first=True).count() == 1
    assert {r.lemma for r in grammar_ro.near_repetitions(t).collect()} == {"la", "totuși"}
    assert spark.sql("SELECT 'e Mai mare ca tine' t").select(grammar_ro.comparatives(F.col("t"))).first()[0] == ["Mai mare ca"]
    r = spark.sql("SELECT 'a  b ,c' t, 'Case=Acc,Nom,Xyz|Number=Sing' f").select(grammar_ro.collapsed_spaces(F.col("t")), grammar_ro.feature_values(F.col("f"), "Case"), grammar_ro.feature_values(F.col("f"), "Person")).first()
    assert tuple(r) == ("a b,c", ["Acc", "Nom"], [])
    tags = [(0, 0, 0, 0, "casă", "Ncfsrn", 0), (0, 0, 0, 1, "frumos", "Afpms-n", 0), (0, 0, 0, 2, "mare", "Afp-s-n", 0)]
    d = spark.createDataFrame(tags, "doc_id bigint, block_ix int, sent_ix int, tok_ix int, text string, tag string, head_ix int")
    assert [(r.text, r.gender, r.number) for r in grammar_ro.disagreements(d).collect()] == [("frumos", True, False)]


def test_suggestions(spark):
    w = spark.createDataFrame([("hte",), ("cxt",)], "lemma string")
    d = spark.createDataFrame([("the",), ("cat",), ("cut",)], "word string")
    assert sorted((r.lemma, r.rank, r.word) for r in grammar_ro.suggestions(w, d, 2).collect()) == [("cxt", 1, "cat"), ("cxt", 2, "cut"), ("hte", 1, "the")]


def test_romanian_letters(spark):
    r = spark.sql("SELECT 'Învîrt şi ţes' t").select(apps.normalized_ro(F.col("t")), apps.stripped(F.col("t"))).first()
    assert tuple(r) == ("Învârt și țes", "Invirt si tes")


def test_flipped_buckets(spark):
    r = spark.range(1).select(vectors.buckets_near(F.lit(5), 3, 1), F.size(vectors.buckets_near(F.lit(0), 8, 2))).first()
    assert sorted(r[0]) == [1, 4, 5, 7] and r[1] == 1 + 8 + 28


def test_values_beyond_limits_without_a_shuffle(spark):
    rows = [(d, float((d * 7 + i * i) % 11), None if i % 4 == 1 else float(i)) for d in range(6) for i in range(1, 2 + 5 * d)] + [(9, 30.0, None)]
    v = spark.createDataFrame(rows, "doc_id bigint, x double, y double").repartition(3, "doc_id")
    long = v.select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("index"), F.col(n).alias("value")) for n in "xy"])))
    w = apps.fluctuations(long, ["doc_id", "index"])
    beyond = F.count_if((F.col("value") < F.round("low", 9) - 1e-6) | (F.col("value") > F.round("high", 9) + 1e-6))
    want = w.groupBy("doc_id", "index").agg(F.count(F.lit(1)).alias("n"), F.first("low"), F.first("high"), beyond)
    got = apps.beyond_limits(v, ["x", "y"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")
    assert plan(got) == 1 < plan(want)  # rows are dealt once, by repartition


def test_index_fluctuations_deal_documents_once(spark, sf):
    from quillspark.plans import further

    rows = further.index_fluctuations(spark, sf)
    rows.collect()
    final = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning(doc_id") == 1
