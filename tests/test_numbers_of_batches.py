"""Numbers of whole batches of sentences and of runs of pairs, against plain loops."""

import math
from collections import Counter

import numpy as np

from quillspark.operators import indices, subwords


def test_repetitions_heights_and_entropies_of_batches():
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 4, 0, 10, 31, 2])
    code = rng.integers(0, 5, size.sum())
    got = np.split(indices.repeated(code, size), np.cumsum(size)[:-1])
    for n, w, out in zip(size, np.split(code, np.cumsum(size)[:-1]), got, strict=True):
        want = [1] if n == 1 else [sum(w[j] == w[i] for j in range(i + 1, min(n, i + 8))) if i < max(1, n - 8) else 0 for i in range(n)]
        assert out.tolist() == want
    heads = [np.array([i // 2 for i in range(n)], float) for n in size] + [np.array([1.0, 0.0]), np.array([np.nan, 1.0, 1.0]), np.array([0.0, 9.0, 1.0])]
    found = indices.heights(np.concatenate(heads), np.array([len(h) for h in heads]))
    want = [math.nan if not n else 1 + (math.floor(math.log2(n - 1)) + 1 if n > 1 else 0) for n in size] + [math.nan, 2, 1]
    assert np.array_equal(found, want, equal_nan=True)
    assert np.isclose(indices.form_entropy("banana", 2), 1.054920, atol=1e-6) and indices.form_entropy("a", 2) == indices.form_entropy("", 1) == 0


def test_indices_need_no_shuffle_behind_their_sentences(spark, sf):
    """Sentences are dealt by id once; tokens, blocks and documents stay where they are, and all is computed in one pass."""
    from quillspark.plans import indices as plan
    from quillspark.plans.complexity import docs_of

    values = plan.values(spark, docs_of(spark, sf), plan.SURFACE, 3)
    text = indices.compute_indices(values, plan.SURFACE, "block")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(doc_id") == 2 and text.count("REPARTITION_BY_NUM") == 2 and "SortMergeJoin" not in text and "Union" not in text


def test_runs_of_pairs_train_as_pairs_do():
    rng = np.random.default_rng(7)
    sentences = [[f"w{rng.integers(40)}x" for _ in range(rng.integers(2, 30))] for _ in range(40)]
    start = rng.uniform(-0.1, 0.1, (128, 8))
    model = subwords.Subwords(start.copy(), np.zeros((128, 8)))
    subwords._train(iter(sentences), model, 3, 5, 0.5, 1)
    plain, draw, pairs = subwords.Subwords(start.copy(), np.zeros((128, 8))), np.random.default_rng(1), []
    for s in sentences:
        pairs += [(s[i], s[j]) for i in range(len(s)) for j in range(max(0, i - 3), min(len(s), i + 4)) if i != j]
    for at in range(0, len(pairs), subwords.BATCH):
        part = pairs[at : at + subwords.BATCH]
        right = [subwords._slot(b, 128) for _, b in part]
        wrong = np.array(right)[draw.integers(0, len(right), (len(right), 5))]
        seen = {0: Counter(), 1: Counter()}
        sums = {0: np.zeros((128, 8)), 1: np.zeros((128, 8))}
        for (a, _), r, ws in zip(part, right, wrong, strict=True):
            own = subwords.grams(a, 128)
            h, back = plain.ngrams[own].mean(0), np.zeros(8)
            for k, t in enumerate([r, *ws]):
                out = plain.contexts[t]
                error = 0.0 if k and t == r else ((k == 0) - 1 / (1 + np.exp(-out @ h))) * 0.5
                back += error * out
                sums[1][t] += error * h
                seen[1][t] += 1
            for g in own:
                sums[0][g] += back
                seen[0][g] += 1
        for kind, table in enumerate((plain.ngrams, plain.contexts)):
            for slot, n in seen[kind].items():
                table[slot] += sums[kind][slot] / n
    assert np.allclose(model.ngrams, plain.ngrams, atol=1e-9) and np.allclose(model.contexts, plain.contexts, atol=1e-9)


def test_a_sum_of_several_changes_counts_as_often():
    rng = np.random.default_rng(2)
    at, change, times = rng.integers(0, 6, 30), rng.normal(size=(30, 4)), rng.integers(1, 5, 30)
    one, each = np.zeros((6, 4)), np.zeros((6, 4))
    subwords._add_means(one, at, change * times[:, None], times)
    subwords._add_means(each, np.repeat(at, times), np.repeat(change, times, 0))
    assert np.allclose(one, each)
