"""N-grams of many words at a time against those of one."""

import numpy as np

from quillspark.operators import subwords


def test_grams_of_many_words_are_those_of_each():
    words = ["the", "a", "", "être", "naïveté", "x" * 40, "ab", "aaaaaaa", "日本", "a😀é", "d\x00d", "the"]
    for some in (words, [w for w in words if w.isascii()], ["é"], [""], []):
        for slots in (1 << 14, 97):
            flat, n, context = subwords.grams_of(some, slots)
            assert context.tolist() == [subwords._slot(w, slots) for w in some]
            assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])][: len(some)] == [subwords.grams(w, slots) for w in some] and n.sum() == len(flat)


def test_vectors_of_many_words_are_those_of_each(spark):
    rng = np.random.default_rng(0)
    model = subwords.Subwords(rng.normal(size=(97, 4)), np.zeros((97, 4)))
    words = ["one", None, "être", "", "x"]
    got = {r.word: r.vec for r in model.vectors(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got[None] is None and all(np.allclose(got[w], model.vector(w)) for w in words if w is not None)
    assert model.vectors(spark.createDataFrame([(None,)], "word string")).first().vec is None
