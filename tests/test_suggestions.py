"""Suggestions for words of any letters and length against all pairs."""

from quillspark.operators import grammar_ro
from quillspark.plans import applications
from quillspark.sources.lexicons import lexicon


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_suggestions_for_all_words(spark, monkeypatch):
    known = sorted({r.word for r in lexicon(spark, "lex_pos").collect()})
    words = sorted({"é" + known[0], known[1] + "ü1", max(known, key=len) + "xy", "zzzzzzzzzzzzzzzzzzzzzz", *[w[:-1] + "ß" for w in known], *[w[1:] + "éa" for w in known]} - set(known))
    monkeypatch.setattr(applications, "docs_of", lambda spark, sf: None)
    monkeypatch.setattr(applications.segment, "tokens", lambda docs: None)
    monkeypatch.setattr(grammar_ro, "misspelled", lambda tokens, d: spark.createDataFrame([(w,) for w in words], "lemma string"))
    got = sorted((r.lemma, r.rank, r.word) for r in applications.spelling_suggestions_all(spark, None).collect())
    want = []
    for w in words:
        near = sorted((d, k) for k in known if (d := edits(w, k)) <= 2)[:3]
        want += [(w, i, k) for i, (_, k) in enumerate(near, 1)]
    assert got == sorted(want)
