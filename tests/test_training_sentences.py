"""Sentences to train on, formed in a sentence's row."""

from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import apps, segment
from quillspark.plans.complexity import annotated_of, docs_of
from quillspark.sources.lexicons import lexicon


def test_training_sentences_are_the_tokens_of_each_sentence_without_a_shuffle(spark, sf):
    t = apps.training_tokens(annotated_of(spark, sf))
    lists = t.groupBy(*segment.SENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_ix", "lemma"))), lambda x: x["lemma"]).alias("words"))
    docs = docs_of(spark, sf)
    got = apps.training_sentences(segment.sentence_words(docs), lexicon(spark, "lex_lemma"), lexicon(spark, "lex_stop"))
    assert Counter(tuple(r.words) for r in got.collect()) == Counter(tuple(r.words) for r in lists.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(tok_ix" not in plan and "Generate posexplode(words" not in plan  # tokens are never rows of their own
