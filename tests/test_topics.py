"""Topics are fitted on all documents and all their training tokens."""

from collections import Counter

import numpy as np
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillspark.operators import apps, segment
from quillspark.plans.complexity import annotated_of, docs_of
from quillspark.sources.lexicons import lexicon


def test_each_document_counts_in_a_topic_model(spark):
    n = 60  # each has a term of its own, 2,000 times
    rows = spark.createDataFrame([(Vectors.sparse(n, [i], [2000.0]),) for i in range(n)], StructType([StructField("features", VectorUDT())]))
    weight = np.array(list(apps.topic_model(rows, 5, 3).topicsMatrix().toArray())).reshape(5, n).sum(0)  # by columns
    assert weight.min() > 100  # a term of a document that is left out has some 5, what it began with


def test_training_words_of_texts_are_those_of_their_sentences(spark, sf):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "The end.Then dogs!cats ...\n\n of 3a b4 d'être\n.one")], "doc_id bigint, text string")
    docs = docs_of(spark, sf).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").union(odd)
    of = lambda rows: Counter(w for r in apps.training_sentences(rows, lexicon(spark, "lex_lemma"), lexicon(spark, "lex_stop")).collect() for w in r.words)
    assert of(docs.select(segment.words(F.col("text")).alias("words"))) == of(segment.sentence_words(docs))
    t = apps.training_tokens(annotated_of(spark, sf)).groupBy("lemma").count()
    assert of(docs_of(spark, sf).select(segment.words(F.col("text")).alias("words"))) == Counter({r.lemma: r["count"] for r in t.collect()})
