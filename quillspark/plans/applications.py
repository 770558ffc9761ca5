"""Queries of applications, lexical relations and language rules, each with the SQL it is checked against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import apps, grammar_ro, measures, segment, wordnet
from ..sources.lexicons import as_sql, lexicon, local_table
from ..sources.tables import stored, table
from .community import rounded
from .complexity import annotated_of, docs_of
from .similarity import WV, cos, element_vectors, pooled_sql, sentence_nodes, word_vectors
from .sqltext import ANNOTATED, SENTENCES, TOKENS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CONTENT = "('ADJ', 'ADV', 'NOUN', 'VERB')"
WVA = WV.replace("FROM t)", "FROM a)")


@query(f"WITH {ANNOTATED}, {WVA}, {pooled_sql('d', 'doc_id')}, w AS (SELECT doc_id, lemma, [v0, v1, v2, v3, v4]::DOUBLE[] AS vec FROM wv WHERE pos IN {CONTENT} AND NOT is_stop AND v0 IS NOT NULL), k AS (SELECT w.doc_id, lemma, sum({cos('w.vec', 'd.vec')}) AS score FROM w JOIN d ON w.doc_id = d.doc_id GROUP BY ALL) SELECT doc_id, lemma, round(score, 6) AS score FROM k WHERE round(score, 9) >= 0.3")
def keywords(spark, sf):
    t = word_vectors(annotated_of(spark, sf))
    from ..operators.vectors import pooled

    content = t.filter(F.col("pos").isin("ADJ", "ADV", "NOUN", "VERB") & ~F.col("is_stop") & F.col("vec").isNotNull())
    return rounded(apps.keywords(content, pooled(t, ["doc_id"], 5)), "score")


@query()
def submodular_summary(spark, sf):
    """Greedy submodular choice of sentences; a test holds the choice itself against hand-made similarities."""
    return apps.submodular_summary(sentence_nodes(spark, sf).select("doc_id", "place", "vec"))


WD = "c AS (SELECT doc_id, block_ix, sent_ix, count(*)::DOUBLE AS value FROM t GROUP BY ALL)"


@query(f"WITH {TOKENS}, {WD}, fl AS (SELECT doc_id, avg(value) AS m, CASE WHEN count(*) = 1 THEN 2 ELSE 2 * stddev_pop(value) END AS d FROM c GROUP BY doc_id) SELECT doc_id, block_ix, sent_ix, value, round(greatest(m - d, 0), 6) AS low, round(m + d, 6) AS high, value < round(greatest(m - d, 0), 9) OR value > round(m + d, 9) AS outside FROM c JOIN fl USING (doc_id)")
def fluctuations(spark, sf):
    v = measures.by_sentence(docs_of(spark, sf)).filter("sent_ix is not null").select("doc_id", "block_ix", "sent_ix", F.col("wd").cast("double").alias("value"))
    out = apps.fluctuations(v, ["doc_id"])
    return rounded(out.withColumn("outside", (F.col("value") < F.round("low", 9)) | (F.col("value") > F.round("high", 9))), "low", "high")


@query(f"""WITH {TOKENS}, c AS (SELECT doc_id, block_ix, sent_ix, count(*) AS v FROM t GROUP BY ALL), l AS (SELECT doc_id, list(v ORDER BY block_ix, sent_ix) AS v FROM c GROUP BY doc_id) SELECT doc_id, '[{{"level":"sent","indices":["Wd"],"results":[[' || array_to_string(v, ',') || ']]}}]' AS feedback FROM l""")
def feedback(spark, sf):
    v = measures.by_sentence(docs_of(spark, sf)).filter("sent_ix is not null")
    place = F.struct("block_ix", "sent_ix")
    return apps.feedback(v.select("doc_id", F.lit("sent").alias("level"), place.alias("place"), F.lit("Wd").alias("index"), F.col("wd").alias("value")))


NAMES = ["commas", "punct", "sentences", "unqwd", "wd"]
FEATS = r"f0 AS (SELECT doc_id, count(*)::DOUBLE AS wd, count(*) FILTER (regexp_full_match(text, '[^\p{L}\p{N}]'))::DOUBLE AS punct, count(*) FILTER (text = ',')::DOUBLE AS commas, count(DISTINCT (block_ix, sent_ix))::DOUBLE AS sentences, count(DISTINCT text)::DOUBLE AS unqwd FROM t GROUP BY doc_id), f AS (UNPIVOT f0 ON wd, punct, commas, sentences, unqwd INTO NAME index VALUE value)"


def features(spark, sf) -> DataFrame:
    """doc_id, index, value, in long form."""
    return feature_table(spark, sf).unpivot("doc_id", NAMES, "index", "value")


def targets(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").filter("quality is not null").select("doc_id", F.col("quality").cast("double").alias("target"))


@query(f"WITH {TOKENS}, {FEATS} SELECT doc_id, commas, punct, sentences, unqwd, wd FROM f0")
def feature_table(spark, sf):
    return feature_rows(docs_of(spark, sf))


def feature_rows(docs: DataFrame) -> DataFrame:
    return measures.by_document(docs).select("doc_id", *[F.col(n).cast("double").alias(n) for n in NAMES])


def labelled_features(spark, sf) -> DataFrame:
    """The feature table of the documents that have a target, and the target: written once, since fits go over it many times."""
    t = targets(spark, sf)
    return stored(feature_rows(docs_of(spark, sf).join(t.select("doc_id"), "doc_id", "left_semi")).join(t, "doc_id"), "labelled-features")


@query(f"WITH {TOKENS}, {FEATS}, n AS (SELECT count(*) AS n FROM documents) SELECT index, round(1 - count(*) FILTER (value <> 0) / max(n), 6) AS zeros, 1 - count(*) FILTER (value <> 0) / max(n) < 0.2 AS kept FROM f, n GROUP BY index")
def rare_features(spark, sf):
    return rounded(apps.rare_features(features(spark, sf), table(spark, sf, "documents").count()), "zeros")


@query(f"WITH {TOKENS}, {FEATS} SELECT index, round(abs(corr(value, quality)), 6) AS correlation FROM f JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY index")
def target_correlations(spark, sf):
    return rounded(apps.correlations(features(spark, sf), targets(spark, sf)), "correlation")


@query(f"WITH {TOKENS}, {FEATS}, j AS (SELECT index, quality, value FROM f JOIN labels USING (doc_id) WHERE quality IS NOT NULL), g AS (SELECT index, quality, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM j GROUP BY ALL), x AS (SELECT index, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g GROUP BY ALL) SELECT index, round((b - s * s / n) / (k - 1) / ((q - b) / (n - k)), 6) AS f FROM x")
def class_anova(spark, sf):
    return rounded(apps.anova(features(spark, sf), targets(spark, sf).withColumnRenamed("target", "label")), "f")


@query()
def collinear_features(spark, sf):
    """Indices that remain after the greedy removal of collinear ones; tests hold the greedy step against a plain version."""
    f = features(spark, sf)
    strength = {r["index"]: r.correlation or 0.0 for r in apps.correlations(f, targets(spark, sf)).collect()}  # one row an index
    w = apps.wide(f, NAMES)
    r = w.agg(*[F.corr(a, b).alias(f"{a}__{b}") for i, a in enumerate(NAMES) for b in NAMES[:i]]).first()
    m = np.eye(len(NAMES))
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[:i]):
            m[i, j] = m[j, i] = r[f"{a}__{b}"] if r[f"{a}__{b}"] is not None else 0.0
    return spark.createDataFrame([(c,) for c in apps.collinear(NAMES, strength, m)], "index string")


@query(f"WITH {TOKENS}, {FEATS}, mm AS (SELECT index, min(value) AS lo, max(value) AS hi FROM f JOIN labels USING (doc_id) GROUP BY index) SELECT doc_id, f.index, round(coalesce(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) END, 0), 6) AS value FROM f JOIN mm ON mm.index = f.index")
def scaled_features(spark, sf):
    return rounded(apps.min_max(features(spark, sf), table(spark, sf, "labels").select("doc_id")), "value")


@query()
def quality_classifier(spark, sf):
    """Held-out predictions of a random forest over the feature table, by quality label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(labelled_features(spark, sf))
    train, test = rows.filter(~apps.hash_split(F.col("doc_id"), 0.2)), rows.filter(apps.hash_split(F.col("doc_id"), 0.2))
    model = RandomForestClassifier(labelCol="target", numTrees=10, maxDepth=5, seed=0).fit(train)
    return model.transform(test).select("doc_id", "target", "prediction")


# Sizes of lines stand in for ratings 1 to 5.
RATED = "rt AS (SELECT event_id, user_id, 1 + event_id % 5 + CASE WHEN event_id % 7 = 0 AND event_id % 5 < 4 THEN 1 ELSE 0 END AS rating FROM events)"


def rated(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", "user_id", (1 + i % 5 + F.when((i % 7 == 0) & (i % 5 < 4), 1).otherwise(0)).alias("rating"))


@query(f"WITH {RATED} SELECT event_id, CASE WHEN rating = 5 THEN 1 ELSE 0 END AS five, greatest(rating::INT - 2, 0) AS four FROM rt")
def rating_classes(spark, sf):
    return rated(spark, sf).select("event_id", apps.five_against_all(F.col("rating")).alias("five"), apps.four_classes(F.col("rating")).alias("four"))


@query(f"WITH {RATED} SELECT rating, round((SELECT count(*) FROM rt) / ((SELECT count(DISTINCT rating) FROM rt) * count(*)), 6) AS weight FROM rt GROUP BY rating")
def class_weights(spark, sf):
    return rounded(apps.class_weights(rated(spark, sf), "rating"), "weight")


@query(f"WITH {RATED}, c AS (SELECT rating, count(*) AS n FROM rt GROUP BY ALL), m AS (SELECT max(n) AS most FROM c), r AS (SELECT rt.*, n, most, row_number() OVER (PARTITION BY rt.rating ORDER BY md5(event_id::VARCHAR), event_id) AS r FROM rt JOIN c USING (rating), m) SELECT event_id, user_id, rating, unnest(range(1, (most // n + CASE WHEN r <= most % n THEN 1 ELSE 0 END + 1)::BIGINT))::INT AS copy FROM r")
def balanced_classes(spark, sf):
    return apps.balanced(rated(spark, sf), "rating", "event_id")


@query(f"WITH {RATED} SELECT rating, count(*) AS n FROM rt GROUP BY rating")
def rating_histogram(spark, sf):
    return rated(spark, sf).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SENTENCES} SELECT doc_id, arg_max(trim(text), (block_ix, sent_ix)) AS last FROM s GROUP BY doc_id")
def last_sentences(spark, sf):
    return segment.sentences(docs_of(spark, sf)).groupBy("doc_id").agg(F.max_by(F.trim("text"), F.struct("block_ix", "sent_ix")).alias("last"))


@query("SELECT doc_id, translate(coalesce(text, ''), 'ăâîșşțţĂÂÎȘŞȚŢ', 'aaissttAAISSTT') AS text FROM documents")
def stripped_diacritics(spark, sf):
    return docs_of(spark, sf).select("doc_id", apps.stripped(F.coalesce("text", F.lit(""))).alias("text"))


@query("WITH d AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark), c AS (SELECT item_id, i, text, substring(text, i, 1) AS ch FROM d) SELECT item_id, (i - 1)::INT AS at, substring('     ' || translate(text, 'ăâîșşțţĂÂÎȘŞȚŢ', 'aaissttAAISSTT') || '     ', i, 11) AS window, CASE lower(ch) WHEN 'ă' THEN 1 WHEN 'â' THEN 2 WHEN 'î' THEN 3 WHEN 'ș' THEN 4 WHEN 'ț' THEN 4 ELSE 0 END AS label FROM c WHERE lower(ch) IN ('a', 'ă', 'â', 'i', 'î', 's', 'ș', 't', 'ț')")
def diacritic_windows(spark, sf):
    return apps.diacritic_windows(table(spark, sf, "benchmark").select("item_id", "text"))


@query(r"SELECT count(*) AS documents, sum(len(regexp_extract_all(text, '[^.!?\n]*[^.!?\n\s][^.!?\n]*[.!?]*')))::BIGINT AS sentences, sum(len(regexp_extract_all(text, '[\p{L}\p{N}]+')))::BIGINT AS words, sum(length(text))::BIGINT AS chars, sum(length(replace(text, ' ', '')))::BIGINT AS chars_no_space, sum(len(regexp_extract_all(lower(text), '[aăâiîsștț]')))::BIGINT AS restorable FROM (SELECT coalesce(text, '') AS text FROM documents)")
def corpus_statistics(spark, sf):
    return apps.corpus_statistics(docs_of(spark, sf))


@query("SELECT letter, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS letter FROM documents) WHERE letter <> '' GROUP BY letter")
def letter_counts(spark, sf):
    return apps.letter_counts(docs_of(spark, sf))


@query("WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, text FROM conversations), p AS (SELECT conv_id, k // 2 AS pair, max(CASE WHEN k % 2 = 0 THEN text END) AS target, max(CASE WHEN k % 2 = 1 THEN text END) AS source FROM l GROUP BY ALL) SELECT conv_id, pair, target, source FROM p WHERE target IS NOT NULL AND source IS NOT NULL")
def correction_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    lines = table(spark, sf, "conversations").withColumn("k", F.row_number().over(w) - 1)
    half = lambda odd: F.max(F.when(F.col("k") % 2 == odd, F.col("text")))
    out = lines.groupBy("conv_id", F.floor(F.col("k") / 2).alias("pair")).agg(half(0).alias("target"), half(1).alias("source"))
    return out.filter("target is not null and source is not null")


@query(r"SELECT item_id, list_concat(a[1:20], list_transform(range(greatest(0, 20 - len(a))), lambda x: 0)) AS ids FROM (SELECT item_id, list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w)) AS a FROM benchmark)")
def fitted_ids(spark, sf):
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), lambda w: F.length(w))
    return table(spark, sf, "benchmark").select("item_id", F.transform(apps.fitted(ids, 20), lambda x: x.cast("bigint")).alias("ids"))


BEAMS = "be AS (SELECT event_id // 4 AS \"group\", event_id % 4 AS beam, -abs(value) / 100 AS logp, event_id % 4 = 3 AS finished FROM events), sc AS (SELECT \"group\", beam, t.token, -(beam + 1) / (t.token + 2.0) AS step FROM be, (SELECT unnest(range(5)) AS token) t)"


@query(f'WITH {BEAMS}, g AS (SELECT be."group", be.beam, token, logp + step AS logp FROM be JOIN sc ON be."group" = sc."group" AND be.beam = sc.beam WHERE NOT finished UNION ALL SELECT "group", beam, -1, logp FROM be WHERE finished), r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(logp, 9) DESC, beam, token) AS rank FROM g) SELECT "group", rank, beam, token::BIGINT AS token, round(logp, 6) AS logp FROM r WHERE rank <= 4')
def beam_search_step(spark, sf):
    i = F.col("event_id")
    b = table(spark, sf, "events").select(F.floor(i / 4).alias("group"), (i % 4).alias("beam"), (-F.abs("value") / 100).alias("logp"), (i % 4 == 3).alias("finished"))
    s = b.select("group", "beam", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("token")).withColumn("logp", -(F.col("beam") + 1) / (F.col("token") + 2.0))
    return rounded(apps.beam_step(b, s, 4).withColumn("token", F.col("token").cast("bigint")), "logp")


@query(f"WITH {ANNOTATED}, f AS (SELECT * FROM a WHERE regexp_full_match(text, '\\p{{L}}+') AND NOT is_stop), d AS (SELECT lower(lemma) AS lemma, count(DISTINCT doc_id) AS df FROM f GROUP BY ALL) SELECT lemma, df FROM d WHERE df >= 8 AND df <= 0.1 * (SELECT count(*) FROM documents)")
def training_dictionary(spark, sf):
    return apps.dictionary(apps.training_tokens(annotated_of(spark, sf)), table(spark, sf, "documents").count())


@query(f"WITH {ANNOTATED}, c AS (SELECT doc_id, lower(lemma) AS lemma, count(*) AS n FROM a WHERE regexp_full_match(text, '\\p{{L}}+') AND NOT is_stop GROUP BY ALL), e AS (SELECT doc_id, 1 + (sum(n * ln(n)) / sum(n) - ln(sum(n))) / ln((SELECT count(*) FROM documents)) AS e FROM c GROUP BY doc_id) SELECT doc_id, lemma, round(ln(n + 1) * e, 6) AS weight FROM c JOIN e USING (doc_id)")
def log_entropy(spark, sf):
    c = apps.training_tokens(annotated_of(spark, sf)).groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("n"))
    return rounded(apps.log_entropy(c, table(spark, sf, "documents").count()), "weight")


@query()
def trained_word_vectors(spark, sf):
    """Word2Vec over training tokens: word and vector of the model's vocabulary."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    lists = apps.training_sentences(segment.sentence_words(docs_of(spark, sf)), lexicon(spark, "lex_lemma"), lexicon(spark, "lex_stop"))
    lists = stored(lists, "sentences")  # the vocabulary and the training read them
    return Word2Vec(vectorSize=16, windowSize=5, minCount=5, maxIter=1, seed=0, numPartitions=4, inputCol="words", outputCol="v").fit(lists).getVectors().select("word", vector_to_array("vector").alias("vector"))


@query()
def topics(spark, sf):
    """LDA over the training dictionary, each round over all documents: topic, and its terms by weight."""
    from pyspark.ml.feature import CountVectorizer

    # a training token never goes across the end of a sentence, so those of a whole text are those of its sentences
    texts = docs_of(spark, sf).select(segment.words(F.col("text")).alias("words"))
    t = stored(apps.training_sentences(texts, lexicon(spark, "lex_lemma"), lexicon(spark, "lex_stop")), "training-words")  # read for the dictionary and for the counts
    model = CountVectorizer(inputCol="words", outputCol="features", minDF=8, maxDF=0.1, vocabSize=2**31 - 1).fit(t)
    lda = apps.topic_model(stored(model.transform(t).select("features"), "term-counts"), 5, 3)  # read in each round
    best = [list(terms._1()) for terms in lda.describeTopics(10)]  # ten of each topic
    return local_table(spark, [(i, [model.vocabulary[x] for x in terms]) for i, terms in enumerate(best)], "topic int, terms array<string>")


# --- lexical relations: a small hierarchy of invented senses over frequent forms ---

SYNSETS = [(1, "the", "n"), (1, "of", "n"), (2, "of", "n"), (2, "and", "n"), (3, "is", "v"), (4, "are", "v"), (5, "in", "n"), (6, "on", "n"), (6, "in", "n"), (7, "to", "v"), (8, "that", "n"), (9, "this", "n"), (3, "was", "v")]
HYPERNYMS = [(1, 8), (2, 8), (5, 1), (6, 2), (8, 9), (4, 3), (7, 3)]
WN = "sw(synset, word, pos) AS (VALUES " + ", ".join(f"({s}, '{w}', '{p}')" for s, w, p in SYNSETS) + "), hy(synset, parent) AS (VALUES " + ", ".join(map(str, HYPERNYMS)) + "), up AS (SELECT DISTINCT synset AS s, synset AS a, 0 AS d FROM sw UNION ALL SELECT up.s, hy.parent, d + 1 FROM up JOIN hy ON hy.synset = up.a), cl AS (SELECT s AS synset, a AS ancestor, min(d) AS distance FROM up GROUP BY ALL), dp AS (SELECT synset, min(distance) AS depth FROM cl WHERE ancestor NOT IN (SELECT synset FROM hy) GROUP BY synset)"


def synsets(spark):
    return local_table(spark, SYNSETS, "synset int, word string, pos string"), local_table(spark, HYPERNYMS, "synset int, parent int")


@query(f"WITH RECURSIVE {WN} SELECT word, max(depth) AS max_depth, round(avg(depth), 6) AS avg_depth, count(*) AS paths FROM sw JOIN dp USING (synset) GROUP BY word")
def hypernym_depths(spark, sf):
    s, h = synsets(spark)
    return rounded(wordnet.hypernym_measures(s, wordnet.depths(wordnet.ancestors(s, h), h)), "avg_depth")


@query(f"WITH RECURSIVE {WN}, syn AS (SELECT DISTINCT a.word, b.word AS synonym FROM sw a JOIN sw b ON a.synset = b.synset AND a.word <> b.word) SELECT w.word, count(synonym) AS polysemy FROM (SELECT DISTINCT word FROM sw) w LEFT JOIN syn ON syn.word = w.word GROUP BY w.word")
def polysemy(spark, sf):
    return wordnet.polysemy(synsets(spark)[0])


@query(f"WITH RECURSIVE {WN} SELECT DISTINCT a.word, b.word AS hypernym FROM sw a JOIN hy ON hy.synset = a.synset JOIN sw b ON b.synset = hy.parent WHERE a.word <> b.word")
def hypernym_words(spark, sf):
    return wordnet.hypernym_words(*synsets(spark))


def word_pairs(spark) -> DataFrame:
    words = synsets(spark)[0].select("word").distinct()
    return words.select(F.col("word").alias("a")).crossJoin(words.select(F.col("word").alias("b"))).filter("a < b")  # a lexicon of fixed size


PAIRS = "pr AS (SELECT a.word AS a, b.word AS b FROM (SELECT DISTINCT word FROM sw) a, (SELECT DISTINCT word FROM sw) b WHERE a.word < b.word)"


@query(f"WITH RECURSIVE {WN}, {PAIRS}, m AS (SELECT x.word AS a, y.word AS b, x.synset AS sa, y.synset AS sb, ca.ancestor, ca.distance AS da, cb.distance AS db, dp.depth FROM sw x JOIN cl ca ON ca.synset = x.synset JOIN sw y ON y.pos = x.pos AND x.word < y.word JOIN cl cb ON cb.synset = y.synset AND cb.ancestor = ca.ancestor JOIN dp ON dp.synset = ca.ancestor), g AS (SELECT a, b, sa, sb, min(da + db) AS d, arg_max(struct_pack(depth, da, db), depth) AS k FROM m GROUP BY ALL), z AS (SELECT a, b, max(1 / (d + 1)) AS path, max(2 * (k.depth + 1) / (2 * (k.depth + 1) + k.da + k.db)) AS wup, max(-ln((d + 1) / (2.0 * (SELECT max(depth) + 1 FROM dp)))) AS lch FROM g GROUP BY ALL) SELECT pr.a, pr.b, round(coalesce(path, 0), 6) AS path, round(coalesce(wup, 0), 6) AS wup, round(coalesce(lch, 0), 6) AS lch FROM pr LEFT JOIN z ON z.a = pr.a AND z.b = pr.b")
def path_similarities(spark, sf):
    s, h = synsets(spark)
    c = wordnet.ancestors(s, h)
    return rounded(wordnet.path_measures(word_pairs(spark), s, c, wordnet.depths(c, h)), "path", "wup", "lch")


@query(f"WITH RECURSIVE {WN}, {PAIRS}, o AS (SELECT word, list(DISTINCT pos || synset) AS own FROM sw GROUP BY word), u AS (SELECT word, list(DISTINCT pos || parent) AS up FROM sw JOIN hy USING (synset) GROUP BY word) SELECT pr.a, pr.b, list_has_any(oa.own, ob.own) AS synonyms, list_has_any(coalesce(ua.up, []), ob.own) OR list_has_any(oa.own, coalesce(ub.up, [])) AS hypernyms, list_has_any(coalesce(ua.up, []), coalesce(ub.up, [])) AS siblings FROM pr JOIN o oa ON oa.word = pr.a JOIN o ob ON ob.word = pr.b LEFT JOIN u ua ON ua.word = pr.a LEFT JOIN u ub ON ub.word = pr.b")
def lexical_relations(spark, sf):
    return wordnet.relations(word_pairs(spark), *synsets(spark))


# --- language rules, with lists of words that the documents have ---

PAIR_LIST = [("of", "of"), ("the", "the"), ("de", "la"), ("que", "que")]


@query(f"WITH {TOKENS}, n AS (SELECT *, lead(lemma) OVER (PARTITION BY doc_id, block_ix, sent_ix ORDER BY tok_ix) AS next FROM t) SELECT doc_id, block_ix, sent_ix, tok_ix, lemma, next FROM n WHERE (lemma, next) IN ({', '.join(map(str, PAIR_LIST))})")
def cacophonies(spark, sf):
    return grammar_ro.cacophonies(segment.tokens(docs_of(spark, sf)), PAIR_LIST)


@query(f"WITH {ANNOTATED}, n AS (SELECT *, lag(tok_ix) OVER (PARTITION BY doc_id, block_ix, sent_ix, lemma ORDER BY tok_ix) AS before FROM a WHERE NOT is_stop AND regexp_matches(text, '\\p{{L}}')) SELECT doc_id, block_ix, sent_ix, tok_ix, lemma, before FROM n WHERE tok_ix - before < 8")
def near_repetitions(spark, sf):
    return grammar_ro.near_repetitions(annotated_of(spark, sf))


@query(f"WITH {TOKENS}, n AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, block_ix, sent_ix ORDER BY tok_ix) AS before FROM t) SELECT doc_id, block_ix, sent_ix, tok_ix, before FROM n WHERE lemma = 'that' AND before IS NOT NULL AND before <> ','")
def missing_commas(spark, sf):
    return grammar_ro.sentences_without_comma(segment.sentence_words(docs_of(spark, sf)), "that")


@query(f"WITH {TOKENS} SELECT doc_id, block_ix, sent_ix, tok_ix, lemma FROM t WHERE lemma IN ('and', 'und', 'et') AND tok_ix = 0")
def starting_conjunctions(spark, sf):
    return grammar_ro.listed(segment.tokens(docs_of(spark, sf)), ["and", "und", "et"], first=True)


@query(f"WITH {TOKENS}, {as_sql('lex_pos')} SELECT lemma, count(*) AS n FROM t WHERE regexp_matches(text, '\\p{{L}}') AND lemma NOT IN (SELECT word FROM lex_pos) GROUP BY lemma")
def misspelled(spark, sf):
    from ..sources.lexicons import lexicon

    return grammar_ro.misspelled(segment.tokens(docs_of(spark, sf)), lexicon(spark, "lex_pos"))


# DuckDB counts edits of bytes; letters beyond ASCII become one byte each, which lower-cased words don't have.
BYTES = "translate({}, 'àâäáãåéèêëíìîïóòôöõúùûüœæçñß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$')"


@query(f"WITH {TOKENS}, {as_sql('lex_pos')}, w AS (SELECT DISTINCT lemma FROM t WHERE regexp_matches(text, '\\p{{L}}') AND lemma NOT IN (SELECT word FROM lex_pos)), n AS (SELECT lemma, word, levenshtein({BYTES.format('lemma')}, {BYTES.format('word')}) AS d FROM w, lex_pos WHERE abs(length(lemma) - length(word)) <= 2), r AS (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY d, word) AS rank FROM n WHERE d <= 2) SELECT lemma, rank, word FROM r WHERE rank <= 3")
def spelling_suggestions(spark, sf):
    """For all misspelled words, within two edits."""
    from ..sources.lexicons import lexicon

    d = lexicon(spark, "lex_pos")
    return grammar_ro.suggestions(grammar_ro.misspelled(segment.tokens(docs_of(spark, sf)), d), d)


spelling_suggestions_all = spelling_suggestions


@query(f"WITH {TOKENS} SELECT doc_id, block_ix, sent_ix, tok_ix, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, block_ix, sent_ix ORDER BY tok_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM t")
def token_offsets(spark, sf):
    return grammar_ro.with_offsets(segment.tokens(docs_of(spark, sf))).select(*segment.SENT, "tok_ix", "start")
