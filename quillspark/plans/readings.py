"""Queries of comprehension and of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import apps, clustering, comprehension, rhythm, segment, threads, wordnet
from ..sources.lexicons import as_sql, lexicon, local_table
from ..sources.tables import shared_dir, stored, table
from ..streaming import activity
from . import applications, community
from .community import rounded
from .complexity import annotated_of, docs_of
from .sqltext import ANNOTATED, TOKENS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sentence_concepts(t: DataFrame) -> DataFrame:
    """doc_id, block_ix, sent_ix, a, b of annotated tokens."""
    content = F.col("pos").isin("NOUN", "VERB", "ADJ", "ADV", "PRON") & ~F.col("is_stop")
    return comprehension.concept_edges(t.select(*segment.SENT, "tok_ix", "lemma", content.alias("content")), ("block_ix", "sent_ix"))


def numbered(edges: DataFrame) -> DataFrame:
    """doc_id, step, a, b: steps count the document's sentences that have edges, from 0, however long its blocks are."""
    w = Window.partitionBy("doc_id").orderBy("block_ix", "sent_ix")
    return edges.select("doc_id", (F.dense_rank().over(w) - 1).alias("step"), "a", "b")


def concepts(spark, sf):
    return numbered(sentence_concepts(annotated_of(spark, sf)))


CONCEPTS = f"{ANNOTATED}, n AS (SELECT doc_id, block_ix, sent_ix, lemma, lead(lemma) OVER (PARTITION BY doc_id, block_ix, sent_ix ORDER BY tok_ix) AS next FROM a WHERE pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PRON') AND NOT is_stop), cd AS (SELECT DISTINCT doc_id, block_ix, sent_ix, least(lemma, next) AS a, greatest(lemma, next) AS b FROM n WHERE next IS NOT NULL AND next <> lemma), ce AS (SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY block_ix, sent_ix) - 1)::INT AS step, a, b FROM cd)"


@query(f"WITH {CONCEPTS} SELECT * FROM ce")
def concept_edges(spark, sf):
    """Edges by step: the document's sentences that have edges, counted from 0."""
    return concepts(spark, sf)


@query(f"WITH {ANNOTATED}, n AS (SELECT doc_id, block_ix, sent_ix, lemma, lead(lemma) OVER (PARTITION BY doc_id, block_ix, sent_ix ORDER BY tok_ix) AS next FROM a WHERE pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PRON') AND NOT is_stop) SELECT DISTINCT doc_id, block_ix, sent_ix, least(lemma, next) AS a, greatest(lemma, next) AS b FROM n WHERE next IS NOT NULL AND next <> lemma")
def concept_edges_by_sentence(spark, sf):
    return sentence_concepts(annotated_of(spark, sf))


_CONTENT = "pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PRON') AND NOT is_stop"
_SAME = lambda x, y: f"{x}.doc_id = {y}.doc_id AND {x}.block_ix = {y}.block_ix AND {x}.sent_ix = {y}.sent_ix"


@query(
    f"WITH RECURSIVE {ANNOTATED}, h AS MATERIALIZED (SELECT doc_id, block_ix, sent_ix, tok_ix, lemma, (tok_ix // 2)::INT AS head_ix, {_CONTENT} AS content FROM a), "
    f"ln AS MATERIALIZED (SELECT c.doc_id, c.block_ix, c.sent_ix, c.tok_ix AS x, c.content AS cx, c.lemma AS lx, p.tok_ix AS y, p.content AS cy, p.lemma AS ly FROM h c JOIN h p ON {_SAME('c', 'p')} AND c.head_ix = p.tok_ix AND c.tok_ix <> p.tok_ix), "
    "bo AS MATERIALIZED (SELECT doc_id, block_ix, sent_ix, x, y, lx, ly, cx, cy FROM ln UNION ALL SELECT doc_id, block_ix, sent_ix, y, x, ly, lx, cy, cx FROM ln), "
    "wk AS (SELECT doc_id, block_ix, sent_ix, x AS start, lx AS a, y AS at, ly AS b, cy AS done FROM bo WHERE cx "
    f"UNION SELECT w.doc_id, w.block_ix, w.sent_ix, w.start, w.a, bo.y, bo.ly, bo.cy FROM wk w JOIN bo ON {_SAME('w', 'bo')} AND bo.x = w.at WHERE NOT w.done AND bo.y <> w.start) "
    "SELECT DISTINCT doc_id, block_ix, sent_ix, a, b FROM wk WHERE done AND a < b"
)
def dependency_concept_edges(spark, sf):
    """Content words of a sentence that its tree joins over other words only."""
    t = annotated_of(spark, sf)
    content = F.col("pos").isin("NOUN", "VERB", "ADJ", "ADV", "PRON") & ~F.col("is_stop")
    rows = t.select(*segment.SENT, "tok_ix", "lemma", content.alias("content"), F.floor(F.col("tok_ix") / 2).cast("int").alias("head_ix"))
    return comprehension.collapsed_edges(rows, ("block_ix", "sent_ix"))


@query()
def concept_activation(spark, sf):
    """Activation of each document's concepts after its last sentence; a test holds it against a plain version."""
    return rounded(comprehension.activation(concepts(spark, sf)), "activation")


@query()
def comprehension_history(spark, sf):
    return rounded(comprehension.history(comprehension.activation(concepts(spark, sf), last_only=False)), "nodes", "active", "activation")


def streamed(spark, sf, build, mode: str) -> DataFrame:
    """The events table, dealt into files, through a stream: what a stream that never ends would give out on these rows."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf, "events").repartition(4).write.parquet(f"{folder}/in")
    return activity.once(build(activity.events(spark, f"{folder}/in")), f"stream_{uuid.uuid4().hex}", folder, mode)


@query("SELECT CAST(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS start, user_id, count(*) AS posts FROM events GROUP BY ALL")
def streamed_windows(spark, sf):
    out = streamed(spark, sf, lambda s: activity.windowed(s, late="60 days"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS posts FROM k GROUP BY user_id, k")
def streamed_sessions(spark, sf):
    """In mode complete, so that sessions that are still open come out too."""
    out = streamed(spark, sf, lambda s: activity.sessions(s, late="60 days"), "complete")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("WITH RECURSIVE ev AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t FROM events), r AS (SELECT user_id, min(t) AS first FROM ev GROUP BY user_id UNION ALL SELECT r.user_id, min(e.t) FROM r JOIN ev e ON e.user_id = r.user_id AND e.t > r.first + 1800 GROUP BY r.user_id, r.first) SELECT r.user_id, first, count(*)::INT AS n FROM r JOIN ev e ON e.user_id = r.user_id AND e.t BETWEEN first AND first + 1800 GROUP BY r.user_id, first")
def streamed_runs(spark, sf):
    out = streamed(spark, sf, lambda s: activity.runs(s, late="60 days", mode="update"), "update")
    return out.groupBy("user_id", F.unix_timestamp("first").alias("first")).agg(F.max("n").alias("n"))


SYLLABLES = [("the", [["DH", "AH0"]]), ("and", [["AE1", "N", "D"]]), ("about", [["AH0"], ["B", "AW1", "T"]]), ("nicht", [["N", "IH1", "CH", "T"]]), ("ertion", [["ER1"], ["SH", "AH0", "N"]])]
SYLLABLES_SQL = "sy(word, n, st) AS (VALUES " + ", ".join(f"('{w}', {len(s)}, {sum(any(p.endswith('1') for p in x) for x in s)})" for w, s in SYLLABLES) + ")"


@query(f"WITH {TOKENS}, {SYLLABLES_SQL} SELECT doc_id, sum(coalesce(n, 1))::BIGINT AS syllables, sum(coalesce(st, 0))::BIGINT AS stressed FROM t LEFT JOIN sy ON word = lemma WHERE regexp_matches(text, '\\p{{L}}') GROUP BY doc_id")
def rhythm_syllables(spark, sf):
    d = local_table(spark, SYLLABLES, "word string, syllables array<array<string>>")
    return rhythm.syllable_counts(segment.tokens(docs_of(spark, sf)), d, ["doc_id"])


_MARKS = "mk(word, marks) AS (VALUES " + ", ".join(f"('{w}', [{', '.join(str(int(any(p.endswith('1') for p in x))) for x in s)}])" for w, s in SYLLABLES) + ")"


@query(
    f"WITH {TOKENS}, {as_sql('lex_stop')}, {_MARKS}, sy AS (SELECT t.doc_id, t.block_ix, t.sent_ix, tok_ix, unnest(CASE WHEN st.word IS NOT NULL THEN list_transform(coalesce(marks, [0]), lambda x: 0) ELSE coalesce(marks, [0]) END) AS stress, generate_subscripts(coalesce(marks, [0]), 1) AS i FROM t LEFT JOIN mk ON mk.word = t.lemma LEFT JOIN lex_stop st ON st.word = t.lemma WHERE regexp_matches(text, '\\p{{L}}')), "
    "nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_ix, sent_ix ORDER BY tok_ix, i) AS k, count(*) OVER (PARTITION BY doc_id, block_ix, sent_ix) AS n FROM sy), g AS (SELECT doc_id, block_ix, sent_ix, k, k - coalesce(lag(k) OVER (PARTITION BY doc_id, block_ix, sent_ix ORDER BY k), 0) - 1 AS gap FROM nu WHERE stress = 1 "
    "UNION ALL SELECT doc_id, block_ix, sent_ix, max(n) + 1, max(n) - coalesce(max(k) FILTER (stress = 1), 0) FROM nu GROUP BY ALL HAVING max(n) > coalesce(max(k) FILTER (stress = 1), 0)) "
    "SELECT s.doc_id, s.block_ix, s.sent_ix, coalesce(array_to_string(list(gap ORDER BY k) FILTER (gap IS NOT NULL), ','), '') AS structure FROM (SELECT DISTINCT doc_id, block_ix, sent_ix FROM t) s LEFT JOIN g ON g.doc_id = s.doc_id AND g.block_ix = s.block_ix AND g.sent_ix = s.sent_ix GROUP BY s.doc_id, s.block_ix, s.sent_ix"
)
def rhythmic_structure(spark, sf):
    """Syllables between stresses, of each sentence."""
    d = local_table(spark, SYLLABLES, "word string, syllables array<array<string>>")
    out = rhythm.rhythmic_structure(segment.tokens(docs_of(spark, sf)), d, lexicon(spark, "lex_stop"), segment.SENT)
    return out.withColumn("structure", F.array_join(F.col("structure").cast("array<string>"), ","))


@query(
    f"WITH {TOKENS}, w AS (SELECT doc_id, block_ix, sent_ix, left(lemma, 1) AS symbol, row_number() OVER (PARTITION BY doc_id, block_ix, sent_ix ORDER BY tok_ix) AS place FROM t WHERE regexp_matches(text, '\\p{{L}}')), o AS (SELECT w.*, EXISTS (SELECT 1 FROM w p WHERE p.doc_id = w.doc_id AND p.block_ix = w.block_ix AND p.sent_ix = w.sent_ix AND p.symbol = w.symbol AND w.place - p.place BETWEEN 1 AND 3) AS goes_on FROM w), "
    "h AS (SELECT *, count(*) FILTER (NOT goes_on) OVER (PARTITION BY doc_id, block_ix, sent_ix, symbol ORDER BY place) AS chain FROM o) SELECT doc_id, block_ix, sent_ix, symbol, array_to_string(list(place ORDER BY place), ',') AS places FROM h GROUP BY doc_id, block_ix, sent_ix, symbol, chain HAVING count(*) > 1"
)
def alliterations(spark, sf):
    """Words of a sentence that begin alike, each at most three words on."""
    first = F.transform(F.filter("words", lambda x: x.rlike(r"\p{L}")), lambda x: F.left(F.lower(x), F.lit(1)))
    words = segment.sentence_words(docs_of(spark, sf)).select(*segment.SENT, first.alias("symbols"))
    return rhythm.recurring_in(words, segment.SENT).withColumn("places", F.array_join(F.col("places").cast("array<string>"), ","))


@query(
    rf"""WITH {{POSTS}}, j AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY ix) AS x FROM p GROUP BY conv_id), z AS (SELECT conv_id, unnest(range(len(a)))::INT AS sent_ix, unnest(a) AS text FROM (SELECT conv_id, regexp_extract_all(x, '{segment.SENTENCE}') AS a FROM j)),
cn AS (SELECT conv_id, ix, regexp_replace(text, '[\s.]+', '', 'g') AS x FROM p), co AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY conv_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM cn WHERE x <> ''),
zn AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY conv_id ORDER BY sent_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT conv_id, sent_ix, regexp_replace(text, '[\s.]+', '', 'g') AS x FROM z))
SELECT zn.conv_id, sent_ix, max(ix)::INT AS ix, max(substring(co.x, (zn.s - co.s + 1)::INT, length(zn.x)) = zn.x AND zn.s < co.s + length(co.x)) FILTER (co.ix = m) AS matches FROM zn JOIN (SELECT zn.conv_id AS c, zn.sent_ix AS i, max(ix) AS m FROM zn JOIN co ON co.conv_id = zn.conv_id AND co.s <= zn.s GROUP BY ALL) l ON l.c = zn.conv_id AND l.i = zn.sent_ix JOIN co ON co.conv_id = zn.conv_id AND co.s <= zn.s GROUP BY zn.conv_id, sent_ix""".replace("{POSTS}", community.POSTS)
)
def sentences_of_contributions(spark, sf):
    """Sentences of whole conversations, each with the post in which it begins."""
    p = community.posts(spark, sf).select("conv_id", "ix", "text")
    whole = p.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "text"))), lambda x: x["text"]), "\n").alias("text"))
    sentences = whole.select("conv_id", F.posexplode(segment.sentence_texts(F.col("text"))).alias("sent_ix", "text"))
    out = threads.aligned_sentences(p, sentences, "conv_id")
    return out.select("conv_id", "sent_ix", F.col("ix").cast("int").alias("ix"), "matches")


@query()
def similar_concepts(spark, sf):
    """Synonyms, hypernyms and nearest words of the fixture hierarchy, as JSON."""
    s, h = applications.synsets(spark)
    near = s.select("word", F.reverse("word").alias("other"))
    return wordnet.similar_concepts(s, h, near)


@query()
def split_labels(spark, sf):
    """Labels with a development share of one fifth, by hash of the id: the same in every run."""
    return table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("target"), apps.hash_split(F.col("doc_id"), 0.2).alias("dev"))


@query()
def regression_search(spark, sf):
    """Cross-validated grid search of a ridge regression over the feature table: parameters and mean absolute error."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.pipeline import Pipeline
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = applications.labelled_features(spark, sf)
    ridge = LinearRegression(labelCol="target", featuresCol="scaled", elasticNetParam=0.0)
    grid = ParamGridBuilder().addGrid(ridge.regParam, [0.01, 0.1, 1.0]).build()
    steps = Pipeline(stages=[VectorAssembler(inputCols=applications.NAMES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), ridge])
    found = CrossValidator(estimator=steps, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="target", metricName="mae"), numFolds=3, seed=0, parallelism=3).fit(rows)
    return spark.createDataFrame([(float(g[ridge.regParam]), float(m)) for g, m in zip(grid, found.avgMetrics, strict=True)], "reg_param double, mae double")


def standardised(spark, sf) -> DataFrame:
    """doc_id, x: the feature table as deviations from each feature's mean, over its standard deviation (0 where all are equal)."""
    f = stored(applications.feature_table(spark, sf), "features")  # read for the statistics and for each pass of what is fitted on it
    stats = f.agg(*[g(n).alias(f"{k}_{n}") for n in applications.NAMES for k, g in (("m", F.avg), ("s", F.stddev_pop))])
    z = [F.coalesce(F.when(F.col(f"s_{n}") > 0, (F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}")), F.lit(0.0)) for n in applications.NAMES]
    return f.join(F.broadcast(stats), F.lit(True)).select("doc_id", F.array(*z).alias("x"))  # one row


@query()
def clustered_documents(spark, sf):
    """Three clusters of documents by standardised features: Ward over clustering features; a test holds it against the exact algorithm."""
    return clustering.clusters(standardised(spark, sf), 3, "ward", key="doc_id")


@query()
def documents_by_complete_link(spark, sf):
    return clustering.clusters(standardised(spark, sf), 3, "complete", key="doc_id")


@query()
def documents_by_birch(spark, sf):
    """Rows within half a standard deviation become one feature first."""
    return clustering.clusters(standardised(spark, sf), 3, "ward", radius=0.5, key="doc_id")


@query("SELECT conv_id, turn + 1 AS child, turn AS parent FROM conversations c WHERE turn > 0 AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn + 1 = c.turn)")
def reply_edges(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("child"), F.col("turn").alias("parent")).filter("parent > 0")
    known = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("parent"))
    return c.join(known, ["conv_id", "parent"], "left_semi").select("conv_id", "child", "parent")
