"""Queries of textual complexity, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, measures, segment
from ..operators import reduce as reducers
from ..operators.segment import BLOCK, SENT
from ..sources.lexicons import as_sql, lexicon
from ..sources.tables import table, text_tasks
from .sqltext import ANNOTATED, BLOCKS, SENTENCES, TOKENS, summary

QUERIES, SQL = {}, {}
PUNCT = r"regexp_full_match(text, '[^\p{L}\p{N}]')"
COUNTS = f"c AS (SELECT doc_id, block_ix, sent_ix, count(*) AS wd, count(*) FILTER ({PUNCT}) AS punct, count(*) FILTER (text = ',') AS commas, count(DISTINCT text) AS unqwd FROM t GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dealt by id once: texts are smaller than their tokens, and all that is grouped within a document later needs no shuffle."""
    return table(spark, sf, "documents").select("doc_id", "text").repartition(text_tasks(spark, sf, "documents"), "doc_id")


def annotated_of(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.by_lexicon(segment.tokens(docs_of(spark, sf)), lexicon(spark, "lex_pos"), lexicon(spark, "lex_lemma"), lexicon(spark, "lex_stop"))


@query(f"WITH {TOKENS}, {COUNTS} {summary('doc_id', 'c', ['wd'])}")
def doc_words_per_sentence(spark, sf):
    return reducers.summary(measures.by_sentence(docs_of(spark, sf)).filter("sent_ix is not null"), ["doc_id"], ["wd"])


@query(f"WITH {TOKENS}, {COUNTS} {summary('doc_id', 'c', ['wd', 'punct', 'commas', 'unqwd'])}")
def surface_by_sentence(spark, sf):
    return reducers.summary(measures.by_sentence(docs_of(spark, sf)).filter("sent_ix is not null"), ["doc_id"], ["wd", "punct", "commas", "unqwd"])


PAR = "p AS (SELECT b.doc_id, b.block_ix, coalesce(sum(wd), 0)::BIGINT AS wd, coalesce(sum(punct), 0)::BIGINT AS punct, coalesce(sum(commas), 0)::BIGINT AS commas FROM b LEFT JOIN c ON b.doc_id = c.doc_id AND b.block_ix = c.block_ix GROUP BY ALL)"


@query(f"WITH {TOKENS}, {COUNTS}, {PAR} {summary('doc_id', 'p', ['wd', 'punct', 'commas'])}")
def surface_by_paragraph(spark, sf):
    return reducers.summary(measures.additive(measures.by_sentence(docs_of(spark, sf)), BLOCK, ["wd", "punct", "commas"]), ["doc_id"], ["wd", "punct", "commas"])


@query(f"WITH {TOKENS}, {COUNTS}, {PAR} SELECT doc_id, sum(wd)::BIGINT AS wd, sum(punct)::BIGINT AS punct, sum(commas)::BIGINT AS commas FROM p GROUP BY doc_id")
def surface_by_document(spark, sf):
    return measures.additive(measures.by_sentence(docs_of(spark, sf)), ["doc_id"], ["wd", "punct", "commas"])


@query(f"WITH {TOKENS}, u AS (SELECT b.doc_id, b.block_ix, count(DISTINCT t.text) AS unqwd FROM b LEFT JOIN t ON b.doc_id = t.doc_id AND b.block_ix = t.block_ix GROUP BY ALL), x AS ({summary('doc_id', 'u', ['unqwd'])}), d AS (SELECT doc_id, count(DISTINCT text) AS unqwd FROM t GROUP BY doc_id) SELECT x.*, coalesce(unqwd, 0) AS unqwd FROM x LEFT JOIN d USING (doc_id)")
def unique_words(spark, sf):
    docs = docs_of(spark, sf)
    return reducers.summary(measures.distinct_words(docs, BLOCK), ["doc_id"], ["unqwd"]).join(measures.distinct_words(docs, ["doc_id"]), "doc_id")


@query(f"WITH {SENTENCES}, n AS (SELECT b.doc_id, b.block_ix, count(s.sent_ix) AS sent FROM b LEFT JOIN s ON b.doc_id = s.doc_id AND b.block_ix = s.block_ix GROUP BY ALL), x AS ({summary('doc_id', 'n', ['sent'])}), d AS (SELECT doc_id, sum(sent)::BIGINT AS sent FROM n GROUP BY doc_id) SELECT * FROM x JOIN d USING (doc_id)")
def sentences_of_paragraphs(spark, sf):
    n = measures.sentence_counts(docs_of(spark, sf))
    return reducers.summary(n, ["doc_id"], ["sent"]).join(measures.additive(n, ["doc_id"], ["sent"]), "doc_id")


@query(f"WITH {BLOCKS} SELECT doc_id, count(*) AS blocks, count(*) FILTER (text = '') AS empty_blocks FROM b GROUP BY doc_id")
def blocks_of_documents(spark, sf):
    return segment.blocks(docs_of(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("text") == "").alias("empty_blocks"))


@query("SELECT doc_id, section_ix, array_to_string(list_filter(string_split(x, chr(10)), lambda l: length(l) > 50), chr(10)) AS text FROM (SELECT doc_id, unnest(range(len(a)))::INT AS section_ix, unnest(a) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10) || chr(10)) AS a FROM documents))")
def cleaned_sections(spark, sf):
    return segment.sections(docs_of(spark, sf), 50)


ENTROPY = "round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS wdentr"


@query(f"WITH {TOKENS}, n AS (SELECT doc_id, lemma, count(*) AS n FROM t GROUP BY ALL), d AS (SELECT doc_id, {ENTROPY} FROM n GROUP BY doc_id), ns AS (SELECT doc_id, block_ix, sent_ix, lemma, count(*) AS n FROM t GROUP BY ALL), es AS (SELECT doc_id, block_ix, sent_ix, {ENTROPY.replace('round(', '(').replace(', 6)', ')')} FROM ns GROUP BY ALL), x AS ({summary('doc_id', 'es', ['wdentr'])}) SELECT * FROM x JOIN d USING (doc_id)")
def word_entropy(spark, sf):
    t = segment.tokens(docs_of(spark, sf))
    doc = measures.word_entropy(t, ["doc_id"]).withColumn("wdentr", F.round("wdentr", 6))
    return reducers.summary(measures.word_entropy(t, SENT), ["doc_id"], ["wdentr"]).join(doc, "doc_id")


def _gram_sql(n: int) -> str:
    grams = f"g AS (SELECT doc_id, block_ix, sent_ix, tok_ix, unnest(CASE WHEN length(text) < {n} THEN [''] ELSE list_transform(range(1, length(text) - {n - 2}), lambda i: substring(text, i, {n})) END) AS gram FROM t), gn AS (SELECT doc_id, block_ix, sent_ix, tok_ix, gram, count(*) AS n FROM g GROUP BY ALL), e AS (SELECT doc_id, block_ix, sent_ix, tok_ix, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM gn GROUP BY ALL)"
    return f"WITH {TOKENS}, {grams} {summary('doc_id', 'e', ['entropy'])}"


@query(_gram_sql(2))
def bigram_entropy(spark, sf):
    t = measures.by_form(segment.tokens(docs_of(spark, sf)), "entropy", measures.gram_entropy(F.col("text"), 2))
    return reducers.summary(t, ["doc_id"], ["entropy"])


@query(_gram_sql(1))
def letter_entropy(spark, sf):
    t = measures.by_form(segment.tokens(docs_of(spark, sf)), "entropy", measures.gram_entropy(F.col("text"), 1))
    return reducers.summary(t, ["doc_id"], ["entropy"])


@query(f"WITH {ANNOTATED}, v AS (SELECT doc_id, length(text) AS chars, abs(length(lemma) - length(text)) AS lemmadiff, CASE WHEN regexp_matches(text, '\\p{{L}}') THEN greatest(len(regexp_extract_all(lemma, '[aeiouyàâäáãåéèêëíìîïóòôöõúùûüœæ]+')), 1) ELSE 0 END AS syllab FROM a) {summary('doc_id', 'v', ['chars', 'lemmadiff', 'syllab'])}")
def word_measures(spark, sf):
    return reducers.summary(measures.word_values(annotated_of(spark, sf)), ["doc_id"], ["chars", "lemmadiff", "syllab"])


def _pos_sql(keys: str) -> str:
    n = ", ".join(f"count(*) FILTER (pos = '{p}') AS pos_{p.lower()}, count(DISTINCT CASE WHEN pos = '{p}' THEN text END) AS unqpos_{p.lower()}" for p in measures.MAIN_POS)
    return f"SELECT {keys}, {n} FROM a GROUP BY {keys}"


@query(f"WITH {ANNOTATED} {_pos_sql('doc_id')}")
def parts_of_speech(spark, sf):
    return measures.main_pos_counts(annotated_of(spark, sf), ["doc_id"])


POS_COLUMNS = [f"{u}pos_{p.lower()}" for p in measures.MAIN_POS for u in ("", "unq")]


@query(f"WITH {ANNOTATED}, p AS ({_pos_sql('doc_id, block_ix, sent_ix')}) {summary('doc_id', 'p', POS_COLUMNS)}")
def parts_of_speech_by_sentence(spark, sf):
    return reducers.summary(measures.main_pos_counts(annotated_of(spark, sf), SENT), ["doc_id"], POS_COLUMNS)


def _list_sql(lex: str, kind: str, by: str, names: list[str]) -> str:
    n = ", ".join(f"coalesce(sum(CASE WHEN {kind} = '{x}' THEN 1 ELSE 0 END), 0)::BIGINT AS {x}" for x in names)
    return f"WITH {TOKENS}, {as_sql(lex)}, c AS (SELECT s.doc_id, s.block_ix, s.sent_ix, {n} FROM s LEFT JOIN (SELECT * FROM t JOIN {lex} ON word = t.{by}) x ON s.doc_id = x.doc_id AND s.block_ix = x.block_ix AND s.sent_ix = x.sent_ix GROUP BY ALL) {summary('doc_id', 'c', names)}"


def _list_counts(spark, sf, lex: str, kind: str, names: list[str], by: str = "lemma"):
    docs = docs_of(spark, sf)
    counts = measures.class_counts(segment.tokens(docs), lexicon(spark, lex), kind, SENT, by)
    return reducers.summary(measures.dense(counts, measures.elements(docs, "sent"), names, kind), ["doc_id"], names)


PRONOUNS, CONNECTORS, ENTITIES = ["fst", "snd", "thrd", "int", "indef"], ["coordinating", "conditions", "contrasts", "addition", "ordering", "purpose"], ["GPE", "ORG", "PERSON", "DATE"]


@query(_list_sql("lex_pron", "kind", "lemma", PRONOUNS))
def pronouns(spark, sf):
    return _list_counts(spark, sf, "lex_pron", "kind", PRONOUNS)


@query(_list_sql("lex_conn", "kind", "lemma", CONNECTORS))
def connectors(spark, sf):
    return _list_counts(spark, sf, "lex_conn", "kind", CONNECTORS)


@query(_list_sql("lex_entity", "ent_type", "text", ENTITIES))
def named_entities(spark, sf):
    return _list_counts(spark, sf, "lex_entity", "ent_type", ENTITIES, "text")


@query(f"WITH {TOKENS}, {as_sql('lex_entity')} SELECT doc_id, count(DISTINCT text) AS unqnmdent FROM t JOIN lex_entity ON word = text GROUP BY doc_id")
def unique_named_entities(spark, sf):
    return segment.tokens(docs_of(spark, sf)).join(lexicon(spark, "lex_entity").select(F.col("word").alias("text")), "text").groupBy("doc_id").agg(F.countDistinct("text").alias("unqnmdent"))


@query(f"WITH {TOKENS}, {as_sql('lex_valence')} SELECT doc_id, list, count(*) AS n FROM t JOIN lex_valence ON word = lemma GROUP BY ALL")
def valence(spark, sf):
    return measures.class_counts(segment.tokens(docs_of(spark, sf)), lexicon(spark, "lex_valence"), "list", ["doc_id"])


@query(f"WITH {TOKENS}, {as_sql('lex_rating')}, m AS (SELECT DISTINCT measure FROM lex_rating) SELECT d.doc_id, m.measure, round(coalesce(avg(value), 0), 6) AS value FROM documents d CROSS JOIN m LEFT JOIN (SELECT doc_id, measure, value FROM t JOIN lex_rating ON word = text) r ON r.doc_id = d.doc_id AND r.measure = m.measure GROUP BY ALL")
def age_ratings(spark, sf):
    docs, ratings = docs_of(spark, sf), lexicon(spark, "lex_rating")
    names = sorted({r.measure for r in ratings.select("measure").distinct().collect()})
    found = measures.rating(segment.tokens(docs), ratings, ["doc_id"])
    every = docs.select("doc_id", F.explode(F.array(*map(F.lit, names))).alias("measure"))
    return every.join(found, ["doc_id", "measure"], "left").select("doc_id", "measure", F.round(F.coalesce("value", F.lit(0.0)), 6).alias("value"))


@query(f"WITH {TOKENS}, {as_sql('lex_rating')}, w AS (SELECT doc_id, block_ix, sent_ix, measure, avg(value) AS v FROM t JOIN lex_rating ON word = text GROUP BY ALL), c AS (SELECT s.doc_id, coalesce(v, 0) AS kuperman FROM s LEFT JOIN (SELECT * FROM w WHERE measure = 'kuperman') w ON s.doc_id = w.doc_id AND s.block_ix = w.block_ix AND s.sent_ix = w.sent_ix) {summary('doc_id', 'c', ['kuperman'])}")
def age_ratings_by_sentence(spark, sf):
    docs = docs_of(spark, sf)
    found = measures.rating(segment.tokens(docs), lexicon(spark, "lex_rating").filter("measure = 'kuperman'"), SENT)
    values = measures.elements(docs, "sent").join(found, SENT, "left").select("doc_id", F.coalesce("value", F.lit(0.0)).alias("kuperman"))
    return reducers.summary(values, ["doc_id"], ["kuperman"])


REPEATED = "n AS (SELECT doc_id, block_ix, sent_ix, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT n.doc_id, n.block_ix, n.sent_ix, CASE WHEN n.n = 1 THEN 1 ELSE count(y.tok_ix) END AS repetitions FROM n JOIN t x USING (doc_id, block_ix, sent_ix) LEFT JOIN t y ON x.doc_id = y.doc_id AND x.block_ix = y.block_ix AND x.sent_ix = y.sent_ix AND x.lemma = y.lemma AND y.tok_ix BETWEEN x.tok_ix + 1 AND x.tok_ix + 7 AND x.tok_ix < greatest(1, n.n - 8) GROUP BY n.doc_id, n.block_ix, n.sent_ix, n.n)"


@query(f"WITH {TOKENS}, {REPEATED} {summary('doc_id', 'r', ['repetitions'])}")
def repetitions(spark, sf):
    return reducers.summary(measures.repetitions(docs_of(spark, sf)), ["doc_id"], ["repetitions"])


@query(f"WITH {TOKENS}, {COUNTS}, g AS (SELECT doc_id, block_ix, sent_ix, avg(wd) AS M, CASE WHEN count(wd) = 1 THEN 0 ELSE stddev_samp(wd) END AS SD, max(wd)::DOUBLE AS \"Max\" FROM c GROUP BY GROUPING SETS ((doc_id), (doc_id, block_ix), (doc_id, block_ix, sent_ix))), u AS (SELECT doc_id, block_ix, sent_ix, 'M' AS r, M AS v FROM g UNION ALL SELECT doc_id, block_ix, sent_ix, 'SD', SD FROM g UNION ALL SELECT doc_id, block_ix, sent_ix, 'Max', \"Max\" FROM g) SELECT doc_id, coalesce(block_ix, -1) AS block_ix, coalesce(sent_ix, -1) AS sent_ix, r || '(Wd / Sent)' AS index, round(v, 6) AS value FROM u")
def indices_of_all_levels(spark, sf):
    values = measures.by_sentence(docs_of(spark, sf)).filter("sent_ix is not null").withColumn("value", F.col("wd"))
    return reducers.all_levels(values, "Wd", "sent").na.fill(-1, ["block_ix", "sent_ix"])


# A fixture tree where tokens hang in pairs below the token of half their place, as an annotator would supply heads.
HEADS = "h AS (SELECT doc_id, block_ix, sent_ix, tok_ix, text, (tok_ix // 2)::INT AS head_ix, CASE WHEN tok_ix = 0 THEN 'root' WHEN tok_ix % 3 = 0 THEN 'nsubj' WHEN tok_ix % 3 = 1 THEN 'obj' ELSE 'amod' END AS dep FROM t)"


def with_heads(spark, sf):
    i = F.col("tok_ix")
    return segment.tokens(docs_of(spark, sf)).withColumn("head_ix", F.floor(i / 2).cast("int")).withColumn("dep", F.when(i == 0, "root").when(i % 3 == 0, "nsubj").when(i % 3 == 1, "obj").otherwise("amod"))


@query(f"WITH {TOKENS}, n AS (SELECT doc_id, block_ix, sent_ix, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT doc_id, CASE WHEN n = 1 THEN 1 ELSE floor(log2(n - 1))::INT + 2 END AS depth FROM n) {summary('doc_id', 'p', ['depth'])}")
def parse_depth(spark, sf):
    return reducers.summary(measures.parse_depth(with_heads(spark, sf)), ["doc_id"], ["depth"])


@query(f"WITH {TOKENS}, {HEADS}, c AS (SELECT doc_id, block_ix, sent_ix, count(*) FILTER (dep = 'nsubj') AS nsubj, count(*) FILTER (dep = 'obj') AS obj, count(*) FILTER (dep = 'root') AS root FROM h GROUP BY ALL) {summary('doc_id', 'c', ['nsubj', 'obj', 'root'])}")
def dependencies(spark, sf):
    t = with_heads(spark, sf).groupBy(*SENT).agg(*[F.count_if(F.col("dep") == d).alias(d) for d in ("nsubj", "obj", "root")])
    return reducers.summary(t, ["doc_id"], ["nsubj", "obj", "root"])


@query(f"WITH {TOKENS}, {HEADS} SELECT p.lemma AS head, c.dep, count(*) AS n FROM (SELECT h.*, lower(text) AS lemma FROM h) c JOIN (SELECT h.*, lower(text) AS lemma FROM h) p ON c.doc_id = p.doc_id AND c.block_ix = p.block_ix AND c.sent_ix = p.sent_ix AND c.head_ix = p.tok_ix WHERE c.head_ix <> c.tok_ix GROUP BY ALL")
def dependency_pairs(spark, sf):
    h = with_heads(spark, sf)
    parents = h.select(*SENT, F.col("tok_ix").alias("head_ix"), F.col("lemma").alias("head"))
    return h.filter("head_ix <> tok_ix").join(parents, [*SENT, "head_ix"]).groupBy("head", "dep").agg(F.count(F.lit(1)).alias("n"))
