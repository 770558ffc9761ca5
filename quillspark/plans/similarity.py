"""Queries of vectors, string kernels and cohesion, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cohesion, kernels, segment, vectors
from ..operators.segment import BLOCK, SENT
from ..sources.tables import table
from .complexity import annotated_of, docs_of
from .sqltext import ANNOTATED, TOKENS

QUERIES, SQL = {}, {}
DIMS = 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# A fixture model: a word's vector counts its letters, and some of them.
LETTERS = "eatn"


def word_vectors(tokens: DataFrame) -> DataFrame:
    """tokens with vec, as a join with a table of word vectors would give."""
    vec = F.array(F.length("lemma").cast("double"), *[F.regexp_count("lemma", F.lit(c)).cast("double") for c in LETTERS])
    return tokens.withColumn("vec", F.when(F.col("text").rlike(r"\p{L}"), vec))


def element_vectors(spark, sf, keys: list[str]) -> DataFrame:
    return vectors.pooled(word_vectors(segment.tokens(docs_of(spark, sf))), keys, DIMS)


def letters(c: str) -> str:
    return f"length(lemma) - length(replace(lemma, '{c}', ''))"


WV = "wv AS (SELECT *, CASE WHEN regexp_matches(text, '\\p{L}') THEN length(lemma) END AS v0, " + ", ".join(f"CASE WHEN regexp_matches(text, '\\p{{L}}') THEN {letters(c)} END AS v{i + 1}" for i, c in enumerate(LETTERS)) + " FROM t)"


def pooled_sql(name: str, keys: str) -> str:
    return f"{name} AS (SELECT {keys}, CASE WHEN sum(v0) IS NULL THEN NULL ELSE [{', '.join(f'sum(v{i})::DOUBLE' for i in range(DIMS))}] END AS vec FROM wv GROUP BY {keys})"


def cos(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN list_inner_product({a}, {a}) > 0 AND list_inner_product({b}, {b}) > 0 THEN list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END, 0)"


EMB = "embeddings_ AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings)"
PLANES = vectors.random_planes(8, 64)
BUCKET_SQL = " + ".join(f"(CASE WHEN list_inner_product(vec, {p}::DOUBLE[]) >= 0 THEN {1 << (7 - i)} ELSE 0 END)" for i, p in enumerate(PLANES))


def emb(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


@query(f"WITH {EMB}, q AS (SELECT * FROM embeddings_ WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS id, {cos('q.vec', 'e.vec')} AS sim FROM q, embeddings_ e WHERE q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, id) AS rank FROM p) SELECT query, rank, id, round(sim, 6) AS sim FROM r WHERE rank <= 10")
def nearest_by_cosine(spark, sf):
    e = emb(spark, sf)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("vec").alias("qvec"))
    return vectors.top_k(q, e.withColumnRenamed("vec_id", "id"), 10).withColumn("sim", F.round("sim", 6))


@query(f"WITH {EMB} SELECT vec_id, ({BUCKET_SQL})::INT AS bucket FROM embeddings_")
def sign_hash_buckets(spark, sf):
    return emb(spark, sf).select("vec_id", vectors.sign_hash(F.col("vec"), PLANES).alias("bucket"))


NEAREST_IN_BUCKETS = f"WITH {EMB}, h AS (SELECT *, ({BUCKET_SQL})::INT AS bucket FROM embeddings_), p AS (SELECT q.vec_id AS query, e.vec_id AS id, bit_count(xor(q.bucket, e.bucket)) AS away, {cos('q.vec', 'e.vec')} AS sim FROM h q, h e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id), x AS (SELECT * FROM p WHERE sim > 0.1), c AS (SELECT query, away, sum(count(*)) OVER (PARTITION BY query ORDER BY away) AS hits FROM x GROUP BY query, away), l AS (SELECT query, coalesce(min(away) FILTER (hits >= 10), 99) AS last FROM c GROUP BY query), r AS (SELECT x.*, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, id) AS rank FROM x JOIN l USING (query) WHERE away <= last) SELECT query, rank, id, round(sim, 6) AS sim FROM r WHERE rank <= 10"


@query(NEAREST_IN_BUCKETS)
def nearest_in_buckets(spark, sf):
    """Own bucket first, further ones while a query has fewer than ten hits."""
    e = emb(spark, sf)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("vec").alias("qvec"))
    return vectors.most_similar(q, e.withColumnRenamed("vec_id", "id"), 10, PLANES, 0.1).withColumn("sim", F.round("sim", 6))


@query(NEAREST_IN_BUCKETS)
def nearest_in_stored_buckets(spark, sf):
    """The same from an index that was built of half of the vectors, opened again and extended by the others."""
    e = emb(spark, sf).withColumnRenamed("vec_id", "id")
    first = vectors.BucketIndex.build(e.filter("id % 2 = 0"), PLANES)
    first.close()
    index = vectors.BucketIndex.open(spark, first.folder)
    index.add(e.filter("id % 2 <> 0"))
    q = e.filter("id % 100 = 0").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    return index.most_similar(q, 10, 0.1).withColumn("sim", F.round("sim", 6))


@query(f"WITH {TOKENS}, {WV}, {pooled_sql('d', 'doc_id')} SELECT doc_id, unnest(range(5))::INT AS dim, unnest(vec) AS value FROM d")
def document_vectors(spark, sf):
    return element_vectors(spark, sf, ["doc_id"]).select("doc_id", F.posexplode("vec").alias("dim", "value"))


ADJ = f"adj AS (SELECT doc_id, block_ix, {cos('vec', 'nv')} AS sim FROM (SELECT *, lead(vec) OVER w AS nv, lead(sent_ix) OVER w AS nx FROM sv WINDOW w AS (PARTITION BY doc_id, block_ix ORDER BY sent_ix)) WHERE nx IS NOT NULL)"


@query(f"WITH {TOKENS}, {WV}, {pooled_sql('sv', 'doc_id, block_ix, sent_ix')}, {ADJ} SELECT e.doc_id, e.block_ix, round(coalesce(avg(sim), 0), 6) AS cohesion FROM (SELECT DISTINCT doc_id, block_ix FROM sv) e LEFT JOIN adj USING (doc_id, block_ix) GROUP BY ALL")
def adjacent_cohesion(spark, sf):
    return cohesion.adjacent_cohesion(element_vectors(spark, sf, SENT), BLOCK, "sent_ix").withColumn("cohesion", F.round("cohesion", 6))


@query(f"WITH {TOKENS}, {WV}, {pooled_sql('sv', 'doc_id, block_ix, sent_ix')}, n AS (SELECT doc_id, block_ix, count(*) AS n FROM sv GROUP BY ALL), p AS (SELECT a.doc_id, a.block_ix, avg({cos('a.vec', 'b.vec')}) AS c FROM sv a JOIN sv b ON a.doc_id = b.doc_id AND a.block_ix = b.block_ix AND a.sent_ix < b.sent_ix GROUP BY ALL) SELECT n.doc_id, n.block_ix, round(coalesce(c, 1), 6) AS cohesion FROM n LEFT JOIN p ON n.doc_id = p.doc_id AND n.block_ix = p.block_ix")
def intra_paragraph_cohesion(spark, sf):
    return cohesion.mutual_cohesion(element_vectors(spark, sf, SENT), BLOCK, DIMS).withColumn("cohesion", F.round("cohesion", 6))


BV = f"{pooled_sql('bw', 'doc_id, block_ix')}, bv AS (SELECT b.doc_id, b.block_ix, bw.vec FROM b LEFT JOIN bw ON b.doc_id = bw.doc_id AND b.block_ix = bw.block_ix)"


def block_vectors(spark, sf) -> DataFrame:
    """Of all blocks, with a null for those without words."""
    return segment.blocks(docs_of(spark, sf)).select(*BLOCK).join(element_vectors(spark, sf, BLOCK), BLOCK, "left")


@query(f"WITH {TOKENS}, {WV}, {BV}, n AS (SELECT doc_id, count(*) AS n FROM bv GROUP BY ALL), p AS (SELECT a.doc_id, avg({cos('a.vec', 'b.vec')}) AS c FROM bv a JOIN bv b ON a.doc_id = b.doc_id AND a.block_ix < b.block_ix GROUP BY ALL) SELECT n.doc_id, round(coalesce(c, 1), 6) AS cohesion FROM n LEFT JOIN p ON n.doc_id = p.doc_id")
def inter_paragraph_cohesion(spark, sf):
    return cohesion.mutual_cohesion(block_vectors(spark, sf), ["doc_id"], DIMS).withColumn("cohesion", F.round("cohesion", 6))


ENDS = f"k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_ix ORDER BY sent_ix) AS k, count(*) OVER (PARTITION BY doc_id, block_ix) AS n FROM sv), f AS (SELECT x.doc_id, x.block_ix, x.k, x.n, {cos('a.vec', 'x.vec')} AS fs, {cos('z.vec', 'x.vec')} AS ls FROM k x JOIN k a ON a.doc_id = x.doc_id AND a.block_ix = x.block_ix AND a.k = 1 JOIN k z ON z.doc_id = x.doc_id AND z.block_ix = x.block_ix AND z.k = z.n)"


@query(f"WITH {TOKENS}, {WV}, {pooled_sql('sv', 'doc_id, block_ix, sent_ix')}, {ENDS} SELECT doc_id, block_ix, round(max(CASE WHEN k = n AND n >= 2 THEN fs END), 6) AS start_end, round(CASE WHEN max(n) >= 3 THEN sum(fs / (k - 1)) FILTER (k > 1) / sum(1 / (k - 1)) FILTER (k > 1) END, 6) AS start_mid, round(CASE WHEN max(n) >= 3 THEN sum(ls / (n - k)) FILTER (k < n) / sum(1 / (n - k)) FILTER (k < n) END, 6) AS mid_end FROM f GROUP BY ALL")
def end_cohesion(spark, sf):
    out = cohesion.end_cohesion(element_vectors(spark, sf, SENT), BLOCK, "sent_ix")
    return out.select(*BLOCK, *[F.round(c, 6).alias(c) for c in ("start_end", "start_mid", "mid_end")])


@query(f"WITH {TOKENS}, {WV}, {pooled_sql('sv', 'doc_id, block_ix, sent_ix')}, e AS (SELECT doc_id, block_ix, count(*) AS n, arg_min_null(vec, sent_ix) AS f, arg_max_null(vec, sent_ix) AS l FROM sv GROUP BY ALL), x AS (SELECT *, lead(f) OVER w AS nf, lead(block_ix) OVER w AS nb FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY block_ix)) SELECT doc_id, block_ix, round(CASE WHEN nb IS NOT NULL AND n >= 2 THEN {cos('l', 'nf')} END, 6) AS cohesion FROM x")
def transition_cohesion(spark, sf):
    return cohesion.transition_cohesion(element_vectors(spark, sf, SENT)).withColumn("cohesion", F.round("cohesion", 6))


def _overlap(kind: str) -> None:
    pos = ", ".join(f"'{p}'" for p in cohesion.OVERLAPS[kind])
    sql = f"WITH {ANNOTATED}, e AS (SELECT doc_id, block_ix, sent_ix, coalesce(list(DISTINCT lemma) FILTER (pos IN ({pos})), []) AS l FROM a GROUP BY ALL), k AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix, sent_ix) AS k FROM e) SELECT x.doc_id, x.k::INT AS a, y.k::INT AS b, round(len(list_intersect(x.l, y.l)) / (0.00001 + len(list_distinct(list_concat(x.l, y.l)))), 6) AS overlap FROM k x JOIN k y ON x.doc_id = y.doc_id AND y.k - x.k BETWEEN 1 AND 2"

    def run(spark, sf):
        return cohesion.lexical_overlap(annotated_of(spark, sf), kind, 2).withColumn("overlap", F.round("overlap", 6))

    run.__name__ = f"{kind}_overlap"
    query(sql)(run)


for _kind in cohesion.OVERLAPS:
    _overlap(_kind)

NUMBERED = "e AS (SELECT doc_id, vec, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix, sent_ix) AS k FROM sv), ed AS (SELECT x.doc_id, x.k AS a, y.k AS b, " + cos("x.vec", "y.vec") + " AS value FROM e x JOIN e y ON x.doc_id = y.doc_id AND y.k - x.k BETWEEN 1 AND 3)"


def sentence_nodes(spark, sf) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("block_ix", "sent_ix")
    return element_vectors(spark, sf, SENT).select("doc_id", F.lit("sent").alias("level"), F.row_number().over(w).alias("place"), "vec")


@query(f"WITH {TOKENS}, {WV}, {pooled_sql('sv', 'doc_id, block_ix, sent_ix')}, {NUMBERED} SELECT doc_id, a::INT AS a, b::INT AS b, round(value, 6) AS value FROM ed")
def semantic_edges(spark, sf):
    return cohesion.semantic_edges(sentence_nodes(spark, sf), 3).select("doc_id", "a", "b", F.round("value", 6).alias("value"))


@query(f"WITH {TOKENS}, {WV}, {pooled_sql('sv', 'doc_id, block_ix, sent_ix')}, {NUMBERED}, l AS (SELECT doc_id, avg(round(value, 9)) + stddev_pop(round(value, 9)) + 1e-9 AS m FROM ed GROUP BY ALL) SELECT ed.doc_id, a::INT AS a, b::INT AS b, round(value, 6) AS value FROM ed JOIN l ON ed.doc_id = l.doc_id WHERE round(value, 9) > m")
def filtered_edges(spark, sf):
    e = cohesion.semantic_edges(sentence_nodes(spark, sf), 3).withColumn("value", F.round("value", 9))
    return cohesion.filtered_edges(e, ["doc_id"], margin=1e-9).select("doc_id", "a", "b", F.round("value", 6).alias("value"))


@query(f"WITH {TOKENS}, {WV}, {BV}, {pooled_sql('dv', 'doc_id')} SELECT bv.doc_id, bv.block_ix AS place, round({cos('bv.vec', 'dv.vec')}, 6) AS value FROM bv JOIN dv ON bv.doc_id = dv.doc_id")
def containment_edges(spark, sf):
    return cohesion.containment_edges(block_vectors(spark, sf).withColumnRenamed("block_ix", "place"), element_vectors(spark, sf, ["doc_id"]), ["doc_id"]).withColumn("value", F.round("value", 6))


@query("WITH g0 AS (SELECT item_id AS id, unnest(list_concat(list_concat(list_transform(range(1, length(text) + 1), lambda i: substring(text, i, 1)), list_transform(range(1, length(text)), lambda i: substring(text, i, 2))), list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)))) AS gram FROM benchmark), g AS (SELECT id, gram, count(*) AS n FROM g0 GROUP BY ALL), own AS (SELECT id, sum(n)::DOUBLE AS own FROM g GROUP BY id), p AS (SELECT item_id AS a, item_id + 1 AS b FROM benchmark WHERE item_id + 1 IN (SELECT item_id FROM benchmark)), k AS (SELECT a, b, sum(least(x.n, y.n)) AS i, count(*) AS c, sum(x.n * y.n) AS s FROM p JOIN g x ON x.id = a JOIN g y ON y.id = b AND y.gram = x.gram GROUP BY ALL) SELECT p.a, p.b, coalesce(i, 0)::BIGINT AS intersection, coalesce(c, 0)::BIGINT AS presence, coalesce(s, 0)::BIGINT AS spectrum, round(coalesce(i, 0) / sqrt(oa.own * ob.own), 6) AS normalized FROM p LEFT JOIN k ON p.a = k.a AND p.b = k.b JOIN own oa ON oa.id = p.a JOIN own ob ON ob.id = p.b")
def string_kernels(spark, sf):
    strings = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    pairs = strings.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(strings.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    return kernels.kernels(pairs, strings).withColumn("normalized", F.round("normalized", 6))
