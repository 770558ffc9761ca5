"""Queries of conversations, activity over time and bibliometric graphs, each with the SQL it is checked against.

Conversations' turns are posts that answer the one before, roles are participants; events are posts over time; orders and
suppliers stand in for articles and authors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import biblio, components, threads
from ..sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def posts(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("id"), F.col("turn").alias("parent_id"), F.col("role").alias("user"), F.lit(None).cast("timestamp").alias("ts"), "text")
    return threads.contributions(c)


POSTS = r"""p0 AS (SELECT conv_id, turn + 1 AS id, turn AS parent_id, role AS "user", trim(coalesce(text, '')) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ix FROM conversations), p AS (SELECT a.conv_id, a.ix, a.id, CASE WHEN a.ix > 0 THEN b.ix END AS parent_ix, a."user", CASE WHEN right(a.x, 1) IN ('.', '!', '?') THEN a.x ELSE a.x || '.' END AS text FROM p0 a LEFT JOIN p0 b ON a.conv_id = b.conv_id AND a.parent_id = b.id AND b.id > 0)"""
EDGES = r"""w AS (SELECT conv_id, ix, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS l FROM p), e AS (SELECT x.conv_id, x.ix AS a, y.ix AS b, round(len(list_intersect(x.l, y.l)) / (0.00001 + len(list_distinct(list_concat(x.l, y.l)))), 6) AS weight FROM w x JOIN w y ON x.conv_id = y.conv_id AND x.ix > y.ix)"""
IMPORTANCE = "imp AS (SELECT conv_id, ix, round(length(text) / 100, 6) AS importance FROM p)"


def edges(p: DataFrame) -> DataFrame:
    """Overlap of each post with all before it in its conversation: conv_id, a (later), b, weight."""
    words = p.select("conv_id", "ix", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("l"))
    pairs = words.withColumnRenamed("ix", "a").join(words.select("conv_id", F.col("ix").alias("b"), F.col("l").alias("o")), "conv_id").filter("a > b")
    value = F.size(F.array_intersect("l", "o")) / (1e-5 + F.size(F.array_union("l", "o")))
    return pairs.select("conv_id", "a", "b", F.round(value, 6).alias("weight"))


def importance(p: DataFrame) -> DataFrame:
    return p.select("conv_id", "ix", F.round(F.length("text") / 100, 6).alias("importance"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f'WITH {POSTS} SELECT conv_id, ix::INT AS ix, id, coalesce(parent_ix, -1)::INT AS parent_ix, "user", text FROM p')
def contributions(spark, sf):
    return posts(spark, sf).drop("ts").na.fill(-1, ["parent_ix"])


@query(f"""WITH {POSTS} SELECT conv_id, "user", min(ix)::INT AS first_ix, count(*) AS posts, count(*) FILTER (len(regexp_extract_all(text, '\\S+')) >= 5) AS significant FROM p GROUP BY ALL""")
def participants(spark, sf):
    return threads.participants(posts(spark, sf))


@query(f'WITH {POSTS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, "user" ORDER BY ix) - 1 AS own FROM p) SELECT a.conv_id, a."user", a.own::INT AS own_ix, coalesce(b.own, -1)::INT AS own_parent FROM o a LEFT JOIN o b ON a.conv_id = b.conv_id AND a."user" = b."user" AND a.parent_ix = b.ix')
def participant_conversations(spark, sf):
    return threads.own_conversation(posts(spark, sf))


INTERACTION = 'it AS (SELECT e.conv_id, x."user" AS source, y."user" AS target, sum(weight) AS score FROM e JOIN p x ON x.conv_id = e.conv_id AND x.ix = a JOIN p y ON y.conv_id = e.conv_id AND y.ix = b WHERE weight > 0 GROUP BY ALL)'


@query(f'WITH {POSTS}, {EDGES}, {INTERACTION}, u AS (SELECT DISTINCT conv_id, "user" FROM p) SELECT a.conv_id, a."user" AS source, b."user" AS target, round(coalesce(score, 0), 6) AS score FROM u a JOIN u b ON a.conv_id = b.conv_id LEFT JOIN it ON it.conv_id = a.conv_id AND it.source = a."user" AND it.target = b."user"')
def interaction(spark, sf):
    p = posts(spark, sf)
    return rounded(threads.score_matrix(p, threads.interaction(p, edges(p))), "score")


@query(f'WITH {POSTS}, {EDGES}, {INTERACTION}, {IMPORTANCE}, o AS (SELECT conv_id, "user", sum(importance) AS c FROM p JOIN imp USING (conv_id, ix) GROUP BY ALL), k AS (SELECT conv_id, source AS "user", sum(score) AS s FROM it WHERE source <> target GROUP BY ALL) SELECT conv_id, "user", round(c, 6) AS contributions_score, round(coalesce(s, 0), 6) AS social_kb FROM o LEFT JOIN k USING (conv_id, "user")')
def involvement(spark, sf):
    p = posts(spark, sf)
    return rounded(threads.involvement(p, edges(p), importance(p)), "contributions_score", "social_kb")


@query(f'WITH {POSTS}, {EDGES}, {INTERACTION}, g AS (SELECT conv_id, target AS u, source AS v, score FROM it WHERE source <> target), d AS (SELECT conv_id, u AS "user", 0 AS i, score AS o FROM g UNION ALL SELECT conv_id, v, score, 0 FROM g) SELECT conv_id, "user", round(sum(i), 6) AS indegree, round(sum(o), 6) AS outdegree FROM d GROUP BY ALL')
def participant_degrees(spark, sf):
    p = posts(spark, sf)
    return rounded(threads.degrees(threads.participant_graph(p, edges(p)), ["conv_id"]), "indegree", "outdegree")


@query()
def network_analysis(spark, sf):
    """Betweenness, closeness and eigenvector centrality; a test holds them against plain versions."""
    p = posts(spark, sf)
    return rounded(threads.network_analysis(threads.participant_graph(p, edges(p))), "betweenness", "closeness", "eigenvector")


@query(f'WITH {POSTS}, {IMPORTANCE}, s AS (SELECT conv_id, min_by("user", ix) AS "user", count(*) AS length, sum(importance) AS score FROM p JOIN imp USING (conv_id, ix) GROUP BY conv_id) SELECT "user", count(*) AS threads, round(sum(score), 6) AS score, sum(length)::BIGINT AS length, round(sum(length) / count(*), 6) AS average_length FROM s GROUP BY "user"')
def new_threads(spark, sf):
    p = posts(spark, sf)
    return rounded(threads.new_threads(p, importance(p)), "score", "average_length")


def activity(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("text"))


EV = 'ev AS (SELECT event_id AS id, user_id AS "user", floor(epoch(ts))::BIGINT AS t, event_type AS text FROM events), st AS (SELECT min(t) AS s FROM ev)'


@query(f'WITH {EV} SELECT "user", ((t - s) // 604800)::INT AS week, count(*) AS posts, min(t) AS first, max(t) AS last FROM ev, st GROUP BY ALL')
def weekly_activity(spark, sf):
    return threads.weekly(activity(spark, sf)).groupBy("user", "week").agg(F.count(F.lit(1)).alias("posts"), F.min("t").alias("first"), F.max("t").alias("last"))


MERGED = (
    f"WITH RECURSIVE {EV}, x AS (SELECT *, \"user\" % 10 AS community, row_number() OVER (PARTITION BY \"user\" % 10 ORDER BY t, id) AS k FROM ev), "
    "r AS (SELECT community, k, \"user\", t FROM x WHERE k = 1 UNION ALL SELECT r.community, min(x.k), arg_min(x.\"user\", x.k), arg_min(x.t, x.k) FROM r JOIN x ON x.community = r.community AND x.k > r.k AND (x.\"user\" <> r.\"user\" OR x.t > r.t + 1800) GROUP BY r.community, r.k), "
    "e AS (SELECT *, coalesce(lead(k) OVER (PARTITION BY community ORDER BY k), 1000000000) AS stop FROM r) "
    "SELECT e.community, arg_min(x.id, x.k) AS id, e.\"user\", e.t, count(*)::INT AS n, array_to_string(list(x.text ORDER BY x.k), ' ') AS text FROM e JOIN x ON x.community = e.community AND x.k >= e.k AND x.k < e.stop GROUP BY e.community, e.k, e.\"user\", e.t"
)


@query(MERGED)
def merged_posts(spark, sf):
    """Runs of one user's posts within 30 minutes of the first, in the stream of each of ten communities."""
    a = activity(spark, sf).withColumn("community", F.col("user") % 10)
    return threads.merged_posts(a, "community", 1800)


PEAK = lambda unit, n: f"{unit}c AS (SELECT \"user\", {unit}, count(*) AS c FROM (SELECT DISTINCT \"user\", {unit}, slot_{unit} FROM r) GROUP BY ALL), {unit}p AS (SELECT \"user\", (ln({n}) - (ln(sum(c)) - sum(c * ln(c)) / sum(c))) * max(c) AS {unit}_peak FROM {unit}c GROUP BY ALL)"
ADD = lambda f: f"list_sum(list_transform(range(1, 8), lambda i: ({f})::DOUBLE))"
PART = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * ln(2 * {p} / ({p} + {q})) ELSE 0 END"
REGULAR = (
    f"WITH {EV}, r AS (SELECT \"user\", (t - s) // 604800 AS week, ((t - s) // 3600) % 24 AS hour, ((t - s) // 86400) % 7 AS day, (t - s) // 3600 AS slot_hour, (t - s) // 86400 AS slot_day FROM ev, st), {PEAK('hour', 24)}, {PEAK('day', 7)}, "
    + "pr AS (SELECT \"user\", week, [" + ", ".join(f"count(*) FILTER (day = {d})" for d in range(7)) + "] AS p FROM r GROUP BY ALL), "
    + 'pa AS (SELECT a."user", a.p AS x, b.p AS y, list_sum(a.p) AS na, list_sum(b.p) AS nb FROM pr a JOIN pr b ON a."user" = b."user" AND a.week < b.week), '
    + f"ws AS (SELECT \"user\", avg({ADD('CASE WHEN x[i] > 0 AND y[i] > 0 THEN 1 ELSE 0 END')} / greatest({ADD('CASE WHEN x[i] > 0 THEN 1 ELSE 0 END')}, {ADD('CASE WHEN y[i] > 0 THEN 1 ELSE 0 END')})) AS ws1, avg(1 - {ADD('(' + PART('(x[i] / na)', '(y[i] / nb)') + ' + ' + PART('(y[i] / nb)', '(x[i] / na)') + ') / 2')} / ln(2)) AS ws2, avg(1 - {ADD('CASE WHEN x[i] + y[i] > 0 THEN pow((x[i] - y[i]) / (x[i] + y[i]), 2) ELSE 0 END')} / {ADD('CASE WHEN x[i] > 0 OR y[i] > 0 THEN 1 ELSE 0 END')}) AS ws3 FROM pa GROUP BY ALL) "
    + 'SELECT k."user", weeks, round(hour_peak, 6) AS hour_peak, round(day_peak, 6) AS day_peak, round(coalesce(ws1, 0), 6) AS ws1, round(coalesce(ws2, 0), 6) AS ws2, round(coalesce(ws3, 0), 6) AS ws3 FROM (SELECT "user", count(DISTINCT week) AS weeks FROM r GROUP BY ALL) k JOIN hourp USING ("user") JOIN dayp USING ("user") LEFT JOIN ws USING ("user")'
)


@query(REGULAR)
def regularity(spark, sf):
    return rounded(threads.regularity(activity(spark, sf)), "hour_peak", "day_peak", "ws1", "ws2", "ws3")


AUTHORS = "aa AS (SELECT l_orderkey AS article, l_suppkey AS author, min(l_linenumber) AS place FROM lineitem GROUP BY ALL), co AS (SELECT a.author AS a, b.author AS b, count(*) AS n FROM aa a JOIN aa b ON a.article = b.article AND a.place < b.place AND a.author <> b.author GROUP BY ALL)"


def article_authors(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("article"), F.col("l_suppkey").alias("author")).agg(F.min("l_linenumber").alias("place"))


@query(f"WITH {AUTHORS} SELECT * FROM co")
def coauthors(spark, sf):
    return biblio.coauthors(article_authors(spark, sf))


@query(f"WITH {AUTHORS}, u AS (SELECT a AS author, n FROM co UNION ALL SELECT b, n FROM co) SELECT author, sum(n)::BIGINT AS degree FROM u GROUP BY author ORDER BY degree DESC, author LIMIT 1000")
def coauthor_degrees(spark, sf):
    return biblio.weighted_degree(biblio.coauthors(article_authors(spark, sf)))


# Vectors stand in for articles; all pairs are compared.
NEAR = "em AS MATERIALIZED (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)), ds AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, round(greatest(0, 1 - list_inner_product(x.v, y.v) / x.s / y.s), 9) AS distance FROM em x JOIN em y ON y.vec_id > x.vec_id)"


def article_vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


@query(f"WITH {NEAR}, m AS (SELECT avg(distance) - stddev_pop(distance) AS l FROM ds) SELECT a, b, round(distance, 6) AS distance FROM ds, m WHERE distance < l")
def article_edges(spark, sf):
    return rounded(biblio.near_pairs(article_vectors(spark, sf)), "distance")


@query(f"WITH {NEAR}, m AS (SELECT avg(distance) - stddev_pop(distance) AS l FROM ds), e AS (SELECT a, b, distance FROM ds, m WHERE distance < l), u AS (SELECT a AS article, distance FROM e UNION ALL SELECT b, distance FROM e) SELECT article, round(sum(1 - distance), 6) AS score FROM u GROUP BY article ORDER BY round(sum(1 - distance), 9) DESC, article LIMIT 50")
def article_ranking(spark, sf):
    return rounded(biblio.top_articles(biblio.near_links(article_vectors(spark, sf))[1], 50), "score")


@query(f"WITH RECURSIVE {NEAR}, m AS (SELECT avg(distance) - stddev_pop(distance) AS l FROM ds), e AS (SELECT a, b FROM ds, m WHERE distance < l), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY node")
def single_link_clusters(spark, sf):
    return components.connected_components(biblio.near_links(article_vectors(spark, sf))[0])


@query()
def component_centralities(spark, sf):
    """Weighted closeness and betweenness within clusters; tests hold them against plain versions."""
    v = article_vectors(spark, sf)
    limit = biblio.near_limit(v)
    found = components.connected_components(biblio.near_links(v, limit)[0])
    return rounded(biblio.component_centralities(v, found, limit), "closeness", "betweenness")


# Two authors for each article: the row's label and its id's last digit.
BY = "au AS (SELECT vec_id AS article, label::BIGINT AS author FROM embeddings UNION SELECT vec_id, 100 + vec_id % 10 FROM embeddings)"


def embedding_authors(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("article"), F.col("label").cast("bigint").alias("author")).union(e.select("vec_id", 100 + F.col("vec_id") % 10)).distinct()


@query(f"WITH {NEAR}, {BY}, bo AS (SELECT a, b, distance FROM ds UNION ALL SELECT b, a, distance FROM ds), n AS (SELECT author, count(*) AS n FROM au GROUP BY ALL), x AS (SELECT au.author, bo.b AS article, (sum(distance) + max(n) - count(*)) / max(n) AS distance FROM au JOIN bo ON au.article = bo.a JOIN n ON n.author = au.author GROUP BY ALL) SELECT author, article, round(distance + 1e-11, 6) AS distance FROM x WHERE distance < 0.99 AND (author, article) NOT IN (SELECT author, article FROM au) UNION ALL SELECT author, article, 0 FROM au")
def author_article_edges(spark, sf):
    out = biblio.author_article_means(embedding_authors(spark, sf), article_vectors(spark, sf), 0.99)
    return rounded(out.withColumn("distance", F.col("distance") + 1e-11), "distance")  # means of few numbers of nine places end in a five now and then


def similar_authors(spark, sf) -> DataFrame:
    return biblio.matched_authors(embedding_authors(spark, sf), article_vectors(spark, sf), 0.8, biblio.matching, "matched")


@query()
def author_similarity(spark, sf):
    """Best matchings of the articles of all pairs of authors; tests hold it against all matchings."""
    return rounded(similar_authors(spark, sf), "similarity")


#: Other names of the queries of all pairs.
article_edges_pairwise, author_article_edges_pairwise = article_edges, author_article_edges
