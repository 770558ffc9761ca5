"""Further queries: rules, corrections, clusters, comprehension, kernels, features over sections, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import annotate, apps, biblio, components, comprehension, grammar_ro, indices, kernel_machines, kernels, latent, measures, segment, subwords, wordnet
from ..operators import reduce as reducers
from ..sources.lexicons import as_sql, lexicon
from ..sources.tables import stored, table
from . import applications, community, readings
from . import indices as all_indices
from .community import rounded
from .complexity import annotated_of, docs_of
from .similarity import cos
from .sqltext import ANNOTATED, TOKENS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- names and tags ---

_LANG = " ".join(f"WHEN n IN ({', '.join(map(repr, names))}) THEN '{code}'" for code, names in annotate.LANGUAGES.items())


@query(f"SELECT doc_id, CASE {_LANG} END AS language FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 3 = 1 THEN lang ELSE lang || 'x' END AS x, lower(trim(x)) AS n FROM documents)")
def language_names(spark, sf):
    i, lang = F.col("doc_id"), F.col("lang")
    name = F.when(i % 3 == 0, F.upper(lang)).when(i % 3 == 1, lang).otherwise(F.concat(lang, F.lit("x")))
    return table(spark, sf, "documents").select("doc_id", annotate.language(name).alias("language"))


_PENN = " ".join("WHEN l = '" + code + "' THEN CASE " + " ".join(f"WHEN starts_with(lower(pos), '{s}') THEN '{t}'" for s, t in rules) + " ELSE '' END" for code, rules in annotate.PENN.items())


@query(f"WITH {as_sql('lex_pos')} SELECT word, l AS lang, CASE {_PENN} ELSE left(pos, 2) END AS tag FROM lex_pos, (SELECT unnest(['fr', 'nl', 'ro', 'en']) AS l)")
def penn_tags(spark, sf):
    rows = lexicon(spark, "lex_pos").withColumn("lang", F.explode(F.array(*map(F.lit, ["fr", "nl", "ro", "en"]))))
    return rows.select("word", "lang", annotate.penn(F.col("pos"), F.col("lang")).alias("tag"))


# --- rules ---

# Fixture tags: words by length as nouns, adjectives, verbs and pronouns with person, gender and number, and heads half their place, as an annotator would supply them.
_TAG = "CASE length(text) % 4 WHEN 0 THEN 'Nc' || CASE WHEN length(text) % 3 = 0 THEN 'f' ELSE 'm' END || CASE WHEN length(text) % 5 = 0 THEN 'p' ELSE 's' END WHEN 1 THEN 'Afp' || CASE WHEN length(text) % 3 = 1 THEN 'f' ELSE 'm' END || 's' WHEN 2 THEN 'Vmip3' || CASE WHEN length(text) % 3 = 0 THEN 'p' ELSE 's' END ELSE 'Pp' || CASE WHEN length(text) % 3 = 0 THEN '1' ELSE '3' END || '-s' END"
_DEP = "CASE WHEN tok_ix = 0 THEN 'root' WHEN tok_ix % 3 = 0 THEN 'nsubj' WHEN tok_ix % 3 = 1 THEN 'conj' ELSE 'amod' END"
TAGGED = f"g AS (SELECT doc_id, block_ix, sent_ix, tok_ix, text, (tok_ix // 2)::INT AS head_ix, {_DEP} AS dep, {_TAG} AS tag FROM t)"


def tagged(spark, sf) -> DataFrame:
    t = segment.tokens(docs_of(spark, sf))
    return t.select(*segment.SENT, "tok_ix", "text", F.floor(F.col("tok_ix") / 2).cast("int").alias("head_ix"), F.expr(_DEP).alias("dep"), F.expr(_TAG).alias("tag"))


@query(f"WITH {TOKENS}, {TAGGED}, s1 AS (SELECT g.*, EXISTS (SELECT 1 FROM g c WHERE c.doc_id = g.doc_id AND c.block_ix = g.block_ix AND c.sent_ix = g.sent_ix AND c.head_ix = g.tok_ix AND c.dep = 'conj') AS several FROM g WHERE dep = 'nsubj' AND tag[1:1] IN ('N', 'P')), s2 AS (SELECT *, several OR count(*) OVER (PARTITION BY doc_id, block_ix, sent_ix, head_ix) > 1 AS plural FROM s1), j AS (SELECT s2.*, v.text AS predicate, v.tag AS vt, CASE WHEN s2.tag[1:1] = 'N' THEN '3' ELSE s2.tag[3:3] END AS p, CASE WHEN plural THEN 'p' WHEN s2.tag[1:1] = 'N' THEN s2.tag[4:4] ELSE s2.tag[5:5] END AS n FROM s2 JOIN g v ON v.doc_id = s2.doc_id AND v.block_ix = s2.block_ix AND v.sent_ix = s2.sent_ix AND v.tok_ix = s2.head_ix AND v.tag[1:1] = 'V') SELECT doc_id, block_ix, sent_ix, tok_ix, text, predicate, p <> vt[5:5] AND NOT plural AS person, n <> vt[6:6] AS number FROM j WHERE (p <> vt[5:5] AND NOT plural) OR n <> vt[6:6]")
def predicate_disagreements(spark, sf):
    return grammar_ro.predicate_disagreements(tagged(spark, sf))


@query(f"WITH {TOKENS}, {TAGGED}, j AS (SELECT c.*, h.text AS head, c.tag[4:4] <> h.tag[3:3] AS gender, c.tag[5:5] <> h.tag[4:4] AS number FROM g c JOIN g h ON h.doc_id = c.doc_id AND h.block_ix = c.block_ix AND h.sent_ix = c.sent_ix AND h.tok_ix = c.head_ix WHERE c.tag[1:1] = 'A' AND h.tag[1:1] = 'N') SELECT doc_id, block_ix, sent_ix, tok_ix, text, head, gender, number FROM j WHERE gender OR number")
def noun_disagreements(spark, sf):
    return grammar_ro.disagreements(tagged(spark, sf))


_SYN = "sy AS (SELECT DISTINCT a.word, b.word AS synonym FROM sw a JOIN sw b ON a.synset = b.synset AND a.word <> b.word)"


@query(f"WITH RECURSIVE {TOKENS}, {applications.WN}, {_SYN} SELECT x.doc_id, x.block_ix, x.sent_ix, x.tok_ix, x.lemma, y.tok_ix AS before, synonym FROM t x JOIN sy ON sy.word = x.lemma JOIN t y ON y.doc_id = x.doc_id AND y.block_ix = x.block_ix AND y.sent_ix = x.sent_ix AND y.lemma = synonym AND x.tok_ix - y.tok_ix BETWEEN 1 AND 7")
def synonym_repetitions(spark, sf):
    return grammar_ro.synonym_repetitions(segment.tokens(docs_of(spark, sf)), wordnet.synonyms(applications.synsets(spark)[0]))


_WORDS, _BARE = ["and", "et", "und"], ["that", "die"]


@query(r"SELECT doc_id, len(regexp_extract_all(x, '(?i),\s*(?:and|et|und)([^\p{L}\p{N}]|$)')) + len(regexp_extract_all(x, '(?i)(^|[^\p{L}\p{N}])(?:and|et|und)\s*,')) AS commas, len(regexp_extract_all(x, '(?i)[\p{L}\p{N}]\s+(?:that|die)([^\p{L}\p{N}]|$)')) AS missing FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)")
def conjunction_commas(spark, sf):
    x = F.coalesce("text", F.lit(""))
    return docs_of(spark, sf).select("doc_id", F.size(grammar_ro.commas_at_coordination(x, _WORDS)).cast("bigint").alias("commas"), F.size(grammar_ro.missing_adversative_commas(x, _BARE)).cast("bigint").alias("missing"))


def corrected_sql() -> str:
    out = "coalesce(text, '')"
    for pattern, new in grammar_ro.corrections(_BARE, _WORDS):
        out = f"regexp_replace({out}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return f"SELECT doc_id, md5({out}) AS corrected_md5 FROM documents"


@query(corrected_sql())
def corrected_texts(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(grammar_ro.corrected(F.coalesce("text", F.lit("")), _BARE, _WORDS).cast("binary")).alias("corrected_md5"))


_PAIRS = ", ".join(map(str, applications.PAIR_LIST))


@query(f"WITH {TOKENS}, w AS (SELECT *, lead(lemma) OVER x AS next, lag(text) OVER x AS before FROM t WINDOW x AS (PARTITION BY doc_id, block_ix, sent_ix ORDER BY tok_ix)) SELECT doc_id, block_ix, sent_ix, (count(*) FILTER ((lemma, next) IN ({_PAIRS})) + count(*) FILTER (lemma = 'that' AND before <> ',') + count(*) FILTER (tok_ix = 0 AND lemma IN ('and', 'und', 'et')))::INT AS errors FROM w GROUP BY ALL")
def common_errors(spark, sf):
    """How many rules each sentence breaks, counted in the array of its words."""
    w, low = F.col("words"), F.transform("words", lambda x: F.lower(x))
    s = segment.sentence_words(docs_of(spark, sf)).withColumn("low", low).withColumn("next", F.slice(F.concat("low", F.array(F.lit(""))), 2, F.size("low"))).withColumn("before", F.concat(F.array(F.lit(",")), w))
    pairs = F.filter(F.zip_with("low", "next", lambda a, b: F.concat_ws(" ", a, b)), lambda p: p.isin(*[f"{a} {b}" for a, b in applications.PAIR_LIST]))
    bare = F.filter(F.zip_with("low", "before", lambda a, b: (a == "that") & (b != ",")), lambda x: x)
    first = F.get("low", F.lit(0)).isin("and", "und", "et").cast("int")
    return s.select(*segment.SENT, (F.size(pairs) + F.size(bare) + first).alias("errors"))


# --- articles and authors ---


@query(f"WITH RECURSIVE {community.NEAR}, m AS (SELECT avg(distance) - stddev_pop(distance) AS l FROM ds), e AS (SELECT a, b, distance FROM ds, m WHERE distance < l) SELECT a AS node, b AS next, round(distance, 6) AS distance FROM e UNION ALL SELECT b, a, round(distance, 6) FROM e")
def article_neighbours(spark, sf):
    return rounded(biblio.neighbours(biblio.near_pairs(community.article_vectors(spark, sf))), "distance")


_CLOSE = "em AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM em x JOIN em y ON y.vec_id > x.vec_id WHERE round(greatest(0, 1 - list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v)) / sqrt(list_inner_product(y.v, y.v))), 9) < 0.65), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other), c AS (SELECT node, min(other) AS component FROM r GROUP BY node), dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)"


def _top_clusters(by: str):
    sql = f"WITH RECURSIVE {_CLOSE} SELECT component, count(*) AS size, round(sum(coalesce(degree, 0)) / count(*), 6) AS mean_degree FROM c LEFT JOIN dg USING (node) GROUP BY component ORDER BY {'size' if by == 'size' else 'round(sum(coalesce(degree, 0)) / count(*), 9)'} DESC, component LIMIT 10"

    def run(spark, sf):
        links, degrees = biblio.near_links(community.article_vectors(spark, sf), 0.65)
        return rounded(biblio.cluster_sizes(components.connected_components(links), degrees, 10, by), "mean_degree")

    run.__name__ = f"clusters_by_{by}"
    query(sql)(run)


for _by in ("size", "mean_degree"):
    _top_clusters(_by)


@query()
def author_similarity_one_way(spark, sf):
    return rounded(biblio.matched_authors(community.embedding_authors(spark, sf), community.article_vectors(spark, sf), 0.8, biblio.repeated_matching, "rounds"), "similarity")


@query()
def author_edges(spark, sf):
    return rounded(biblio.author_edges(stored(community.similar_authors(spark, sf), "similar-authors")), "distance")


# --- comprehension ---

_FORMS = "vec(word, x, y) AS (SELECT DISTINCT lemma, length(lemma)::DOUBLE, (1 + length(lemma) - length(replace(lemma, 'e', '')))::DOUBLE FROM a)"


def form_vectors(rows: DataFrame) -> DataFrame:
    """A fixture vector for each lemma: its length, and its e's plus one."""
    return rows.select(F.col("lemma").alias("word")).distinct().select("word", F.array(F.length("word").cast("double"), F.regexp_count("word", F.lit("e")).cast("double") + 1).alias("vec"))


@query(f"WITH {readings.CONCEPTS}, {_FORMS}, p AS (SELECT DISTINCT doc_id, a, b FROM ce), d AS (SELECT doc_id, p.a, p.b, round(greatest(0, 1 - {cos('[u.x, u.y]', '[w.x, w.y]')}), 9) AS distance FROM p JOIN vec u ON u.word = p.a JOIN vec w ON w.word = p.b), l AS (SELECT doc_id, avg(distance) - stddev_pop(distance) AS l FROM d GROUP BY doc_id) SELECT d.doc_id, a, b, round(distance, 6) AS distance FROM d JOIN l USING (doc_id) WHERE distance < l - 1e-9")
def near_concepts(spark, sf):
    """Concept pairs nearer than mean - deviation of their document's."""
    a = annotated_of(spark, sf)
    d = comprehension.word_distances(readings.concepts(spark, sf), form_vectors(a)).withColumn("distance", F.round("distance", 9))
    s = d.groupBy("doc_id").agg((F.avg("distance") - F.stddev_pop("distance") - 1e-9).alias("limit"))
    return rounded(d.join(s, "doc_id").filter("distance < limit").drop("limit"), "distance")


@query(f"WITH RECURSIVE {ANNOTATED}, {as_sql('lex_rating')}, {applications.WN}, {_SYN}, {_FORMS.replace("lemma", "lower(text)")}, hyw AS (SELECT DISTINCT a.word, b.word AS other FROM sw a JOIN hy ON hy.synset = a.synset JOIN sw b ON b.synset = hy.parent WHERE a.word <> b.word), re AS (SELECT word, synonym AS other FROM sy UNION SELECT * FROM hyw), ss AS (SELECT doc_id, block_ix, sent_ix, sum(x) AS x, sum(y) AS y FROM a JOIN vec ON vec.word = lower(a.text) GROUP BY ALL), own AS (SELECT DISTINCT doc_id, block_ix, sent_ix, lower(text) AS lemma FROM a WHERE pos IN ('NOUN', 'VERB')), ages AS (SELECT word, min(value) AS age FROM lex_rating WHERE measure = 'kuperman' GROUP BY word), nw AS (SELECT DISTINCT o.doc_id, o.block_ix, o.sent_ix, re.other AS word FROM own o JOIN re ON re.word = o.lemma WHERE NOT EXISTS (SELECT 1 FROM own z WHERE z.doc_id = o.doc_id AND z.block_ix = o.block_ix AND z.sent_ix = o.sent_ix AND z.lemma = re.other)), k AS (SELECT nw.doc_id, nw.block_ix, nw.sent_ix, nw.word, {cos('[vec.x, vec.y]', '[ss.x, ss.y]')} AS s FROM nw JOIN vec ON vec.word = nw.word JOIN ss ON ss.doc_id = nw.doc_id AND ss.block_ix = nw.block_ix AND ss.sent_ix = nw.sent_ix LEFT JOIN ages ON ages.word = nw.word WHERE coalesce(age, 0) < 9), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_ix, sent_ix ORDER BY round(s, 9) DESC, word) AS rank FROM k WHERE s > 0.33) SELECT doc_id, block_ix, sent_ix, rank, word, round(s, 6) AS similarity FROM r WHERE rank <= 3")
def expanded_concepts(spark, sf):
    """Synonyms and hypernyms that join the concepts of each sentence."""
    a, (s, h) = annotated_of(spark, sf), applications.synsets(spark)
    related = wordnet.synonyms(s).union(wordnet.hypernym_words(s, h)).toDF("word", "other").distinct()
    ages = lexicon(spark, "lex_rating").filter("measure = 'kuperman'").groupBy("word").agg(F.min("value").alias("age"))
    step = F.struct("block_ix", "sent_ix").alias("step")
    a = a.withColumn("lemma", F.lower("text"))
    vec = form_vectors(a)
    sums = a.join(vec.withColumnRenamed("word", "lemma"), "lemma").groupBy("doc_id", step).agg(F.array(F.sum(F.col("vec")[0]), F.sum(F.col("vec")[1])).alias("vec"))
    out = comprehension.expanded(a.select("doc_id", step, "lemma", "pos"), related, ages, vec, sums)
    return out.select("doc_id", "step.block_ix", "step.sent_ix", "rank", "word", F.round("similarity", 6).alias("similarity"))


@query()
def comprehension_metrics(spark, sf):
    """Nine means over the history of each document's concept graph."""
    return comprehension.full_history(readings.concepts(spark, sf))


# --- strings ---

_GRAMS = "g0 AS (SELECT item_id AS id, unnest(list_concat(list_concat(list_transform(range(1, length(text) + 1), lambda i: substring(text, i, 1)), list_transform(range(1, length(text)), lambda i: substring(text, i, 2))), list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)))) AS gram FROM benchmark)"
_KERNELS = "g AS (SELECT id, gram, count(*) AS n FROM g1 GROUP BY ALL), own AS (SELECT id, sum(n)::DOUBLE AS own FROM g GROUP BY id), k AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS i, count(*) AS c, sum(x.n * y.n) AS s FROM g x JOIN g y ON y.gram = x.gram AND x.id < y.id GROUP BY ALL), kr AS (SELECT p.a, p.b, coalesce(i, 0)::BIGINT AS intersection, coalesce(c, 0)::BIGINT AS presence, coalesce(s, 0)::BIGINT AS spectrum, coalesce(i, 0) / sqrt(oa.own * ob.own) AS normalized FROM (SELECT x.item_id AS a, y.item_id AS b FROM benchmark x JOIN benchmark y ON x.item_id < y.item_id) p LEFT JOIN k ON p.a = k.a AND p.b = k.b JOIN own oa ON oa.id = p.a JOIN own ob ON ob.id = p.b)"


def benchmark_pairs(spark, sf) -> tuple[DataFrame, DataFrame]:
    strings = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return strings.select(F.col("id").alias("a")).join(strings.select(F.col("id").alias("b")), F.col("a") < F.col("b")), strings


@query(f"WITH {_GRAMS}, g1 AS (SELECT * FROM g0), {_KERNELS} SELECT a, b, intersection, presence, spectrum, round(normalized, 6) AS normalized FROM kr")
def kernel_matrix(spark, sf):
    """All pairs of the benchmark's strings, a list of fixed size."""
    pairs, strings = benchmark_pairs(spark, sf)
    return rounded(kernels.kernels(pairs, strings), "normalized")


@query(f"WITH {_GRAMS}, g1 AS (SELECT id, CASE WHEN gram IN ('a', 'e', 'i', 'o', 'u') THEN '#vowel' WHEN gram IN ('th', 'he', 'an') THEN '#common' ELSE gram END AS gram FROM g0), {_KERNELS} SELECT a, b, intersection, presence, spectrum, round(normalized, 6) AS normalized FROM kr")
def clustered_kernels(spark, sf):
    """Kernels with n-grams counted by clusters."""
    pairs, strings = benchmark_pairs(spark, sf)
    clusters = spark.createDataFrame([(g, "#vowel") for g in "aeiou"] + [(g, "#common") for g in ("th", "he", "an")], "gram string, cluster string")
    return rounded(kernels.kernels(pairs, strings, clusters=clusters), "normalized")


@query(f"WITH {_GRAMS}, g1 AS (SELECT * FROM g0), {_KERNELS}, bo AS (SELECT a, b, normalized FROM kr UNION ALL SELECT b, a, normalized FROM kr), r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(normalized, 9) DESC, b) AS r FROM bo), la AS (SELECT item_id, length(text) % 3 AS l FROM benchmark) SELECT count(*) AS strings, count(*) FILTER (x.l = y.l) AS \"right\" FROM r JOIN la x ON x.item_id = a JOIN la y ON y.item_id = b WHERE r = 1")
def kernel_accuracy(spark, sf):
    """How often the string nearest by normalised kernel has the same label (here the length modulo 3); ties to the smaller id."""
    pairs, strings = benchmark_pairs(spark, sf)
    return kernels.accuracy(kernels.kernels(pairs, strings), strings.select("id", (F.length("text") % 3).alias("label")))


# --- applications ---

_FIVE = ["Wd", "UnqWd", "Punct", "Commas", "WdEntr"]
_SERIES = (
    all_indices.BASE
    + f", s5 AS (SELECT doc_id, block_ix, sent_ix, count(*)::DOUBLE AS \"Wd\", count(DISTINCT text)::DOUBLE AS \"UnqWd\", count(*) FILTER (pos = 'PUNCT')::DOUBLE AS \"Punct\", count(*) FILTER (text = ',')::DOUBLE AS \"Commas\" FROM a GROUP BY ALL), n5 AS (SELECT doc_id, block_ix, sent_ix, lemma, count(*) AS n FROM a GROUP BY ALL), "
    "sr AS (SELECT doc_id, block_ix, sent_ix, index, value FROM (UNPIVOT s5 ON \"Wd\", \"UnqWd\", \"Punct\", \"Commas\" INTO NAME index VALUE value) UNION ALL SELECT doc_id, block_ix, sent_ix, 'WdEntr', ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM n5 GROUP BY ALL)"
)


def sentence_values(spark, sf) -> DataFrame:
    """doc_id, block_ix, sent_ix and five indices, one a column; they need no more than parts of speech and lemmas, and rows stay where documents are dealt."""
    n = F.col("n")
    forms = annotated_of(spark, sf).groupBy(*segment.SENT, "lemma", "text").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == "PUNCT").alias("punct"))
    commas = F.sum(F.when(F.col("text") == ",", n).otherwise(0)).alias("commas")
    lemmas = forms.groupBy(*segment.SENT, "lemma").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"), F.sum("punct").alias("punct"), commas)  # a form has one lemma
    counts = [F.sum(c).cast("double").alias(name) for c, name in (("n", "Wd"), ("forms", "UnqWd"), ("punct", "Punct"), ("commas", "Commas"))]
    return lemmas.groupBy(*segment.SENT).agg(*counts, (F.ln(F.sum("n")) - F.sum(n * F.ln("n")) / F.sum("n")).alias("WdEntr"))


@query(f"WITH RECURSIVE {_SERIES}, f AS (SELECT doc_id, index, avg(value) AS m, CASE WHEN count(*) = 1 THEN 2 ELSE 2 * stddev_pop(value) END AS d FROM sr GROUP BY doc_id, index) SELECT doc_id, index, count(*) AS n, round(greatest(any_value(m - d), 0), 6) AS low, round(any_value(m + d), 6) AS high, count(*) FILTER (value < round(greatest(m - d, 0), 9) - 1e-6 OR value > round(m + d, 9) + 1e-6) AS outside FROM sr JOIN f USING (doc_id, index) GROUP BY doc_id, index")
def index_fluctuations(spark, sf):
    """For five indices how many sentences of a document are beyond two deviations, and the limits."""
    return rounded(apps.beyond_limits(sentence_values(spark, sf), list(_FIVE)), "low", "high")


_SECTIONS = "se AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents), sw_ AS (SELECT doc_id, len(regexp_extract_all(x, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')) AS wd, len(regexp_extract_all(x, ',')) AS commas, length(x) AS chars FROM se)"


@query(f"WITH {_SECTIONS} SELECT doc_id, round(avg(wd), 6) AS wd, round(avg(commas), 6) AS commas, round(avg(chars), 6) AS chars FROM sw_ GROUP BY doc_id")
def section_features(spark, sf):
    """A document's features as means over its sections (here its lines)."""
    s = docs_of(spark, sf).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("x"))
    long = s.select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("index"), v.cast("double").alias("value")) for n, v in (("wd", F.size(segment.words(F.col("x")))), ("commas", F.regexp_count("x", F.lit(","))), ("chars", F.length("x")))])))
    return rounded(apps.wide(apps.mean_features(long), ["wd", "commas", "chars"]), "wd", "commas", "chars")


@query(f"WITH {_SECTIONS}, w AS (SELECT * FROM (VALUES (0, 'commas'), (1, 'wd'), (2, 'absent')) v(place, index)), f AS (SELECT doc_id, 'wd' AS index, avg(wd) AS value FROM sw_ GROUP BY doc_id UNION ALL SELECT doc_id, 'commas', avg(commas) FROM sw_ GROUP BY doc_id UNION ALL SELECT doc_id, 'chars', avg(chars) FROM sw_ GROUP BY doc_id) SELECT doc_id, place, f.index, round(value, 6) AS value FROM f JOIN w ON w.index = f.index")
def selected_features(spark, sf):
    """Of a long feature table the indices that a list names, with their places in it."""
    s = docs_of(spark, sf).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("x"))
    long = s.select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("index"), v.cast("double").alias("value")) for n, v in (("wd", F.size(segment.words(F.col("x")))), ("commas", F.regexp_count("x", F.lit(","))), ("chars", F.length("x")))])))
    names = spark.createDataFrame([(0, "commas"), (1, "wd"), (2, "absent")], "place int, index string")
    return rounded(apps.mean_features(long).join(names, "index"), "value")


@query("SELECT doc_id, lang, source, dense_rank() OVER (ORDER BY lang) - 1 AS lang_code, dense_rank() OVER (ORDER BY source) - 1 AS source_code FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def encoded_labels(spark, sf):
    docs = table(spark, sf, "documents").filter("lang is not null and source is not null").select("doc_id", "lang", "source")
    return apps.encoded(apps.encoded(docs, "lang"), "source")


@query("SELECT coalesce(event_type, '*') AS event_type, coalesce((user_id % 5)::VARCHAR, '*') AS part, count(*) AS posts, round(sum(value), 4) AS value FROM events GROUP BY CUBE (event_type, (user_id % 5))")
def activity_cube(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 5).cast("string").alias("part"), "value")
    out = e.cube("event_type", "part").agg(F.count(F.lit(1)).alias("posts"), F.round(F.sum("value"), 4).alias("value"))
    return out.na.fill("*", ["event_type", "part"])


# Each participant's own posts of a conversation as a document, by a number for (conversation, role).
_OWN = "documents AS (SELECT conv_id * 10 + CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL)"


@query(all_indices.indices_sql("doc", ("surface", "discourse")).replace("WITH RECURSIVE ", f"WITH RECURSIVE {_OWN}, ", 1))
def participant_complexity(spark, sf):
    """The indices of what each participant says in a conversation."""
    c = table(spark, sf, "conversations")
    who = (F.col("conv_id") * 10 + F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)).alias("doc_id")
    posts = c.select(who, "turn", F.coalesce("text", F.lit("")).alias("text")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    chosen = [m for m in all_indices.MEASURES if m.category in ("surface", "discourse")]
    return indices.compute_indices(all_indices.values(spark, posts, chosen), chosen)


@query(f'WITH {community.EV}, w AS (SELECT "user" % 10 AS community, ((t - s) // 604800)::INT AS week, "user", t, id FROM ev, st), n AS (SELECT *, lag("user") OVER (PARTITION BY community, week ORDER BY t, id) AS before FROM w), c AS (SELECT community, week, count(*) AS posts, count(DISTINCT "user") AS participants FROM w GROUP BY ALL), e AS (SELECT community, week, count(*) AS answers, count(DISTINCT ("user", before)) AS pairs FROM n WHERE before <> "user" GROUP BY ALL) SELECT community, week, posts, participants, coalesce(answers, 0) AS answers, coalesce(pairs, 0) AS pairs FROM c LEFT JOIN e USING (community, week)')
def weekly_communities(spark, sf):
    """Each community's weeks on their own: posts, participants, posts that follow another participant's, and pairs that do."""
    from ..operators import threads

    a = community.activity(spark, sf).withColumn("community", F.col("user") % 10)
    return threads.weekly_communities(a, "community")


@query("WITH p AS (SELECT conv_id, turn, role AS \"user\", text, lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations), k AS (SELECT *, sum(CASE WHEN before IS NULL OR turn - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, \"user\" ORDER BY turn) AS run FROM p) SELECT conv_id, min(turn) AS id, \"user\", count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM k GROUP BY conv_id, \"user\", run")
def merged_by_distance(spark, sf):
    """Posts of one user that are at most two places apart become one."""
    from ..operators import threads

    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("role").alias("user"), "text")
    out = threads.merged_by_distance(c, "conv_id", 2)
    return out.select("conv_id", "id", "user", "n", F.col("chars").cast("bigint").alias("chars"))


@query()
def document_topics_by_svd(spark, sf):
    """Five latent dimensions of documents from log-entropy weights of all terms; a test holds them against an exact decomposition."""
    c = apps.training_tokens(annotated_of(spark, sf)).groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("n"))
    return latent.latent_dimensions(apps.log_entropy(c, table(spark, sf, "documents").count()), 5)[0]


@query()
def essay_scores(spark, sf):
    """Held-out grades by a kernel machine for numbers on the standardised feature table, and what is reported of them: at least 0.1, less 7."""
    rows = readings.standardised(spark, sf).join(applications.targets(spark, sf), "doc_id").select("doc_id", "x", (F.col("target") + 7).alias("target"))
    test = apps.hash_split(F.col("doc_id"), 0.2)
    model = kernel_machines.fit(rows.filter(~test).select("x", F.col("target").alias("y")), kernel_machines.Kernel("rbf", 1 / len(applications.NAMES)), classify=False)
    return model.predict(rows.filter(test)).select("doc_id", "target", "prediction", F.greatest(F.col("prediction") - 7, F.lit(0.1)).alias("reported"))


@query()
def quality_by_kernel_machine(spark, sf):
    """Held-out quality labels by a polynomial kernel machine with balanced classes."""
    rows = readings.standardised(spark, sf).join(applications.targets(spark, sf), "doc_id")
    test = apps.hash_split(F.col("doc_id"), 0.2)
    weights = {r.target: r.weight for r in apps.class_weights(rows.filter(~test), "target").collect()}  # one row a class
    model = kernel_machines.fit(rows.filter(~test).select("x", F.col("target").alias("y")), kernel_machines.Kernel("poly", 1 / len(applications.NAMES), degree=3), class_weights=weights)
    return model.predict(rows.filter(test)).select("doc_id", "target", "prediction")


@query()
def subword_vectors(spark, sf):
    """Vectors of all lower-cased words of the documents, from their character n-grams."""
    sentences = segment.sentence_words(docs_of(spark, sf)).select(F.xxhash64(*segment.SENT).alias("key"), F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.rlike(r"\p{L}")).alias("words"))
    sentences = stored(sentences, "subword-sentences")  # read for the training and for the words
    model = subwords.train(sentences, epochs=1)
    return model.vectors(sentences.select(F.explode("words").alias("word")).distinct())


@query(f"WITH {TOKENS} SELECT doc_id, round(avg(n), 6) AS tokens_a_block, round(avg(chars), 6) AS chars FROM (SELECT doc_id, block_ix, count(*) AS n, sum(length(text)) AS chars FROM t GROUP BY ALL) GROUP BY doc_id")
def block_means(spark, sf):
    s = measures.by_sentence(docs_of(spark, sf)).filter("sent_ix is not null").groupBy(*segment.BLOCK).agg(F.sum("wd").alias("n"), F.sum(F.length(F.array_join("words", ""))).alias("chars"))
    return s.groupBy("doc_id").agg(F.round(reducers.mean("n"), 6).alias("tokens_a_block"), F.round(reducers.mean("chars"), 6).alias("chars"))
