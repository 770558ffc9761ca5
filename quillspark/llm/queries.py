"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import ann, bpe, htmltext, hyperminhash, langid, lloyd, media, mixing, simhash, substring, toxicity, variants, warc
from .common import fold_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(fold_of(F.col("doc_id"), 5) != 0))
    return toxicity.score(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = langid.train(docs.filter(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents"))
    stored = stored.select("doc_id", "n_bytes", F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return media.read(stored).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.BLOCK, media.BLOCK)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "units",
    )


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    ranks, pattern = bpe.read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN
    return bpe.encode(docs, ranks, pattern, decoded=True).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_texts(table(spark, sf_dir, "pages"))


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.compress(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_media_columns": op2_media_columns,
    "op3_language_id": op3_language_id,
    "op4_byte_level_bpe": op4_byte_level_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_html_extraction": op9_html_extraction,
    "op10_mixing_sources": op10_mixing_sources,
    "op11_minhash": op11_minhash,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling_variants": op13_spelling_variants,
}
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Removal by comparing all windows of 50 words.
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {WORDS_SQL} AS w FROM documents),
x AS (SELECT row, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM d, unnest(range(1, greatest(1, len(w) - 48))) u(i) WHERE doc_id IS NOT NULL),
f AS (SELECT k, min(doc_id) AS first FROM x GROUP BY k),
r AS (SELECT row, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM x JOIN f USING (k) WHERE first < doc_id GROUP BY row),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS m, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j))), lambda j: w[j]) END AS kept FROM d LEFT JOIN r USING (row))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""

OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (h)"""

#: Sources that stop at 3 times their size are those of least size by weight, as many as the shared rest still exceeds.
OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
o AS (SELECT *, row_number() OVER o AS k, coalesce(sum(3 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(n) OVER () AS total FROM w WINDOW o AS (ORDER BY n / w, source NULLS LAST)),
c AS (SELECT min(k) AS k FROM o WHERE (total - capped)::DOUBLE * w / rest <= 3 * n),
g AS (SELECT o.source, o.n, CASE WHEN o.k < c.k THEN (3 * o.n)::DOUBLE ELSE (b.total - b.capped)::DOUBLE * o.w / b.rest END AS target FROM o, c JOIN o b ON b.k = c.k),
q AS (SELECT d.doc_id, d.source, d.size, g.n, g.target, round_even(g.target, 0)::BIGINT AS budget, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(d.doc_id::VARCHAR, '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, n AS source_size, target, CASE WHEN n = 0 THEN 0 ELSE (size * (budget // n) + greatest(0, least(size, budget % n - before)))::BIGINT END AS taken FROM q"""

#: Every pair that shares a shingle, then all that can be reached.
OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT row, md5(array_to_string(w[i:i + 3], ' ')) AS k FROM d, unnest(range(1, greatest(2, len(w) - 2))) u(i) WHERE len(w) > 0),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
p AS (SELECT a.row AS a, b.row AS b, count(*) AS same FROM s a JOIN s b ON a.k = b.k AND a.row <> b.row GROUP BY a.row, b.row),
l AS (SELECT a, b FROM p JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
r AS (SELECT row AS a, row AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a AS row, min(doc_id) AS component_id FROM r JOIN d ON d.row = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (row) LEFT JOIN n USING (row)"""


def _lloyd_sql(rounds: int = lloyd.ROUNDS, parts: int = lloyd.PARTS, entries: int = lloyd.ENTRIES) -> str:
    """Each round assigns all parts anew and takes the mean of all parts of an entry."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT row, x.part, e, x.v, list_inner_product(c.v, c.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(x.v, x.v) AS d FROM x JOIN b{i} c ON c.part = x.part)")
        steps.append(f"a{i} AS (SELECT row, part, min(d) AS d, arg_min(e, d * {entries} + e) AS e, any_value(v) AS v FROM d{i} GROUP BY row, part)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT part, e, j, floor(sum(v[j]) / count(*)) AS m FROM a{i}, unnest(range(1, len(v) + 1)) u(j) GROUP BY part, e, j)")
            steps.append(f"m{i} AS (SELECT part, e, list(m::DOUBLE ORDER BY j) AS v FROM s{i} GROUP BY part, e)")
            steps.append(f"b{i + 1} AS (SELECT part, e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (part, e))")
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM k, unnest(range({parts})) u(part)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS e, v FROM x WHERE row <= {entries}),
{", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
h AS (SELECT sha256(string_agg(v[j]::BIGINT::VARCHAR, ',' ORDER BY part, e, j)) AS h FROM b{rounds}, unnest(range(1, len(v) + 1)) u(j)),
o AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY row)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM o JOIN k USING (row), h"""


#: CRC-32 byte by byte, on all runs at once; near words by what is left of each word without a code point, replaced ones at the same place.
OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT byte, c FROM bits WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
q AS MATERIALIZED (SELECT row_number() OVER () AS id, w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY doc_id, w)),
bytes AS MATERIALIZED (SELECT id, i, ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT AS byte FROM q, unnest(range(length(x) // 2)) u(i)),
crc AS (SELECT id, 0::BIGINT AS i, 4294967295::BIGINT AS c FROM q UNION ALL SELECT s.id, s.i + 1, xor(s.c >> 8, tab.c)::BIGINT FROM (SELECT crc.id, crc.i, crc.c, b.byte FROM crc JOIN bytes b ON b.id = crc.id AND b.i = crc.i) s JOIN tab ON tab.byte = xor(s.c, s.byte) & 255),
h AS (SELECT id, xor(arg_max(c, i), 4294967295) AS h FROM crc GROUP BY id),
v AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM q JOIN h USING (id)) WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
g AS MATERIALIZED (SELECT w, n, i, w[:i] AS a, w[i + 2:] AS b FROM v, unnest(range(length(w))) u(i)),
near AS (SELECT x.w, y.w AS o, y.n FROM g x JOIN g y USING (i, a, b) WHERE x.w <> y.w
 UNION ALL SELECT x.w, v.w, v.n FROM (SELECT DISTINCT w, a || b AS s FROM g) x JOIN v ON v.w = x.s
 UNION ALL SELECT v.w, x.w, x.n FROM (SELECT DISTINCT w, n, a || b AS s FROM g) x JOIN v ON v.w = x.s),
best AS MATERIALIZED (SELECT w, count(*)::BIGINT AS n_near, first(o ORDER BY n DESC, o) AS o, max(n) AS m FROM near GROUP BY w),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN o END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (w)),
chain AS (SELECT w, w AS o, 0 AS k FROM f UNION ALL SELECT chain.w, f.form, k + 1 FROM chain JOIN f ON f.w = chain.o WHERE f.form IS NOT NULL),
root AS (SELECT w, arg_max(o, k) AS root FROM chain GROUP BY w)
SELECT w AS word, form, root, n, n_near, form_n FROM f JOIN root USING (w)"""

#: The others have no form in SQL (learned models, transport streams, BPE, XXH64 with a seed, approximate search); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op10_mixing_sources": OP10_SQL,
    "op11_minhash": OP11_SQL,
    "op12_vector_codes": _lloyd_sql(),
    "op13_spelling_variants": OP13_SQL,
}
