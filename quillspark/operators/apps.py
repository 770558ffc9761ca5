"""Applications over tokens and index tables: keywords, summaries, fluctuations, feature selection, label and text utilities."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import numbered
from .segment import sentence_texts
from .vectors import cosine

# --- keywords and summaries ---


def keywords(tokens: DataFrame, documents: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, lemma, score: similarities of a lemma's occurrences to the document, summed, if at least threshold.

    tokens: doc_id, lemma, vec of content words; documents: doc_id, vec. Equal lemmas have equal vectors, so
    occurrences are counted first and only distinct lemmas meet their document.
    """
    n = tokens.groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    out = n.join(documents.select("doc_id", F.col("vec").alias("doc_vec")), "doc_id").select("doc_id", "lemma", (F.col("n") * cosine(F.col("vec"), F.col("doc_vec"))).alias("score"))
    return out.filter(F.round("score", 9) >= threshold)


def rank_summary(sentences: DataFrame, importance: DataFrame, top: int = 3) -> DataFrame:
    """doc_id, summary: the most important sentences joined by a space in order of rank; ties to the earlier one.

    sentences: doc_id, place, text; importance: doc_id, node, importance.
    """
    rows = sentences.join(importance.select("doc_id", F.col("node").alias("place"), "importance"), ["doc_id", "place"])
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("importance", 6)), "place")
    best = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top)
    return best.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " ").alias("summary"))


def first_greatest(value: np.ndarray) -> int:
    """The place that a search from the left ends at which only moves on for what is more than 1e-12 greater."""
    at = 0
    while (better := np.flatnonzero(value[at + 1 :] > value[at] + 1e-12)).size:
        at += 1 + int(better[0])
    return at


def submodular_choice(sim: np.ndarray, share: float = 0.2, alpha: float = 3.0, weight: float = 5.0, rounds: int = 20) -> list[int]:
    """Greedy choice of share of the rows that maximises coverage, sum min(sum sim to the choice, alpha / n * sum sim), plus
    weight * sum over clusters of the root of the mean similarity of what is chosen there. Clusters: k-means with a tenth of the rows, seeded by the first ones.
    """
    n = len(sim)
    k, size = max(1, -(-n // 10)), int(share * n)
    centres = sim[np.linspace(0, n - 1, k).astype(int)].copy()
    label, rows = np.full(n, -1), max(1, 2_000_000 // n)
    with_all = sim if np.array_equal(sim, sim.T) else np.ascontiguousarray(sim.T)
    for _ in range(rounds):
        # the row's own square is the same for all centres
        far = (centres * centres).sum(1) - 2 * sim @ centres.T
        new = (far <= far.min(1, keepdims=True) + 1e-9).argmax(1)  # equal centres go to the first
        if np.array_equal(new, label):
            break  # the centres stay too
        label = new
        total = np.bincount(label, minlength=k)
        order = np.argsort(label, kind="stable")
        there = np.flatnonzero(total)
        centres[there] = np.add.reduceat(sim[order], (np.cumsum(total) - total)[there], axis=0) / total[there, None]
    limit, mean = alpha / n * sim.sum(1), np.maximum(sim.mean(1), 0)
    chosen: list[int] = []
    covered, inside = np.zeros(n), np.zeros(k)
    left = np.ones(n, bool)
    while len(chosen) < size:
        value = np.concatenate([np.minimum(covered + with_all[at : at + rows], limit).sum(1) for at in range(0, n, rows)])
        roots = np.sqrt(inside)
        value += weight * (roots.sum() - roots[label] + np.sqrt(inside[label] + mean))
        best = first_greatest(np.where(left, value, -np.inf))
        left[best] = False
        chosen.append(best)
        covered += sim[:, best]
        inside[label[best]] += mean[best]
    return sorted(chosen)


def submodular_summary(sentences: DataFrame) -> DataFrame:
    """doc_id, place of the chosen sentences. sentences: doc_id, place, vec; a document's sentences are one group."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        dims = max((len(v) for v in g["vec"] if v is not None), default=1)
        x = np.stack([np.zeros(dims) if v is None else np.asarray(v, float) for v in g["vec"]])
        size = np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        places = g["place"].to_numpy()[submodular_choice(unit @ unit.T)]
        return pd.DataFrame({"doc_id": key[0], "place": places}).astype({"doc_id": "int64", "place": "int32"})

    return sentences.groupBy("doc_id").applyInPandas(run, "doc_id bigint, place int")


# --- fluctuations and feedback ---


def fluctuations(values: DataFrame, keys: list[str], clip: bool = True) -> DataFrame:
    """values with low, high (mean -+ 2 population deviations of the series; one value: -+ 2; low clipped at 0 if clip) and outside."""
    s = values.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    s = s.select(*keys, *_limits(F.col("n"), F.col("m"), F.col("sd"), clip))
    return values.join(s, keys).withColumn("outside", (F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def _limits(n: Column, mean: Column, deviation: Column, clip: bool) -> list[Column]:
    spread = F.when(n == 1, 2.0).otherwise(2 * deviation)
    low = F.coalesce(mean - spread, F.lit(0.0))
    return [(F.greatest(low, F.lit(0.0)) if clip else low).alias("low"), F.coalesce(mean + spread, F.lit(1.0)).alias("high")]


def beyond_limits(series: DataFrame, names: list[str], key: str = "doc_id", margin: float = 1e-6) -> DataFrame:
    """key, index, n, low, high, outside: the limits of fluctuations and how many values are beyond them by more than margin.

    series: key, and one number a column of names. Where its rows are dealt by key nothing shuffles: a key's values stay in one row, bounded by the document.
    """
    stats = [g(n).alias(f"__{k}_{n}") for n in names for k, g in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]
    rows = series.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct(*names)).alias("__all"), *stats)
    each = [F.struct(F.lit(n).alias("index"), *_limits(F.col(f"__n_{n}"), F.col(f"__m_{n}"), F.col(f"__s_{n}"), True), F.col(f"__all.{n}").alias("__v")) for n in names]
    rows = rows.select(key, "n", F.inline(F.array(*each)))
    beyond = F.filter("__v", lambda x: (x < F.round("low", 9) - margin) | (x > F.round("high", 9) + margin))
    return rows.select(key, "index", "n", "low", "high", F.size(beyond).cast("bigint").alias("outside"))


def feedback(values: DataFrame) -> DataFrame:
    """doc_id, feedback: JSON of each level's index names and their values in order. values: doc_id, level, place, index, value."""
    by = values.groupBy("doc_id", "level", "index").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
    by = by.groupBy("doc_id", "level").agg(F.array_sort(F.collect_list(F.struct("index", F.transform("v", lambda x: x["value"]).alias("results")))).alias("r"))
    level = F.struct("level", F.transform("r", lambda x: x["index"]).alias("indices"), F.transform("r", lambda x: x["results"]).alias("results"))
    return by.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(level))).alias("feedback"))


# --- features ---


def wide(features: DataFrame, names: list[str]) -> DataFrame:
    """doc_id and a column for each index of names, from doc_id, index, value."""
    return features.groupBy("doc_id").pivot("index", names).agg(F.first("value"))


def rare_features(features: DataFrame, documents: int, most: float = 0.2) -> DataFrame:
    """index, zeros (share of documents where it is 0 or missing), kept."""
    z = features.groupBy("index").agg(F.count_if(F.col("value") != 0).alias("some"))
    return z.select("index", (1 - F.col("some") / F.lit(documents)).alias("zeros")).withColumn("kept", F.col("zeros") < most)


def correlations(features: DataFrame, targets: DataFrame) -> DataFrame:
    """index, correlation: absolute Pearson correlation with targets(doc_id, target); null for a constant."""
    j = features.join(targets, "doc_id")
    n, x, y = F.count(F.lit(1)), F.col("value"), F.col("target")
    vx, vy = n * F.sum(x * x) - F.sum(x) ** 2, n * F.sum(y * y) - F.sum(y) ** 2
    return j.groupBy("index").agg(F.when((vx > 1e-12) & (vy > 1e-12), F.abs((n * F.sum(x * y) - F.sum(x) * F.sum(y)) / F.sqrt(vx * vy))).alias("correlation"))


def anova(features: DataFrame, classes: DataFrame) -> DataFrame:
    """index, f: one-way analysis of variance of each index over classes(doc_id, label)."""
    g = features.join(classes, "doc_id").groupBy("index", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    t = g.groupBy("index").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") ** 2 / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") ** 2 / F.col("n"), F.col("q") - F.col("b")
    return t.select("index", F.when((F.col("k") > 1) & (within > 1e-9), between / (F.col("k") - 1) / (within / (F.col("n") - F.col("k")))).alias("f"))


def collinear(columns: list[str], strength: dict[str, float], matrix: np.ndarray, most: float = 0.9) -> list[str]:
    """Columns that remain when of each pair correlated above most, strongest first, the one less tied to the target goes."""
    heap = [(-matrix[i, j], i, j) for i in range(len(columns)) for j in range(i) if matrix[i, j] > most]
    heapq.heapify(heap)
    gone: set[int] = set()
    while heap:
        _, i, j = heapq.heappop(heap)
        if i not in gone and j not in gone:
            gone.add(i if strength[columns[i]] < strength[columns[j]] else j)
    return [c for i, c in enumerate(columns) if i not in gone]


def min_max(features: DataFrame, train: DataFrame) -> DataFrame:
    """Values scaled by the least and greatest of train(doc_id); a constant index becomes 0."""
    s = features.join(train, "doc_id", "left_semi").groupBy("index").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return features.join(s, "index").select("doc_id", "index", F.coalesce(F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))), F.lit(0.0)).alias("value"))


def label_type(labels: DataFrame, label: str) -> str:
    """float if all labels are numbers, else string."""
    r = labels.agg(F.count(label).alias("n"), F.count(F.expr(f"try_cast({label} AS double)")).alias("d")).first()
    return "float" if r.n == r.d else "string"


def hash_split(key: Column, share: float, seed: int = 0) -> Column:
    """Whether a row belongs to a share of all, the same in every run and however rows are partitioned."""
    return F.pmod(F.crc32(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary")), F.lit(10_000)) < int(share * 10_000)


# --- sentiment data ---


def five_against_all(rating: Column) -> Column:
    return F.when(rating == 5, 1).otherwise(0)


def four_classes(rating: Column) -> Column:
    """1 and 2 are one class, 3 to 5 one each."""
    return F.greatest(rating.cast("int") - 2, F.lit(0))


def expected_rating(probabilities: Column) -> Column:
    """sum of i / 5 * p_i over classes i from 1."""
    return F.aggregate(F.transform(probabilities, lambda p, i: p * (i + 1) / 5), F.lit(0.0), lambda s, x: s + x)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, weight: n / (k n_c)."""
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return c.join(F.broadcast(t), F.lit(True)).select(label, (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))  # one row


def balanced(rows: DataFrame, label: str, key: str) -> DataFrame:
    """Rows of smaller classes repeated (column copy tells them apart) until all classes are as large as the largest.

    Each row is read floor(largest / n) times; the rest is made up by the rows first in hash order, numbered by running sums, so a class may have any number of rows.
    """
    c = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.max("n").alias("most"))
    placed = numbered(rows.withColumn("__order", F.md5(F.col(key).cast("string"))), [label], ["__order", key], "__r")
    ranked = placed.join(c, label).join(F.broadcast(t), F.lit(True))  # one row
    times = F.floor(F.col("most") / F.col("n")) + F.when(F.col("__r") < F.col("most") % F.col("n"), 1).otherwise(0)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*rows.columns, "copy")


# --- diacritics ---

#: Letters that diacritics may be missing from, and what they become without (fixed values).
MARKED, PLAIN = "ăâîșşțţĂÂÎȘŞȚŢ", "aaissttAAISSTT"
RESTORABLE = "aăâiîsștț"


def stripped(text: Column) -> Column:
    return F.translate(text, MARKED, PLAIN)


def normalized_ro(text: Column) -> Column:
    """Comma-below letters, and â inside words."""
    return F.regexp_replace(F.translate(text, "şţŞŢ", "șțȘȚ"), r"(?<=\p{L})î(?=\p{L})", "â")


def diacritic_label(letter: Column) -> Column:
    """0 plain, 1 ă, 2 â, 3 î, 4 ș or ț."""
    low = F.lower(letter)
    return F.when(low == "ă", 1).when(low == "â", 2).when(low == "î", 3).when(low.isin("ș", "ț"), 4).otherwise(0)


def diacritic_windows(rows: DataFrame, text: str = "text", reach: int = 5) -> DataFrame:
    """rows' columns but text, at, window, label: the stripped letters around each one that may carry a mark."""
    padded = F.concat(F.lit(" " * reach), stripped(F.col(text)), F.lit(" " * reach))
    at = F.explode(F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.lower(F.substring(F.col(text), i, F.lit(1))).isin(*RESTORABLE)))
    out = rows.filter(F.length(text) > 0).withColumn("at", at)
    return out.select(*[c for c in rows.columns if c != text], (F.col("at") - 1).alias("at"), F.substring(padded, F.col("at"), F.lit(2 * reach + 1)).alias("window"), diacritic_label(F.substring(F.col(text), F.col("at"), F.lit(1))).alias("label"))


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row: documents, sentences, words, characters, characters but spaces, letters that may carry marks."""
    t = F.coalesce("text", F.lit(""))
    return docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.size(sentence_texts(t))).alias("sentences"),
        F.sum(F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+"))).alias("words"),
        F.sum(F.length(t)).alias("chars"),
        F.sum(F.length(F.replace(t, F.lit(" "), F.lit("")))).alias("chars_no_space"),
        F.sum(F.regexp_count(F.lower(t), F.lit("[" + RESTORABLE + "]"))).alias("restorable"),
    )


def letter_counts(docs: DataFrame) -> DataFrame:
    """letter, n, counted in each document first, so that texts never explode to one row a letter."""
    return docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("letter")).filter("letter <> ''").groupBy("letter").agg(F.count(F.lit(1)).alias("n"))


# --- grammatical error correction ---


def pairs_of_lines(lines: DataFrame) -> DataFrame:
    """pair, target, source of lines(line_no, text): even lines are targets, odd ones sources; incomplete pairs go."""
    out = lines.groupBy(F.floor(F.col("line_no") / 2).alias("pair")).agg(F.max(F.when(F.col("line_no") % 2 == 0, F.col("text"))).alias("target"), F.max(F.when(F.col("line_no") % 2 == 1, F.col("text"))).alias("source"))
    return out.filter("target is not null and source is not null")


def fitted(ids: Column, length: int, fill: int = 0) -> Column:
    """An array cut or filled to a length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill), length)), 1, length)


def length_penalty(length: Column, alpha: float = 0.6) -> Column:
    return F.pow((F.lit(5.0) + length) / 6.0, F.lit(alpha))


def beam_step(beams: DataFrame, scores: DataFrame, width: int) -> DataFrame:
    """One step of beam search: group, rank, beam (parent), token, logp.

    beams: group, beam, logp, finished; scores: group, beam, token, logp (log-softmaxed). A finished beam goes on with the token -1 alone.
    """
    going = beams.filter("not finished").join(scores.withColumnRenamed("logp", "step"), ["group", "beam"]).select("group", "beam", "token", (F.col("logp") + F.col("step")).alias("logp"))
    done = beams.filter("finished").select("group", "beam", F.lit(-1).alias("token"), "logp")
    w = Window.partitionBy("group").orderBy(F.desc(F.round("logp", 9)), "beam", "token")
    return going.union(done).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= width).select("group", "rank", "beam", "token", "logp")


def modelled(rows: DataFrame, schema: str, model: object) -> DataFrame:
    """Rows through an outside model, batch by batch: model takes an iterator of pandas batches and yields the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from model(batches)

    return rows.mapInPandas(run, schema)


# --- training corpora ---


def training_tokens(tokens: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Alphabetic tokens but stop words, as lower-case lemmas; of a vocabulary(lemma) if given."""
    out = tokens.filter(F.col("text").rlike(r"^\p{L}+$") & ~F.col("is_stop")).withColumn("lemma", F.lower("lemma"))
    return out if vocabulary is None else out.join(vocabulary, "lemma", "left_semi")


def training_sentences(sentences: DataFrame, lemmas: DataFrame, stop: DataFrame) -> DataFrame:
    """words: the training tokens of each sentence that has any, in order; of sentences with an array of words. Forms are looked up by lemmas(word, lemma) and stop(word), which become one row, so they are small.

    Sentences aren't taken apart, so nothing is shuffled.
    """
    known = lemmas.agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("__lemma"))
    known = known.crossJoin(stop.agg(F.collect_set("word").alias("__stop")))
    rows = sentences.select("words").crossJoin(F.broadcast(known))  # one row
    kept = F.filter("words", lambda x: x.rlike(r"^\p{L}+$") & ~F.array_contains("__stop", F.lower(x)))
    words = F.transform(kept, lambda x: F.lower(F.coalesce(F.try_element_at("__lemma", F.lower(x)), F.lower(x))))
    return rows.select(words.alias("words")).filter(F.size("words") > 0)


def topic_model(counts: DataFrame, topics: int, rounds: int):
    """The JVM's LDA model (online variational Bayes) of counts(features), vectors of the counts of terms, each round over all rows.

    The estimator of pyspark.ml takes a sample for each round, with replacement even at a rate of 1, and so leaves rows out; the optimizer below it can be told not to.
    """
    jvm = counts.sparkSession._jvm
    every = jvm.org.apache.spark.mllib.clustering.OnlineLDAOptimizer().setMiniBatchFraction(1.0).setSampleWithReplacement(False).setOptimizeDocConcentration(True)
    lda = jvm.org.apache.spark.mllib.clustering.LDA().setK(topics).setMaxIterations(rounds).setSeed(0).setOptimizer(every)
    rows = getattr(getattr(jvm.org.apache.spark.ml.clustering, "LDA$"), "MODULE$").getOldDataset(counts._jdf, "features")  # as the estimator does
    return lda.run(rows)


def dictionary(tokens: DataFrame, documents: int, least: int = 8, most: float = 0.1) -> DataFrame:
    """lemma, df of lemmas in at least some documents and at most a share of them."""
    return tokens.groupBy("lemma").agg(F.countDistinct("doc_id").alias("df")).filter((F.col("df") >= least) & (F.col("df") <= most * documents))


def log_entropy(counts: DataFrame, documents: int) -> DataFrame:
    """doc_id, lemma, weight: ln(1 + tf) * (1 + sum p ln p / ln N), the sum over the document's own lemmas."""
    t = counts.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("q"))
    e = t.select("doc_id", (1 + (F.col("q") / F.col("t") - F.ln("t")) / F.ln(F.lit(float(max(documents, 2))))).alias("e"))
    return counts.join(e, "doc_id").select("doc_id", "lemma", (F.ln(F.col("n") + 1) * F.col("e")).alias("weight"))


def mean_features(values: DataFrame) -> DataFrame:
    """doc_id, index, value: means over a document's sections, from doc_id, index, value with one row for each section."""
    return values.groupBy("doc_id", "index").agg(F.avg("value").alias("value"))


def encoded(rows: DataFrame, label: str) -> DataFrame:
    """rows with <label>_code: the label's number in order, from 0. Labels are few: their distinct values are numbered in one task and joined back."""
    codes = rows.select(label).distinct().withColumn(f"{label}_code", (F.row_number().over(Window.orderBy(label)) - 1).cast("bigint"))
    return rows.join(codes, label)
