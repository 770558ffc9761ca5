"""Textual-complexity measures: values of elements, to be reduced by quillspark.operators.reduce."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segment import BLOCK, SENT, blocks, repaired, sentence_texts, sentence_words, sentences, words

PUNCTUATION = r"^[^\p{L}\p{N}]$"
MAIN_POS = ("NOUN", "VERB", "ADJ", "ADV", "PRON")


def by_sentence(docs: DataFrame) -> DataFrame:
    """Counts of words, punctuation and commas of each sentence; a block without one has a row with a null sent_ix and zeros.

    All of these share one scan and one tokenisation, and tokens are never exploded.
    """
    w = F.col("words")
    return sentence_words(docs, outer=True).select(
        *SENT, F.size(w).alias("wd"), F.size(F.filter(w, lambda x: x.rlike(PUNCTUATION))).alias("punct"), F.size(F.filter(w, lambda x: x == ",")).alias("commas"), F.size(F.array_distinct(w)).alias("unqwd"), w.alias("words")
    )


def additive(values: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Counts of a higher level as sums of the lower level's."""
    return values.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def distinct_words(docs: DataFrame, keys: list[str]) -> DataFrame:
    """unqwd: distinct word forms, case told apart, of each element of keys; 0 for an empty block."""
    words = sentence_words(docs, outer=True).select(*SENT, F.explode_outer("words").alias("w"))
    return words.groupBy(*keys).agg(F.countDistinct("w").alias("unqwd"))


def by_document(docs: DataFrame) -> DataFrame:
    """doc_id, wd, punct, commas, sentences, unqwd of each document (ids differ) that has a word, counted inside its row: nothing is exploded, grouped or sorted."""
    lines = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n\n"), F.lit("\n")), "\n")
    s = docs.select("doc_id", F.flatten(F.transform(lines, lambda x: sentence_texts(repaired(x)))).alias("s"))
    s = s.select("doc_id", F.size("s").alias("sentences"), F.flatten(F.transform("s", words)).alias("w"))
    w = F.col("w")
    counts = {"wd": w, "punct": F.filter(w, lambda x: x.rlike(PUNCTUATION)), "commas": F.filter(w, lambda x: x == ","), "unqwd": F.array_distinct(w)}
    return s.filter(F.size(w) > 0).select("doc_id", "sentences", *[F.size(v).alias(k) for k, v in counts.items()])


def sentence_counts(docs: DataFrame) -> DataFrame:
    """sent: sentences of each block, 0 for an empty one."""
    return sentences(docs, outer=True).groupBy(*BLOCK).agg(F.count("sent_ix").alias("sent"))


def entropy_of(items: Column) -> Column:
    """Entropy (natural logarithm) of an array's elements, without exploding it; 0 for an empty array."""
    n = F.size(items).cast("double")
    counts = F.transform(F.array_distinct(items), lambda x: F.size(F.filter(items, lambda y: y == x)).cast("double"))
    return F.when(n > 0, F.ln(n) - F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.ln(c)) / n).otherwise(0.0)


def word_entropy(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """wdentr: entropy of the lemmas of each element; two aggregations, so that no element's words are gathered."""
    n = tokens.groupBy(*keys, "lemma").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("wdentr"))


def letter_grams(word: Column, n: int) -> Column:
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def gram_entropy(word: Column, n: int) -> Column:
    return entropy_of(letter_grams(word, n))


def by_form(tokens: DataFrame, name: str, value: Column) -> DataFrame:
    """tokens with a costly value of their text, computed once for each distinct form; rows of the most frequent forms are split by AQE in the join."""
    forms = tokens.select("text").distinct().withColumn(name, value)
    return tokens.join(forms, "text")


def word_values(tokens: DataFrame) -> DataFrame:
    """Measures of single words: length, distance of form and lemma, vowel groups as syllables.

    Syllables are counted as groups of vowels, one at least for a word with letters, where no syllable lexicon is given.
    """
    syllables = F.when(F.col("text").rlike(r"\p{L}"), F.greatest(F.regexp_count("lemma", F.lit("[aeiouyàâäáãåéèêëíìîïóòôöõúùûüœæ]+")), F.lit(1))).otherwise(0)
    return tokens.select("*", F.length("text").alias("chars"), F.abs(F.length("lemma") - F.length("text")).alias("lemmadiff"), syllables.alias("syllab"))


def class_counts(tokens: DataFrame, lexicon: DataFrame, kind: str, keys: list[str], by: str = "lemma") -> DataFrame:
    """keys, kind, n: how many tokens of an element are in each list of a lexicon (kind, word), in long form; no row for none."""
    return tokens.join(lexicon.select(F.col("word").alias(by), kind), by).groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("n"))


def dense(counts: DataFrame, elements: DataFrame, names: list[str], kind: str) -> DataFrame:
    """One column for each of a fixed list of names, 0 where an element has none."""
    keys = elements.columns
    wide = counts.groupBy(*keys).agg(*[F.sum(F.when(F.col(kind) == n, F.col("n")).otherwise(0)).alias(n) for n in names])
    return elements.join(wide, keys, "left").na.fill(0, names)


def rating(tokens: DataFrame, ratings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, value: mean rating of the words that have one, by exact form; elements without such a word have no row (their value is 0)."""
    return tokens.join(ratings.withColumnRenamed("word", "text"), "text").groupBy(*keys, "measure").agg(F.avg("value").alias("value"))


def repetitions(docs: DataFrame, window: int = 8) -> DataFrame:
    """repetitions of each sentence: pairs of equal lemmas, a start among positions 0..max(1, n-window)-1 and a partner
    up to window-1 positions on; a sentence of one word pairs with itself.
    """
    w = F.transform("words", lambda x: F.lower(x))
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), n - window) - 1)
    pairs = F.aggregate(starts, F.lit(0), lambda s, i: s + F.size(F.filter(F.slice("lemmas", i + 2, window - 1), lambda x: x == F.col("lemmas")[i])))
    out = sentence_words(docs).withColumn("lemmas", w).filter(n > 0)
    return out.select(*SENT, F.when(n == 1, 1).otherwise(pairs).alias("repetitions"))


def parse_depth(tokens: DataFrame) -> DataFrame:
    """depth: height of the dependency tree of each sentence, the root alone being 1; from tokens with head_ix.

    Trees are walked up by pointer doubling over one sentence at a time (bounded by its length), in Arrow batches. A
    token that heads itself is a root; of a sentence without a root the depth is null.
    """
    rows = tokens.groupBy(*SENT).agg(F.array_sort(F.collect_list(F.struct("tok_ix", "head_ix"))).alias("t"))
    rows = rows.select(*SENT, F.transform("t", lambda x: x["tok_ix"]).alias("ix"), F.transform("t", lambda x: x["head_ix"]).alias("heads"))

    def height(ix: np.ndarray, heads: np.ndarray) -> int | None:
        place = {t: i for i, t in enumerate(ix)}
        up = np.array([place.get(h, i) for i, h in enumerate(heads)])
        if not (up == np.arange(len(up))).any():
            return None
        depth = (up != np.arange(len(up))).astype(int)
        for _ in range(len(up).bit_length() + 1):
            depth, up = depth + depth[up], up[up]
        return int(depth[(up == up[up])].max()) + 1

    def run(batches):
        for b in batches:
            yield b[SENT].assign(depth=pd.array([height(i, h) for i, h in zip(b["ix"], b["heads"], strict=True)], "Int64"))

    return rows.mapInPandas(run, "doc_id bigint, block_ix int, sent_ix int, depth int")


def main_pos_counts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens and distinct forms of the main parts of speech of each element, in one aggregation over annotated tokens."""
    n = [F.count_if(F.col("pos") == p).alias(f"pos_{p.lower()}") for p in MAIN_POS]
    u = [F.countDistinct(F.when(F.col("pos") == p, F.col("text"))).alias(f"unqpos_{p.lower()}") for p in MAIN_POS]
    return tokens.groupBy(*keys).agg(*n, *u)


def elements(docs: DataFrame, level: str) -> DataFrame:
    """Keys of all elements of a level, those without words too."""
    return {"doc": lambda: docs.select("doc_id"), "block": lambda: blocks(docs).select(*BLOCK), "sent": lambda: sentences(docs).select(*SENT)}[level]()
