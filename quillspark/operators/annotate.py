"""Annotation of tokens: a protocol for outside annotators, and the default one from lexicon tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Annotator(Protocol):
    """Turns batches of sentences (key columns and text) into batches of annotated tokens."""

    schema: str

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def annotated(sentences: DataFrame, annotator: Annotator) -> DataFrame:
    """Runs an outside model; the only place on this path where rows go through Python."""
    run: Callable = annotator
    return sentences.mapInPandas(run, annotator.schema)


def by_lexicon(tokens: DataFrame, pos: DataFrame, lemmas: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """tokens with pos, and lemma and is_stop if their tables are given.

    A token without entry is NUM if it is all digits, PUNCT without letters and digits, else X. Lexicons
    are joined on the lower-cased form; Spark broadcasts them while they are below its size threshold.
    """
    low = tokens.withColumn("__w", F.lower("text"))
    out = low.join(pos.select(F.col("word").alias("__w"), F.col("pos").alias("__pos")), "__w", "left")
    default = F.when(F.col("text").rlike(r"^\p{N}+$"), "NUM").when(F.col("text").rlike(r"^[^\p{L}\p{N}]$"), "PUNCT").otherwise("X")
    out = out.withColumn("pos", F.coalesce("__pos", default)).drop("__pos")
    if lemmas is not None:
        out = out.join(lemmas.select(F.col("word").alias("__w"), F.col("lemma").alias("__lemma")), "__w", "left").withColumn("lemma", F.coalesce("__lemma", "lemma")).drop("__lemma")
    if stop is not None:
        out = out.join(stop.select(F.col("word").alias("__w"), F.lit(True).alias("__stop")), "__w", "left").withColumn("is_stop", F.coalesce("__stop", F.lit(False))).drop("__stop")
    return out.drop("__w")


def universal_pos_ro(tag: Column) -> Column:
    """Universal part of speech of a Romanian morpho-syntactic tag, by its prefix."""
    rules = [("Np", "PROPN"), ("N", "NOUN"), ("Va", "AUX"), ("V", "VERB"), ("A", "ADJ"), ("R", "ADV"), ("P", "PRON"), ("D", "DET"), ("T", "DET"), ("S", "ADP"), ("C", "CCONJ"), ("M", "NUM"), ("I", "INTJ"), ("Y", "X")]
    out = F.lit("X")
    for prefix, name in reversed(rules):
        out = F.when(F.startswith(tag, F.lit(prefix)), name).otherwise(out)
    return out


#: Names by which a language is known (fixed values).
LANGUAGES = {
    "ro": ["ro", "rou", "romanian"], "en": ["en", "eng", "english"], "es": ["es", "esp", "spanish"], "ru": ["ru", "rus", "russian"], "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french"], "it": ["it", "ita", "italian"], "nl": ["nl", "nld", "dut", "dutch"], "pt": ["pt", "por", "portuguese"],
}
#: Beginnings of a language's own tags and the Penn tag they stand for; the first that fits counts (fixed values).
PENN = {
    "fr": [("noun", "NN"), ("propn", "NN"), ("verb", "VB"), ("adj", "JJ"), ("adv", "RB"), ("adp", "IN"), ("cconj", "CC")],
    "nl": [("n_", "NN"), ("n|", "NN"), ("propn", "NN"), ("v_", "VB"), ("v|", "VB"), ("adj", "JJ"), ("adv", "RB"), ("adp", "IN"), ("cconj", "CC"), ("conj", "CC")],
    "ro": [("n", "NN"), ("v", "VB"), ("a", "JJ"), ("r", "RB"), ("s", "IN"), ("cs", "IN"), ("c", "CC")],
}


def language(name: Column) -> Column:
    """The code of a language by any of its names, by a map literal; null if unknown."""
    known = F.create_map(*[F.lit(x) for code, names in LANGUAGES.items() for n in names for x in (n, code)])
    return F.try_element_at(known, F.lower(F.trim(name)))


def penn(tag: Column, lang: Column) -> Column:
    """The Penn tag of a language's own tag: by rules, '' if none fits; the first two letters for languages without rules."""
    low, out = F.lower(tag), F.substring(tag, 1, 2)
    for code, rules in PENN.items():
        found = F.lit("")
        for start, name in reversed(rules):
            found = F.when(F.startswith(low, F.lit(start)), name).otherwise(found)
        out = F.when(lang == code, found).otherwise(out)
    return out


def from_conllu(rows: DataFrame, doc_id: Column) -> DataFrame:
    """Annotated tokens as indices.annotated_rows and the rules take them, of readers.conllu's rows: each document is one block.

    Gives doc_id, block_ix, sent_ix, tok_ix, text, lemma, pos (upos), tag (xpos), head_ix (a root, or a token without a head, heads itself), dep, ent (null).
    """
    w = Window.partitionBy("doc_id").orderBy("sentence")
    t = rows.withColumn("doc_id", doc_id.cast("bigint")).withColumn("sent_ix", (F.dense_rank().over(w) - 1).cast("int"))
    head = F.when(F.coalesce("head", F.lit(0)) > 0, F.col("head") - 1).otherwise(F.col("ix") - 1).cast("int")
    tok = (F.col("ix") - 1).cast("int")
    return t.select("doc_id", F.lit(0).alias("block_ix"), "sent_ix", tok.alias("tok_ix"), F.col("form").alias("text"), "lemma", F.col("upos").alias("pos"), F.col("xpos").alias("tag"), head.alias("head_ix"), F.col("deprel").alias("dep"), F.lit(None).cast("string").alias("ent"))
