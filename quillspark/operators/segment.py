"""Documents as blocks, sentences and tokens: nested splits exploded in one narrow stage, without a shuffle.

block: the text's lines, after one pass that joins double line ends; empty lines stay blocks. sentence and token:
regular expressions that Spark and other SQL engines read alike. Empty blocks have no sentence.
Null text is one empty block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sentence as other SQL engines with linear matching may state it. Spark's matcher would go back over runs of blanks again and again, so sentence_texts
#: takes pieces up to the end marks and drops blank ones, which gives the same.
SENTENCE = r"[^.!?\n]*[^.!?\n\s][^.!?\n]*[.!?]*"
PIECE, NOT_BLANK = r"[^.!?\n]+[.!?]*", r"[^.!?\n\s]"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Begins at the start of a run of letters and never goes back, so that long runs cost no more than their length.
MISSING_SPACE = r"(?<![a-z])([a-z]++)\.([A-Z][a-z]+)"
BLOCK, SENT = ["doc_id", "block_ix"], ["doc_id", "block_ix", "sent_ix"]


def repaired(text: Column) -> Column:
    """A space behind a full stop that runs into the next sentence."""
    return F.regexp_replace(text, MISSING_SPACE, "$1. $2")


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_ix, text."""
    lines = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n\n"), F.lit("\n")), "\n")
    return docs.select("doc_id", F.posexplode(lines).alias("block_ix", "text"))


def sections(docs: DataFrame, least: int = 0) -> DataFrame:
    """doc_id, section_ix, text: parts between empty lines; lines of up to least characters are dropped if least is positive."""
    out = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("section_ix", "text"))
    if least:
        out = out.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), lambda x: F.length(x) > least), "\n"))
    return out


def sentence_texts(text: Column) -> Column:
    """The sentences of a text as an array."""
    return F.filter(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda x: x.rlike(NOT_BLANK))


def sentences(docs: DataFrame, outer: bool = False) -> DataFrame:
    """doc_id, block_ix, sent_ix, text; with outer also a row with nulls for each block without a sentence."""
    explode = F.posexplode_outer if outer else F.posexplode
    return blocks(docs).select(*BLOCK, explode(sentence_texts(repaired(F.col("text")))).alias("sent_ix", "text"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sentence_words(docs: DataFrame, outer: bool = False) -> DataFrame:
    """One row for each sentence with its tokens as an array: what measures by sentence need, without exploding tokens."""
    return sentences(docs, outer).withColumn("words", F.coalesce(words(F.col("text")), F.array().cast("array<string>")))


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, block_ix, sent_ix, tok_ix, text, lemma (lower case, where no annotator says otherwise)."""
    return sentences(docs).select(*SENT, F.posexplode(words(F.col("text"))).alias("tok_ix", "text")).withColumn("lemma", F.lower("text"))
