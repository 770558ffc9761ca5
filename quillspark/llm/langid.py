"""Language identification with error-correcting output codes.

Each learned language gets a codeword of bits. One linear classifier for each bit, over character n-grams inside
words, tells on which side of that bit a text is; the languages' codewords are then compared with all bits at once.
Decoding is loss-weighted: language k has the loss sum_b w_b log(1 + exp(-M_kb f_b)) with M the code as +-1, f the
classifiers' margins and w_b the share of training documents that bit gets right beyond chance, so that doubtful bits count less and a few
wrong bits are corrected. A text whose two best losses are closer than MARGIN is flagged as ambiguous.

Up to 7 languages have the exhaustive code (every split of the languages once, 2^(k-1)-1 bits), more have 63
hash-random bits. The fit runs on the driver over at most SAMPLE_ROWS documents of each language in hash order of
their ids and texts, SAMPLE_TOTAL documents and SAMPLE_CHARS characters in all; hash thresholds by language bound what any task holds of a language
before it is sorted. Every document is scored, whole.

Defined cases: null texts and texts without a letter are `und`, with score 0, not ambiguous; so is everything if
no document has a language to learn; with one learned language, every text with a letter has that language, score 1; equal texts
get equal results; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TokenTable, map_batches, sample_shares

SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_CHARS = 400, 2000, 8_000_000
BUCKETS, GRAMS = 1 << 13, (2, 3)
STEPS, RATE, DECAY = 80, 0.05, 1e-6
MARGIN = 0.05
EXHAUSTIVE, RANDOM_BITS = 7, 63
#: Letters, with the marks that follow them; digits, fractions, Roman numeral signs and the like are none.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
UNKNOWN = "und"


def code(k: int) -> np.ndarray:
    """k codewords as rows of +-1. Every column splits the languages into two parts that aren't empty."""
    if k <= EXHAUSTIVE:
        bits = [[1 if i == 0 else 1 - 2 * (b >> (i - 1) & 1) for i in range(k)] for b in range(1, 1 << max(0, k - 1))]
        return np.array(bits, np.float64).reshape(-1, k).T
    columns, seed = [], 0
    while len(columns) < RANDOM_BITS:
        c = [1 if xxhash.xxh64_intdigest(str(i), seed) & 1 else -1 for i in range(k)]
        seed += 1
        if abs(sum(c)) <= k // 2:
            columns.append(c)
    return np.array(columns, np.float64).T


class Buckets(dict):
    """The bucket of each n-gram met; emptied when full."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        b = self[gram] = xxhash.xxh32_intdigest(gram) % BUCKETS
        return b


BUCKET = Buckets()


def grams(word: str) -> list[int]:
    w = f"<{word}>"
    return [BUCKET[w[i : i + n]] for n in GRAMS for i in range(len(w) - n + 1)]


def tokens(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Model:
    """languages in order; codewords [k, bits]; weights [buckets, bits] and bias of the bits' classifiers; trust of each bit."""

    languages: list[str]
    codewords: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def row(self, token: str) -> np.ndarray:
        """Sums over the token's n-grams: the weights of each bit, and 1."""
        ids = [g for w in WORDS(token) for g in grams(w)]
        return np.add.reduce(self.counted.take(ids, axis=0)) if ids else 0.0

    def table(self) -> TokenTable:
        self.counted = np.append(self.weights, np.ones((len(self.weights), 1)), axis=1).astype(np.float32)
        return TokenTable(self.weights.shape[1] + 1, self.row, 250_000)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Of each language, for margins [rows, bits]."""
        return np.logaddexp(0, -margins[:, None, :] * self.codewords[None]) @ self.trust

    def predict(self, text: str | None, table: TokenTable) -> tuple[str, float, bool]:
        if not text or not self.languages:
            return UNKNOWN, 0.0, False
        total = table.look_up(tokens(text)).sum(axis=0, dtype=np.float64)
        if not total[-1]:
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses((total[:-1] / total[-1] + self.bias)[None])[0]
        order = np.argsort(loss, kind="stable")
        p = np.exp(-SHARPNESS * (loss - loss[order[0]]))
        return self.languages[order[0]], float(1 / p.sum()), bool(loss[order[1]] - loss[order[0]] < MARGIN)


#: Turns differences of mean losses into the score.
SHARPNESS = 4.0


def fit(texts: list[str], langs: list[str], steps: int = STEPS) -> Model:
    """One L2-regularised logistic classifier for each bit, all by the same full-batch Adam steps."""
    languages = sorted(set(langs))
    words = code(len(languages)) if languages else np.zeros((0, 0))
    if len(languages) < 2:
        return Model(languages, words, np.zeros((BUCKETS, words.shape[1])), np.zeros(words.shape[1]), np.zeros(words.shape[1]))
    known = lru_cache(maxsize=300_000)(lambda w: np.array([g for x in WORDS(w) for g in grams(x)], np.int32))
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        if parts := [known(w) for w in tokens(t)]:
            c = np.bincount(np.concatenate(parts), minlength=BUCKETS)
            x[i] = c / max(1, c.sum())
    known.cache_clear()
    scale = 1 / (np.sqrt((x.astype(np.float64) ** 2).mean(axis=0)) + 1e-4)
    x *= scale.astype(np.float32)
    which = np.array([languages.index(lang) for lang in langs])
    share = 1 / np.bincount(which, minlength=len(languages))[which] / len(languages)
    y = words[which]
    w, b = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    mb, vb = np.zeros_like(b), np.zeros_like(b)
    for step in range(1, steps + 1):
        f = x @ w + b
        d = -y / (1 + np.exp(np.clip(y * f, -30, 30))) * share[:, None]
        g, gb = x.T @ d.astype(np.float32) + DECAY * w, d.sum(axis=0)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= (RATE * 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-9)).astype(np.float32)
        b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    right = ((np.sign(x @ w + b) == y) * share[:, None]).sum(axis=0)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(languages, words, w * scale[:, None].astype(np.float32), b, trust / trust.sum())


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on text and lang of docs; rows to hold out are to be filtered before. Equal rows count once."""
    order = F.xxhash64("doc_id", F.col("text"))
    hashed = docs.filter("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), order.alias("h"))
    ids = sample_shares(hashed, "lang", "h", sample_rows).select("doc_id", "lang", F.length("text").alias("n"), "h").distinct()
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= sample_rows)
    chosen, left = [], SAMPLE_CHARS
    for r in ranked.orderBy("r", "lang").limit(SAMPLE_TOTAL).collect():
        if r.n <= left:
            left -= r.n
            chosen.append((r.doc_id, r.lang, r.h))
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, lang string, h bigint")
    rows = hashed.join(F.broadcast(picked), ["doc_id", "lang", "h"]).groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text"))  # at most SAMPLE_TOTAL ids
    rows = rows.orderBy("h", "doc_id", "lang").collect()
    return fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and ambiguous of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times bits numbers

    def make():
        m = shared.value
        table = m.table()

        def row(doc_id: int, text: str | None) -> Iterator[tuple]:
            yield (doc_id, *m.predict(text, table))

        return row

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), "doc_id bigint, lang_pred string, score double, ambiguous boolean", make)
