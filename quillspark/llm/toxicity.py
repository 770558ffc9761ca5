"""Toxicity by multiple-instance learning: documents are bags of sentences, joined by noisy-or.

A sentence with log-odds z is toxic with probability sigmoid(z), a document unless none of its sentences is:
P = 1 - prod(1 - sigmoid(z)) = 1 - exp(-sum(softplus(z))). Only documents are labelled; the loss of P against
the label is passed down to the sentences, so that training finds which of them are to blame, and the trained
sentence scores locate offending sentences later. z is a bias plus the weights of the words' features: the word
itself and its character 4- and 5-grams with word ends, so that unseen forms of known stems count too.

The fit runs on the driver, over a bounded sample of labelled documents: at most SAMPLE_ROWS of each class in
hash order of their ids, and at most SAMPLE_CHARS characters. Classes are weighted back to their true share, which
is counted over all labels. Features are those met in at least MIN_DOCS toxic documents, and MIN_SHARE of them, and relatively more
often than in others, at most MAX_FEATURES by strength of association. Every document is scored, whole.

Defined cases: null, empty and blank texts have no sentence and score 0, predicted 0; equal texts score the same;
null labels are no labels, and a document labelled twice counts as toxic if any label says so; without labels of both
classes all scores are the share of toxic labels (0 without labels); an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .common import SLICE_ROWS, TokenTable, hash_sample, map_batches

SAMPLE_ROWS, SAMPLE_CHARS = 1500, 12_000_000
MIN_DOCS, MIN_SHARE, MAX_FEATURES, GRAMS = 3, 0.002, 40_000, (4, 5)
STEPS, RATE, DECAY = 80, 0.15, 2e-5
WORDS, LONGEST = re.compile(r"[^\W\d_]+").findall, 40
#: A sentence ends behind a token that ends in one of these, perhaps followed by closing marks, and at the end of a line.
ENDS = re.compile(r"[.!?…。！？][\"'»”’)\]]*$").search
TOKENS = re.compile(r"\S+|\n").finditer
LINE_END = "\n"


def features(word: str) -> set[str]:
    """The word and its character n-grams, all with word ends; of over-long words, the n-grams only."""
    w = f"<{word}>"
    out = {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)}
    if len(word) <= LONGEST:
        out.add(w)
    return out


def tokens(text: str) -> list[str]:
    """Words with their punctuation, and line ends."""
    return text.replace("\n", " \0 ").split()


@dataclass
class Model:
    """Weights of features, and the bias of every sentence; prior is set alone if there was nothing to learn."""

    weights: dict[str, float]
    bias: float
    prior: float | None = None

    def row(self, token: str) -> tuple[float, float]:
        """Weight of a token, and whether a sentence ends behind it."""
        known, total = self.weights, 0.0
        for word in WORDS(token.lower()):
            w = f"<{word}>"
            hits = [g for n in GRAMS for i in range(len(w) - n + 1) if (g := w[i : i + n]) in known]
            if w in known and len(word) <= LONGEST:
                hits.append(w)
            if hits:
                total += sum(known[f] for f in sorted(set(hits)))  # in order, so that sums agree everywhere
        return total, float(token == "\0" or bool(ENDS(token)))

    def table(self) -> TokenTable:
        return TokenTable(2, self.row)

    def sentences(self, text: str, table: TokenTable) -> np.ndarray:
        """Log-odds of each sentence."""
        if text.isspace() or not (found := tokens(text)):
            return np.zeros(0)
        rows = table.look_up(found)
        starts = np.flatnonzero(np.concatenate([[True], rows[:-1, 1] > 0]))
        return np.add.reduceat(rows[:, 0].astype(np.float64), starts) + self.bias

    def score(self, text: str | None, table: TokenTable) -> float:
        if self.prior is not None:
            return self.prior
        return float(-np.expm1(-np.logaddexp(0, self.sentences(text or "", table)).sum()))

    def located(self, text: str, table: TokenTable, least: float = 0.5) -> list[dict]:
        """start, end (in characters) and probability of each sentence that is toxic with at least that probability."""
        spans, first, last = [], None, 0
        for m in TOKENS(text.replace("\0", " ")):
            if first is None:
                first = m.start()
            last = m.end()
            if m[0] == LINE_END or ENDS(m[0]):
                spans.append((first, last))
                first = None
        if first is not None:
            spans.append((first, last))
        out = []
        for a, b in spans:
            z = self.sentences(text[a:b].replace("\n", " "), table)
            p = float(-np.expm1(-np.logaddexp(0, z).sum()))
            if p >= least:
                out.append({"start": a, "end": b, "p": p})
        return out


def fit(texts: list[str], toxic: list[int], weight: list[float], steps: int = STEPS) -> Model:
    """Full-batch Adam on the noisy-or log loss, from document labels alone."""
    y, share = np.asarray(toxic, bool), np.asarray(weight, float)
    share = share / share.sum()
    of_word: dict[str, list[str]] = {}
    in_toxic: Counter[str] = Counter()
    in_other: Counter[str] = Counter()
    for t, bad in zip(texts, y, strict=True):
        seen: set[str] = set()
        for w in set(WORDS(t.lower())):
            if w not in of_word:
                of_word[w] = sorted(features(w))
            seen.update(of_word[w])
        (in_toxic if bad else in_other).update(seen)
    n1, n0 = max(1, int(y.sum())), max(1, int((~y).sum()))
    least = max(MIN_DOCS, MIN_SHARE * n1)
    strength = {f: np.log((c + 0.5) / (n1 + 1) / ((in_other[f] + 0.5) / (n0 + 1))) for f, c in in_toxic.items() if c >= least}
    strength = {f: s * np.sqrt(in_toxic[f]) for f, s in strength.items() if s > 1.0}
    names = sorted(strength, key=lambda f: (-strength[f], f))[:MAX_FEATURES]
    at = {f: i for i, f in enumerate(names)}
    word_at: dict[str, int] = {}
    word_features: list[int] = []
    word_of_feature: list[int] = []
    token_word: list[int] = []
    token_sentence: list[int] = []
    sentence_doc: list[int] = []
    chosen = {w: ids for w, fs in of_word.items() if (ids := [at[f] for f in fs if f in at])}
    for w, ids in chosen.items():
        word_features += ids
        word_of_feature += [len(word_at)] * len(ids)
        word_at[w] = len(word_at)
    for d, t in enumerate(texts):
        open_ = False
        for token in tokens(t):
            if not open_:
                sentence_doc.append(d)
                open_ = True
            for w in WORDS(token.lower()):
                if w in word_at:
                    token_word.append(word_at[w])
                    token_sentence.append(len(sentence_doc) - 1)
            if token == "\0" or ENDS(token):
                open_ = False
    wf, wo, tw, ts, sd = (np.asarray(x, np.int64) for x in (word_features, word_of_feature, token_word, token_sentence, sentence_doc))
    theta, bias = np.zeros(len(names)), -6.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        of_words = np.bincount(wo, theta[wf], len(word_at))
        z = np.clip(np.bincount(ts, of_words[tw], len(sd)) + bias, -60, 60)
        total = np.bincount(sd, np.logaddexp(0, z), len(texts))
        slope = np.where(y, -1 / np.expm1(np.clip(total, 1e-9, 60)), 1.0) * share
        dz = slope[sd] / (1 + np.exp(-z))
        dw = np.bincount(tw, dz[ts], len(word_at))
        g = np.append(np.bincount(wf, dw[wo], len(names)) + DECAY * theta, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        theta, bias = theta - move[:-1], bias - move[-1]
    return Model({f: float(theta[i]) for f, i in at.items() if abs(theta[i]) > 1e-6}, float(bias))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fits on labels(doc_id, toxic) and the texts of docs. Rows to hold out are to be filtered from labels before."""
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Model({}, 0.0, float(bool(counts.get(1))))
    order = F.xxhash64("doc_id")
    chosen = spark.createDataFrame([tuple(r) for c in (0, 1) for r in hash_sample(known.filter(F.col("toxic") == c), F.col("doc_id"), sample_rows, counts[c]).orderBy(order, "doc_id").limit(sample_rows).collect()], "doc_id bigint, toxic int")
    # equal rows count once, and of the texts of one id the least hash, so that a row repeated very often stays one
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # at most twice sample_rows ids
    rows = stored(rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxicity-sample")
    sizes = rows.select("doc_id", F.length("text").alias("n"), order.alias("h")).orderBy("h", "doc_id").collect()
    left, ids = sample_chars, []
    for r in sizes:
        if (r.n or 0) <= left:
            left -= r.n or 0
            ids.append(r.doc_id)
    took = [(r.text or "", r.toxic) for r in rows.filter(F.col("doc_id").isin(ids)).orderBy(order, "doc_id").collect()]
    n = Counter(y for _, y in took)
    if not n[0] or not n[1]:
        return Model({}, 0.0, counts[1] / (counts[0] + counts[1]))
    return fit([t for t, _ in took], [y for _, y in took], [counts[y] / n[y] for _, y in took])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and sentences: where the sentences are for which a document of score 0.5 or more is to blame."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def make():
        m = shared.value
        table = m.table()

        def row(doc_id: int, text: str | None) -> Iterator[tuple]:
            s = m.score(text, table)
            yield doc_id, s, m.located(text, table) if text and s >= 0.5 and m.prior is None else []

        return row

    return map_batches(docs.select("doc_id", F.col("text").cast("string")), "doc_id bigint, score double, sentences array<struct<start: bigint, end: bigint, p: double>>", make)


def filtered(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below threshold, columns unchanged; one pass, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.table()
        for b in (part.slice(i, SLICE_ROWS) for part in batches for i in range(0, part.num_rows, SLICE_ROWS)):
            yield b.filter(pa.array([m.score(t, table) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
