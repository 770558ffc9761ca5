"""Word vectors from hashed character n-grams, so that unseen words have one too: skip-gram with negative samples, averaged over partitions.

A word's vector is the mean of its n-grams' vectors (and that of the whole word), each found in a table of a fixed number of slots by hash. Every
epoch each partition trains a copy of the tables on its sentences, in order, and hands back the slots that it has changed; Spark averages them by slot over the partitions that
changed them. What is broadcast and collected are the tables, whose size is a parameter and doesn't grow with the corpus. Negatives are other context words of the
same batch, which follow the words' frequencies. The same rows, partitions and seed give the same tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS, SLOTS, SHORTEST, LONGEST = 16, 1 << 14, 3, 6
WINDOW, NEGATIVES, EPOCHS, RATE = 3, 5, 3, 0.5
#: Pairs of words that one step is made of; sentences whose new words are hashed side by side.
BATCH, SENTENCES = 256, 1000
MASK = (1 << 64) - 1


def _slot(text: str, slots: int) -> int:
    """FNV-1a over UTF-8, mixed once more."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & MASK
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & MASK) % slots


def grams(word: str, slots: int = SLOTS) -> list[int]:
    """Slots of the word's n-grams between marks of its ends, and of the whole word, once each."""
    marked = f"<{word}>"
    found = {marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)} | {marked}
    return sorted({_slot(g, slots) for g in found})


def grams_of(words: list[str], slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of grams of each of the words, one word's after the other, how many each has, and the slot of the word without marks; letters of all words are hashed side by side."""
    if not words:
        return (np.zeros(0, np.int64),) * 3
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer(("".join(f"<{w}>" for w in words) + "\0" * LONGEST).encode("utf-32-le"), np.uint32).astype(np.uint64)
    long = (text >= 0x80).astype(int) + (text >= 0x800) + (text >= 0x10000)  # UTF-8 bytes behind the first
    head = text >> (6 * long).astype(np.uint64) | np.array([0, 0xC0, 0xE0, 0xF0], np.uint64)[long]
    prime, basis = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)

    def stepped(h: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = (h ^ head[at]) * prime
        for k in range(3):
            more = np.flatnonzero(long[at] > k)
            if not len(more):
                break
            letters = at[more]
            h[more] = (h[more] ^ (text[letters] >> (6 * (long[letters] - k - 1)).astype(np.uint64) & np.uint64(0x3F) | np.uint64(0x80))) * prime
        return h

    def slot(h: np.ndarray) -> np.ndarray:
        return (((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)) % np.uint64(slots)).astype(np.int64)

    def whole(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = np.full(len(start), basis)
        for n in range(int(size.max())):
            at = np.flatnonzero(size > n)
            h[at] = stepped(h[at], start[at] + n)
        return slot(h)

    ends = np.cumsum(size)
    owner, place = np.repeat(np.arange(len(words)), size), np.arange(ends[-1])
    left, h, keys = ends[owner] - place, np.full(len(place), basis), []
    for n in range(1, LONGEST + 1):
        h = stepped(h, place + n - 1)
        if n >= SHORTEST:
            keys.append((owner * slots + slot(h))[left >= n])
    keys.append(np.arange(len(words)) * slots + whole(ends - size, size))
    key = np.unique(np.concatenate(keys))
    return key % slots, np.bincount(key // slots, minlength=len(words)), whole(ends - size + 1, size - 2)


@dataclass
class Subwords:
    """ngrams: slots x dims, the vectors that words are made of; contexts: slots x dims, what they predict."""

    ngrams: np.ndarray
    contexts: np.ndarray

    def vector(self, word: str) -> np.ndarray:
        return self.ngrams[grams(word, len(self.ngrams))].mean(0)

    def vectors(self, words: DataFrame, word: str = "word") -> DataFrame:
        """word, vec of each row; null for a null word."""
        table = words.sparkSession.sparkContext.broadcast(self.ngrams)  # slots x dims numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Subwords(table.value, table.value)
            for b in batches:
                found = b.column(0).to_pylist()
                flat, n, _ = grams_of([w for w in found if w is not None], len(own.ngrams))
                means = np.add.reduceat(own.ngrams[flat], np.cumsum(n) - n) / n[:, None] if len(n) else own.ngrams[:0]
                ends = np.cumsum([0, *[w is not None for w in found]]) * means.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(means.ravel()), mask=b.column(0).is_null())
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["word", "vec"])

        return words.select(F.col(word).alias("word")).mapInArrow(run, "word string, vec array<double>")


def _add_means(table: np.ndarray, at: np.ndarray, change: np.ndarray, times: np.ndarray | None = None) -> None:
    """Adds to each slot the mean of its changes, so that a frequent slot makes no larger step than others; a change may be the sum of several (times)."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    n = np.diff(starts, append=len(own)) if times is None else np.add.reduceat(times[order], starts)
    table[own[starts]] += np.add.reduceat(change[order], starts) / n[:, None]


def _train(sentences: Iterator[list[str]], model: Subwords, window: int, negatives: int, rate: float, seed: int) -> None:
    """One pass in place."""
    slots, rng = len(model.ngrams), np.random.default_rng(seed)
    known: dict[str, tuple[np.ndarray, int]] = {}
    centre: list[np.ndarray] = []  # a word and how many of its pairs follow each other: its n-grams are looked up once for them
    times: list[int] = []
    other: list[int] = []

    def step() -> None:
        sizes = np.fromiter(map(len, centre), np.int64, len(centre))
        owner, flat, pairs = np.repeat(np.arange(len(centre)), sizes), np.concatenate(centre), np.array(times)
        h = np.repeat(np.add.reduceat(model.ngrams[flat], np.cumsum(sizes) - sizes) / sizes[:, None], pairs, 0)  # each word has a slot
        right = np.array(other)
        wrong = right[rng.integers(0, len(right), (len(right), negatives))]
        target = np.concatenate([right[:, None], wrong], 1)
        label = np.zeros(target.shape)
        label[:, 0] = 1
        out = model.contexts[target]
        error = (label - 1 / (1 + np.exp(-np.clip((out * h[:, None]).sum(2), -30, 30)))) * rate
        error[:, 1:][wrong == right[:, None]] = 0  # a negative that is the word itself
        back = (error[..., None] * out).sum(1)
        _add_means(model.contexts, target.ravel(), (error[..., None] * h[:, None]).reshape(target.size, -1))
        _add_means(model.ngrams, flat, np.add.reduceat(back, np.cumsum(pairs) - pairs)[owner], pairs[owner])
        centre.clear()
        times.clear()
        other.clear()

    def looked_up() -> Iterator[list[tuple[np.ndarray, int]]]:
        while some := list(islice(sentences, SENTENCES)):
            if len(known) > 50_000:
                known.clear()
            new = list({w for words in some for w in words if w not in known})
            flat, n, context = grams_of(new, slots)
            known.update(zip(new, zip(np.split(flat, np.cumsum(n)[:-1]), context.tolist(), strict=False), strict=False))
            for words in some:
                yield [known[w] for w in words]

    for own in looked_up():
        for i, (g, _) in enumerate(own):
            new = True
            for j in range(max(0, i - window), min(len(own), i + window + 1)):
                if j != i:
                    if new:
                        centre.append(g)
                        times.append(0)
                        new = False
                    times[-1] += 1
                    other.append(own[j][1])
                    if len(other) == BATCH:
                        step()
                        new = True
    if other:
        step()


def train(sentences: DataFrame, dims: int = DIMS, slots: int = SLOTS, epochs: int = EPOCHS, window: int = WINDOW, negatives: int = NEGATIVES, rate: float = RATE, seed: int = 0, partitions: int | None = None) -> Subwords:
    """Tables trained on sentences (key, words: array of strings); the key deals them out and puts them in order. Null sentences and words count as none."""
    spark = sentences.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sentences.select("key", F.filter("words", lambda w: w.isNotNull()).alias("words")).filter(F.size("words") > 1).repartition(n, "key").sortWithinPartitions("key", "words")
    rng = np.random.default_rng(seed)
    model = Subwords(rng.uniform(-0.5, 0.5, (slots, dims)) / dims, np.zeros((slots, dims)))
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((model.ngrams, model.contexts))  # twice slots x dims numbers
        pace = rate * (1 - epoch / epochs)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, pace=pace, epoch=epoch) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own = Subwords(*(t.copy() for t in shared.value))
            part = TaskContext.get().partitionId()
            _train((s for b in batches for s in b.column("words").to_pylist()), own, window, negatives, pace, seed + 7919 * epoch + part)
            for kind, (new, old) in enumerate(zip((own.ngrams, own.contexts), shared.value, strict=True)):
                at = np.flatnonzero((new != old).any(1))
                if len(at):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * dims, pa.int32()), pa.array(new[at].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), lists], names=["kind", "slot", "v"])

        changed = rows.select("words").mapInArrow(run, "kind int, slot int, v array<double>")
        means = changed.groupBy("kind", "slot").agg(*[F.avg(F.col("v")[i]).alias(f"v{i}") for i in range(dims)]).toPandas()  # at most twice slots rows
        model = Subwords(shared.value[0].copy(), shared.value[1].copy())
        for kind, table in enumerate((model.ngrams, model.contexts)):
            own = means[means["kind"] == kind]
            table[own["slot"].to_numpy()] = own[[f"v{i}" for i in range(dims)]].to_numpy()
    return model
