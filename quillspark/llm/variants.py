"""Spelling variants of a corpus' words by wildcard groups, without pairs.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Every word of the vocabulary goes to one
group for each of its positions, named by position, prefix and suffix: the words of such a group differ from each other in that one code point. A group
keeps its size and its two best words (most occurrences, ties to the smaller word), so each member learns how many near words it has there, and the
best that isn't itself. For inserted and deleted code points each word goes to one group for each different string that is left when one code point is
deleted, and to the group of its own string: there the deletions meet the vocabulary. The word whose string it is learns how many
longer words the group has and the best of them; the longer words learn of that word. Every near pair meets in exactly one group, so counts add up.

Groups are 128-bit hashes, made from running hashes of prefix and suffix, so a word of n letters takes n steps, not n^2, however long it is. Words are numbered in order of preference
by a range sort, and groups hold these numbers, not words. A wildcard group has at most as many words as there are letters (90), a
deletion group at most that times the length, so no group is hot. Runs are counted where they are read, in tables of bounded size, before Spark sums them.

A word's form is its near word of most occurrences, if those are RATIO times its own; root follows forms to the last. As counts grow RATIO-fold with each
step there are few steps, and the pointers are doubled until they cover the longest chain that the largest count allows.

Defined cases: null and empty texts have no words; rows of equal ids count like others; a null id stands as the empty string in what is hashed; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Letters of a run, as Latin-1: A-Z in lower case, a-z, U+00C0 to U+00FF; all others separate.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
DELETE_EACH = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Characters of a text, and different words of a task, at a time.
CHUNK, TABLE = 1 << 20, 200_000
#: Primes of the running hashes, and their bases.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
BASES = np.array([1000003, 1500450271, 961748941, 472882027], np.uint64)
#: Letters of words of one length whose keys are made at a time.
LETTERS_AT_A_TIME = 50_000
#: Kinds of keys: a word with a wildcard, with a code point deleted, as it is.
WILDCARD, DELETED, WHOLE = 0, 1, 2


def _is_letter(c: str) -> bool:
    return c < "\u0100" and LETTERS[ord(c)] != 32


def runs(text: str | None, least: int = LEAST_LENGTH) -> Iterator[bytes]:
    """Maximal runs of letters in Latin-1, lower-cased, of at least so many code points; a text is read chunk by chunk."""
    at, text = 0, text or ""
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and _is_letter(text[end]):  # a run isn't cut
            end += 1
        for run in text[at:end].encode("latin-1", "replace").translate(LETTERS).split():
            if len(run) >= least:
                yield run
        at = end


def damaged(doc_id: int | None, run: bytes, seed: int, each: int = DELETE_EACH) -> bytes:
    """The run, less one code point if the hash of id and run says so; seed is the crc32 of the id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode("utf-8"), seed)
    if h % each:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, times: int = LEAST_COUNT, each: int = DELETE_EACH) -> DataFrame:
    """word, n: damaged runs of at least least code points that occur times times overall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def batch() -> Iterator[pa.RecordBatch]:
            words, counts = [w.decode("latin-1") for w in seen], list(seen.values())
            seen.clear()
            for a in range(0, len(words), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 10_000], pa.string()), pa.array(counts[a : a + 10_000], pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for w, n in Counter(runs(text, least)).items():
                    w = damaged(doc_id, w, seed, each)
                    if len(w) >= least:
                        seen[w] += n
                if len(seen) > TABLE:
                    yield from batch()
        yield from batch()

    counted = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _powers(n: int) -> np.ndarray:
    """primes x n: powers of the bases, by doubling."""
    out = np.ones((len(PRIMES), 1), np.uint64)
    step = BASES[:, None].copy()
    while out.shape[1] < n:
        out = np.concatenate([out, out * step % PRIMES[:, None]], 1)
        step = step * step % PRIMES[:, None]
    return out[:, :n]


_POWERS = _powers(64)


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length: which word (index), kind, k1, k2 of their groups: one for each position, one for each different deletion, their own."""
    n, p = len(words[0]), PRIMES[:, None, None]
    x = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
    power = (_POWERS[:, : n + 1] if n < _POWERS.shape[1] else _powers(n + 1))[:, None, :]
    # sums of x[j] * base^j up to each place, and of x[j] * base^(j-1): what follows a deleted place moves down by one
    here = np.zeros((len(PRIMES), len(words), n + 1), np.uint64)
    moved = np.zeros_like(here)
    here[..., 1:] = np.cumsum(x * power[..., :n] % p, -1)
    moved[..., 2:] = np.cumsum(x[:, 1:] * power[..., : n - 1] % p, -1)
    wild = (here[..., :-1] + here[..., -1:] - here[..., 1:]) % p
    less = (here[..., :-1] + moved[..., -1:] - moved[..., 1:]) % p
    keep = np.ones((len(words), n), bool)  # deleting any letter of a run of equal ones leaves the same
    keep[:, :-1] = x[:, 1:] != x[:, :-1]
    at, place = np.nonzero(keep)
    every = np.arange(len(words))
    sums = np.concatenate([wild.reshape(len(PRIMES), -1), less[:, at, place], here[..., -1] % PRIMES[:, None]], 1)
    word = np.concatenate([np.repeat(every, n), at, every])
    kind = np.repeat(np.array([WILDCARD, DELETED, WHOLE], np.int8), [len(words) * n, len(at), len(words)])
    # the length tells strings of different lengths apart, kind and position the wildcards
    tag = np.concatenate([np.tile(2 * np.arange(n) + 1, len(words)), np.zeros(len(at) + len(words), np.int64)]).astype(np.uint64)
    length = (n - (kind == DELETED)).astype(np.uint64)
    shift = np.uint64(31)
    k1 = ((sums[0] << shift | sums[1]) + tag * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    k2 = ((sums[2] << shift | sums[3]) + length * np.uint64(0xD6E8FEB86659FD93) + (tag << np.uint64(1))).view(np.int64)
    return word, kind, k1, k2


def group_keys(words: DataFrame) -> DataFrame:
    """k1, k2, kind, rank: the groups of each of words (word, rank)."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("kind", pa.int8()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, rank = b.column("word").to_pylist(), b.column("rank").to_numpy()
            by: dict[int, list[int]] = {}
            for i, w in enumerate(word):
                by.setdefault(len(w), []).append(i)
            for n, own in by.items():
                step = max(1, LETTERS_AT_A_TIME // n)
                for a in range(0, len(own), step):
                    part = own[a : a + step]
                    index, kind, k1, k2 = keys([word[i] for i in part])
                    ranks = rank[part][index]
                    for c in range(0, len(index), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(v[c : c + 50_000]) for v in (k1, k2, kind, ranks)], schema=schema)

    dealt = words.select("word", "rank").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # words are few beside their keys
    return dealt.mapInArrow(run, "k1 bigint, k2 bigint, kind tinyint, rank bigint")


def near_counts(words: DataFrame) -> DataFrame:
    """rank, n_near, best (the least rank of its near words) of those of words (word, rank) that have near words."""
    from pyspark.sql import Window

    group = Window.partitionBy("k1", "k2")
    ordered = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda kind, agg: agg(F.when(F.col("kind") == kind, F.col("rank"))).over(ordered)
    second = F.nth_value(F.when(F.col("kind") == WILDCARD, F.col("rank")), 2).over(ordered)
    dealt = group_keys(words).withColumns({"size": of(WILDCARD, F.count), "top": of(WILDCARD, F.min), "second": second, "longer": of(DELETED, F.count), "longest": of(DELETED, F.min), "own": of(WHOLE, F.min)})
    wild = F.col("kind") == WILDCARD
    gone = F.col("kind") == DELETED
    n = F.when(wild, F.col("size") - 1).when(gone, F.col("own").isNotNull().cast("bigint")).otherwise(F.col("longer"))
    best = F.when(wild, F.when(F.col("top") != F.col("rank"), F.col("top")).otherwise(F.col("second"))).when(gone, F.col("own")).otherwise(F.col("longest"))
    return dealt.select("rank", n.alias("n"), best.alias("best")).filter("n > 0").groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def ranked(words: DataFrame) -> DataFrame:
    """word, n, rank: numbers that ascend from the word of most occurrences on, ties by code point."""
    return stored(words.orderBy(F.col("n").desc(), "word").withColumn("rank", F.monotonically_increasing_id()), "variants-words")


def variant_forms(docs: DataFrame, ratio: int = RATIO, **options: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary."""
    words = ranked(vocabulary(docs, **options))
    near = near_counts(words)
    known = words.select(F.col("rank").alias("best"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    found = words.join(near, "rank").join(known, "best", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    found = stored(found.select("rank", "n_near", F.when(formed, F.col("best")).alias("form_rank"), F.when(formed, F.col("near_word")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")), "variants-near")

    to = found.filter("form_rank is not null").select("rank", F.col("form_rank").alias("root_rank"))
    most, covered, longest = words.agg(F.max("n")).first()[0] or 0, 1, 1
    while most >= ratio ** (longest + 1):  # so many forms may follow one another
        longest += 1
    while covered < longest:
        step = to.toDF("root_rank", "next")
        to = stored(to.join(step, "root_rank", "left").select("rank", F.coalesce("next", "root_rank").alias("root_rank")), "variants-roots")
        covered *= 2
    roots = to.join(words.select(F.col("rank").alias("root_rank"), F.col("word").alias("root")), "root_rank").select("rank", "root")
    out = words.join(found, "rank", "left").join(roots, "rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
