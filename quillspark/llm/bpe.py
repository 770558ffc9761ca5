"""Byte-level BPE encoding and decoding with two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace) finds the slot of a whole pre-token in
two array reads and one comparison of bytes; most pre-tokens of a text end here. Tier two: a pre-token that is no
vocabulary entry is merged by a heap of (rank, place) over a doubly linked list of its bytes, so that a pre-token
of n bytes costs O(n log n), however long it is. What either tier finds for a pre-token is remembered in a table
of bounded size, which is emptied when full.

The vocabulary (ranks by token bytes) has a fixed size that doesn't depend on the data; it is sent to the workers
as a broadcast variable. The vocabulary file is a parameter and read on the driver only.

Defined cases: null and empty texts have no ids and decode to no bytes; text without any vocabulary entry still
encodes, as every byte is a token; equal texts have equal ids; other columns are ignored or, if asked for, carried;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MASK = (1 << 64) - 1
#: The pre-tokenizer pattern of the vocabularies in use (fixed value); only for it is it known where chunks may be cut.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNEVEN, LONE_SPACE = re.compile(r"^ | $| \s|\s ").search, re.compile(r"(?<=\S) (?=\S)").split
#: Remembered pre-tokens in each Python worker, and the longest that is remembered.
MEMO_ENTRIES, MEMO_LENGTH = 500_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def _mixed(h: int, d: int) -> int:
    h = (h ^ (d * 0x9E3779B97F4A7C15)) & MASK
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & MASK
    return h ^ (h >> 32)


class PerfectHash:
    """Minimal perfect hash of byte strings to slots 0..n-1, with the keys kept to verify a hit.

    Keys fall into n/4 buckets. A bucket of several keys, largest first, tries displacements until its keys land
    in free slots; a bucket of one key stores its slot itself, as -slot-1.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.shift = [0] * max(1, n // 4)
        self.keys: list[bytes] = [b""] * n
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for k in keys:
            h = xxhash.xxh64_intdigest(k)
            buckets.setdefault(h % len(self.shift), []).append((h, k))
        free = np.ones(n, bool)
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                break
            found, base, span = 0, 1, 16
            while not found:
                with np.errstate(over="ignore"):
                    d = np.arange(base, base + span, dtype=np.uint64)
                    h = np.array([[m[0]] for m in members], np.uint64) ^ (d * np.uint64(0x9E3779B97F4A7C15))
                    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    slots = ((h ^ (h >> np.uint64(32))) % np.uint64(n)).astype(np.int64)
                good = free[slots].all(axis=0)
                ordered = np.sort(slots, axis=0)
                good &= (ordered[1:] != ordered[:-1]).all(axis=0)
                if good.any():
                    found = int(d[np.argmax(good)])
                base, span = base + span, min(4096, 2 * span)
            self.shift[b] = found
            for h1, k in members:
                slot = _mixed(h1, found) % n
                free[slot] = False
                self.keys[slot] = k
        rest = iter(np.flatnonzero(free).tolist())
        for b, members in buckets.items():
            if len(members) == 1:
                slot = next(rest)
                self.shift[b] = -slot - 1
                self.keys[slot] = members[0][1]

    def slot(self, key: bytes) -> int:
        """The slot of key, or -1 if it is none of the keys."""
        if not self.keys:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % len(self.shift)]
        slot = -d - 1 if d < 0 else _mixed(h, d) % len(self.keys)
        return slot if self.keys[slot] == key else -1


class Codec(dict):
    """Ids by pre-token; a missing pre-token is looked up or merged, then remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes, such as {missing[0]}")
        self.hash = PerfectHash(list(ranks))
        self.ids = [ranks[k] for k in self.hash.keys]
        self.pattern = pattern
        self.ranks = ranks
        self.tokens = {r: k for k, r in ranks.items()}

    def __reduce__(self):
        return _codec, (self.ranks, self.pattern, self.hash)

    def ready(self) -> Codec:
        """Opens the codec in a worker; what it remembers outlives a task, as workers and their broadcast values do."""
        if hasattr(self, "find"):
            return self
        self.find = regex.compile(self.pattern).findall
        self.cuts = self.pattern == GPT_PATTERN
        self.pieces: dict[str, bytes] = {}
        return self

    def __missing__(self, chunk: str) -> bytes:
        """Ids of a chunk between two places where the pre-tokenizer always cuts, as 32-bit numbers one behind the other: texts join them without touching each id."""
        known, out = self.pieces, b""
        for piece in self.find(chunk):
            if (ids := known.get(piece) or self.get(piece)) is None:
                ids = np.array(self.piece(piece), np.int32).tobytes()
                if len(piece) <= MEMO_LENGTH and piece != chunk:  # a chunk of one piece is remembered below, once
                    if len(known) >= MEMO_ENTRIES:
                        known.clear()
                    known[piece] = ids
            out = out + ids if out else ids
        if len(chunk) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[chunk] = out
        return out

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        slot = self.hash.slot(data)
        return (self.ids[slot],) if slot >= 0 else tuple(self.merged(data))

    def merged(self, data: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, leftmost first, until no pair is a token."""
        n, get, push, pop = len(data), self.ranks.get, heapq.heappush, heapq.heappop
        wide = n.bit_length() + 1
        low = (1 << wide) - 1  # a heap entry is rank, start and stop of a pair in one integer
        end = list(range(1, n + 2))  # where the part that starts here stops, which is where the next starts; 0: merged into another
        before = list(range(-1, n))
        heap = [(r << wide | i) << wide | i + 2 for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            stop, i = entry & low, entry >> wide & low
            j = end[i]
            if not j or j >= n or end[j] != stop:  # one of the two has been merged meanwhile
                continue
            end[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := get(data[i : (e := end[stop])])) is not None:
                    push(heap, (r << wide | i) << wide | e)
            if (p := before[i]) >= 0 and (r := get(data[p:stop])) is not None:
                push(heap, (r << wide | p) << wide | stop)
        out, i = [], 0
        while i < n:
            out.append(get(data[i : end[i]]))
            i = end[i]
        return out

    def packed(self, text: str | None) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(b"".join(map(self.__getitem__, self.chunks(text))), np.int32) if text else np.zeros(0, np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.packed(text).tolist()

    def chunks(self, text: str) -> list[str]:
        """text cut before each lone space between two other characters.

        The pattern has no look-behind, looks ahead in white space only, and lets a space only begin a match that
        goes on with other characters, so each of these places is between two of its matches.
        """
        if not self.cuts:
            return [text]
        first, *rest = LONE_SPACE(text) if UNEVEN(text) else text.split(" ")
        return [first, *[" " + x for x in rest]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(ranks: dict[bytes, int], pattern: str, found: PerfectHash) -> Codec:
    codec = Codec.__new__(Codec)
    codec.hash, codec.pattern, codec.ranks = found, pattern, ranks
    codec.ids, codec.tokens = [ranks[k] for k in found.keys], {r: k for k, r in ranks.items()}
    return codec


def _each(shared: object, use: Callable[[Codec], Callable]) -> Callable[[], Callable]:
    return lambda: use(shared.value.ready())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns keep, and ids array<int>, of each row's whole text; with decoded also the bytes that these ids stand for, decoded where they are encoded."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(ranks, pattern))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def use(codec: Codec) -> Callable:
        def both(*row: object) -> list[tuple]:
            ids = codec.packed(row[-1])
            return [(*row[:-1], ids, codec.decode(ids.tolist()))]

        return both if decoded else lambda *row: [(*row[:-1], codec.packed(row[-1]))]

    schema = f"{kept}, ids array<int>" + ", decoded binary" * decoded
    size = (lambda row: 64 + 4 * len(row[-2]) + len(row[-1])) if decoded else lambda row: 64 + 4 * len(row[-1])
    return map_batches(docs.select(*keep, F.col("text").cast("string")), schema, _each(shared, use), size)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded (whose last column is ids), and decoded binary, the bytes of the ids. Needs the tokens alone, no hash."""
    shared = encoded.sparkSession.sparkContext.broadcast({r: k for k, r in ranks.items()})  # the vocabulary
    kept = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)

    def make() -> Callable:
        token = shared.value.__getitem__
        return lambda *row: [(*row, b"".join(map(token, row[-1].tolist())))]

    return map_batches(encoded, f"{kept}, decoded binary", make, lambda row: 64 + 4 * len(row[-2]) + len(row[-1]))
