"""HyperMinHash links, vector codes and spelling variants against brute force over small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import hyperminhash, lloyd, variants
from quillspark.sources.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- op11


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset(" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_corpus(spark, sf):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    base = [f"w{i}" for i in range(150)]
    for i in range(150):  # many straddle the threshold
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"q{rng.randrange(1000)}"
        rows.append((7000 + i, " ".join(words)))
    rows += [(8000, "a b c d e f g"), (8001, "a b c d e f g h"), (8002, "one two"), (8003, "One\tTWO"), (8004, "two one"), (8005, None), (8006, ""), (8007, " \n\f"), (8008, "É b c d"), (8009, "é b c d")]
    rows += [(8010, " ".join(f"s{i % 7}" for i in range(500))), (8011, " ".join(f"s{i % 7}" for i in range(400))), (None, "One two"), (None, " ".join(base)), (None, None), (8012, "one  two"), (8012, "something else is here now")]
    # a chain through a row without id
    rows += [(8020, " ".join(f"c{i}" for i in range(100))), (None, " ".join(f"c{i}" for i in range(9, 109))), (8021, " ".join(f"c{i}" for i in range(18, 118)))]
    return rows + [(8030, "x y z u v")] * 40


@pytest.mark.parametrize("tile", [hyperminhash.TILE_ROWS, 16])
def test_components_of_shingle_sets(spark, sf, tile, monkeypatch):
    monkeypatch.setattr(hyperminhash, "TILE_ROWS", tile)
    rows = near_corpus(spark, sf)
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id bigint, text string, component_id string, node int, bands int")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in hyperminhash.near_duplicates(docs).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(components(rows), key=key)
    assert len({c for d, _, c in got if d and 7000 <= d < 7150}) > 1  # the group isn't one component
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in hyperminhash.near_duplicates(docs).collect())


def test_no_documents_and_long_documents(spark):
    assert hyperminhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert sorted(hyperminhash.near_duplicates(spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    long = " ".join(map(str, range(300_000)))
    got = hyperminhash.near_duplicates(spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 1_000_000)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 299_997, 1, True), (2, 299_998, 1, False), (3, 1, 3, True)]


def test_registers_and_estimates():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    got = hyperminhash.registers(h)
    for b in range(hyperminhash.BUCKETS):
        own = [int(x) & (1 << 57) - 1 for x in h if int(x) >> 57 == b]
        want = 0
        if own:
            bits = f"{min(own):057b}"
            zeros = len(bits) - len(bits.lstrip("0"))
            want = (zeros + 1) << 10 | int(bits[zeros + 1 :].ljust(10, "0")[:10], 2)
        assert got[b] == want
    assert not hyperminhash.registers(h[:0]).any() and hyperminhash.registers(np.zeros(1, np.uint64))[0] == 63 << 10
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(40):
            x = rng.integers(0, 2**64, 2000, dtype=np.uint64)
            k = int(2000 * share)  # of 2,000 in the union, k in both
            rest = (2000 - k) // 2
            a, b = (hyperminhash.registers(np.unique(s)) for s in (x[: k + rest], np.concatenate([x[:k], x[k + rest :]])))
            j = hyperminhash.estimate(((a == b) & (a > 0)).sum(), ((a | b) > 0).sum(), k + rest, 2000 - rest)
            errors.append(float(j) - share)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    # chance collisions of disjoint sets: as many as expected
    n, hits = 300, 0
    for _ in range(3000):
        a, b = (hyperminhash.registers(np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))) for _ in range(2))
        hits += ((a == b) & (a > 0)).sum()
    expected = float(hyperminhash.expected_collisions(n, n))
    assert abs(hits / 3000 - expected) < 6 * np.sqrt(expected / 3000)


# ---- op12


def plain_codes(rows, rounds=4, entries=256):
    kept = sorted(((i, k, [int(np.floor(1024 * x)) for x in v]) for i, k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    x = np.array([r[2] for r in kept], dtype=object)
    width = x.shape[1] // 4
    parts = [x[:, p * width : (p + 1) * width] for p in range(4)]
    books = [p[:entries].copy() for p in parts]
    nearest = lambda p, book: [min(range(len(book)), key=lambda e: (sum((p[i] - book[e]) ** 2), e)) for i in range(len(p))]
    for _ in range(rounds):
        for p in range(4):
            to = nearest(parts[p], books[p])
            for e in set(to):
                mine = [i for i, t in enumerate(to) if t == e]
                books[p][e] = sum(parts[p][i] for i in mine) // len(mine)
    codes = [nearest(parts[p], books[p]) for p in range(4)]
    error = [int(sum(sum((parts[p][i] - books[p][codes[p][i]]) ** 2) for p in range(4))) for i in range(len(kept))]
    label = Counter()
    for (_, k, _), e in zip(kept, error, strict=True):
        label[k] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(r[0], "".join(f"{codes[p][i]:02x}" for p in range(4)), error[i], label[r[1]], digest) for i, r in enumerate(kept)]


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), rng.normal(size=8).tolist()) for i in rng.permutation(n)]
    rows += [(5, 1, rng.normal(size=8).tolist()), (6, 1, [0.5] * 8), (6, 1, [0.5] * 8), (None, None, [0.25] * 8)]
    return rows, rows + [(1000, 1, None), (1001, 1, [None] + [1.0] * 7), (1002, 1, [float("nan")] * 8), (1003, 1, [float("inf")] * 8), (1004, 2, []), (1005, 2, [1.0, 2.0]), (1006, 2, [1.0] * 6), (1007, 2, [1e9] * 8)]


@pytest.mark.parametrize("entries", [20, 256])
def test_codes_equal_a_full_recount(spark, entries):
    plain, rows = vectors(1, 120)
    df = spark.createDataFrame([(i, k, v, "clash", 1) for i, k, v in rows], "vec_id bigint, label int, embedding array<double>, code string, error int")
    got = sorted((tuple(r) for r in lloyd.compress(df, entries=entries).collect()), key=str)
    assert got == sorted(plain_codes(plain, entries=entries), key=str)


def test_codes_of_no_vectors_and_of_wide_ones(spark):
    schema = "vec_id bigint, label int, embedding array<double>"
    assert lloyd.compress(spark.createDataFrame([], schema)).count() == 0
    assert lloyd.compress(spark.createDataFrame([(1, 1, None), (2, 1, [])], schema)).count() == 0
    rng = np.random.default_rng(2)
    rows = [(i, 0, (rng.normal(size=4) * 20_000).tolist()) for i in range(40)]  # too large for doubles to be exact
    got = sorted(tuple(r) for r in lloyd.compress(spark.createDataFrame(rows, schema), entries=8).collect())
    assert got == sorted(plain_codes(rows, entries=8))


def test_a_fit_goes_on_where_it_was_saved(spark):
    _, rows = vectors(4, 100)
    df = lloyd.whole(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"))
    fit = lloyd.DeltaLloyd.start(df, entries=12)
    for _ in range(2):
        fit.assign()
        fit.move()
    folder = fit.save()
    fit.discard()  # as another session, which doesn't know the tables
    again = lloyd.DeltaLloyd.open(spark, folder)
    again.assign()
    assert again.step == 3 and again.counts.sum() == 4 * again.vectors().count()
    # the running sums are those of a full recount
    x = np.array([r.v for r in again.vectors().orderBy("row").collect()])
    codes = np.array([r.codes for r in spark.read.parquet(f"{folder}/round_3").filter("row is not null").orderBy("row").collect()])
    for p in range(4):
        for e in range(12):
            mine = x[codes[:, p] == e, 2 * p : 2 * p + 2]
            assert again.counts[p, e] == len(mine) and (again.sums[p, e] == mine.sum(0)).all()
    # only parts that moved were counted: plus and minus cancel
    moved = spark.read.parquet(f"{folder}/round_3").filter("row is null").selectExpr("sum(n)").first()[0]
    assert not moved


# ---- op13


def plain_variants(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    by = {}
    for w in n:
        for i in range(len(w)):
            by.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for group in by.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    for w in n:
        for i in range(len(w)):
            d = w[:i] + w[i + 1 :]
            if d in n:
                near[w].add(d)
                near[d].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return out


def test_variants_and_their_roots(spark, sf):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    words = ["abcdefgh", "abcdefgx", "abcdefg", "abcdefghh", "abcdefghhh", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÀÉîöüÿß", "Éàîöüÿß", "àéîöüÿßa", "bcdefgh"]
    for i, w in enumerate(words):
        rows += [(9000 + i, " ".join([w] * (3 ** (i % 5 + 1))))]
    rows += [(None, "abcdefgh abcdefgh, ABCDEFGH"), (9100, None), (9101, ""), (9102, "日本語 abcĀdefghijk abcĀdefghijk"), (9103, "x" * 5000 + " " + "x" * 5000), (9104, "x" * 4999 + " " + "x" * 4999 + "y")]
    rows += [(9200, "chained" + c + " ") for c in "aaaab"] * 30 + [(9300 + i, "".join(rng.choice("ab") for _ in range(7)) + " ") for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id bigint, text string, n int, word string")
    got = sorted((tuple(r) for r in variants.variant_forms(docs).collect()), key=str)
    assert got == sorted(plain_variants(rows), key=str)
    assert any(r[1] for r in got) and max(r[4] for r in got) > 5


def test_roots_follow_long_chains(spark):
    # a letter more at a time, each ten times as frequent; ids whose hash damages nothing
    words = ["wordword" + "x" * i for i in range(5)]
    rows, doc = [], 0
    for i, w in enumerate(words):
        for _ in range(2 * 10**i // (1000 if i > 2 else 1)):
            while zlib.crc32(f"{doc}:{w}".encode()) % 31 == 0:
                doc += 1
            rows.append((doc, " ".join([w] * (1000 if i > 2 else 1))))
            doc += 1
    got = {r.word: (r.form, r.root, r.n_near) for r in variants.variant_forms(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {w: ((words[i + 1] if i < 4 else None), words[4], 1 if i in (0, 4) else 2) for i, w in enumerate(words)}


def test_no_words(spark):
    assert variants.variant_forms(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert variants.variant_forms(spark.createDataFrame([(1, None), (2, "short words")], "doc_id bigint, text string")).count() == 0


def test_runs_are_read_in_chunks(monkeypatch):
    text = "abcdefgh ÀBCDEFGHĀxyzxyzxyz " * 50
    want = list(variants.runs(text))
    monkeypatch.setattr(variants, "CHUNK", 10)
    assert list(variants.runs(text)) == want and len(want) == 150


def test_keys_meet_for_near_words_only():
    rng = random.Random(1)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)} | {"a" * 200, "a" * 199, "a" * 99 + "b" + "a" * 100}
    groups = {}
    for n in {len(w) for w in words}:
        same = sorted(w for w in words if len(w) == n)
        found = list(zip(*(c.tolist() for c in variants.keys(same)), strict=True))
        assert len({(i, a, b) for i, _, a, b in found}) == len(found)
        for i, k, a, b in found:
            groups.setdefault((a, b), []).append((k, same[i]))
    got = set()
    for g in groups.values():
        for k, w in g:
            for j, x in g:
                if w < x and (k == j == variants.WILDCARD or {k, j} == {variants.DELETED, variants.WHOLE}):
                    assert (w, x) not in got
                    got.add((w, x))
    shorter = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    near = lambda a, b: (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or a in shorter(b) or b in shorter(a)
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}
