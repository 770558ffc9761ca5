"""Toxicity, language identification, media columns, byte-level BPE, mixing: brute force, exact round trips, held-out rows."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, langid, media, mixing, toxicity
from quillspark.llm.common import fold_of
from quillspark.sources.tables import table

ODD = [None, "", " \n\t", "x", "é" * 300, "a" * 20_000, "tail \x00\x01 zero", "日本語 のテキスト 😀", "same", "same"]


def odd_docs(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", "clash", 7) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score string, size int")


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as p

    return bpe.Codec(bpe.read_ranks(p.path("byte_bpe_multi_50k.tiktoken")), p.PATTERN).ready()


@pytest.fixture(scope="module")
def tiktoken_encoding(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=codec.pattern, mergeable_ranks=codec.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_verifies(codec):
    assert len({codec.hash.slot(k) for k in codec.ranks}) == len(codec.ranks) == len(codec.hash.keys)
    assert codec.hash.slot(b"no such token \xff") == -1


def test_ids_are_those_of_the_tiktoken_library(spark, sf, codec, tiktoken_encoding):
    rng = random.Random(0)
    alphabet = "ab '\n\t sé日1.,! 　\u0085\x1c😀"
    texts = [r.text for r in table(spark, sf, "documents").select("text").collect()] + [t or "" for t in ODD]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == tiktoken_encoding.encode_ordinary(t), repr(t[:80])
        assert codec.decode(ids) == t.encode()


def test_pattern_is_the_one_that_chunks_are_cut_for(codec):
    assert codec.pattern == bpe.GPT_PATTERN and codec.cuts


def test_a_long_pre_token_is_merged_in_reasonable_time(codec):
    ids = codec.encode("a" * 200_000)
    assert codec.decode(ids) == b"a" * 200_000


def test_bpe_query_on_odd_rows(spark, tiktoken_encoding):
    from quillspark.llm.queries import bpe_digests

    got = {r.doc_id: r for r in bpe_digests(odd_docs(spark)).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_digests(odd_docs(spark).limit(0)).count() == 0


def test_ids_are_decoded_again(spark, codec):
    rows = odd_docs(spark)
    one = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in bpe.encode(rows, codec.ranks, codec.pattern, decoded=True).collect()}
    two = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(rows, codec.ranks, codec.pattern), codec.ranks).collect()}
    assert one == two and all(one[i][1] == (t or "").encode() for i, t in enumerate(ODD))


# --- media columns ---


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 150, 156, 157, 183, 184, 8191, 8192, 8193, 70_000])
def test_transport_stream_round_trip(n):
    payload = bytes(i * 7 % 256 for i in range(n)).ljust(max(1, -(-n // 64)) * 64, b"\0")
    stream = media.mux(payload)
    back = media.demux(stream)
    assert back.payload == payload and len(stream) == 188 * back.packets and not back.jumps and not back.bad_tables
    assert len(back.units) == -(-len(payload) // media.UNIT_BYTES)
    assert [u[1] for u in back.units] == [i * media.UNIT_TICKS for i in range(len(back.units))]
    assert [u[2] for u in back.units] == [i % media.UNITS_TO_ACCESS == 0 for i in range(len(back.units))]


def test_lost_packets_and_bad_tables_are_noticed():
    stream = media.mux(bytes(40_000))
    lost = media.demux(stream[: 188 * 20] + stream[188 * 21 :])
    assert lost.jumps == 1 and len(lost.payload) == 40_000 - 184
    bad = bytearray(stream)
    bad[188 + 12] ^= 1
    assert media.demux(bytes(bad)).bad_tables == 1
    with pytest.raises(ValueError):
        media.demux(stream[:-1])


def test_known_crc():
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_media_query(spark):
    docs = odd_docs(spark)
    rows = media.read(media.store(docs)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        n, payload = media.padded(ODD[r.doc_id])
        assert r.n_bytes == n and bytes(r.payload) == payload
    assert len({r.feature for r in rows if ODD[r.doc_id] == "same"}) == 1
    assert media.read(media.store(docs.limit(0))).count() == 0


# --- mixing ---


def plain_targets(sizes, most=3):
    """By repeated sharing in fractions."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, out, rest = Fraction(sum(sizes.values())), {}, set(order)
    while rest:
        total = sum(weight[s] for s in rest)
        over = {s for s in rest if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in rest}
        for s in over:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in over)
        rest -= over
    return out


def test_targets():
    rng = random.Random(1)
    for _ in range(200):
        sizes = {(None if i == 0 and rng.random() < 0.3 else f"s{i}"): rng.choice([0, 1, 5, 100, 10_000]) for i in range(rng.randrange(1, 9))}
        got, want = mixing.targets(list(sizes.items())), plain_targets(sizes)
        assert all(abs(got[s] - float(want[s])) < 1e-6 * max(1, float(want[s])) for s in sizes)


@pytest.mark.parametrize("hot", [False, True])
def test_mix_against_prefix_sums(spark, hot):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(40))), "hot" if hot and i % 3 else rng.choice(["a", "b", "c", None])) for i in range(400)] + [(400, None, "a"), (401, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(402))
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    of = Counter()
    for i, _, s in rows:
        of[s] += sizes[i]
    goal = mixing.targets(list(of.items()))
    taken = Counter()
    for s in of:
        order = sorted((i for i, _, x in rows if x == s), key=lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest(), sizes[i]))
        budget, left = round(goal[s]), round(goal[s])
        while left > 0 and of[s]:
            for i in order:
                n = min(sizes[i], left)
                taken[i] += n
                left -= n
        assert sum(taken[i] for i in order) == (budget if of[s] else 0)
    for r in got:
        assert (r.size, r.taken, r.source_size) == (sizes[r.doc_id], taken[r.doc_id], of[r.source])
        assert abs(r.target - goal[r.source]) < 1e-9 and r.taken <= 3 * r.size
    again = mixing.mix(docs.repartition(7), partitions=5).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}
    mixed = mixing.mixed_documents(docs).collect()
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
    assert words == +taken


def test_mix_of_odd_rows(spark):
    assert mixing.mix(odd_docs(spark)).count() == len(ODD)
    assert mixing.mix(odd_docs(spark).limit(0)).count() == 0


# --- toxicity ---

BAD = ["vile", "rotten", "nasty"]


def toxic_corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randrange(1, 9))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(BAD) + rng.choice(["", "ly", "ish"])
        out.append((i, ". ".join(sentences) + ".", toxic))
    return out


def test_instances_are_learned_from_bags():
    train, test = toxic_corpus(600), toxic_corpus(300, 4)
    model = toxicity.fit([t for _, t, _ in train], [y for _, _, y in train], [1.0] * len(train))
    found = model.table()
    right = [(model.score(t, found) >= 0.5) == bool(y) for _, t, y in test]
    assert sum(right) / len(right) > 0.97
    for _, t, y in test[:100]:
        if y and model.score(t, found) >= 0.5:
            spans = model.located(t, found, 0.3)
            assert spans and any(any(b in t[s["start"] : s["end"]] for b in BAD) for s in spans)


def test_noisy_or_is_that_of_sentences():
    import math

    model = toxicity.Model({"<bad>": 3.0}, -2.0)
    p = lambda z: 1 / (1 + math.exp(-z))
    want = 1 - (1 - p(-2)) * (1 - p(1)) * (1 - p(4))
    assert abs(model.score("fine. bad! bad bad", model.table()) - want) < 1e-6
    assert model.score("", model.table()) == model.score(None, model.table()) == 0.0


def test_toxicity_query_rows_and_null_labels(spark):
    docs = odd_docs(spark).union(spark.createDataFrame([(100 + i, t, None, None, None, None) for i, t, _ in toxic_corpus(300)], odd_docs(spark).schema))
    labels = spark.createDataFrame([(100 + i, y) for i, _, y in toxic_corpus(300)] + [(100, None), (None, 1), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ODD) + 300 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (0, 1, 2)} == {0.0}
    kept = toxicity.filtered(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in rows)
    assert toxicity.train(docs, labels.filter("toxic = 1")).prior == 1.0
    assert toxicity.train(docs, labels.limit(0)).prior == 0.0
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- language identification ---


def test_codes_tell_languages_apart():
    for k in (1, 2, 3, 4, 7, 12, 30):
        c = langid.code(k)
        assert c.shape[0] == k
        if k > 1:
            distance = min(int((c[i] != c[j]).sum()) for i in range(k) for j in range(i))
            assert distance == (2 ** (k - 2) if k <= langid.EXHAUSTIVE else distance) and distance > 0


def test_wrong_bits_are_corrected():
    import numpy as np

    words = langid.code(4)
    m = langid.Model(list("abcd"), words, np.zeros((8, 7)), np.zeros(7), np.full(7, 1 / 7))
    for k in range(4):
        for bit in range(7):
            margins = 3 * words[k].copy()
            margins[bit] *= -1
            assert m.losses(margins[None])[0].argmin() == k


def test_held_out_languages(spark, sf):
    docs = table(spark, sf, "documents")
    held = fold_of(docs["doc_id"], 4) == 2
    model = langid.train(docs.filter(~held))
    truth = {r.doc_id: r.lang for r in docs.filter(held).collect()}
    rows = langid.identify(docs.filter(held), model).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.9
    odd = {r.doc_id: r for r in langid.identify(odd_docs(spark), model).collect()}
    assert len(odd) == len(ODD) and all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2))
    assert odd[8].score == odd[9].score and odd[7].lang_pred != "und"
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd_docs(spark), nothing).collect()} == {"und"}


def test_folds_are_those_of_crc32(spark):
    rows = spark.range(200).select("id", fold_of(F.col("id"), 5).alias("fold")).collect()
    assert all(r.fold == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_texts_without_letters_have_no_language(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.train(docs)
    rows = spark.createDataFrame(list(enumerate(["½ ² ③ Ⅷ", "12 ٣ _ -- 😀", "①②", "ª", "é", "日本"])), "doc_id bigint, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(rows, model).collect()}
    assert [got[i] == "und" for i in range(6)] == [True, True, True, False, False, False]


def test_languages_are_learned_from_bounded_samples(spark):
    rows = [(i % 50, f"wort haus {i % 50}", "de", "x") for i in range(3000)] + [(5000 + i, f"word house {i}", "en", "y") for i in range(40)] + [(9000, None, "en", "z"), (9001, "t", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, h string")
    model = langid.train(docs, sample_rows=30)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs.filter("lang is not null").dropDuplicates(["doc_id"]), model).collect()}
    assert got[3] == "de" and got[5003] == "en" and got[9000] == "und"
    assert langid.train(docs.filter("lang = 'de'")).languages == ["de"]


def test_media_and_language_queries_as_registered(spark, sf):
    from quillspark.llm import queries

    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = queries.op2_media_columns(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n, payload = media.padded(texts[r.doc_id])
        stream = media.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest())
    for r in queries.op3_language_id(spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    truth = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, sf).collect()}
    assert sorted(got) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [i for i, y in truth.items() if i in got and got[i].held_out and y is not None]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.9 * len(held)


def test_mix_of_rows_without_and_with_equal_ids(spark):
    rng = random.Random(9)
    rows = [(None, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))), rng.choice("ab")) for _ in range(200)]
    rows += [(7, "one two three", "a")] * 50 + [(7, "four five", "b")] * 3 + [(8, None, "a"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = mixing.mix(docs).collect()
    assert len(plan) == len(rows)
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r.source] += len(r.text.split())
    taken = Counter()
    for r in plan:
        taken[r.source] += r.taken
    assert words == +taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in plan)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_streams_that_others_write():
    """Sections over two packets, two elementary PIDs, packets sent twice, announced discontinuities, unit lengths."""
    pmt_pid, a, b = 0x30, 0x41, 0x42
    info = b"".join(bytes([media.PRIVATE_TYPE]) + (0xE000 | p).to_bytes(2, "big") + (0xF000 | 100).to_bytes(2, "big") + bytes([0x0A, 98]) + bytes(98) for p in (a, b))
    pmt = media._section(media.PMT_TABLE, 7, (0xE000 | a).to_bytes(2, "big") + b"\xf0\x00" + info)
    pat = media._section(media.PAT_TABLE, 1, (7).to_bytes(2, "big") + (0xE000 | pmt_pid).to_bytes(2, "big"))
    assert len(pmt) > 184

    def packet(pid, counter, data, start=False, flags=None):
        field = b"" if flags is None else bytes([flags])
        room = 184 - len(data)
        if room or field:
            return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, 0x30 | counter, room - 1]) + (field.ljust(room - 1, b"\xff") if field else b"\0"[: room - 1].ljust(room - 1, b"\xff")) + data
        return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, 0x10 | counter]) + data

    unit = lambda ticks, data, told: b"\0\0\1\xbd" + told.to_bytes(2, "big") + b"\x80\x80\x05" + media._stamp(ticks) + data
    head = media._table_packet(0, 0, pat) + packet(pmt_pid, 0, b"\0" + pmt[:183], True) + packet(pmt_pid, 1, pmt[183:].ljust(184, b"\xff"))
    one, two = packet(a, 3, unit(90, b"A" * 100, 108) + b"Z" * 20, True), packet(b, 9, unit(180, b"B" * 100, 0), True)
    more = packet(a, 4, unit(91, b"C" * 50, 500), True)
    s = media.demux(head + one + two + one + packet(b, 2, b"D" * 60, flags=0x80) + more)
    assert s.payloads == {a: b"A" * 100 + b"C" * 50, b: b"B" * 100 + b"D" * 60}
    assert s.programs == ((7, a, 6), (7, b, 6)) and s.payload == s.payloads[a]
    assert (s.jumps, s.bad_tables, s.short, s.faults) == (0, 0, 1, 0)
    assert [u.pts for u in s.units_of[a]] == [90, 91]


def test_broken_streams_are_counted_in_spark(spark):
    stream = media.mux(bytes(range(256)) * 100)
    cases = [stream, stream[:-1], stream[:1000] + stream[1100:], b"", b"\0" * 500, None, b"G", stream[:188 * 3] + b"\x47" * 188 + stream[188 * 3 :]]
    rows = spark.createDataFrame([(i, c, "clash") for i, c in enumerate(cases)], "doc_id bigint, media binary, feature_ string")
    got = {r.doc_id: r for r in media.read(rows).collect()}
    assert len(got) == len(cases)
    assert bytes(got[0].payload) == bytes(range(256)) * 100 and got[0].feature.endswith("jumps=0;bad_tables=0;short=0;faults=0")
    assert "faults=1" in got[1].feature and bytes(got[1].payload) == bytes(got[0].payload)[: len(got[1].payload)]
    assert "faults=0" not in got[2].feature and len(got[2].payload) < 25_600
    assert bytes(got[3].payload) == b"" and got[5].payload is None and got[5].feature is None and got[5].units == []
    assert got[0].units[0].clock == 0 and got[0].units[0].access


def test_equal_rows_are_mixed_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARE", 7)
    rows = [(1, "a b c d e", "s1")] * 2000 + [(2, "one two three", "s2")] + [(None, "x y", "s2")] * 3 + [(3, "long " * 5000, "s3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = mixing.mix(docs).collect()
    by = {}
    for r in plan:
        by.setdefault((r.doc_id, r.source), []).append(r)
    assert len(by[1, "s1"]) == 2000 and len({r.target for r in by[1, "s1"]}) == 1
    for source in ("s1", "s2", "s3"):
        own = [r for r in plan if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target) and all(0 <= r.taken <= 3 * r.size for r in own)
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r.doc_id, r.source] += len(r.text.split())
    assert words == Counter({k: sum(r.taken for r in v) for k, v in by.items()})
