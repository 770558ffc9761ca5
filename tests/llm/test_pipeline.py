"""Each stage of the pipeline against a plain version on what the stage before it kept."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_dedup_and_search import plain_fingerprint, removed

from quillspark.llm import mixing, toxicity
from quillspark.llm.common import fold_of
from quillspark.sources.tables import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows before the first stage and after each."""
    folder, docs = tmp_path_factory.mktemp("stages"), table(spark, sf, "documents")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(str(folder / str(i)))
        out.append(spark.read.parquet(str(folder / str(i))))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_toxic_documents_go(spark, sf, stages):
    model = toxicity.train(stages[0], table(spark, sf, "labels").filter(fold_of(F.col("doc_id"), 5) != 0))
    found = model.table()
    assert texts(stages[1]) == {i: t for i, t in texts(stages[0]).items() if model.score(t, found) < 0.5}


def test_one_of_each_group_stays(stages):
    before = texts(stages[1])
    prints = {i: plain_fingerprint(t) for i, t in before.items()}
    near = {i: [j for j in before if (prints[i] ^ prints[j]).bit_count() <= 4] for i in before}
    want = set()
    for i in sorted(before):
        seen, open_ = {i}, [i]
        while open_:
            for j in near[open_.pop()]:
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        if min(seen) == i:
            want.add(i)
    assert texts(stages[2]) == {i: before[i] for i in want}


def test_repeated_passages_go(stages):
    rows = list(texts(stages[2]).items())
    after = texts(stages[3])
    for i, n, gone, digest in removed(rows):
        if gone == n and n:
            assert i not in after
        elif gone:
            assert hashlib.sha256(after[i].encode()).hexdigest() == digest
        else:
            assert after[i] == dict(rows)[i]


def test_mix_takes_what_it_says(stages):
    taken = {r.doc_id: r.taken for r in mixing.mix(stages[3]).collect()}
    got = Counter()
    for r in stages[4].collect():
        got[r.doc_id] += len(r.text.split())
    assert got == Counter({i: n for i, n in taken.items() if n})
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_every_row_is_encoded(stages):
    import public_tokenizers as p
    import tiktoken

    from quillspark.llm import bpe

    own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.read_ranks(p.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    digest = lambda t: hashlib.sha256(",".join(map(str, own.encode_ordinary(t))).encode()).hexdigest()
    assert Counter((r.doc_id, r.ids_sha256) for r in stages[5].collect()) == Counter((r.doc_id, digest(r.text)) for r in stages[4].collect())
