"""Concepts of blocks of more than 1,000 sentences."""

from quillspark.plans import readings


def test_steps_of_long_blocks(spark, monkeypatch):
    rows = [(1, 0, i, k, f"w{i % 7}x{k}", "NOUN", False) for i in range(1003) for k in range(2)]
    rows += [(1, 1, i, k, f"v{i}x{k}", "NOUN", False) for i in range(5) for k in range(2)]
    t = spark.createDataFrame(rows, "doc_id bigint, block_ix int, sent_ix int, tok_ix int, lemma string, pos string, is_stop boolean")
    monkeypatch.setattr(readings, "annotated_of", lambda spark, sf: t)
    steps = {r.step: (r.a, r.b) for r in readings.concepts(spark, None).collect()}
    assert steps == {i: (f"w{i % 7}x0", f"w{i % 7}x1") for i in range(1003)} | {1003 + i: (f"v{i}x0", f"v{i}x1") for i in range(5)}
    assert {(r.a, r.b) for r in readings.concept_edges(spark, None).collect()} == set(steps.values())
    assert readings.comprehension_history(spark, None).first().steps == 1008
