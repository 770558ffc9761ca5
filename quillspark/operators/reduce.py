"""Reducers from elements of one level to those above: mean, sample deviation, maximum of flat values.

Values are reduced over all elements of a level below an ancestor, not level by level. Nulls don't count; the deviation of
one value is 0, of none null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 6
LEVEL_NAME = {"word": "Word", "sent": "Sent", "block": "Par", "doc": "Doc"}


def mean(value: str) -> Column:
    return F.avg(value)


def deviation(value: str) -> Column:
    return F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value))


REDUCERS = {"M": mean, "SD": deviation, "Max": F.max}


def index_name(reducer: str, measure: str, level: str) -> str:
    """Such as M(Wd / Sent); without a reducer the value itself is meant."""
    return f"{reducer}({measure} / {LEVEL_NAME[level]})"


def summary(values: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """keys, and for each measure m_, sd_ and max_ columns, in one aggregation."""
    wide = [f(x).cast("double").alias(f"{r.lower()}_{x}") for x in measures for r, f in REDUCERS.items()]
    out = values.groupBy(*keys).agg(*wide)
    return out.select(*keys, *[F.round(f"{r.lower()}_{x}", PLACES).alias(f"{r.lower()}_{x}") for x in measures for r in REDUCERS])


def all_levels(values: DataFrame, measure: str, level: str) -> DataFrame:
    """doc_id, block_ix, sent_ix, index, value at every level above the values' own, in one pass by grouping sets.

    values: doc_id, block_ix, sent_ix, value. Rows of blocks have a null sent_ix, those of documents a null block_ix too.
    """
    sets = values.groupingSets([["doc_id"], ["doc_id", "block_ix"], ["doc_id", "block_ix", "sent_ix"]], "doc_id", "block_ix", "sent_ix")
    wide = sets.agg(*[f("value").cast("double").alias(r) for r, f in REDUCERS.items()])
    long = wide.unpivot(["doc_id", "block_ix", "sent_ix"], list(REDUCERS), "reducer", "value")
    return long.select("doc_id", "block_ix", "sent_ix", F.format_string(f"%s({measure} / {LEVEL_NAME[level]})", "reducer").alias("index"), F.round("value", PLACES).alias("value"))
