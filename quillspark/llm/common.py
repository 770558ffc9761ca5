"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the contracts call a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes after which a Python operator hands its rows on; bounds the memory of one output batch.
FLUSH_BYTES = 4 << 20
#: Rows of a batch that are Python objects at a time.
SLICE_ROWS = 256


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds: the fixed split into rows to learn from and held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def hash_sample(df: DataFrame, key: Column, wanted: int, total: int) -> DataFrame:
    """Rows of about 1.5 times wanted distinct keys (all, if total isn't more), chosen by hash of the key.

    To be sorted by hash and cut to wanted afterwards: what tasks then send to the driver is bounded by wanted, however many tasks there are.
    """
    share = min(1.0, (1.5 * wanted + 50) / max(total, 1))
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def sample_shares(df: DataFrame, group: str, key: str, wanted: int) -> DataFrame:
    """Rows of about 1.5 times wanted distinct keys (a hash) of each group, or all of a small group, by thresholds of the key.

    Distinct keys are counted by sketches that combine before the shuffle. The driver gets one row for each group, so groups must be few, as classes of a model are.
    """
    counts = df.groupBy(group).agg(F.approx_count_distinct(key).alias("n")).collect()
    share = df.sparkSession.createDataFrame([(r[group], int(min(1.0, (1.5 * wanted + 50) / max(0.9 * r.n, 1)) * (1 << 30))) for r in counts], f"{group} string, __below bigint")
    return df.join(F.broadcast(share), group).filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.col("__below")).drop("__below")  # one row for each group


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]], size: Callable[[tuple], int] | None = None) -> DataFrame:
    """df through a Python function that gets one row's values and yields output rows as tuples.

    make runs once in each task and returns that function. Output is sent on in small batches: size tells
    the bytes of an output row, so that long texts don't gather in memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)
    assert isinstance(spark_schema, StructType)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function, rows, held = make(), [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in (part.slice(at, SLICE_ROWS) for part in batches for at in range(0, part.num_rows, SLICE_ROWS)):
            for values in zip(*(c.to_pylist() if not _large(c) else _values(c) for c in b.columns), strict=True):
                for out in function(*values):
                    rows.append(out)
                    held += size(out) if size else 64
                    if held >= FLUSH_BYTES or len(rows) >= 8192:
                        yield batch()
                        rows.clear()
                        held = 0
        if rows:
            yield batch()

    return df.mapInArrow(run, schema)


def _large(column: pa.Array) -> bool:
    return pa.types.is_list(column.type) or pa.types.is_large_list(column.type)


def _values(column: pa.Array) -> Iterator:
    """List columns as numpy arrays, without a Python object for each element."""
    for x in column:
        yield None if not x.is_valid else x.values.to_numpy(zero_copy_only=False)


class TokenTable(dict):
    """Rows of numbers by token, computed when a token is first met and kept in one array.

    The table is emptied between two texts once it holds more than entries tokens.
    """

    def __init__(self, width: int, row: Callable[[str], object], entries: int = 400_000) -> None:
        super().__init__()
        self.row, self.entries, self.rows = row, entries, np.zeros((4096, width), np.float32)

    def __missing__(self, token: str) -> int:
        i = len(self)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[i] = self.row(token)
        self[token] = i
        return i

    def look_up(self, tokens: list[str]) -> np.ndarray:
        if len(self) > self.entries:
            self.clear()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.rows[at]
