"""Sequential folds over the rows of a key, for operators whose state no expression carries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str | StructType) -> DataFrame:
    """``fold`` of each key's rows (tuples in the order of ``df.columns``, sorted by ``order``).

    Rows are dealt by key and sorted by Spark, which spills; a task then walks its rows once and
    holds those of one key.
    """
    out_schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out_schema)
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: list[tuple] = []
        last = None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = tuple(row[i] for i in at)
                if rows and key != last:
                    out += fold(rows)
                    rows = []
                last = key
                rows.append(row)
            if len(out) > 20_000:
                yield batch()
                out = []
        if rows:
            out += fold(rows)
        yield batch()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)
