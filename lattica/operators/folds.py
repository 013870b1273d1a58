"""Recurrences along time: a value of one time needs that of the time before, and no window says it.

Rows of a run (a fold, a strategy) are sorted by t within a task, and a step is called for each in
order; its results are new columns of the same rows. Time and memory are those of one pass: a step
keeps what it needs itself. Runs are dealt to tasks; a run is a single path by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[..., tuple]


def fold_runs(times: DataFrame, run: Sequence[str], columns: Sequence[str], fields: Sequence[str], begin: Callable[[], Step]) -> DataFrame:
    """times with a double for each of `fields`: what the step, begun anew for each run, makes of `columns` at each t."""
    schema = T.StructType([*times.schema.fields, *[T.StructField(f, T.DoubleType()) for f in fields]])
    arrow = to_arrow_schema(schema)
    at = {n: i for i, n in enumerate(times.columns)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = None, None
        for batch in batches:
            keys = zip(*(batch.column(at[k]).to_pylist() for k in run)) if run else [()] * batch.num_rows
            made = []
            for key, *row in zip(keys, *(batch.column(at[c]).to_pylist() for c in columns)):
                if step is None or key != last:
                    step, last = begin(), key
                made.append(step(*row))
            new = zip(*made) if made else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(x), pa.float64()) for x in new]], schema=arrow)

    dealt = times.repartition(*[f"`{k}`" for k in run]) if run else times.repartition(1)
    return dealt.sortWithinPartitions(*[f"`{k}`" for k in run], "t").mapInArrow(each, schema)
