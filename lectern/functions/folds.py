"""Ordered folds: rows of one key, in order, through a small running state.

Rows are shuffled by key, sorted inside their partitions (spilling to disk when
large), and streamed in Arrow batches. A key is never gathered in memory; what is
held is the state alone. Use only where a row's result depends on the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[], object],
    step: Callable[[object, dict], list[tuple]],
    schema: str | T.StructType,
    finish: Callable[[object], list[tuple]] | None = None,
) -> DataFrame:
    """Apply ``step(state, row)`` to each row in order; it returns output tuples.

    Output columns are the keys followed by ``schema``; ``finish`` runs once a key
    is complete.
    """
    key_fields = [df.schema[k] for k in keys]
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*key_fields, *fields.fields])
    names = full.fieldNames()
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def close(out):
            if current is not None and finish is not None:
                out.extend((*current, *t) for t in finish(state))

        for batch in batches:
            out: list[tuple] = []
            for values in zip(*[batch[c].array for c in columns]):
                row = dict(zip(columns, values))
                key = tuple(row[k] for k in keys)
                if key != current:
                    close(out)
                    current, state = key, start()
                out.extend((*key, *t) for t in step(state, row))
            if out:
                yield pd.DataFrame.from_records(out, columns=names)
        out = []
        close(out)
        if out:
            yield pd.DataFrame.from_records(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, full)
