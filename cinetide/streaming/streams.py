"""The ordered operators on streams: state per key, results as in batch.

Frames of a video arrive in any order within a gap; `in_order` buffers them per
key, emits the contiguous prefix and hands rows on in order, so the recursions
(differences, duplicate runs, averages, arbitration) can run in the same state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinetide.operators.folds import Step

STATE = "buffer binary"


def in_order(stream: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], step: Step, out: str, kind: str, most_gap: int | None = None) -> DataFrame:
    """Rows in order of a dense index per key, folded by step as operators.folds.folded() does.

    A row waits until all before it are there.  Only if most_gap is given and more rows
    wait, the missing ones are skipped.  Rows that come twice or after their place was
    passed are dropped.
    """
    fields = [f for f in stream.schema.fields if f.name in {*keys, order, *values}]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` {kind}"
    names = [f.name for f in fields]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, folded, waiting = pickle.loads(state.get[0]) if state.exists else (0, None, {})
        for frame in frames:
            for row in frame[names].itertuples(index=False, name=None):
                index = row[names.index(order)]
                if index >= following:
                    waiting.setdefault(int(index), row)
        done = []
        while waiting:
            if following not in waiting:
                if most_gap is None or len(waiting) <= most_gap:
                    break
                following = min(waiting)
            row = waiting.pop(following)
            folded, value = step(folded, tuple(row[names.index(v)] for v in values))
            done.append((*row, value))
            following += 1
        state.update((pickle.dumps((following, folded, waiting)),))
        yield pd.DataFrame(done, columns=[*names, out])

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def diff_step(distance: Callable[[Any, Any], float], duplicate: float, cut: float, first: float = 255.0) -> Step:
    """G1, D7, D8, G2 on a stream: the state is (last value, root, number); the result is (diff, is_dup, is_cut, root)."""

    def step(state, row):
        value, index = row
        diff = first if state is None else float(distance(value, state[0]))
        is_dup = state is not None and diff < duplicate
        root = state[1] if is_dup else index
        return (value, root), (diff, bool(is_dup), bool(diff > cut or state is None), int(root))

    return step


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """F13 on a stream: processed and skipped rows of each window of event time; late rows fall out."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("processed"), F.count_if("is_dup").alias("skipped"))


def cache_sink(path: str, key: str = "key") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends objects whose key is not cached yet.  A repeated batch adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        except AnalysisException as e:  # the first batch finds no table
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        fresh.write.mode("append").parquet(path)

    return put
