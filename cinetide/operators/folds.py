"""Ordered folds: recursions whose state is the previous result.

No window frame can express them.  Rows are sorted by key and order within
partitions and streamed through the step as Arrow batches, so a task holds one
batch and one state however long a key's rows are.  Scene segments belong to the
key, which splits long videos.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

Step = Callable[[Any, tuple], tuple[Any, Any]]


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], step: Step, out: str, kind: str) -> DataFrame:
    """Adds column `out`: step(state, values of the row) gives the new state (None at a key's start) and the row's result."""
    names = df.columns
    result = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        fresh = True
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            rows = zip(*(batch.column(v).to_pylist() for v in values), strict=True)
            found = []
            for k, row in zip(own, rows, strict=True):
                if fresh or k != key:
                    key, state, fresh = k, None, False
                state, value = step(state, row)
                found.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, result)], [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {kind}"
    dealt = df.repartition(*(F.col(k) for k in keys)) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema).select(*names, out)


def iir(strength: float = 0.5, still: int = 24) -> Step:
    """G4 on whole numbers: blends with the last result, the more the less the input moved; state is (input, result)."""
    most = int(strength * 256)

    def step(state, row):
        now = row[0]
        if state is None or now is None:
            return (now, now), now
        motion = abs(now - state[0])
        alpha = 0 if motion >= still else most * (still - motion) // still
        out = (now * (256 - alpha) + state[1] * alpha) >> 8
        return (now, out), out

    return step


def ema(keep: float = 0.7, seed: float = 3000.0) -> Step:
    """Moving average over (value, success); failures leave it."""

    def step(state, row):
        value, ok = row
        state = seed if state is None else state
        if ok and value is not None:
            state = state * keep + value * (1 - keep)
        return state, state

    return step


def arbitration() -> Step:
    """L4 over (session_start, force, is_tunnel, now): accepted unless an older session's tunnel would replace a newer one.

    State is the session in force; a missing session counts as 0, and an accepted 0 stores the time.
    """

    def step(state, row):
        mine, force, tunnel, now = row
        mine = mine or 0
        if state and not force and mine < state and tunnel:
            return state, False
        return mine or now, True

    return step


def newest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], session: str = "session_start") -> DataFrame:
    """L4 where nothing is forced and all come by a tunnel: accepted unless an earlier one was newer; a running maximum, without a fold."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("accepted", F.coalesce(F.col(session) >= F.max(session).over(before), F.lit(True)))


def throttle(gap: int) -> Step:
    """Whether a report at (time) passes: the first does, and then one in every gap."""

    def step(state, row):
        if state is None or row[0] - state >= gap:
            return row[0], True
        return state, False

    return step
