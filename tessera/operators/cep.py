"""Sequential pattern matching over ordered rows of a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_WITHIN_MS = 60_000
UNSUPPORTED = ("times", "one_or_more", "zero_or_more", "not_followed_by", "branch")


class UnsupportedPattern(ValueError):
    """A combinator that sequential patterns don't have."""


class Pattern:
    """Stages that follow each other, with other events allowed in between, within a time."""

    def __init__(self, stages: Sequence[str] = (), within_ms: int = DEFAULT_WITHIN_MS):
        self.stages, self.within_ms = tuple(stages), within_ms

    @classmethod
    def begin(cls, stage: str) -> Pattern:
        return cls((stage,))

    def followed_by(self, stage: str) -> Pattern:
        return Pattern((*self.stages, stage), self.within_ms)

    def within(self, ms: int) -> Pattern:
        return Pattern(self.stages, ms)

    def __getattr__(self, name: str):
        if name in UNSUPPORTED:
            raise UnsupportedPattern(f"{name} is not supported: patterns are plain sequences")
        raise AttributeError(name)


def advance(state: tuple[int, int] | None, ts: int, is_stage, stages: int, within: int) -> tuple[tuple[int, int] | None, bool, bool]:
    """One step of the matcher: (new state, event taken, match complete).

    The state is (next stage, start time).  A partial match is given up when more
    than ``within`` has passed since its start, and the event may begin a new one;
    so it is where a time is NaN, which no limit holds.
    """
    if state is not None and not ts - state[1] <= within:
        state = None
    if state is None:
        if not is_stage(0):
            return None, False, False
        state = (0, ts)
    if not is_stage(state[0]):
        return state, False, False
    nxt = state[0] + 1
    return (None, True, True) if nxt == stages else ((nxt, state[1]), True, False)


def _matched(df: DataFrame, key: str, ts: str, ties: Sequence[str], stages: Sequence[str | None], within: int, stage: str | None) -> DataFrame:
    """Rows of complete matches; without ``stage`` every row is whatever stage comes next.

    Keys are sorted one after the other into the tasks, and a task steps through
    its rows batch by batch, so there is no call for each key.  What it holds are
    a batch and the rows of the one match that is open.
    """
    numbered = [T.StructField("match_id", T.LongType()), T.StructField("match_stage", T.IntegerType())]
    # intervals of months have no Arrow type and travel as text
    texts = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, T.YearMonthIntervalType | T.CalendarIntervalType)}
    carried = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])
    schema, n_stages = T.StructType([*carried.schema.fields, *numbered]), len(stages)
    first = F.lag(F.lit(False), 1, True).over(Window.partitionBy(key).orderBy(ts, *ties))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done_of_key, held = None, 0, None
        for batch in batches:
            # the rows of the open match come first
            taken = list(range(held.num_rows)) if held is not None else []
            batch = pa.concat_batches([held, batch]) if taken else batch
            rows, ids = [], []
            begins, times = batch.column("__first").to_pylist(), batch.column(ts).to_pylist()
            kinds = batch.column(stage).to_pylist() if stage is not None else None
            for i in range(len(taken), batch.num_rows):
                if begins[i]:
                    state, done_of_key = None, 0
                before = state
                state, used, done = advance(state, times[i], lambda k, i=i: kinds is None or kinds[i] == stages[k], n_stages, within)
                if used:
                    if before is None or state is not None and state[0] == 1 or n_stages == 1:
                        taken = []
                    taken.append(i)
                if done:
                    rows += taken
                    ids += [done_of_key] * n_stages
                    done_of_key += 1
                    taken = []
            held = batch.take(pa.array(taken if state is not None else [], pa.int64()))
            out = batch.drop_columns(["__first"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ids, pa.int64()), pa.array([*range(n_stages)] * (len(ids) // n_stages), pa.int32())], schema.names)

    got = carried.withColumn("__first", first).mapInArrow(run, schema)
    return got.select(*[F.col(f"`{f.name}`").cast(texts[f.name]).alias(f.name) if f.name in texts else F.col(f"`{f.name}`") for f in schema])


def match_stages(df: DataFrame, key: str, ts: str, stage: str, pattern: Pattern, ties: Sequence[str] = ()) -> DataFrame:
    """Rows that take part in complete matches, with ``match_id`` and ``match_stage``; ``stage`` names each row's stage.

    One partial match a key at a time.  Only rows of the pattern's stages are
    sent to the matcher, a key's rows in order.
    """
    rows = df.where(F.col(stage).isin(*pattern.stages) & F.col(ts).isNotNull())
    return _matched(rows, key, ts, ties, pattern.stages, pattern.within_ms, stage)


def match_any(df: DataFrame, key: str, ts: str, n_stages: int, within_ms: int = DEFAULT_WITHIN_MS, ties: Sequence[str] = ()) -> DataFrame:
    """Matches without conditions on the rows: every row is the next stage of its key's match.

    So matches are consecutive groups of ``n_stages`` rows, restarted when a row
    comes more than ``within_ms`` after its match began.
    """
    return _matched(df.where(F.col(ts).isNotNull()), key, ts, ties, (None,) * n_stages, within_ms, None)
