"""Event-time operators over bounded tables: windows, interval joins, as-of joins, late data.

Event times are epoch milliseconds (long) unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since 1970 of a timestamp, with or without zone (the session's zone should be UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def tumbling(df: DataFrame, ts: str, size: int, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """(keys, window_start_ms, window_end_ms, aggregates) of half-open windows of ``size`` ms; NULL times are skipped."""
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(size))
    slotted = df.where(F.col(ts).isNotNull()).withColumn("window_start_ms", start)
    return slotted.groupBy(*keys, "window_start_ms", (F.col("window_start_ms") + size).alias("window_end_ms")).agg(*aggs)


def sliding(df: DataFrame, ts: str, size: int, slide: int, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Windows of ``size`` ms that start every ``slide`` ms; an event is in each that covers it."""
    latest = F.col(ts) - F.pmod(F.col(ts), F.lit(slide))
    n = -(-size // slide)
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: latest - i * slide), lambda s: s + size > F.col(ts))
    spread = df.where(F.col(ts).isNotNull()).withColumn("window_start_ms", F.explode(starts))
    return spread.groupBy(*keys, "window_start_ms", (F.col("window_start_ms") + size).alias("window_end_ms")).agg(*aggs)


def sessions(df: DataFrame, ts: str, gap: int, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Sessions of a key: a new one starts ``gap`` ms or more after the last event; it ends ``gap`` ms after its last.

    ``session_window`` would join events exactly ``gap`` apart, so it is asked for
    one millisecond less and its end moved: the session merge is a partial
    aggregate, which a window over each key's events is not.
    """
    timed = df.where(F.col(ts).isNotNull()).withColumn("__at", F.timestamp_millis(F.col(ts)))
    grouped = timed.groupBy(*keys, F.session_window("__at", f"{gap - 1} milliseconds").alias("__w")).agg(*aggs)
    rest = [c for c in grouped.columns if c not in (*keys, "__w")]
    return grouped.select(*keys, F.unix_millis("__w.start").alias("window_start_ms"), (F.unix_millis("__w.end") + 1).alias("window_end_ms"), *rest)


def count_windows(df: DataFrame, order: Sequence[str], size: int, keys: Sequence[str], *aggs: Column, slide: int | None = None, partial: bool = True) -> DataFrame:
    """Windows over every ``size`` rows of a key, starting every ``slide`` rows; the last ones may be partial."""
    slide = slide or size
    if not 1 <= slide <= size:
        raise ValueError("slide must lie between 1 and size")
    place = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("__i", F.row_number().over(place) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - size + 1) / slide)).cast("int")
    spread = numbered.withColumn("window_index", F.explode(F.sequence(first, F.floor(F.col("__i") / slide).cast("int"))))
    out = spread.groupBy(*keys, "window_index").agg(*aggs, F.count(F.lit(1)).alias("__n"))
    return (out if partial else out.where(F.col("__n") == size)).drop("__n")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, lower: int, upper: int, bucket: bool = True) -> DataFrame:
    """Pairs with the same key and lower <= right_ts - left_ts <= upper, both included.

    Rows are also joined on time buckets as wide as the interval, so a key with
    many events splits into many join keys and each right row meets only left
    rows of two neighbouring buckets.  Right columns get the prefix ``r_``.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).where(F.col(f"r_{right_ts}").isNotNull() & F.col(f"r_{key}").isNotNull())
    left = left.where(F.col(left_ts).isNotNull() & F.col(key).isNotNull())
    within = (F.col(f"r_{right_ts}") - F.col(left_ts)).between(lower, upper)
    same = F.col(key) == F.col(f"r_{key}")
    if not bucket:
        return left.join(r, same & within, "inner")
    width = max(upper - lower, 1)
    lb = F.explode(F.sequence(F.floor((F.col(left_ts) + lower) / width), F.floor((F.col(left_ts) + upper) / width)))
    return left.withColumn("__b", lb).join(r.withColumn("__rb", F.floor(F.col(f"r_{right_ts}") / width)), same & (F.col("__b") == F.col("__rb")) & within, "inner").drop("__b", "__rb")


def window_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: int) -> DataFrame:
    """Pairs at most ``within`` ms apart, either way."""
    return interval_join(left, right, key, left_ts, right_ts, -within, within)


def as_of_join(stream: DataFrame, versions: DataFrame, keys: Sequence[str], ts: str, version: str, how: str = "inner", lookback: int | None = None, slots: int | None = None) -> DataFrame:
    """Each stream row with the latest version of its key at or before its time.

    Both sides are sorted together once per key and the last version seen is
    carried along: one shuffle and no range explosion.  With ``slots``, the time is
    cut into so many (times are numbers then), a key's slots are sorted apart, and
    the last version before a slot comes from a table of one row for each key and
    slot: for a key with a large part of all rows, and the default without keys.  Versions precede stream
    rows of the same time.  With ``lookback``, versions older than the newest one
    by more than it have been evicted.  ``how`` is inner or left; no keys means
    one version history for all.  Version columns get the prefix ``v_``.
    """
    names = versions.columns
    if lookback is not None:
        newest = versions.agg(F.max(version).alias("__newest"))
        versions = versions.crossJoin(F.broadcast(newest)).where(F.col(version) >= F.col("__newest") - lookback).drop("__newest")
    body = F.struct(*[F.col(c) for c in names])
    table = versions.where(F.col(version).isNotNull()).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(version).alias("__t"), F.lit(0).alias("__side"), body.alias("__v"))
    rows = stream.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in stream.columns]).alias("__row"))
    both = table.unionByName(rows, allowMissingColumns=True)
    ks = [f"__k{i}" for i in range(len(keys))]
    slots = slots or (None if keys else NO_KEY_SLOTS)
    if slots and dict(both.dtypes)["__t"] in ("tinyint", "smallint", "int", "bigint"):
        both = _slotted(both, ks, slots)
        ks = [*ks, "__slot"]
    w = Window.partitionBy(*ks).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("__v", ignorenulls=True).over(w)
    seen = both.withColumn("__last", F.coalesce(last, F.col("__prior")) if "__prior" in both.columns else last).where("__side = 1")
    if how == "inner":
        seen = seen.where("__last IS NOT NULL")
    return seen.select("__row.*", *[F.col(f"__last.{c}").alias(f"v_{c}") for c in names])


#: Slots of time of an as-of join without keys.
NO_KEY_SLOTS = 200


def _slotted(both: DataFrame, ks: list[str], slots: int) -> DataFrame:
    """Add ``__slot`` and ``__prior``, the last version of the key before the slot."""
    low, high = both.agg(F.min("__t"), F.max("__t")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // slots))
    both = both.withColumn("__slot", F.floor((F.col("__t") - F.lit(low or 0)) / width))
    ends = both.groupBy(*ks, "__slot").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__t"))).alias("__end"))
    before = Window.partitionBy(*ks).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"{k}_") for k in ks], F.col("__slot").alias("__slot_"), F.last("__end", ignorenulls=True).over(before).alias("__prior"))
    same = F.col("__slot") == F.col("__slot_")
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return both.join(ends, same).drop("__slot_", *[f"{k}_" for k in ks])


def split_late(df: DataFrame, ts: str, watermark: int | Column, threshold: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows): late is earlier than the watermark by more than ``threshold``; a NULL time is an error."""
    timed = df.withColumn(ts, F.when(F.col(ts).isNull(), F.raise_error(F.lit("event time is NULL")).cast("long")).otherwise(F.col(ts)))
    late = F.col(ts) < (watermark if isinstance(watermark, Column) else F.lit(watermark)) - threshold
    return timed.where(~late), timed.where(late)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in event order, as streaming deduplication keeps it."""
    body = F.struct(*[F.col(c) for c in (*order, *[c for c in df.columns if c not in order])])
    return df.groupBy(*keys).agg(F.min(body).alias("__first")).select("__first.*").select(*df.columns)
