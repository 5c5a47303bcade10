"""Mixing sources to target weights by hash-random order and exact word budgets.

Every document gets a key hashed from its id, sources are cut into ranges of
that key, word counts are summed per range, and the running sums of the ranges
give each document its place in its source's order.  A source whose target
exceeds its size repeats whole epochs; the last epoch stops at the exact word.

Only (id, source, size, key) rows are shuffled, never texts, and no window
spans more than one range, so a source with a third of all rows costs no more
than the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, written

#: A source's target stops at this multiple of its size.
MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
#: Documents in a range of keys, on average.
RANGE_ROWS = 5_000


def word_count(text: str | Column = "text") -> Column:
    """Number of words; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Add ``target`` to (source, source_size, n_docs).

    Sources by code point, null last, take the weights in turn.  A target stops
    at ``max_epochs`` times the source's size and what is over is shared again
    by weight.  Those rounds converge to target = min(cap, level * weight); each
    round is one aggregate of one row, whatever the number of sources.  The
    ranking is a window over one narrow row per source, not per document.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.lit(0)
    for i, x in enumerate(weights):
        w = F.when(turn == i, F.lit(x)).otherwise(w)
    ranked = written(sizes.withColumn("weight", w.cast("long")), "mix-sources")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    if share == 1.0:
        total = int(total)
    capped, level = -1, None
    while True:
        full = F.lit(False) if level is None else (F.col("source_size") * max_epochs <= F.col("weight") * F.lit(level))
        got = ranked.agg(
            F.sum(F.when(full, F.col("source_size") * max_epochs).otherwise(0)).alias("cap"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("w"),
            F.sum(full.cast("long")).alias("n"),
        ).first()
        if got["n"] is None or got["n"] == capped or not got["w"]:
            break
        capped, level = got["n"], (total - got["cap"]) / got["w"]
    level = 0.0 if level is None else level
    # what is capped in the last round stays capped
    return ranked.withColumn("target", F.least((F.col("source_size") * max_epochs).cast("double"), F.lit(float(level)) * F.col("weight")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    Null or empty texts have size 0 and take nothing; a null source is a source
    of its own, ranked last; rows with equal ids are ordered by size and keep
    separate results; an empty table gives an empty result.  Reruns agree, as
    keys depend on ids alone.
    """
    sized = written(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = written(source_targets(per_source, weights, max_epochs), "mix-targets")

    # Sources are joined by broadcast only in so far as Spark sees that they are small.
    keyed = sized.join(targets, sized.source.eqNullSafe(targets.source), "inner").select(
        "doc_id", sized.source, "size", "source_size", "n_docs", "target",
        F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
    )
    ranges = F.ceil(F.col("n_docs") / range_rows)
    keyed = written(keyed.withColumn("bucket", F.floor(((F.col("key") / F.lit(2.0**64)) + 0.5) * ranges).cast("long")), "mix-keyed")

    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    starts = starts.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "start")
    within = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("prior", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, placed.source.eqNullSafe(starts.s2) & (placed.bucket == starts.b2), "inner")

    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("prior")))
    return placed.select(
        "doc_id", "source", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"),
        "target", (epochs * F.col("size") + cut).cast("long").alias("taken"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{SPACES}]*[^{SPACES}]+"), F.lit(0)), F.lit(1), n), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per epoch taken.

    A document comes once for each whole epoch, and the one document where a
    source's budget ends comes once more, cut after its last word taken, so that
    each source gives exactly its budget.  Documents of which the mix takes
    nothing go.  Rows of equal id and size are treated as the same document.
    """
    plan = mix(docs, **options).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    plan = plan.groupBy("__id", "__size").agg(F.max("__taken").alias("__taken"))
    cols = [F.col(c) for c in docs.columns]
    sized = docs.withColumn("__words", word_count())
    kept = sized.join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")), "inner")
    whole, part = F.floor(F.col("__taken") / F.col("__size")).cast("int"), (F.col("__taken") % F.col("__size")).cast("int")
    pieces = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = kept.withColumn("__piece", F.explode(pieces))
    text = F.when(F.col("__piece") == 0, F.col("text")).otherwise(first_words(F.col("text"), F.col("__piece")))
    return out.withColumn("text", text).select(*cols)
