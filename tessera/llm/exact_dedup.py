"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a table of one row per distinct text, bucketed and sorted by
digest, so that a batch of new digests meets it in a sort-merge anti-join
without moving the index.  Everything runs on DataFrame functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, join_groups, path_text, scratch_path, written

#: Buckets of a new index at least; more where the session shuffles into more parts.
INDEX_BUCKETS = 64
INDEX_SCHEMA = "digest STRING, keep_id BIGINT, group_size BIGINT"


def normalised(text: str | Column = "text") -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SPACES}]+", " ")


def text_digest(text: str | Column = "text") -> Column:
    """Lowercase hex SHA-256 of the normalised text; null counts as empty."""
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """One row per distinct text seen so far: digest, keep_id, group_size.

    ``path`` lies in shared storage and outlives the session.  A new index has
    as many ``buckets`` as the session's shuffles have parts, which should follow
    the size of what it is to hold; the number is kept beside the data, and a
    later session that asks for another one is refused.  ``group_size`` of a digest
    counts the batch that brought it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        known = path_text(spark, f"{path}/_buckets")
        if known and buckets not in (None, int(known)):
            raise ValueError(f"the index at {path} has {known} buckets, not {buckets}")
        buckets = int(known) if known else buckets or max(INDEX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not known:
            path_text(spark, f"{path}/_buckets", str(buckets))
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"tessera_digests_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> DataFrame:
        """Add the digests that the index lacks; returns them (a written table)."""
        fresh = written(groups.join(self.read().hint("merge"), "digest", "left_anti"), "digest-new")
        (
            fresh.select("digest", "keep_id", "group_size").write.format("parquet").mode("append")
            .option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)
        return fresh

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest_groups(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of (doc_id, digest), combined before the shuffle."""
    return digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def dedup_report(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest doc_id stays, within this batch and against
    what the index held before: a text that the index knows keeps the index's
    keep_id, and all its new copies go.  Null texts count as empty; null ids lose
    to any other id; rows that repeat an id and text all carry that id's answer;
    an empty table gives an empty report.
    """
    spark = docs.sparkSession
    digests = written(docs.select("doc_id", text_digest().alias("digest")), "digests")
    own = index or DigestIndex(spark, scratch_path(spark, "digest-index"))
    groups = written(digest_groups(digests), "digest-groups")
    fresh = own.append(groups)
    if index is None:
        known = fresh
        own.close()
        known = known.withColumn("old", F.lit(False))
    else:
        new = fresh.select("digest").withColumn("new", F.lit(True))
        known = groups.join(new, "digest", "left").join(own.read().select("digest", F.col("keep_id").alias("old_id")), "digest", "left")
        known = known.select("digest", F.col("old_id").alias("keep_id"), "group_size", F.col("new").isNull().alias("old"))
        known = written(known, "digest-known")
    out = join_groups(digests, known, "digest", "group_size", "inner")
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (~F.col("old") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all columns of ``docs``; one row for each text.

    Rows that repeat both id and text leave one row.  The join is on digest and
    id together, so a group of copies, however large, is spread over all tasks.
    """
    keep = dedup_report(docs, index).where("kept").select(F.col("text_sha256").alias("__digest"), F.col("doc_id").alias("__keep")).distinct()
    # any column may break ties between rows of equal id and text, nested ones by their JSON
    marked = docs.withColumn("__d", text_digest())
    kept = marked.join(keep, (F.col("__d") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__keep")), "left_semi")
    nested = lambda kind: kind.startswith(("map", "struct", "array", "variant"))
    others = [F.to_json(F.struct(F.col(f"`{c}`"))) if nested(kind) else F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text")]
    once = Window.partitionBy("__d", "doc_id").orderBy(*(others or [F.lit(0)]))
    return kept.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*docs.columns)
