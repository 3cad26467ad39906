"""Exact dedup with a persistent digest index (DataFrame functions only)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii, maybe_broadcast, read_table

#: A digest with at least this share of the rows is joined by broadcast; at most 1 / HOT_SHARE digests have it.
HOT_SHARE = 1e-4
#: Rows of the first batch in a bucket of a new index, and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 16


def normalised(text):
    return lower_ascii(F.coalesce(text.cast("string"), F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A table of text digests, bucketed and sorted by digest, that outlives the session's data frames.

    A batch appends a row per distinct text of it: digest (32 bytes), doc_id (of the row that stands for the text; null
    where an earlier batch had it), n_rows (rows with this text in the batch), batch. ``add`` deduplicates a batch
    against itself and, by a sort-merge join on the bucketed digest, against all earlier batches. The number of buckets
    follows the first batch's rows; a task reads one bucket, sorted.
    """

    def __init__(self, spark: SparkSession, table: str, rows: int = 0, buckets: int | None = None):
        self.spark, self.table = spark, table
        if spark.catalog.tableExists(table):
            described = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").first()
            self.buckets = int(described["data_type"])
        else:
            self.buckets = buckets or max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
            self._write(spark.createDataFrame([], "digest binary, doc_id long, n_rows long, known boolean, batch long"))

    def _write(self, df: DataFrame) -> None:
        (df.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table))

    def read(self) -> DataFrame:
        """digest, doc_id, n_rows (of all batches) per text."""
        stands = F.min_by("doc_id", F.when(~F.col("known"), F.col("batch")))
        return self.spark.table(self.table).groupBy("digest").agg(stands.alias("doc_id"), F.sum("n_rows").alias("n_rows"))

    def add(self, rows: DataFrame) -> None:
        """Append a batch (doc_id, digest). Of its equal texts that no earlier batch had, the largest doc_id stands for all."""
        at = (self.spark.table(self.table).agg(F.max("batch")).first()[0] or 0) + 1
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"))
        if at > 1:
            had = self.spark.table(self.table).filter("NOT known").select("digest").hint("merge")
            new = groups.join(had, "digest", "left_anti").withColumn("known", F.lit(False))
            again = groups.join(had, "digest", "left_semi").select("digest", F.lit(None).cast("long").alias("doc_id"), "n_rows", F.lit(True).alias("known"))
            groups = new.unionByName(again)
        else:
            groups = groups.withColumn("known", F.lit(False))
        self._write(groups.withColumn("batch", F.lit(at).cast("long")))

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, digest) with keep_id (of the row that stands for the text) and n_rows.

        Digests with a HOT_SHARE of the indexed rows are joined by broadcast (at most 1 / HOT_SHARE of them
        exist, whatever the input), so that a huge group of copies doesn't meet in one task; the others by merge join.
        """
        index = self.read().withColumnRenamed("doc_id", "keep_id")
        total = self.spark.table(self.table).agg(F.sum("n_rows")).first()[0] or 0
        hot = F.broadcast(checkpointed(index.filter(F.col("n_rows") > max(100, total * HOT_SHARE))))
        cold = rows.join(hot, "digest", "left_anti").join(index.hint("merge"), "digest")
        return rows.join(hot, "digest").unionByName(cold)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _looked_up(batches: list[DataFrame], table: str | None) -> DataFrame:
    """doc_id, digest, keep_id, n_rows of all batches' rows after adding one batch after the other. An index without a name goes again."""
    spark = batches[0].sparkSession
    rows = batches[0]
    for x in batches[1:]:
        rows = rows.unionByName(x)
    index = DigestIndex(spark, table or f"digest_index_{uuid.uuid4().hex}", rows.count())
    for x in batches:
        index.add(x)
    out = index.lookup(rows)
    if table is None:
        out = checkpointed(out)
        index.drop()
    return out


def _result(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "keep_id", F.col("n_rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, table: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of equal texts the
    row with the largest doc_id stays. With ``table``, texts already in that index are dropped in favour of
    the indexed row, new ones are appended to it, and group_size counts the rows of all batches; without, a fresh index
    serves this call. Null doc_id: such a row is dropped when any row with an id has its text, and otherwise it stays
    (keep_id null). Of repeated rows (same id and text) all show kept = true, as they can't be told apart; ``survivors``
    keeps one of them. Other columns are ignored. An empty table gives an empty result.
    """
    return _result(_looked_up([checkpointed(digests(docs))], table))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of repeated rows one.

    What goes is found by ids and digests alone, so that texts needn't move where copies are few.
    """
    rows = checkpointed(digests(docs))
    found = _looked_up([rows], None)
    key = ["doc_id", "digest"]
    twice = checkpointed(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key))
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*key).unionByName(twice).distinct()

    def meet(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        digest = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
        b = b.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        return a.join(maybe_broadcast(b), (digest == F.col("_digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), how)

    stay = meet(docs, checkpointed(gone), "left_anti")
    if twice.isEmpty():
        return stay
    kept = twice.join(found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("digest").distinct(), "digest", "left_semi")
    again = meet(docs, checkpointed(kept), "left_semi")
    again = again.withColumn("_key", F.sha2(normalised(F.col("text")).cast("binary"), 256)).dropDuplicates(["doc_id", "_key"]).drop("_key")
    return stay.unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as two batches, the upper half of the ids first, so that the second meets an index."""
    rows = checkpointed(digests(read_table(spark, sf_dir, "documents")))
    half = F.lit(rows.agg(((F.min("doc_id") + F.max("doc_id")) / 2).cast("long")).first()[0])
    upper = F.coalesce(F.col("doc_id") > half, F.lit(False))
    return _result(_looked_up([rows.filter(upper), rows.filter(~upper)], None))


SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM n
"""
