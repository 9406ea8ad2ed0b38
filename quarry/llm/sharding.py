"""Contiguous shards of near equal bytes from global prefix sums.

Rows are cut into consecutive buckets of doc_id. Bucket totals (one row each, summed before the
shuffle) are added up in order; inside a bucket a running sum, sorted by one task, places each
row. A row goes to the shard in which the middle of its bytes falls, so shards are contiguous in
doc_id and differ by about one row's size. A second round of bucket totals numbers the rows of
each shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import renamed, table

SHARDS = 16
#: Rows of a bucket, about; a bucket's rows are sorted by one task.
BUCKET_ROWS = 20_000
#: Buckets at most; only their totals meet in one place.
MAX_BUCKETS = 10_000


def bucket_bounds(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Increasing first ids of all buckets but the first, from approximate quantiles."""
    n = docs.agg(F.count("doc_id")).first()[0]
    k = min(MAX_BUCKETS, -(-n // bucket_rows))
    if k < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(10_000, 4 * k))).first()[0]
    return sorted(set(found))


def shard_by_bytes(docs: DataFrame, n_shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs, and before them the columns in keep.

    Size is the text's UTF-8 bytes plus 1 (null text: 1, crc32 0). Rows are ordered by doc_id
    (null first), then size, crc32 and a hash of the text; equal rows are interchangeable. Slots
    count from 0 in each shard in that order. Texts of any length count whole. An empty table gives
    no rows; of the other columns of docs those in keep stay, as `<name>_in` where the result has a
    column of that name itself.
    """
    kept = [c for c in keep or [] if c != "doc_id"]
    own = {c: f"_kept_{i}" for i, c in enumerate(kept)}
    names = renamed(kept, ["doc_id", "size", "text_crc32", "shard", "slot"])
    rows = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in own.items()],
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("h"),
    )
    bounds = bucket_bounds(docs.select(F.col("doc_id").cast("long")), bucket_rows)
    # the number of bounds at or below the id, by halving the sorted list
    bucket = F.lit(0)
    if bounds:
        held = F.array(*[F.lit(b) for b in bounds])
        state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

        def halve(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            right = F.element_at(held, F.least(mid + 1, F.lit(len(bounds)))) <= F.col("doc_id")
            over = s["lo"] >= s["hi"]
            return F.struct(F.when(over | ~right, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(over | right, s["hi"]).otherwise(mid).alias("hi"))

        steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.aggregate(steps, state, halve)["lo"])
    rows = rows.withColumn("bucket", bucket.cast("int"))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("bucket").agg(F.sum("size").alias("t"))  # one row a bucket, MAX_BUCKETS at most
    whole = Window.partitionBy(F.lit(1))
    starts = totals.select("bucket", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("before"), F.sum("t").over(whole).alias("total"))
    inside = Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32", "h")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("upto", upto).join(F.broadcast(starts), "bucket")
    middle = F.expr(f"((2 * (before + upto) - size) * {n_shards}) div (2 * total)")  # exact up to 10^17 bytes
    placed = placed.withColumn("shard", F.least(middle, F.lit(n_shards - 1)).cast("int"))
    in_shard = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("k"))  # buckets + shards rows at most
    offsets = counts.select("bucket", "shard", F.coalesce(F.sum("k").over(in_shard), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "size", "text_crc32", "h"))
    numbered = placed.withColumn("nth", nth).join(F.broadcast(offsets), ["bucket", "shard"])
    slot = (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot")
    made = {"doc_id": F.col("doc_id"), "size": F.col("size"), "text_crc32": F.col("text_crc32"), "shard": F.col("shard"), "slot": slot}
    return numbered.select(*[F.col(k).alias(names[c]) for c, k in own.items()], *made.values())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_by_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no CRC-32: it is folded over the bytes with the polynomial 0xEDB88320.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT n, c FROM (
    WITH RECURSIVE t(n, c, k) AS (
      SELECT CAST(n AS BIGINT), CAST(n AS BIGINT), 0 FROM range(256) AS r(n)
      UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8
    ) SELECT n, c FROM t WHERE k = 8)
), tab AS (SELECT list(c ORDER BY n) AS l FROM crc_table
), hexed AS (SELECT rowid AS r, doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
), bytes AS (
  SELECT r, doc_id, CAST(length(h) // 2 AS BIGINT) + 1 AS size,
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(h) // 2), lambda i: CAST(('0x' || h[2 * i + 1 : 2 * i + 2]) AS BIGINT))) AS b FROM hexed
), summed AS (
  SELECT doc_id, size, xor(list_reduce(b, lambda c, x: xor(l[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM bytes, tab
), run AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM summed
), cut AS (
  SELECT *, CAST(least(((2 * upto - size) * 16) // (2 * total), 15) AS INTEGER) AS shard FROM run
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""
