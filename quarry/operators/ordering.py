"""Row numbers within keys of any size, and the queries that need a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import views
from quarry.plans.session import materialize
from quarry.plans.views import table

#: Rows of a range, about, that one task sorts; ranges at most.
RANGE_ROWS, MAX_RANGES = 200_000, 2000


def numbered(df: DataFrame, keys: list[str], order: list[Column], by: Column, name: str = "nth", range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with each row's place (from 1) within its keys, in a total order that begins with the number `by`.

    Rows are cut into ranges of `by`; a key's ranges are counted first and the counts summed up in
    front of each, so a key with a large share of all rows is sorted by many tasks. Null numbers
    come first. Ranges are as even as the values of `by` are.
    """
    rows = df.withColumn("_by", by.cast("double"))
    k = min(MAX_RANGES, -(-rows.count() // range_rows))
    part = F.lit(0)
    if k > 1:
        bounds = sorted(set(rows.agg(F.percentile_approx("_by", [i / k for i in range(1, k)], 10_000)).first()[0] or []))
        part = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= F.col("_by")))
        part = F.when(F.col("_by").isNull(), 0).otherwise(part)
    rows = rows.withColumn("_part", part.cast("int"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    if k <= 1:
        return rows.withColumn(name, inside.cast("long")).drop("_by", "_part")
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))  # MAX_RANGES rows a key at most
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    placed = rows.withColumn("_in", inside).join(offsets, same)
    return placed.withColumn(name, F.col("_in") + F.col("_before")).drop("_by", "_part", "_p", "_in", "_before", *[f"_k_{c}" for c in keys])


def rank_top_percent(spark: SparkSession, sf_dir: str, percent: int = 10) -> DataFrame:
    """The leading percent (one at least) of each source's documents by length, then id; only those marked where any is.

    A document is marked if its label has quality 1.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    marks = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("m")).distinct()
    docs = docs.join(marks, F.col("doc_id") == F.col("m"), "left").withColumn("mark", F.col("m").isNotNull()).drop("m")
    counts = docs.groupBy(F.col("source").alias("s")).agg(F.count_if("mark").alias("marked"), F.count("*").alias("all"))  # a row a source
    docs = docs.join(counts, F.col("source").eqNullSafe(F.col("s"))).where("mark OR marked = 0").withColumn("n", F.when(F.col("marked") > 0, F.col("marked")).otherwise(F.col("all")))
    rows = numbered(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], -F.col("n_chars"), "rank")
    return rows.where(F.col("rank") <= F.greatest(F.lit(1), F.expr(f"n * {percent} div 100"))).select("source", "doc_id", "rank")


def dealt(spark: SparkSession, sf_dir: str, slots: int = 6) -> DataFrame:
    """(source, doc_id, worker): documents of a source dealt in turn to its workers, no more than it has rows."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    counts = docs.groupBy(F.col("source").alias("s")).agg(F.least(F.count("*"), F.lit(slots)).alias("workers"))
    rows = numbered(docs, ["source"], [F.col("doc_id")], F.col("doc_id")).join(counts, F.col("source").eqNullSafe(F.col("s")))
    return rows.select("source", "doc_id", ((F.col("nth") - 1) % F.col("workers")).cast("long").alias("worker"))


def rank_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir)


def rank_plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a plan gets wrong against the dealt one: documents missing, given twice, unknown, or given to another worker."""
    right = dealt(spark, sf_dir)
    plan = right.where("doc_id % 23 <> 0").withColumn("worker", F.when(F.col("doc_id") % 29 == 0, F.col("worker") + 1).otherwise(F.col("worker")))
    plan = plan.unionAll(plan.where("doc_id % 31 = 0")).unionAll(plan.where("doc_id % 37 = 0").withColumn("doc_id", -F.col("doc_id") - 1)).select("doc_id", "worker")
    given = plan.groupBy("doc_id").agg(F.count("*").alias("times"), F.min("worker").alias("given"))
    both = right.select("doc_id", F.col("worker").alias("due")).join(given, "doc_id", "full_outer")
    fault = F.when(F.col("due").isNull(), "unexpected").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "duplicate").when(F.col("due") != F.col("given"), "misplaced")
    return both.select("doc_id", fault.alias("fault")).where("fault IS NOT NULL")


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global ids of the distinct supplier and part pairs, in their order."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    found = numbered(rows, [], [F.col("l_suppkey"), F.col("l_partkey")], F.col("l_suppkey"))
    return found.select("l_suppkey", "l_partkey", F.concat(F.lit("seed-"), F.lpad(F.col("nth").cast("string"), 7, "0")).alias("id"))


def uniquely_named(rows: DataFrame, base: str, order: list[str], by: Column, name: str = "name") -> DataFrame:
    """rows with a name each: base, or base with the first of `-2`, `-3` and on that no earlier row has taken.

    order is total and begins with the number `by`. A row that finds its name taken by an earlier one
    tries the next number, with the later rows of its base; names that only rows of one base ask
    for are right at once, so rounds are as many as names of different bases run into each other.
    """
    now = materialize(numbered(rows, [base], [F.col(c) for c in order], by, "_nth").withColumn("_k", F.col("_nth")))
    wanted = F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.col("_k").cast("string")))
    place = F.struct(*order)
    while True:
        asked = now.withColumn(name, wanted)
        taken = asked.groupBy(name).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        late = asked.join(taken, name).where(place != F.col("_first")).groupBy(base, "_nth").agg(F.max(F.col("_k") + 1 - F.col("_nth")).alias("_shift"))
        late = materialize(late)
        if not late.take(1):
            return asked.drop("_nth", "_k")
        # a shift holds for the row and all that follow of its base; between two late rows lies a range of numbers
        steps = late.groupBy(base).agg(F.array_sort(F.collect_list(F.struct("_nth", "_shift"))).alias("_steps"))
        moved = now.join(steps, base, "left")
        shift = F.array_max(F.transform(F.filter("_steps", lambda s: s["_nth"] <= F.col("_nth")), lambda s: s["_shift"]))
        now = materialize(moved.withColumn("_k", F.greatest("_k", F.col("_nth") + F.coalesce(shift, F.lit(0)))).drop("_steps"))


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of part names made unique by `-2`, `-3` and on."""
    rows = table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("base"))
    return uniquely_named(rows, "base", ["p_partkey"], F.col("p_partkey")).select("p_partkey", "name")


def line_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occurred before in their text, and for which time they do now."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("line")).cast("long")
    rows = lines.select("doc_id", F.col("line").cast("long").alias("line"), F.md5("t").alias("h")).withColumn("nth", nth)
    return rows.where("nth > 1").select("doc_id", "line", "nth")


def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line windows of each path with overlapping ones made one."""
    loc = views.located(views.occurrences(spark, sf_dir), spark, sf_dir).where("path IS NOT NULL").select("path", "start_line", "end_line").distinct()
    w = Window.partitionBy("path").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = loc.withColumn("new", F.when(F.col("start_line") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("path", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n")).drop("island")


def diverse_sample(spark: SparkSession, sf_dir: str, most: int = 96) -> DataFrame:
    """At most 96 documents: the longest of every source and language first, then the next ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")
    first = [F.desc("n_chars"), F.col("doc_id")]
    rows = numbered(docs, ["lang"], first, -F.col("n_chars"), "in_lang")
    rows = numbered(rows, ["source"], first, -F.col("n_chars"), "in_source")
    chosen = rows.withColumn("turn", F.least("in_lang", "in_source"))
    return chosen.orderBy("turn", F.desc("n_chars"), "doc_id").limit(most).select("doc_id", "source", "lang", "turn")


def capped_gaps(spark: SparkSession, sf_dir: str, most: int = 256) -> DataFrame:
    """Documents without a label, the first 256 by id, each with how many there are and how many were left out."""
    gaps = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_anti")
    whole = gaps.agg(F.count("*").alias("total"))  # one row
    return gaps.orderBy("doc_id").limit(most).crossJoin(F.broadcast(whole)).withColumn("omitted", F.greatest(F.lit(0), F.col("total") - most))


def activity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty scans: running ones first, then by last activity, start and id."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    active = F.greatest("o_orderdate", F.coalesce("shipped", "o_orderdate"))
    rows = rows.select(F.col("o_orderkey").alias("scan_id"), (F.col("o_orderstatus") == "O").alias("running"), active.alias("active_at"), "o_orderdate")
    return rows.orderBy(F.desc("running"), F.desc("active_at"), F.desc("o_orderdate"), "scan_id").limit(20).drop("o_orderdate")


def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the distinct part names and brands without regard to case; a few hundred values."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "part").select(F.upper("p_type"))).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(F.collate("name", "UTF8_LCASE"), "name")).cast("long").alias("place"))


def shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard files whose number is not their place: names must count from 1 without a gap; files of one folder."""
    files = table(spark, sf_dir, "part").where("p_partkey % 41 <> 7").select("p_brand", F.concat(F.lit("shard-"), F.lpad((F.expr("p_partkey div 25") + 1).cast("string"), 6, "0"), F.lit(".jsonl")).alias("file"), "p_partkey")
    files = files.groupBy("p_brand", "file").agg(F.min("p_partkey").alias("first"))
    rows = files.withColumn("number", F.regexp_extract("file", r"shard-0*(\d+)\.jsonl$", 1).cast("long")).withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy("number")).cast("long"))
    return rows.where("number <> place").select("p_brand", "file", "number", "place")


QUERIES = {f.__name__: f for f in (rank_top_percent, rank_round_robin, rank_plan_check, sequence_ids, unique_names, line_occurrences, merged_windows, diverse_sample, capped_gaps, activity_page, locale_order, shard_names)}
_DEALT = "dealt AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % least(count(*) OVER (PARTITION BY source), 6) AS worker FROM documents)"
ORACLES = {
    "rank_top_percent": """WITH m AS (SELECT d.*, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS mark FROM documents d), k AS (SELECT * FROM (SELECT *, count(*) FILTER (mark) OVER (PARTITION BY source) AS marked FROM m) WHERE mark OR marked = 0)
      SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM k) WHERE rank <= greatest(1, n * 10 // 100)""",
    "rank_round_robin": f"WITH {_DEALT} SELECT * FROM dealt",
    "rank_plan_check": f"""WITH {_DEALT}, a AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN worker + 1 ELSE worker END AS worker FROM dealt WHERE doc_id % 23 <> 0), p AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE doc_id % 31 = 0 UNION ALL SELECT -doc_id - 1, worker FROM a WHERE doc_id % 37 = 0),
      g AS (SELECT doc_id, count(*) AS times, min(worker) AS given FROM p GROUP BY 1), f AS (SELECT coalesce(d.doc_id, g.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'unexpected' WHEN times IS NULL THEN 'missing' WHEN times > 1 THEN 'duplicate' WHEN d.worker <> given THEN 'misplaced' END AS fault FROM dealt d FULL JOIN g ON d.doc_id = g.doc_id) SELECT * FROM f WHERE fault IS NOT NULL""",
    "sequence_ids": "SELECT l_suppkey, l_partkey, 'seed-' || lpad(CAST(row_number() OVER (ORDER BY l_suppkey, l_partkey) AS VARCHAR), 7, '0') AS id FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)",
    "unique_names": "WITH b AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9._/-]+', '-', 'g'), '^[._/-]+|[._/-]+$', '', 'g') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS nth FROM b) SELECT p_partkey, CASE WHEN nth = 1 THEN base ELSE base || '-' || nth END AS name FROM n",
    "line_occurrences": "WITH l AS (SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)), n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, t ORDER BY line) AS nth FROM l) SELECT * FROM n WHERE nth > 1",
    "merged_windows": f"""WITH {views.SQL}, w AS (SELECT DISTINCT path, start_line, end_line FROM loc WHERE path IS NOT NULL), r AS (SELECT *, max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
      i AS (SELECT *, sum(CASE WHEN start_line <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY start_line, end_line) AS island FROM r) SELECT path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS n FROM i GROUP BY path, island""",
    "diverse_sample": """WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_chars FROM documents), r AS (SELECT *, least(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id), row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id)) AS turn FROM d)
      SELECT doc_id, source, lang, turn FROM r ORDER BY turn, n_chars DESC NULLS LAST, doc_id LIMIT 96""",
    "capped_gaps": "WITH g AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT doc_id, (SELECT count(*) FROM g) AS total, greatest(0, (SELECT count(*) FROM g) - 256) AS omitted FROM g ORDER BY doc_id LIMIT 256",
    "activity_page": "SELECT o_orderkey AS scan_id, o_orderstatus = 'O' AS running, greatest(o_orderdate, coalesce(s, o_orderdate)) AS active_at FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY 2 DESC, 3 DESC, o_orderdate DESC, 1 LIMIT 20",
    "locale_order": "SELECT name, row_number() OVER (ORDER BY lower(name), name) AS place FROM (SELECT p_name AS name FROM part UNION SELECT upper(p_type) FROM part)",
    "shard_names": "WITH f AS (SELECT DISTINCT p_brand, p_partkey // 25 + 1 AS number FROM part WHERE p_partkey % 41 <> 7), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY number) AS place FROM f) SELECT p_brand, 'shard-' || lpad(CAST(number AS VARCHAR), 6, '0') || '.jsonl' AS file, number, place FROM r WHERE number <> place",
}
