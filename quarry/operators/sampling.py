"""Bounded samples that keep every kind, evidence windows of bounded length, and places in a total order of any columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quarry.operators.history import text_search
from quarry.plans.session import materialize
from quarry.plans.views import table


def leading(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each key with their place `nth`, at most so many a key.

    Every task drops all but its own first rows of a key before the shuffle (a group limit below
    the exchange), so that what travels is bounded by tasks x keys x most, and a hot key is no load.
    """
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= most)


def diverse(df: DataFrame, row: str, keys: list[str], order: list[Column], most: int = 96) -> DataFrame:
    """(row, turn): at most so many rows, the first of every value of every key before the second of any.

    A row's turn is its best place among the rows of one of its key values; rows are taken by turn,
    then by order, which is total (end it with the row). A key column may be an array: a row
    counts for each element, and an empty or null array is a value of its own. Null is a value too.
    No more than `most` rows of a value can be taken, so only these leave their tasks. A row id that
    comes twice is told once.
    """
    found = None
    for k in keys:
        value = F.explode_outer(k) if isinstance(df.schema[k].dataType, ArrayType) else F.col(k)
        one = leading(df.withColumn("_v", value), "_v", order, most).select(F.col(row).alias("_row"), "nth")
        found = one if found is None else found.unionAll(one)
    turns = found.groupBy("_row").agg(F.min("nth").cast("long").alias("turn"))  # keys x values x most rows at most
    rows = df.join(turns, F.col(row) == F.col("_row")).drop("_row").dropDuplicates([row])
    return rows.orderBy("turn", *order).limit(most)


def evidence_windows(hits: DataFrame, path: str, line: str, category: str, reach: int = 4, most: int = 16) -> DataFrame:
    """(path, start_line, end_line, hits, categories): hits no more than `reach` lines apart share a window of at most `most` lines.

    Longer runs are cut every `most` lines from their first hit. Hits of one line and category count
    once; null paths or lines are no hits. The lines of one path with hits are put in order by one
    task: no more than the lines of that file, however many hits they have.
    """
    lines = hits.where(F.col(path).isNotNull() & F.col(line).isNotNull()).groupBy(F.col(path).alias("path"), F.col(line).cast("long").alias("line")).agg(F.collect_set(category).alias("c"))
    w = Window.partitionBy("path").orderBy("line")
    fresh = F.when(F.col("line") - F.lag("line").over(w) <= reach, 0).otherwise(1)
    runs = lines.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min("line").over(Window.partitionBy("path", "_run"))
    cut = F.floor((F.col("line") - first) / most)
    agg = runs.withColumn("_cut", cut).groupBy("path", "_run", "_cut").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sum(F.size("c")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("categories"))
    return agg.drop("_run", "_cut")


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in an order of any columns (collations too), without a window over all rows.

    Rows are sorted by ranges, numbered within their partition, and the sizes of the partitions
    (a row each) are summed up in front of them. Equal rows get places in no stated order.
    """
    rows = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    before = sizes.select("_p", F.coalesce(ahead, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), part == F.col("_p")).withColumn(name, F.col("_before") + inside + 1).drop("_m", "_p", "_before")


def diverse_documents(spark: SparkSession, sf_dir: str, most: int = 96) -> DataFrame:
    """At most 96 documents: the longest of every source and language first, then the next ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")
    return diverse(docs, "doc_id", ["source", "lang"], [F.desc("n_chars"), F.col("doc_id")], most).select("doc_id", "source", "lang", "turn")


#: Words of the corpus that stand for categories of risk.
MARKS = {"article": "(?:^| )(?:the|die|le|la)(?: |$)", "joint": "(?:^| )(?:and|und|et)(?: |$)", "place": "(?:^| )(?:of|von|de)(?: |$)"}


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, category): words that stand for categories; a line is a sentence, as the texts have few line feeds."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), r"[.\n]")).alias("line", "t"))
    kinds = F.array_compact(F.array(*[F.when(F.col("t").rlike(p), k) for k, p in MARKS.items()]))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.explode(kinds).alias("category"))


def risk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence windows over the marked lines of all documents, of at most four lines."""
    found = evidence_windows(marked_lines(spark, sf_dir), "doc_id", "line", "category", 1, 4)
    return found.select(F.col("path").alias("doc_id"), "start_line", "end_line", "hits", F.array_join("categories", ",").alias("categories"))


def risk_inventory(spark: SparkSession, sf_dir: str, most: int = 96) -> DataFrame:
    """At most 96 evidence windows that keep every category and as many documents as there is room for, those with most hits first."""
    found = evidence_windows(marked_lines(spark, sf_dir), "doc_id", "line", "category", 1, 4).withColumn("window", F.concat_ws(":", "path", "start_line"))
    rows = diverse(found, "window", ["categories", "path"], [F.desc("hits"), F.col("path"), F.col("start_line")], most)
    return rows.select(F.col("path").alias("doc_id"), "start_line", "hits", "turn")


def collated_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the distinct first words of texts and of part names in the order of a Unicode collation: accents and case come after letters."""
    words = table(spark, sf_dir, "documents").select(F.regexp_extract("text", r"^[^ \n]+", 0).alias("name")).union(table(spark, sf_dir, "part").select("p_name")).where("name <> ''").distinct()
    return placed(words, [F.collate("name", "UNICODE"), F.col("name")])


def folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold SCHSS or ÉTÉ without regard to case, by full folding: schß does."""
    docs = table(spark, sf_dir, "documents")
    return docs.where(text_search("SCHSS", "text") | text_search("ÉTÉ", "text")).select("doc_id", text_search("SCHSS", "text").alias("sharp"))


QUERIES = {f.__name__: f for f in (diverse_documents, risk_windows, risk_inventory, collated_order, folded_search)}
_MARKED = "l AS (SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[.\\n]') AS l FROM documents)), m AS (" + " UNION ALL ".join(f"SELECT doc_id, line, '{k}' AS category FROM l WHERE regexp_matches(t, '{p}')" for k, p in MARKS.items()) + ")"
_WINDOWS = f"""{_MARKED}, a AS (SELECT doc_id, line, list(DISTINCT category) AS c FROM m GROUP BY ALL), n AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) <= 1 THEN 0 ELSE 1 END AS fresh FROM a),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM n), f AS (SELECT *, (line - min(line) OVER (PARTITION BY doc_id, run)) // 4 AS cut FROM r),
  w AS (SELECT doc_id, min(line) AS start_line, max(line) AS end_line, CAST(sum(len(c)) AS BIGINT) AS hits, list_sort(list_distinct(flatten(list(c)))) AS categories FROM f GROUP BY doc_id, run, cut)"""
ORACLES = {
    "diverse_documents": """WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_chars FROM documents), r AS (SELECT *, least(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id), row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id)) AS turn FROM d)
      SELECT doc_id, source, lang, turn FROM r ORDER BY turn, n_chars DESC NULLS LAST, doc_id LIMIT 96""",
    "risk_windows": f"WITH {_WINDOWS} SELECT doc_id, start_line, end_line, hits, array_to_string(categories, ',') AS categories FROM w",
    "risk_inventory": f"""WITH {_WINDOWS}, e AS (SELECT doc_id, start_line, hits, unnest(categories) AS k FROM w UNION ALL SELECT doc_id, start_line, hits, 'document ' || doc_id FROM w),
      t AS (SELECT doc_id, start_line, hits, row_number() OVER (PARTITION BY k ORDER BY hits DESC, doc_id, start_line) AS nth FROM e) SELECT doc_id, start_line, hits, min(nth) AS turn FROM t GROUP BY ALL ORDER BY turn, hits DESC, doc_id, start_line LIMIT 96""",
    "collated_order": "WITH n AS (SELECT regexp_extract(text, '^[^ \\n]+') AS name FROM documents UNION SELECT p_name FROM part) SELECT name, row_number() OVER (ORDER BY name COLLATE en_us, name) AS place FROM n WHERE name <> ''",
    "folded_search": "WITH d AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents) SELECT doc_id, contains(t, 'schss') AS sharp FROM d WHERE contains(t, 'schss') OR contains(t, 'été')",
}
