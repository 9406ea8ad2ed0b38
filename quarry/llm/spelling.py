"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask holds, for each letter, whether the word has it an odd number of times; one edit
flips at most two bits. The bits are split into three bands, so two words one edit apart agree in
a band at least, and words that agree in a band and differ in length by at most one are verified.
The more words there are, the more often the bits outside a band, of which two at most differ, are
split into three bands again, one of which agrees: a key is a band of bands, and a pair is taken
at the first key in which it agrees. Words that crowd in a key all the same (masks tell little of
words of few letters) are joined on the words that are left when a code point is deleted, which
is as exact, and linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.plans.session import materialize

#: Runs of letters, and the mask's bits: a to z, then U+00C0 to U+00FF in turn on those that are left.
LETTERS = r"[A-Za-z\u00C0-\u00FF]+"
BITS = 60
#: Words of a key and a length that are compared with each other at most.
GROUP_WORDS = 1000
#: More words than these split bands once and twice.
SPLIT_WORDS = (20_000, 4_000_000)
#: Rules of a word: code points and occurrences at least, times that its form is as frequent at least.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 5, 3, 2
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, slip: int | None = None) -> DataFrame:
    """(doc_id, word): every run of letters of text, A to Z lower-cased; null texts have none.

    With slip, a word loses the code point at h % length where slip divides h, the CRC-32 of
    `<doc_id>:<word>` (a null id is empty there).
    """
    own = docs.select(F.col("doc_id").cast("long"), F.explode(F.regexp_extract_all(F.translate("text", _CAPITALS, _SMALL), F.lit(LETTERS), F.lit(0))).alias("word"))
    if slip is None:
        return own
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = F.col("h") % F.length("word")
    cut = F.concat(F.substring("word", F.lit(1), at.cast("int")), F.substring("word", (at + 2).cast("int"), F.length("word")))
    return own.withColumn("h", h).select("doc_id", F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(found: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of found (word) that are long and frequent enough; null words do not count."""
    kept = found.where(F.length("word") >= least_length)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def parity_mask(word: Column) -> Column:
    """The parities of a word's letters, a bit each; letters beyond U+00FF share bits too."""
    bit = lambda c: F.when(F.ascii(c) < 128, F.pmod(F.ascii(c) - 97, F.lit(26))).otherwise(26 + F.pmod(F.ascii(c) - 192, F.lit(BITS - 26)))
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    # call_function, as F.shiftleft takes a plain number of places alone
    return F.aggregate(letters, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))))


def band_keys(levels: int, bits: tuple[int, ...] = tuple(range(BITS))) -> list[int]:
    """Masks of bands, split levels times; whichever two bits differ, two words agree in one of them."""
    bands = [bits[i::3] for i in range(3)]
    below = lambda i: band_keys(levels - 1, tuple(b for b in bits if b not in bands[i])) if levels else [0]
    return [sum(1 << b for b in bands[i]) | more for i in range(3) for more in below(i)]


def _by_deletion(words: DataFrame) -> DataFrame:
    """Pairs of words (word, n) one edit apart, by the words that deletions leave."""
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    left = F.concat(F.substring("word", F.lit(1), F.col("at") - 1), F.substring("word", F.col("at") + 1, F.length("word"))).alias("left")
    cut = words.select("word", "n", at).select("word", "n", "at", left)
    names = [F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")]
    # a word of the other length, or the same place of both words
    longer = words.alias("a").join(cut.dropDuplicates(["word", "left"]).alias("b"), F.col("a.word") == F.col("b.left"))
    place = (F.col("a.left") == F.col("b.left")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.word") < F.col("b.word"))
    return longer.select(*names).unionAll(cut.alias("a").join(cut.alias("b"), place).select(*names))


def near_words(words: DataFrame, group_words: int = GROUP_WORDS, levels: int | None = None) -> DataFrame:
    """(word, n, other, other_n): for every word of words (word, n), all words one edit apart.

    An edit inserts, deletes or replaces one code point, so a pair comes in both directions. Words
    are distinct and not null; an empty table gives no pairs. No pair is lost, however many words
    share letters. levels is how often bands are split (None: as the number of words asks).
    """
    if levels is None:
        n = words.count()
        levels = sum(n > most for most in SPLIT_WORDS)
    masks = band_keys(levels)
    keys = F.posexplode(F.array(*[F.col("mask").bitwiseAND(F.lit(m)) for m in masks])).alias("key", "value")
    rows = words.select("word", "n", F.length("word").alias("length"), parity_mask(F.col("word")).alias("mask"))
    held = rows.select("*", keys).repartition("key", "value")
    alike = Window.partitionBy("key", "value")
    sized = held.withColumn("same", F.count("*").over(Window.partitionBy("key", "value", "length")))
    sized = sized.withColumn("most", F.max("same").over(alike)).drop("same")
    light, crowded = sized.where(F.col("most") <= group_words), sized.where(F.col("most") > group_words)
    a = light.select("key", "value", F.struct("word", "n", "mask").alias("a"), F.col("length").alias("meets"))
    b = light.select("key", "value", F.struct("word", "n", "mask").alias("b"), "length", F.explode(F.array("length", F.col("length") - 1)).alias("meets"))
    met = a.join(b, ["key", "value", "meets"])
    flips = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    first = F.coalesce(*[F.when(flips.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)])
    order = (F.col("meets") < F.col("length")) | (F.col("a.word") < F.col("b.word"))
    met = met.where((F.bit_count(flips) <= 2) & order & (first == F.col("key")) & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    names = [F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")]
    pairs = met.select(*names).unionAll(_by_deletion(crowded.groupBy("word").agg(F.first("n").alias("n"))))
    turned = F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = pairs.select(F.inline(F.array(F.struct("word", "n", "other", "other_n"), turned)))
    return both.repartition("word").dropDuplicates(["word", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms (word, form) from each word that has one.

    Each round doubles the steps that a link spans; as a form is at least twice as frequent as its
    word, chains of 64-bit counts end within six rounds.
    """
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(on, "root", "left")
        links = materialize(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not links.where("moved").take(1):
            return links.select("word", "root")


def variants(words: DataFrame, times: int = FORM_TIMES, **how: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each word one row.

    n_near counts the words one edit away; the form is the most frequent of them (the least by code
    points among equals) if it is at least times as frequent as the word, else null; the root is the
    end of the chain of forms, the word itself if it has none.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best")
    near = near_words(words, **how).groupBy("word").agg(F.count("*").alias("n_near"), best)
    told = words.join(near, "word", "left")
    right = -F.col("best.m") >= times * F.col("n")
    told = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(right, F.col("best.form")).alias("form"), F.when(right, -F.col("best.m")).alias("form_n")))
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(materialize(vocabulary(runs(table(spark, sf_dir, "documents"), slip=97))))


#: CRC-32 is folded over the bytes with the polynomial 0xEDB88320; words one edit apart by the words that deletions leave.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT n, c FROM (
    WITH RECURSIVE t(n, c, k) AS (
      SELECT CAST(n AS BIGINT), CAST(n AS BIGINT), 0 FROM range(256) AS r(n)
      UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8
    ) SELECT n, c FROM t WHERE k = 8)
), tab AS (SELECT list(c ORDER BY n) AS l FROM crc_table
), runs AS (
  SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL
), hexed AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs
), hashed AS (
  SELECT w, k, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(x) // 2), lambda i: CAST(('0x' || x[2 * i + 1 : 2 * i + 2]) AS BIGINT))),
    lambda c, b: xor(l[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM hexed, tab
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words AS a JOIN cut AS b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words AS a JOIN cut AS b ON a.word = b.rest
), ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS nth FROM pairs
), told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words AS w LEFT JOIN ranked AS r ON w.word = r.word AND nth = 1
), chain(word, stop) AS (SELECT word, word FROM told UNION ALL SELECT c.word, t.form FROM chain AS c JOIN told AS t ON c.stop = t.word WHERE t.form IS NOT NULL
), ends AS (SELECT c.word, c.stop FROM chain AS c JOIN told AS t ON c.stop = t.word WHERE t.form IS NULL)
SELECT t.word, form, stop AS root, n, n_near, form_n FROM told AS t JOIN ends AS e ON t.word = e.word
"""
