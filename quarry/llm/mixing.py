"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power `exponent`, normalised. The exponent is bisected
(every round tries a grid of values in one aggregation over the source totals) to the least one in
0 to 1 that keeps the epochs of every source within a limit, or that reaches a target entropy. The
token budget is the least at which every source is read `min_epochs` times, so that no source loses
a row unless a smaller budget is asked for.

Rows are dealt into `CELLS` cells of their source by a hash; one scan sums up the cells, and all that
follows is planned on those sums. A block is a run of cells. Every epoch permutes the blocks and the
rows inside each block by seeded hashes; full epochs keep every row, the last one stops at the
budget: block totals decide where, and only the block that the budget ends in is cut by rows. The
plan (a row a source, and a row a block of the last epoch) is broadcast while it is small, so rows
are repeated where they are read and no text is shuffled but that of the cut blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import renamed, table
from quarry.plans.session import materialize

#: A source's rows may be read so many times.
MAX_REPEAT = 2.0
#: Exponents tried at once, and rounds; the section shrinks by GRID each round.
GRID, ROUNDS = 32, 5
#: Rows of a block, about, and cells of a source; blocks are runs of cells.
BLOCK_ROWS, CELLS = 4096, 65_536
#: Rows of the plan that are broadcast at most, about 40 bytes each; beyond it the plan is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The columns that `mix` adds.
ADDED = ["_epoch", "_block", "_weight", "_budget", "_tokens"]
SPACE = r"[\t\n\x0B\f\r ]"


def token_count(text: str | Column) -> Column:
    """Words between white space, plus one for the end; a null text has one token."""
    some = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    blank = lambda c: F.when(c.rlike(SPACE), 1).otherwise(0)
    words = F.size(F.split(some, f"{SPACE}+")) - blank(F.substring(some, 1, 1)) - blank(F.substring(some, -1, 1))
    return F.when(some == "", 1).otherwise(words + 1).cast("long")


def totals(docs: DataFrame, source: str = "source", tokens: str = "_tokens", rows: Column | None = None) -> DataFrame:
    """(source, rows, tokens, share); rows of a null source are a source of their own."""
    found = docs.groupBy(source).agg((F.count("*") if rows is None else F.sum(rows)).alias("rows"), F.sum(tokens).alias("tokens"))
    whole = found.agg(F.sum("tokens").alias("all"))  # one row
    return found.crossJoin(F.broadcast(whole)).withColumn("share", F.col("tokens") / F.col("all")).drop("all")


def temperature(sources: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, min_epochs: float = 1.0, budget: int | None = None) -> float:
    """The least exponent in 0 to 1 within the repetition limit, or the largest that reaches the entropy (in nats).

    sources has (share, tokens). The limit is on the epochs that a source is read: at a budget, its
    weight times the budget by its tokens; without one, the least read source is read min_epochs
    times. Both targets fall back to 1 (weights are the shares) if even that misses them; an empty
    table gives 1.
    """
    share = F.col("share")

    def holds(a: float) -> Column:
        z = F.sum(F.pow(share, F.lit(a)))
        if entropy is not None:
            # H = log z - a * sum(s^a log s) / z
            return (F.log(z) - a * F.sum(F.pow(share, F.lit(a)) * F.log(share)) / z) >= entropy
        most = F.max(F.pow(share, F.lit(a - 1)))
        if budget is not None:
            return most * F.lit(float(budget)) / (z * F.sum("tokens")) <= max_repeat
        return most / F.min(F.pow(share, F.lit(a - 1))) * min_epochs <= max_repeat

    lo, hi = 0.0, 1.0
    live = sources.where("tokens > 0")
    for k in range(ROUNDS):
        tried = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
        good = [i for i, x in enumerate(live.agg(*[holds(a).alias(f"m{i}") for i, a in enumerate(tried)]).first()) if x]
        if not good:
            return 1.0 if k == 0 else (lo if entropy is not None else hi)
        i = good[-1] if entropy is not None else good[0]  # an entropy holds below some exponent, a limit above one
        if i == (GRID if entropy is not None else 0):
            return tried[i]
        lo, hi = (tried[i], tried[i + 1]) if entropy is not None else (tried[i - 1], tried[i])
    return lo if entropy is not None else hi


def _held(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, min_epochs: float = 1.0, budget: int | None = None, seed: int = 0, marks: bool = True) -> DataFrame:
    """docs repeated to their sources' budgets, with _epoch (from 0), _block, _weight, _budget and _tokens.

    Without marks only the columns of docs come out. With them, a column of docs that has a name of
    the five comes out as `<name>_in`. Tokens of a row: words of its text between white space, plus
    one for the end; a null text has one; texts of any length are counted whole. Ties in the seeded
    order are broken by id and text; equal rows are interchangeable, and each is repeated. The
    partial epoch keeps rows while their running total is within what is left of the budget. Where
    a budget asks for more than max_repeat epochs, a source ends at max_repeat. An empty table stays
    empty; a row with a null source belongs to the null source; all columns stay.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*at.values()).withColumn("tokens", token_count(at["text"]))
    key = F.xxhash64(F.lit(seed), at[id_col], at["text"])
    rows = rows.withColumn("src", F.col(at[source])).withColumn("cell", F.pmod(key, F.lit(CELLS)).cast("int"))
    cells = materialize(rows.groupBy("src", "cell").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")))
    found = materialize(totals(cells, "src", "tokens", F.col("rows")))
    n_sources = found.count()
    exponent = temperature(found, max_repeat, entropy, min_epochs, budget)
    weight = F.pow("share", F.lit(exponent))
    norm = found.agg(F.sum(weight).alias("z"), F.max(F.col("share") / weight).alias("top"), F.sum("tokens").alias("all"))  # one row
    need = F.lit(float(budget)) if budget is not None else F.col("all") * F.col("top") * F.col("z") * min_epochs
    asked = F.ceil(F.round(need * weight / F.col("z"), 6))
    if budget is not None and max_repeat is not None and entropy is None:
        asked = F.least(asked, F.floor(F.col("tokens") * F.lit(max_repeat)))
    plan = found.crossJoin(F.broadcast(norm)).select(
        F.col("src").alias("s"),
        (weight / F.col("z")).alias("weight"),
        F.col("tokens").alias("total"),
        asked.alias("budget"),
        F.least(F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.lit(1)), F.lit(CELLS)).cast("int").alias("blocks"),
    )
    plan = plan.withColumn("full", F.expr("CAST(budget div total AS INT)")).withColumn("left", F.col("budget") - F.col("full") * F.col("total"))
    plan = _held(materialize(plan), n_sources)
    block = F.expr(f"CAST(CAST(cell AS BIGINT) * blocks div {CELLS} AS INT)")
    # the last epoch's blocks, up to the one that the budget ends in
    sums = cells.join(plan, F.col("src").eqNullSafe(F.col("s"))).where("left > 0").groupBy("src", "full", "left", block.alias("b")).agg(F.sum("tokens").alias("t"))
    turn = F.xxhash64(F.lit(seed), F.lit("block"), "src", "b", "full")
    ahead = Window.partitionBy("src").orderBy(turn, "b").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows a source at most
    reached = sums.withColumn("before", F.coalesce(F.sum("t").over(ahead), F.lit(0))).where("before < left")
    reached = materialize(reached.select(F.col("src").alias("bs"), "b", "before", (F.col("before") + F.col("t") <= F.col("left")).alias("inside")))
    n_reached = reached.count()
    placed = rows.join(plan, F.col("src").eqNullSafe(F.col("s"))).withColumn("block", block)
    there = lambda x: placed.join(_held(x, n_reached), F.col("src").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("b")), "left")
    times = F.col("full") + F.when(F.col("inside"), 1).otherwise(0)
    epochs = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    whole = there(reached.where("inside").select("bs", "b", "inside")).withColumn("epoch", F.explode(epochs))
    order = Window.partitionBy("src", "block").orderBy(F.xxhash64(F.lit(seed), "epoch", at[id_col], at["text"]), at[id_col], at["text"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = there(reached.where("not inside")).where("before is not null").withColumn("epoch", F.col("full"))  # one block a source
    cut = cut.withColumn("upto", F.sum("tokens").over(order)).where("before + upto <= left")
    own = [*at.values(), "epoch", "block", "weight", "budget", "tokens"]
    mixed = whole.select(own).unionAll(cut.select(own))
    names = renamed(docs.columns, ADDED)
    if not marks:
        return mixed.select(*[F.col(k).alias(c) for c, k in at.items()])
    return mixed.select(*[F.col(k).alias(names[c]) for c, k in at.items()], *[F.col(a[1:]).alias(a) for a in ADDED])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    turn = F.xxhash64(F.lit(0), F.lit("block"), "source", "_block", "_epoch")
    return mixed.select(
        "doc_id",
        "source",
        F.col("_epoch").alias("epoch"),
        F.col("_block").alias("block"),
        turn.alias("block_order"),
        F.xxhash64(F.lit(0), "_epoch", "doc_id", "text").alias("row_order"),
        F.col("_tokens").alias("tokens"),
        F.round("_weight", 9).alias("weight"),
        F.col("_budget").cast("long").alias("budget"),
    )
