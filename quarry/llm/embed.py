"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors cos >= t means a distance of at most eps = sqrt(2 - 2 t). Vectors are rotated to
principal axes (fitted on a bounded sample; any rotation keeps distances, so the fit only decides
how much is skipped), sorted by their grid cells of side eps on the leading axes, and cut into
sequence intervals of about `INTERVAL_BYTES`. Two intervals are joined only if their bounding boxes
come within eps: boxes meet in the cells of `MEET` axes at once, each pair in one cell alone, before
any vector moves. A join halves both intervals recursively, skips pairs of parts whose boxes are
farther apart, and compares what is left by exact double precision cosines. One task takes an
interval and up to `FAN` partners, so the interval travels once for them.

Equal vectors are counted once beforehand. Interval pairs return link counts and spanning links
(at most one a vector), never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import find, table, union_pairs
from quarry.operators.graph import connected_components
from quarry.plans.session import materialize

THRESHOLD = 0.9
#: Vectors that the principal axes are fitted on.
SAMPLE = 10_000
AXES, MEET = 8, 3
#: Bytes of doubles of an interval, about, and its vectors at least; partners of an interval in one task.
INTERVAL_BYTES, MIN_INTERVAL, FAN = 8 << 20, 64, 4
LEAF = 256
#: Lengths of vectors that axes are fitted for, the most frequent ones; others use their leading components as they are.
FITTED = 64


def _units(data: np.ndarray) -> np.ndarray:
    """Rows of doubles at length 1; scaled first, so that no square over- or underflows."""
    v = data.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_axes(sample: np.ndarray, axes: int = AXES) -> np.ndarray:
    """Columns: the leading directions of unit vectors around their mean."""
    u = _units(sample)
    u -= u.mean(axis=0)
    return np.linalg.eigh(u.T @ u)[1][:, ::-1][:, :axes]


def usable(vector: str):
    """Whether a vector has a direction: components, all finite, not all zero."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def _near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], eps: float) -> bool:
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float((gap * gap).sum()) <= eps * eps


def join_intervals(u: np.ndarray, y: np.ndarray, v: np.ndarray, z: np.ndarray, same: bool, threshold: float, eps: float, mult_u: np.ndarray, mult_v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link weights of both sides, and the roots of their linked sets (u first, then v).

    u, v are unit vectors and y, z their leading coordinates. With same, v is u and each pair
    counts once.
    """
    n = len(u)
    weight_u, weight_v = np.zeros(n, np.int64), np.zeros(len(v), np.int64)
    parent = np.arange(n if same else n + len(v))
    stack = [(0, n, 0, len(v))]
    while stack:
        a, b, c, d = stack.pop()
        if same and d <= a:
            continue
        if not _near((y[a:b].min(axis=0), y[a:b].max(axis=0)), (z[c:d].min(axis=0), z[c:d].max(axis=0)), eps):
            continue
        if b - a > LEAF or d - c > LEAF:
            lefts = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > LEAF else [(a, b)]
            rights = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > LEAF else [(c, d)]
            stack += [(*p, *q) for p in lefts for q in rights]
            continue
        hit = u[a:b] @ v[c:d].T >= threshold
        if same:
            hit &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        i, j = np.nonzero(hit)
        if len(i):
            i, j = i + a, j + c
            np.add.at(weight_u, i, mult_v[j])
            np.add.at(weight_u if same else weight_v, j, mult_u[i])
            union_pairs(parent, i, j if same else j + n)
    return weight_u, weight_v, find(parent, np.arange(len(parent)))


_BLOCK = "block long, dim int, lo array<double>, hi array<double>, names binary, mult binary, data binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("names", pa.binary()), ("mult", pa.binary()), ("data", pa.binary())])
_FOUND_SCHEMA = pa.schema([("name", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _leading(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates on the leading axes; without a fit, the first components."""
    turned = axes.get(u.shape[1])
    return u[:, :AXES] if turned is None else u @ turned


def meeting(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b) of the blocks whose boxes come within eps, a <= b; only their boxes are shuffled.

    A box is in every cell that it overlaps on MEET axes, and as a left side in those beside them; a
    pair counts in the least cell that both are in. Cells have sides of eps, so a box of a unit
    vectors' interval is in few.
    """
    at = lambda c, k: F.floor(F.coalesce(F.get(F.col(c), F.lit(k)), F.lit(0.0)) / eps).cast("long")
    box = blocks.select("dim", "block", "lo", "hi", *[at("lo", k).alias(f"l{k}") for k in range(MEET)], *[at("hi", k).alias(f"h{k}") for k in range(MEET)])
    sides = []
    for name, more in (("a", 1), ("b", 0)):
        side = box.select("dim", F.col("block").alias(name), F.col("lo").alias(f"{name}lo"), F.col("hi").alias(f"{name}hi"), *[(F.col(f"l{k}") - more).alias(f"{name}{k}") for k in range(MEET)], *[(F.col(f"h{k}") + more).alias(f"h{k}") for k in range(MEET)])
        for k in range(MEET):
            side = side.withColumn(f"c{k}", F.explode(F.sequence(F.col(f"{name}{k}"), F.col(f"h{k}")))).drop(f"h{k}")
        sides.append(side)
    gaps = F.zip_with(F.arrays_zip("alo", "ahi"), F.arrays_zip("blo", "bhi"), lambda p, q: F.greatest(F.lit(0.0), p["alo"] - q["bhi"], q["blo"] - p["ahi"]))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = sides[0].join(sides[1], ["dim", *[f"c{k}" for k in range(MEET)]]).where("a <= b")
    for k in range(MEET):
        pairs = pairs.where(F.col(f"c{k}") == F.greatest(f"a{k}", f"b{k}"))
    return pairs.where(apart <= eps * eps).select("a", "b")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, interval: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    id, link with nothing; vectors of different lengths never link, and any number of lengths may
    occur. A very long vector makes short intervals. Repeated rows are rows of their own and link
    with each other; different vectors of one id are told apart. An empty table gives no rows; other
    columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    kind = next((f.dataType.elementType.simpleString() for f in rows.schema if f.name == "v"), "double")
    if kind not in ("float", "double"):
        kind, rows = "double", rows.withColumn("v", F.col("v").cast("array<double>"))
    stored = np.dtype("<f4" if kind == "float" else "<f8")
    rows = rows.withColumn("ok", usable("v") & F.col("vec_id").isNotNull())
    distinct = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    distinct = materialize(distinct.withColumn("dim", F.size("v")).withColumn("name", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(FITTED).collect()}
    axes = {}
    for dim, many in sizes.items():
        some = distinct.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE / len(sizes) / many) * (1 << 30)))
        sample = some.limit(SAMPLE // len(sizes)).select("v").toArrow().column("v").combine_chunks()  # SAMPLE vectors at most
        if len(sample):
            axes[dim] = principal_axes(sample.flatten().to_numpy().reshape(-1, dim))
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-9) + 1e-9
    step = lambda d: interval or max(MIN_INTERVAL, INTERVAL_BYTES // (8 * d))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(3).to_numpy()
            cells = np.zeros((batch.num_rows, AXES), np.int64)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                y = _leading(_units(batch.column(0).take(pa.array(at)).flatten().to_numpy().reshape(-1, d)), axes)
                cells[at, : y.shape[1]] = np.floor(y / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, k]) for k in range(AXES)]], names=["v", "name", "mult", "dim", *[f"c{k}" for k in range(AXES)]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted vectors in intervals; one interval is held at a time."""
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            d = part.column(3)[0].as_py()
            data = part.column(0).chunk(0).flatten().to_numpy().astype(stored).reshape(-1, d)
            y = _leading(_units(data), axes)
            names = part.column(1).to_numpy()
            return pa.RecordBatch.from_pylist([{"block": int(names[0]), "dim": d, "lo": y.min(axis=0).tolist(), "hi": y.max(axis=0).tolist(), "names": names.tobytes(), "mult": part.column(2).to_numpy().tobytes(), "data": data.tobytes()}], schema=_BLOCK_SCHEMA)

        for batch in batches:
            dim = batch.column(3).to_numpy()
            at = 0
            while at < batch.num_rows:
                if held and held[0].column(3)[0].as_py() != dim[at]:
                    yield out()
                    held = []
                same = np.flatnonzero(dim[at:] != dim[at])
                room = step(int(dim[at])) - sum(x.num_rows for x in held)
                n = min(room, int(same[0]) if len(same) else batch.num_rows - at)
                held.append(batch.slice(at, n))
                at += n
                if n == room:
                    yield out()
                    held = []
        if held:
            yield out()

    order = ["dim", *[f"c{k}" for k in range(AXES)], "name"]
    content = distinct.agg(F.sum("dim"), F.count("*")).first()
    parts = -(-content[1] // interval) if interval else -(-8 * (content[0] or 0) // INTERVAL_BYTES)
    gridded = distinct.select("v", "name", "mult", "dim").mapInArrow(project, f"v array<{kind}>, name long, mult long, dim int, " + ", ".join(f"c{k} long" for k in range(AXES)))
    ordered = gridded.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order)
    blocks = materialize(ordered.select("v", "name", "mult", "dim").mapInArrow(pack, _BLOCK))
    pairs = meeting(blocks, eps)
    turn = F.row_number().over(Window.partitionBy("a").orderBy("b"))  # ids of an interval's partners alone
    pairs = materialize(pairs.withColumn("turn", F.floor((turn - 1) / FAN)))

    def load(row: dict) -> tuple[np.ndarray, ...]:
        u = _units(np.frombuffer(row["data"], stored).reshape(-1, row["dim"]))
        return u, _leading(u, axes), np.frombuffer(row["names"], np.int64), np.frombuffer(row["mult"], np.int64)

    def compare(mine: pa.Table, others: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return _FOUND_SCHEMA.empty_table()
        mine = mine.slice(0, 1).to_pylist()[0]
        u, y, nu, mu = load(mine)
        out = []
        for i in range(others.num_rows):
            other = others.slice(i, 1).to_pylist()[0]
            same = mine["block"] == other["block"]
            v, z, nv, mv = (u, y, nu, mu) if same else load(other)
            wu, wv, root = join_intervals(u, y, v, z, same, threshold, eps, mu, mv)
            names, links = (nu, wu) if same else (np.concatenate([nu, nv]), np.concatenate([wu, wv]))
            at = np.flatnonzero(links)
            out.append(pa.table({"name": names[at], "links": links[at], "root": names[root[at]]}, schema=_FOUND_SCHEMA))
        return pa.concat_tables(out) if out else _FOUND_SCHEMA.empty_table()

    keep = ["block", "dim", "names", "mult", "data"]
    mine = blocks.select(*[F.col(c).alias(f"m_{c}") for c in keep])
    lefts = pairs.select("a", "turn").distinct().join(mine, F.col("a") == F.col("m_block")).select("a", "turn", *[F.col(f"m_{c}").alias(c) for c in keep])
    asked = pairs.select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("turn").alias("t"))
    rights = asked.join(blocks.select(*keep), F.col("q") == F.col("block")).select("p", "t", *keep)
    shaped = lambda x: x.select(keep)
    paired = lefts.groupBy("a", "turn").cogroup(rights.groupBy("p", "t"))
    found = materialize(paired.applyInArrow(lambda x, y: compare(shaped(x), shaped(y)), "name long, links long, root long"))

    components = connected_components(found, "name", "root")
    links = found.groupBy("name").agg(F.sum("links").alias("links"))
    known = distinct.select("v", "name", "least", "mult").join(links, "name", "left").join(components, F.col("name") == F.col("node"), "left")
    known = materialize(known.select("v", "least", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "name").alias("class")))
    least = known.groupBy("class").agg(F.min("least").alias("comp"))
    known = known.join(least, "class").select(F.col("v").alias("w"), "n", "comp")
    good = rows.where("ok").join(known, F.col("v") == F.col("w")).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("comp").alias("component_id"))
    lone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionAll(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x
), deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e JOIN comp ON comp.x = e.vec_id LEFT JOIN deg ON deg.x = e.vec_id
"""
