"""Vectors: cosine, nearest neighbours, pairs above a threshold. All results are exact.

Both searches run as block products over cells. Items belong to the nearest of a few pivots, as many as
the square root of the table's rows but no more than leave ``CELL`` rows to a cell, so that cells grow slower
than the table. For unit vectors, cosine
at least ``t`` means distance at most ``r = sqrt(2 - 2t)``, and a query farther than ``r`` from the plane
half way between its own pivot and another one cannot match an item of that other cell. A query visits only
the cells it can match in. Where no threshold is given, each query finds its ``k`` best in its own cell first,
and the last of these is its threshold for the others.

Cells that lie together are put into packs of an eighth of the table, at least ``BLOCK`` and at most ``WIDE`` times
``BLOCK`` rows, and a query is sent to a pack once, however many of its cells it visits. A cell larger than that is cut
into blocks, so one that holds a third of all vectors becomes many tasks, and so are the visitors of a pack. One task
multiplies one block of queries with one block of items, ``SLICE_SCORES`` scores at a time, and only the hits leave
it, slice by slice: the best ``k`` per query, or the pairs above the threshold. No pair table is formed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.session import stored

#: Largest item table that ``method="broadcast"`` accepts.
BROADCAST_BYTES = 64 << 20
BLOCK = 2048
#: Blocks of large tables are up to this many times larger, so that vectors are sent to fewer of them.
WIDE = 16
CELL = 128
SLICE_SCORES = 1 << 20
#: Hits that a task holds before it hands them on.
HELD = 1 << 16
DIGITS = 9


def as_doubles(c: str) -> Column:
    return F.transform(F.col(c), lambda v: v.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two double vectors; null when either has no direction."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def index_score(cos: Column) -> Column:
    """Cosine on the 0..1 scale that a vector index reports."""
    return (1 + cos) / 2


def unit_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Double vectors of length one; rows without a direction are left out.

    The length enters as an array of its own: inside a lambda it would be computed per element. Rows are left out
    behind a generator: a filter on the length would be moved to the scan, and compute the vectors once more there.
    """
    doubles = df.withColumn(vec, as_doubles(vec)).withColumn("_norm", norm(vec))
    lengths = F.array_repeat("_norm", F.size(vec))
    unit = F.when(F.col("_norm") > 0, F.zip_with(vec, lengths, lambda v, n: v / n))
    rows = doubles.select("*", F.explode_outer(F.array(unit)).alias("_unit_vec")).where("_unit_vec is not null")
    return rows.withColumn(vec, F.col("_unit_vec")).drop("_norm", "_unit_vec")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64", copy=False)


def _shape(items: DataFrame) -> tuple[int, int]:
    """Rows and vector length of a table."""
    size = items.agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("width")).first()
    return size["rows"], size["width"] or 1


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best scores per row, the leftmost column first among equals."""
    width = scores.shape[1]
    if width <= k:
        rows, cols = (m.ravel() for m in np.indices(scores.shape))
        return rows, cols
    bound = np.partition(scores, width - k, axis=1)[:, width - k]
    rows, cols = np.nonzero(scores >= bound[:, None])
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    kept = np.arange(len(rows)) - first < k
    return rows[kept], cols[kept]


def _hits(
    q_ids: np.ndarray, q: np.ndarray, i_ids: np.ndarray, items: np.ndarray, k: int | None,
    bound: float | None, strict: bool, same: str | None, least: np.ndarray | None = None,
) -> Iterator[pd.DataFrame]:
    """Hits of a block of queries in a block of items, SLICE_SCORES scores at a time.

    ``same``: None for two tables, ``other`` to skip an id paired with itself, ``ordered`` to keep
    pairs with the lower id on the query side only. ``least``: a score below which a query needs no hit.
    """
    by_id = np.argsort(i_ids, kind="stable")
    i_ids, items = i_ids[by_id], items[by_id]
    step = max(1, SLICE_SCORES // len(i_ids))
    low = np.full(len(q_ids), -np.inf if bound is None else bound)
    low = low if least is None else np.maximum(low, least)
    for start in range(0, len(q_ids), step):
        ids = q_ids[start : start + step]
        scores, floor = q[start : start + step] @ items.T, low[start : start + step, None]
        if np.isfinite(floor).all():
            # Only what may reach the floor is rounded.
            rows, cols = np.nonzero(scores >= floor - 2 * 10.0**-DIGITS)
        elif k is not None:
            scores = np.round(scores, DIGITS) + 0.0
            if same == "other":
                scores[ids[:, None] == i_ids[None, :]] = -np.inf
            rows, cols = _best(scores, k)
        else:
            rows, cols = np.nonzero(np.isfinite(scores))
        found = np.round(scores[rows, cols], DIGITS) + 0.0
        kept = np.isfinite(found)
        if same == "other":
            kept &= ids[rows] != i_ids[cols]
        elif same == "ordered":
            kept &= ~(ids[rows] >= i_ids[cols])
        if bound is not None:
            kept &= found > bound if strict else found >= bound
        rows, cols, found = rows[kept], cols[kept], found[kept]
        if k is not None:
            order = np.lexsort((cols, -found, rows))
            rows, cols, found = rows[order], cols[order], found[order]
            first = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
            rows, cols, found = rows[first], cols[first], found[first]
        if len(rows):
            yield pd.DataFrame({"q_id": ids[rows], "i_id": i_ids[cols], "cos": found})


HIT = "q_id {id}, i_id {id}, cos double"


def _pivots(items: DataFrame, count: int) -> np.ndarray:
    """A fixed choice of ``count`` item vectors."""
    rows = items.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(count).collect()
    return np.unique(np.array([row.vec for row in rows], dtype="float64"), axis=0)


def _radius(cos: Column | float) -> Column:
    """Distance within which vectors of at least this cosine lie; half a unit of the last digit is allowed for."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.lit(cos) if isinstance(cos, float) else cos)) + 10.0**-DIGITS)


def _homes(df: DataFrame, pivots: np.ndarray, id_type: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The cell of each vector: that of its nearest pivot. Text columns ``keep`` stay beside it."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                rows, step = _matrix(batch["vec"]), max(1, SLICE_SCORES // len(pivots))
                nearest = [(rows[i : i + step] @ pivots.T).argmax(axis=1) for i in range(0, len(rows), step)]
                yield batch.assign(cell=np.concatenate(nearest).astype("int32"))

    kept = "".join(f", {name} string" for name in keep)
    return df.select("id", "vec", *keep).mapInPandas(cells, f"id {id_type}, vec array<double>{kept}, cell int")


def visits(
    df: DataFrame, pivots: np.ndarray, id_type: str, lower_only: bool = False, count_only: bool = False,
    packs: np.ndarray | None = None,
) -> DataFrame:
    """Rows of id, vec, cell and whether it is home, for every cell that a vector can match in.

    ``df``: id, vec, cell (its own) and ``radius``; a column ``least`` stays beside the vector. With ``packs``, the
    pack of each cell, ``cell`` is a pack that holds such a cell. ``lower_only`` restricts the others to lower
    numbers, which leaves each pair of a self join in exactly one of them. ``count_only`` gives cell and n
    instead, without carrying vectors. A vector leaves Python once, with the list of what it visits.
    """
    packs = np.arange(len(pivots)) if packs is None else packs
    by_pack = np.argsort(packs, kind="stable")
    firsts = np.flatnonzero(np.diff(packs[by_pack], prepend=-1))
    beside = [c for c in ("least",) if c in df.columns]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, SLICE_SCORES // len(pivots))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                home, radius = part["cell"].to_numpy(), part["radius"].to_numpy()[:, None]
                square = np.maximum(2 - 2 * _matrix(part["vec"]) @ pivots.T, 0)
                own = square[np.arange(len(home)), home][:, None]
                between = np.sqrt(np.maximum(2 - 2 * pivots[home] @ pivots.T, 0))
                beyond = (square - own) / (2 * np.maximum(between, 1e-6))
                # Pivots that nearly coincide say nothing in floating point: visit both cells.
                reach = (beyond <= radius + 1e-7) | (between < 1e-5)
                reach[np.arange(len(home)), home] = True
                reach = np.logical_or.reduceat(reach[:, by_pack], firsts, axis=1)
                if lower_only:
                    reach &= np.arange(len(firsts))[None, :] <= packs[home][:, None]
                if count_only:
                    yield pd.DataFrame({"cell": np.arange(len(firsts), dtype="int32"), "n": reach.sum(axis=0)})
                    continue
                visited = np.split(np.nonzero(reach)[1].astype("int32"), np.cumsum(reach.sum(axis=1))[:-1])
                yield part[["id", "vec", *beside]].assign(own=packs[home].astype("int32"), cells=visited)

    rows = df.select("id", "vec", "cell", "radius", *beside)
    if count_only:
        return rows.mapInPandas(cells, "cell int, n long")
    kind = f"id {id_type}, vec array<double>{''.join(f', {c} double' for c in beside)}, own int, cells array<int>"
    found = rows.mapInPandas(cells, kind).withColumn("cell", F.explode("cells"))
    return found.select("id", "vec", *beside, "cell", (F.col("cell") == F.col("own")).alias("home"))


def _packed(items: DataFrame, pivots: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows of a block, the pack of each cell, and the items of each pack; from one narrow row for each cell."""
    sizes = np.zeros(len(pivots), np.int64)
    for row in items.groupBy("cell").agg(F.count("*").alias("n")).collect():
        sizes[row["cell"]] = row["n"]
    block = min(max(math.ceil(sizes.sum() / 8), BLOCK), WIDE * BLOCK)
    centres = pivots[:: math.ceil(math.sqrt(len(pivots)))]
    packs, held, at = np.zeros(len(pivots), np.int64), 0, 0
    for cell in np.argsort((pivots @ centres.T).argmax(axis=1), kind="stable").tolist():
        if held and held + sizes[cell] > block:
            held, at = 0, at + 1
        packs[cell] = at
        held += sizes[cell]
    return block, packs, np.bincount(packs, weights=sizes).astype(np.int64)


def _at(values: np.ndarray, place: str) -> Column:
    return F.element_at(F.lit([int(v) for v in values]), F.col(place) + 1)


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("vec").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors of different lengths")
    return values.reshape(len(column), -1)


def _products(
    q: DataFrame, visitors: np.ndarray, items: DataFrame, packing: tuple[int, np.ndarray, np.ndarray], *,
    bound: float | None, strict: bool, k: int | None, same: str | None,
) -> DataFrame:
    """Hits (q_id, i_id, cos) of visiting vectors (id, vec, cell, home; may be least) in the items' packs.

    ``cell`` of ``q`` is a pack, that of ``items`` (id, vec, cell) a cell. ``visitors``: at most so many rows of
    ``q`` visit each pack, in a self join without those at home.
    """
    self_join = same == "ordered"
    id_type = items.schema["id"].dataType.simpleString()
    block, packs, sizes = packing
    n_items, n_asks = np.maximum(-(-sizes // block), 1), -(-np.asarray(visitors) // block)
    if not self_join:
        n_asks = np.maximum(n_asks, 1)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    none = F.array().cast("array<int>")
    upto = lambda first, n: F.when(F.col(n) > first, F.sequence(first, (F.col(n) - 1).cast("int"))).otherwise(none)
    unit, start = ["cell", "home", "qb", "ib"], F.lit(0)

    q_side = q.withColumns({"ni": _at(n_items, "cell"), "nq": _at(n_asks, "cell")})
    i_side = items.select("id", "vec", _at(packs, "cell").alias("cell"))
    i_side = i_side.withColumns({"ni": _at(n_items, "cell"), "nq": _at(n_asks, "cell")}).withColumn("ib", place("ni"))
    away = F.transform(upto(start, "nq"), lambda b: F.struct(F.lit(False).alias("home"), b.alias("qb")))
    if self_join:
        # Inside a pack of a self join the item table is the query table: same blocks, each pair of them once.
        q_side = q_side.withColumn("qb", F.when(F.col("home"), place("ni")).otherwise(place("nq")))
        blocks = F.when(F.col("home"), upto(F.col("qb"), "ni")).otherwise(upto(start, "ni"))
        inside = F.transform(F.sequence(start, F.col("ib")), lambda b: F.struct(F.lit(True).alias("home"), b.alias("qb")))
        meets = F.concat(inside, away)
    else:
        q_side = q_side.withColumn("home", F.lit(False)).withColumn("qb", place("nq"))
        blocks, meets = upto(start, "ni"), away
    least = F.col("least") if "least" in q.columns else F.lit(None).cast("double")
    q_side = q_side.withColumn("ib", F.explode(blocks)).select("id", "vec", least.alias("least"), F.lit(True).alias("asks"), *unit)
    i_side = i_side.withColumn("u", F.explode(meets)).select(
        "id", "vec", F.lit(None).cast("double").alias("least"), F.lit(False).alias("asks"), "cell", "u.home", "u.qb", "ib"
    )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}
        for batch in batches:
            for asks, rows in sides.items():
                rows.append(batch.filter(pc.equal(batch.column("asks"), asks)))
        left, right = (pa.Table.from_batches(sides[asks]) for asks in (True, False))
        sides.clear()
        if not left.num_rows or not right.num_rows:
            return
        kind = left.schema.field("id").type
        diagonal = all(left.column(c)[0].as_py() == v for c, v in (("home", True), ("qb", left.column("ib")[0].as_py())))
        rule = (same if diagonal else None) if self_join else same
        ids, floors = left.column("id").to_pandas().to_numpy(), left.column("least").to_pandas().to_numpy(dtype="float64")
        floors = np.where(np.isnan(floors), -np.inf, floors)
        asked, i_ids, matrix = _vectors(left), right.column("id").to_pandas().to_numpy(), _vectors(right)
        del left, right
        held: list[pd.DataFrame] = []
        for hits in _hits(ids, asked, i_ids, matrix, k, bound, strict, rule, floors):
            held.append(hits)
            if sum(map(len, held)) > HELD:
                yield as_batch(held, kind)
                held = []
        if held:
            yield as_batch(held, kind)

    def as_batch(held: list[pd.DataFrame], kind: pa.DataType) -> pa.RecordBatch:
        rows = pd.concat(held)
        ids = [pa.array(rows[c], from_pandas=True).cast(kind) for c in ("q_id", "i_id")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(rows["cos"])], names=["q_id", "i_id", "cos"])

    return q_side.unionByName(i_side).groupBy(*unit).applyInArrow(multiply, HIT.format(id=id_type))


def _visited(
    queries: DataFrame, items_in: Callable[[DataFrame], DataFrame], pivots: np.ndarray, id_type: str, **rule
) -> DataFrame:
    """Hits of queries in the cells that can hold them; ``items_in`` gives the items for cells and their visitors (cell, n)."""
    bound, k = rule["bound"], rule["k"]
    placed = stored(_homes(queries, pivots, id_type), "queries")
    if bound is not None and bound > -1:
        placed = placed.withColumn("radius", _radius(float(bound)))
    else:
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
        items = items_in(sizes)
        packing = _packed(items, pivots)
        at_home = placed.select("id", "vec", _at(packing[1], "cell").alias("cell"), F.lit(True).alias("home"))
        own = _products(at_home, _in_packs(sizes, packing[1]), items, packing, **rule)
        best = Window.partitionBy("q_id").orderBy(F.desc("cos"), "i_id")
        last = own.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k)
        last = stored(last.select(F.col("q_id").alias("id"), F.col("cos").alias("least")), "bounds")
        # A query whose own pack holds fewer than k items may have to visit all.
        placed = placed.join(last, "id", "left").withColumn(
            "radius", F.when(F.col("least").isNotNull(), _radius(F.col("least"))).otherwise(F.lit(4.0))
        )
    counts = stored(visits(placed, pivots, id_type, count_only=True).groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    items = items_in(counts)
    packing = _packed(items, pivots)
    # A query that visits several cells of a pack is one visitor.
    visitors = np.minimum(_in_packs(counts, packing[1]), placed.count())
    return _products(visits(placed, pivots, id_type, packs=packing[1]), visitors, items, packing, **rule)


def _in_packs(counts: DataFrame, packs: np.ndarray) -> np.ndarray:
    """Visitors of each pack, from those of its cells (cell, n)."""
    found = np.zeros(int(packs.max()) + 1, np.int64)
    for row in counts.collect():
        found[packs[row["cell"]]] += row["n"]
    return found


def _block_join(
    queries: DataFrame, items: DataFrame, *, bound: float | None, strict: bool, k: int | None, same: str | None
) -> DataFrame:
    """Hits (q_id, i_id, cos) of unit vectors, by block products over the cells that can hold them."""
    spark = items.sparkSession
    id_type = items.schema["id"].dataType.simpleString()
    n_items, _ = _shape(items)
    if not n_items:
        return spark.createDataFrame([], HIT.format(id=id_type))
    pivots = _pivots(items, math.ceil(min(math.sqrt(n_items), n_items / CELL)))
    homes = stored(_homes(items, pivots, id_type), "homes")
    rule = {"bound": bound, "strict": strict, "k": k, "same": same}
    if same == "ordered":
        placed, packing = homes.withColumn("radius", _radius(float(bound))), _packed(homes, pivots)
        asking = visits(placed, pivots, id_type, True, packs=packing[1])
        counts = visits(placed, pivots, id_type, True, True, packing[1]).groupBy("cell").agg(F.sum("n").alias("n"))
        visitors = _in_packs(counts, np.arange(len(packing[2]))) - packing[2]
        return _products(asking, visitors, homes, packing, **rule)
    return _visited(queries, lambda sizes: homes, pivots, id_type, **rule)


def _fits(items: DataFrame) -> bool:
    """Whether the item vectors stay below BROADCAST_BYTES, by their counted rows."""
    rows, width = _shape(items)
    return rows * (8 * width + 16) <= BROADCAST_BYTES


def _broadcast_top(
    queries: DataFrame, items: DataFrame, k: int, bound: float | None, strict: bool, same: str | None
) -> DataFrame:
    """Top ``k`` against a checked small item table held by every executor: no shuffle."""
    id_type = items.schema["id"].dataType.simpleString()
    table = items.select("id", "vec").toPandas()
    if table.empty:
        return items.sparkSession.createDataFrame([], HIT.format(id=id_type))
    shared = items.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), _matrix(table["vec"])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        for batch in batches:
            if not batch.empty:
                yield from _hits(
                    batch["id"].to_numpy(), _matrix(batch["vec"]), ids, vectors, k, bound, strict, same
                )

    return queries.select("id", "vec").mapInPandas(search, HIT.format(id=id_type))


def _bound(floor: float | None, scale: str) -> float | None:
    """A floor on a score scale as raw cosine."""
    if scale not in ("index", "cosine"):
        raise ValueError(f"unknown score scale: {scale}")
    return floor if floor is None or scale == "cosine" else round(2 * floor - 1, DIGITS)


def knn(
    queries: DataFrame,
    items: DataFrame,
    k: int = 1,
    floor: float | None = None,
    *,
    strict: bool = False,
    scale: str = "index",
    skip_self: bool = False,
    method: str = "blocks",
) -> DataFrame:
    """The ``k`` nearest items of each query: q_id, i_id, score, rank.

    Both tables hold ``id`` and ``vec``. ``floor`` applies after the best ``k`` are chosen; since
    it only removes the tail of a ranking, it may as well be applied inside the search.
    ``scale`` is ``index`` for 0..1 scores or ``cosine``. Equal scores rank by item id.
    ``method`` is ``blocks``, or ``broadcast`` for an item table of less than 64 MB that every
    executor holds; a larger one is refused.
    """
    bound = _bound(floor, scale)
    same = "other" if skip_self else None
    if method not in ("blocks", "broadcast"):
        raise ValueError(f"unknown method: {method}")
    if method == "broadcast" and not _fits(items):
        raise ValueError("too many items to hold on every executor; use blocks")
    queries, items = unit_vectors(queries), unit_vectors(items)
    if method == "broadcast":
        hits = _broadcast_top(queries, items, k, bound, strict, same)
    else:
        hits = _block_join(queries, items, bound=bound, strict=strict, k=k, same=same)
    return _ranked(hits, k, scale)


def _ranked(hits: DataFrame, k: int, scale: str) -> DataFrame:
    nearest = Window.partitionBy("q_id").orderBy(F.desc("cos"), "i_id")
    score = F.col("cos") if scale == "cosine" else index_score(F.col("cos"))
    ranked = hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("q_id", "i_id", score.alias("score"), "rank")


def collapse_copies(items: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (id = lowest id that holds them) and the membership of every item.

    Copies never meet each other in a pair search: one vector stands for the whole group, however
    large it is.
    """
    reps = items.groupBy("vec").agg(F.min("id").alias("rep"))
    members = items.join(reps, "vec").select("rep", "id", *keep)
    return reps.select(F.col("rep").alias("id"), "vec"), members


def similar_pairs(items: DataFrame, threshold: float, *, strict: bool = True) -> DataFrame:
    """Pairs of items with cosine above the threshold: a < b, score. Items hold distinct vectors."""
    hits = _block_join(
        unit_vectors(items), unit_vectors(items), bound=threshold, strict=strict, k=None, same="ordered"
    )
    return hits.select(
        F.least("q_id", "i_id").alias("a"), F.greatest("q_id", "i_id").alias("b"), F.col("cos").alias("score")
    )
