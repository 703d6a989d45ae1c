"""Operator 5: embedding near-dedup as an exact metric range join.

Unit vectors with cosine >= t lie within sqrt(2 - 2 t) of each other. Pivots cut
each label's vectors into cells; a vector is copied to every other cell that a
partner's cell could be, by the triangle inequality and by its distance from the
plane between both pivots. Each cell then finds all partners of its own vectors
without any other cell. The copies are counted first: a label takes as many pivots
as leave few of them. Where two pivots already cause many, as in data without
clusters, it stays one cell.

Cells are compared block by block, in waves that take a vector along a fixed number of
times, so that what lies on disk is bounded by the input. Pairs of rows are first
bounded by their places in the space that some pivots span.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ._spark import HOT_KEYS, Sets, components, discard, map_groups, new_table, shuffles_removed, stored

THRESHOLD = 0.98
#: Vectors a cell is meant to own, and pivots of a label: at most so many. All labels
#: share one list of pivots and use its first ones.
CELL_ROWS, PIVOTS = 2048, 256
#: Copies of a vector, its own place included, that pivots may cause in a label's mean.
COPIES = 1.5
#: Vectors of a cell that one block may hold, and their bytes; how many blocks a block
#: meets in one wave; partitions of a wave at most.
CELL_BLOCK, BLOCK_BYTES, ROUNDS, MOST_TASKS = 65_536, 32 << 20, 2, 2000
#: Rows that get their cells at once, and rows on each side of one product.
CHUNK, TILE = 512, 1024
#: Slack for rounding in distances, and in bounds in single precision.
SLACK, SLACK_32 = 1e-6, 1e-5


def usable(embedding: str) -> F.Column:
    """Whether a vector takes part: no null or non-finite component, not zero."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(embedding, good) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an array column of numbers, of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; first by their largest value,
    against overflow."""
    rows = rows / np.abs(rows).max(1, keepdims=True).astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _spread(drawn: np.ndarray) -> np.ndarray:
    """Unit vectors in an order in which each is far from all before, so that the first
    ones lie in different clusters."""
    order, least = [], np.full(len(drawn), np.inf)
    for _ in range(len(drawn)):
        order.append(int(least.argmax()))
        least = np.minimum(least, 1 - drawn @ drawn[order[-1]])
        least[order] = -np.inf
    return drawn[order]


def _pivots(drawn: np.ndarray, length: int) -> np.ndarray:
    """PIVOTS unit vectors of a length: those drawn from the data, if they have it, then
    fixed random directions. Results hold for any pivots; those of the data follow its
    clusters."""
    more = unit(np.random.default_rng(length).standard_normal((PIVOTS, length)))
    return np.concatenate([drawn, more])[:PIVOTS] if drawn.shape[1] == length else more


def _measured(drawn: np.ndarray):
    """A function of a batch (v, pivots): CHUNK rows of one length and number of pivots
    at a time, that number, the rows' places, their squared distances from the pivots
    and the pivots' distances from each other."""
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def parts(batch):
        lengths, counts = batch.column("v").value_lengths().to_numpy(zero_copy_only=False), batch.column("pivots").to_numpy()
        for length, k in np.unique(np.stack([lengths, counts], 1), axis=0).tolist():
            rows = np.flatnonzero((lengths == length) & (counts == k))
            if length not in known:
                p = _pivots(drawn, length)
                known[length] = p, np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
            p, between = known[length]
            for at in range(0, len(rows), CHUNK):
                some = rows[at : at + CHUNK]
                yield k, some, np.maximum(0, 2 - 2 * unit(matrix(batch.column("v").take(pa.array(some)))) @ p[:k].T), between[:k, :k]

    return parts


def _copied(square: np.ndarray, between: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows by their squared distances from pivots: the nearest pivot, and for each
    whether its cell holds the row."""
    d, nearest, one = np.sqrt(square), square.argmin(1), np.arange(len(square))
    edge = (square - square[one, nearest][:, None]) <= 2 * (reach + SLACK) * between[nearest]
    copied = edge & (d <= d[one, nearest][:, None] + 2 * reach + SLACK)
    copied[one, nearest] = True
    return nearest, copied


def _counts(drawn: np.ndarray, reach: float):
    """Places in cells that the vectors of a space would take, if its first k pivots cut
    it: for all of them, half of them, and so on."""

    def count(batches):
        parts = _measured(drawn)
        for batch in batches:
            spaces, found = batch.column("space").to_numpy(), []
            for k, some, square, between in parts(batch):
                own, place = np.unique(spaces[some], return_inverse=True)
                while k > 1:
                    n = np.bincount(place, _copied(square[:, :k], between[:k, :k], reach)[1].sum(1))
                    found += zip(own.tolist(), [k] * len(own), n.astype(np.int64).tolist(), strict=True)
                    k //= 2
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["space", "k", "places"])

    return count


def _cells(drawn: np.ndarray, reach: float):
    def assign(batches):
        parts = _measured(drawn)
        for batch in batches:
            row, cell, own = [], [], []
            for _, some, square, between in parts(batch):
                nearest, copied = _copied(square, between, reach)
                r, c = np.nonzero(copied)
                row.append(some[r]), cell.append(c), own.append(nearest[r] == c)
            if row:
                row, cell, own = (np.concatenate(x) for x in (row, cell, own))
                out = batch.drop_columns(["pivots"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int64)), pa.array(own)], [*out.schema.names, "cell", "own"])

    return assign


def _bounds(v: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Rows whose products are no less than the cosines of v's: the place in the space
    that some pivots span, and the distance from it."""
    length = v.shape[1]
    basis = np.linalg.qr(_pivots(drawn, length)[: min(length, max(16, length // 16))].T)[0]
    out = np.empty((len(v), basis.shape[1] + 1), np.float32)
    for at in range(0, len(v), TILE):
        x = unit(v[at : at + TILE])
        within = x @ basis
        out[at : at + TILE, :-1], out[at : at + TILE, -1] = within, np.linalg.norm(x - within @ basis.T, axis=1)
    return out


def _near(v: np.ndarray, w: np.ndarray, bound: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of v and w whose cosine is >= threshold; bound is no
    less than their cosines, but for rounding."""
    rows = np.flatnonzero(bound.max(1) >= threshold - SLACK_32)
    i, j = np.nonzero(bound[rows] >= threshold - SLACK_32)
    if not len(i):
        return i, j
    columns, j = np.unique(j, return_inverse=True)
    x, y = unit(v[rows]), unit(w[columns])
    if len(i) * 8 < len(rows) * len(columns):
        near = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
        i, j = i[near], j[near]
    else:
        i, j = np.nonzero(x @ y.T >= threshold)
    return rows[i], columns[j]


def _partners(drawn: np.ndarray, threshold: float):
    def links(table: pa.Table) -> pa.RecordBatch | None:
        m, a, b = len(table), table["task_a"][0].as_py(), table["task_b"][0].as_py()
        split = int((table["block"].to_numpy() == a).sum())  # rows are sorted by block
        if m < 2 or (a != b and split in (0, m)):
            return None
        v = matrix(table["v"])
        ids, copies, own = table["rep"].to_numpy(), table["copies"].to_numpy(), table["own"].to_numpy()
        bound = _bounds(v, drawn)
        linked, sets, found = np.zeros(m, np.int64), Sets(m), []
        label, joined = np.arange(m), 0
        for at in range(0, split, TILE):
            to = min(at + TILE, split)
            for other in range(at if a == b else split, m, TILE):
                i, j = _near(v[at:to], v[other : other + TILE], bound[at:to] @ bound[other : other + TILE].T, threshold)
                i, j = i + at, j + other
                wanted = (own[i] | own[j]) & (i < j)
                i, j = i[wanted], j[wanted]
                if not len(i):
                    continue
                linked += (np.bincount(i, copies[j] * own[i], m) + np.bincount(j, copies[i] * own[j], m)).astype(np.int64)
                # label: roots of some time ago; what they hold together is together
                apart = np.flatnonzero(label[i] != label[j])
                for k, others in _runs(i[apart], j[apart]):
                    others = others[label[others] != label[k]]
                    others = others[np.unique(label[others], return_index=True)[1]].tolist()
                    found += [(ids[k], ids[o]) for o in others if sets.join(k, o)]
                    joined += len(others)
                    if joined > TILE:
                        label, joined = _roots(sets), 0
        rows = [(ids[k], None, linked[k]) for k in np.flatnonzero(linked)] + [(x, y, 0) for x, y in found]
        if not rows:
            return None
        x, y, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "n"])

    return links


def _runs(i: np.ndarray, j: np.ndarray):
    """Each value of i, sorted, with its j."""
    values, starts = np.unique(i, return_index=True)
    return zip(values.tolist(), np.split(j, starts[1:]), strict=True) if len(values) else ()


def _roots(sets: Sets) -> np.ndarray:
    parent = np.array(sets.parent)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _with(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """df with what a stored table tells of its keys; without a shuffle of df, unless
    there are many keys."""
    return df.join(F.broadcast(known) if known.count() <= HOT_KEYS else known, key)


def _compared(cells: DataFrame, drawn: np.ndarray, threshold: float) -> DataFrame:
    """The rows of _partners() for all pairs of blocks of each cell.

    In round t of a cell of n blocks, block a meets block (t - a) mod n: each pair meets
    in one of n rounds, and a vector goes to one task a round. A wave shuffles ROUNDS
    rounds at once; its shuffle files go before the next."""
    held = F.greatest(F.lit(1), F.least(F.lit(CELL_BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("width")))))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("members"), F.max(F.size("v")).alias("width")).where("members > 1")
    sizes = stored(sizes.select("cell", F.ceil(F.col("members") / held).cast("int").alias("blocks")), "embedding-blocks")
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    placed = _with(cells, sizes, "cell").withColumn("block", F.pmod(F.xxhash64(F.lit(17), "rep"), "blocks").cast("int"))
    path, schema = new_table(cells.sparkSession, "embedding-links"), "u long, v long, n long"
    found = stored(cells.sparkSession.createDataFrame([], schema), "embedding-links", path)
    for first in range(0, most, ROUNDS):
        wave = placed.where(F.col("blocks") > first).withColumn("round", F.explode(F.sequence(F.lit(first), F.least(F.lit(first + ROUNDS), "blocks") - 1)))
        other = F.pmod(F.col("round") - F.col("block"), "blocks")
        wave = wave.withColumn("task_a", F.least("block", other)).withColumn("task_b", F.greatest("block", other))
        wave = wave.select(F.xxhash64(F.lit(23), "cell", "task_a", "task_b").alias("task"), "task_a", "task_b", "block", "rep", "copies", "own", "v")
        # tasks of whole blocks; cells of one block are left to Spark
        tasks = sizes.where(F.col("blocks") > F.lit(max(1, first))).agg(F.sum(F.least(F.lit(ROUNDS), F.col("blocks") - first) * F.col("blocks") / 2)).first()[0]
        stored(map_groups(wave, "task", _partners(drawn, threshold), schema, ["block", "rep"], tasks and math.ceil(min(MOST_TASKS, 3 * tasks))), "embedding-links", path)
    return found.sparkSession.read.schema(schema).parquet(path)


def embedding_near_dedup(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links vectors of equal label whose cosine, in double precision, is >= threshold.

    Returns a row for each input row: vec_id, n_links (other rows linked with
    directly), component_id (smallest vec_id that links lead to), kept (vec_id =
    component_id). Vectors that are null, zero or hold null or non-finite
    components, and rows without label or vec_id, link with nothing; vectors of
    unequal length do not compare. Repeated rows count as rows of their own. An
    empty table gives an empty result; further columns are not read."""
    with shuffles_removed(embeddings.sparkSession):
        return _near_dedup(embeddings, threshold)


def _near_dedup(embeddings: DataFrame, threshold: float) -> DataFrame:
    reach = math.sqrt(2 - 2 * threshold)
    given = embeddings.schema["embedding"].dataType
    kind = "float" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "double"  # half the bytes of the same values
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    rows = rows.withColumn("live", usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("key_a", F.xxhash64(F.lit(1), "label", "v")).withColumn("key_b", F.xxhash64(F.lit(2), "label", "v"))
    key = ["key_a", "key_b"]
    whole = stored(
        rows.where("live").groupBy(*key, "label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("space", F.xxhash64("label", F.size("v"))).select(*key, "space", "rep", "copies", "v"),
        "embedding-classes",
    )
    # a bounded draw, spread by hash: what all labels take their pivots from
    draw = whole.select("v", F.xxhash64(F.lit(5), "rep").alias("h")).orderBy("h").limit(PIVOTS).select("v").collect()
    drawn = _spread(unit(np.array([r["v"] for r in draw if len(r["v"]) == len(draw[0]["v"])]))) if draw else np.zeros((0, 0))
    # labels that nobody shares have nothing to compare
    spaces = stored(whole.groupBy("space").agg(F.count("*").alias("n")).where("n > 1"), "embedding-spaces")
    tried = _with(whole.select("space", "v"), spaces.select("space", F.greatest(F.lit(2), F.least(F.lit(PIVOTS), F.expr(f"n div {CELL_ROWS}"))).cast("int").alias("pivots")), "space")
    counted = tried.mapInArrow(_counts(drawn, reach), "space long, k long, places long").groupBy("space", "k").agg(F.sum("places").alias("places"))
    fit = counted.join(spaces, "space").where(F.col("places") <= COPIES * F.col("n")).groupBy("space").agg(F.max("k").alias("k"))
    taken = stored(spaces.join(fit, "space", "left").select("space", F.coalesce("k", F.lit(1)).cast("int").alias("pivots")), "embedding-pivots")
    placed = _with(whole.select("space", "rep", "copies", "v"), taken, "space")
    placed = placed.mapInArrow(_cells(drawn, reach), f"space long, rep long, copies long, v array<{kind}>, cell long, own boolean")
    cells = stored(placed.withColumn("cell", F.xxhash64("space", "cell")).drop("space"), "embedding-cells")
    classes = stored(whole.select(*key, "rep", "copies"), "embedding-ids")
    discard(whole)  # their vectors lie in the cells
    verified = _compared(cells, drawn, threshold)
    discard(cells)
    linked = verified.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(verified.where("v is not null").select("u", "v"), "embedding-components").withColumnRenamed("node", "rep")
    answers = classes.join(linked, "rep", "left").join(roots, "rep", "left")
    return (
        rows.select("vec_id", "live", *[F.when(F.col("live"), F.col(k)).alias(k) for k in key])
        .join(answers, key, "left")
        .select("vec_id", F.when(F.col("live"), F.col("copies") - 1 + F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(F.col("live"), F.coalesce("root", "rep")).otherwise(F.col("vec_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
