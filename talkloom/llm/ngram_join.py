"""Operator 2: n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed 5-word shingles. Equal sets are one class. Between
classes, locality-sensitive bands of MinHash values give candidate buckets; in a
bucket, MinHash values are compared a few at a time and a pair is dropped once
the posterior probability that its similarity reaches the threshold falls below
a tolerance; what is left joins into candidate clusters. Within a cluster the
same incremental comparison runs over all pairs, and the rest are verified with
their exact shingle sets.

No pair is ever a row: a task returns, for each class, how many documents it
links with, and the edges of a spanning forest. Shingle sets are written once;
only those of classes in candidate clusters are read and shuffled.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import Sets, block_tasks, components, map_groups, stored, tidy

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: 24 bands of 4 values: a pair at 0.8 meets in no band with probability 3e-6.
BANDS, ROWS = 24, 4
#: Further MinHash values (a byte each) that the Bayesian comparison reads, STEP at a time.
COMPARED, STEP = 64, 16
TOLERANCE = 1e-5
#: Members of a bucket, and bytes of a cluster's sets, that one block may hold.
BUCKET_BLOCK, CLUSTER_BLOCK = 8192, 16 << 20
#: Bytes of a set's row beside its shingles, about.
ROW_BYTES = 200
#: Clustered classes (8 bytes each) that may be broadcast to fetch their sets.
BROADCAST_ROWS = 4_000_000


@cache
def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    n = BANDS * ROWS + COMPARED
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(shingles: np.ndarray, offsets: np.ndarray, family: slice = slice(None)) -> np.ndarray:
    """MinHash values (texts x functions) of shingle sets, none of them empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    xors, factors = (f[family] for f in _hash_family())
    out = np.empty((len(offsets) - 1, len(xors)), np.uint32)
    for k in range(len(xors)):
        h = (x ^ xors[k]) * factors[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x846CA68B)
        h ^= h >> np.uint32(16)
        out[:, k] = np.minimum.reduceat(h, offsets[:-1])
    return out


@cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... compared values: the fewest matches that leave
    P(similarity >= threshold | matches) at tolerance or above, under a uniform
    prior. One-byte values match by chance once in 256."""
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        # posterior Beta(m + 1, n - m + 1); its tail beyond t is a binomial sum
        tail = lambda m: sum(math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))  # noqa: B023, E731
        out.append(next(m for m in range(n + 1) if tail(m) >= tolerance))
    return tuple(out)


def plausible(signatures: np.ndarray, i: int, others: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Those of `others` whose posterior never falls below the tolerance."""
    matches = np.zeros(len(others), np.int16)
    for k, fewest in enumerate(least):
        if not len(others):
            break
        cut = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (signatures[others, cut] == signatures[i, cut]).sum(1, dtype=np.int16)
        keep = matches >= fewest
        others, matches = others[keep], matches[keep]
    return others


def _describe(batches):
    for batch in batches:
        for part in T.slices(batch.column("text")):
            n = part.hi - part.lo
            sets, offsets = T.shingles(T.words(part), n, SHINGLE_WORDS)
            some = np.flatnonzero(np.diff(offsets))
            digests = np.zeros((2, n), np.int64)
            bands, compared = [b""] * n, [b""] * n
            if len(some):
                starts = np.append(offsets[some], len(sets))
                for k in (0, 1):
                    digests[k, some] = np.add.reduceat(T.mix(sets, k + 1), starts[:-1]).view(np.int64)
                values = minhash(sets, starts)
                keys = values[:, : BANDS * ROWS].reshape(len(some), BANDS, ROWS).astype(np.uint64)
                key = np.arange(BANDS, dtype=np.uint64)[None, :]
                for r in range(ROWS):
                    key = T.mix(key ^ (keys[:, :, r] + np.uint64(r << 32)))
                small = values[:, BANDS * ROWS :].astype(np.uint8)
                for at, row in enumerate(some):
                    bands[row], compared[row] = key[at].view(np.int64), small[at].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(part.lo, n),
                    batch.column("text_hash").slice(part.lo, n),
                    pa.array(digests[0]),
                    pa.array(digests[1]),
                    pa.array(np.diff(offsets)),
                    pa.array([list(b) if len(b) else [] for b in bands], pa.list_(pa.int64())),
                    pa.array(compared, pa.binary()),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(sets.astype("<u8", copy=False))]),
                ],
                ["doc_id", "text_hash", "digest_a", "digest_b", "n_shingles", "bands", "compared", "shingles"],
            )


DESCRIBED = "doc_id long, text_hash long, digest_a long, digest_b long, n_shingles long, bands array<long>, compared binary, shingles binary"


def _key() -> list[F.Column]:
    """doc_id and a hash of the text: what tells rows apart that are no repeats."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")]


def described(documents: DataFrame) -> DataFrame:
    """Digest of each document's shingle set, band keys, MinHash bytes and the set
    itself (sorted little-endian unsigned 64-bit hashes)."""
    return documents.select(*_key(), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_describe), DESCRIBED)


def _sides(table: pa.Table) -> tuple[np.ndarray, int, int]:
    return table["block"].to_numpy(), table["task_a"][0].as_py(), table["task_b"][0].as_py()


def _partners(i: int, block: np.ndarray, a: int, b: int, later: np.ndarray) -> np.ndarray | None:
    """Indices that task (a, b) compares with i: each pair of the task once."""
    if a == b:
        return later[i + 1 :]
    return np.flatnonzero(block == b) if block[i] == a else None


def _bucket_edges(threshold: float, tolerance: float):
    def edges(table: pa.Table) -> pa.RecordBatch | None:
        ids, m = table["node"].to_numpy(), len(table)
        least = least_matches(threshold, tolerance)
        signatures = np.frombuffer(b"".join(table["compared"].to_pylist()), np.uint8).reshape(m, COMPARED)
        block, a, b = _sides(table)
        # `near` is a hint of the set a member is in: those that are there already
        # need no comparison
        sets, near, every = Sets(m), np.arange(m), np.arange(m)
        found: list[tuple[int, int]] = []
        for i in range(m):
            others = _partners(i, block, a, b, every)
            if others is None or not len(others):
                continue
            near[i] = sets.find(i)
            linked = plausible(signatures, i, others[near[others] != near[i]], least)
            for j in linked.tolist():
                if sets.join(i, j):
                    found.append((ids[i], ids[j]))
            near[linked] = near[i] = sets.find(i)
        if not found:
            return None
        u, v = np.array(found, np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges


def _cluster_links(threshold: float, tolerance: float):
    def links(table: pa.Table) -> pa.RecordBatch | None:
        m = len(table)
        if m < 2:
            return None
        ids, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        signatures = np.frombuffer(b"".join(table["compared"].to_pylist()), np.uint8).reshape(m, COMPARED)
        sizes = table["n_shingles"].to_numpy()
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        shingles = np.frombuffer(b"".join(x.as_buffer() for x in table["shingles"]), "<u8")
        block, a, b = _sides(table)
        del table
        _, local = np.unique(shingles, return_inverse=True)
        del shingles
        present = np.zeros(local.max() + 1, np.int32)
        least = least_matches(threshold, tolerance)
        sets, every, linked = Sets(m), np.arange(m), np.zeros(m, np.int64)
        found: list[tuple[int, int]] = []
        for i in range(m):
            others = _partners(i, block, a, b, every)
            if others is None or not len(others):
                continue
            low, high = sizes[others] >= threshold * sizes[i], sizes[i] >= threshold * sizes[others]
            others = plausible(signatures, i, others[low & high], least)
            if not len(others):
                continue
            mine = local[offsets[i] : offsets[i + 1]]
            present[mine] = 1
            starts = np.concatenate([[0], np.cumsum(sizes[others])])[:-1]
            shared = np.add.reduceat(present[np.concatenate([local[offsets[j] : offsets[j + 1]] for j in others])], starts)
            present[mine] = 0
            others = others[shared / (sizes[others] + sizes[i] - shared) >= threshold]
            linked[i] += copies[others].sum()
            linked[others] += copies[i]
            found += [(ids[i], ids[j]) for j in others.tolist() if sets.join(i, j)]
        some = np.flatnonzero(linked)
        rows = [(ids[k], None, linked[k]) for k in some] + [(u, v, 0) for u, v in found]
        if not rows:
            return None
        u, v, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "n"])

    return links


def _classes(documents: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The documents described, and their classes (digest_a, digest_b): rep, the
    smallest (doc_id, text_hash); copies; n, how many rows they link with beside
    copies; head, the smallest rep that links lead to."""
    each = stored(described(documents).withColumn("row", F.monotonically_increasing_id()), "ngram-described")
    live = each.where("n_shingles > 0 and doc_id is not null")
    grouped = live.groupBy("digest_a", "digest_b").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"), F.min("row").alias("row"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("compared").alias("compared"))
    # numbered once written: digests tell classes apart, however doc_ids repeat
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = banded.join(crowded, "band").join(classes.select("node", "compared"), "node")
    edges = map_groups(block_tasks(members, "band", "members", "node", BUCKET_BLOCK).drop("band", "members"), "task", _bucket_edges(threshold, tolerance), "u long, v long", ["node"])
    clusters = stored(components(stored(edges, "ngram-candidates"), "ngram-clusters"), "ngram-clusters")

    inside = stored(clusters.join(classes.select("node", "row", "copies", "n_shingles", "compared"), "node"), "ngram-clustered")
    wanted = inside.select("row")
    sets = each.select("row", "shingles").join(F.broadcast(wanted) if inside.count() <= BROADCAST_ROWS else wanted, "row", "left_semi")
    sets = inside.join(sets, "row").drop("row")
    weight = inside.groupBy("root").agg(F.sum(8 * F.col("n_shingles") + ROW_BYTES).alias("weight"))
    tasks = block_tasks(sets.join(weight, "root"), "root", "weight", "node", CLUSTER_BLOCK).drop("root", "weight")
    verified = stored(map_groups(tasks, "task", _cluster_links(threshold, tolerance), "u long, v long, n long", ["node"]), "ngram-links")
    linked = verified.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = stored(components(verified.where("v is not null").select("u", "v"), "ngram-components").join(classes.select("node", "rep"), "node"), "ngram-roots")
    heads = roots.groupBy("root").agg(F.min("rep").alias("head"))
    roots = roots.select("node", "root").join(heads, "root").drop("root")
    classes = classes.select("digest_a", "digest_b", "rep", "copies", "node").join(linked, "node", "left").join(roots, "node", "left")
    return each, classes.select("digest_a", "digest_b", "rep", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("head", "rep").alias("head"))


def ngram_jaccard_join(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Links documents whose sets of 5-word shingles have Jaccard >= threshold.

    Returns a row for each input row: doc_id; class_id, the smallest doc_id that
    links lead to (its own included); copy_id, the smallest doc_id with an equal
    shingle set; n_links, the rows it links with directly.

    Words are what blanks and control characters separate, ASCII and Latin-1
    letters fold case. A text of one to four words is one shingle. Null, empty and
    blank texts have none: they link with nothing and are their own class. Rows of
    one doc_id and text are copies of each other; rows of one doc_id and different
    texts are documents of their own. A null doc_id has null class_id and links with
    nothing. An empty table gives an empty result. Columns other than doc_id and
    text are not read."""
    each, classes = _classes(documents, threshold, tolerance)
    live = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return each.select("doc_id", "digest_a", "digest_b", "n_shingles").join(classes, ["digest_a", "digest_b"], "left").select(
        "doc_id",
        F.when(live, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(live, F.col("rep.doc_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.when(live, F.col("copies") - 1 + F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each_class(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near duplicates: of each class one row stays, the first
    by doc_id and, of one doc_id, by the hash of its text. Rows with a null doc_id
    stay, as do those without words, but for repeats of one doc_id and text.

    What goes is broadcast up to BROADCAST_ROWS rows, so that texts stay where they
    are; beyond, documents and decisions are joined by shuffle."""
    each, classes = _classes(documents, threshold, TOLERANCE)
    rows = each.where("doc_id is not null").groupBy("doc_id", "text_hash", "digest_a", "digest_b").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n_shingles"))
    judged = rows.join(classes.select("digest_a", "digest_b", "head"), ["digest_a", "digest_b"], "left")
    stays = (F.col("n_shingles") == 0) | (F.struct("doc_id", "text_hash") == F.col("head"))
    gone = stored(judged.withColumn("stays", stays).where(~F.col("stays") | (F.col("rows") > 1)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "stays"), "ngram-decisions")
    small = gone.count() <= BROADCAST_ROWS
    sized = lambda df: F.broadcast(df) if small else df
    doc_id, text_hash = _key()
    same = (doc_id == F.col("__id")) & (text_hash == F.col("__hash"))
    single = documents.join(sized(gone), same, "left_anti")
    repeated = documents.join(sized(gone.where("stays")), same).dropDuplicates(["__id", "__hash"])
    return single.select(*documents.columns).unionByName(repeated.select(*documents.columns))
