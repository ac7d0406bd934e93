"""Codes of vectors by one small codebook a part (operator 12).

Components become integers and vectors are cut into equal parts; each part position has a codebook, fitted by rounds of
assignment and means. In each round the driver builds a kd-tree over every codebook and broadcasts them; tasks search
them branch and bound, a batch of vectors at a time, and send one row of counts and sums per part and entry, however
many vectors they saw. Sums are integers, so neither their order nor the number of tasks changes a bit.

The search keeps the best (distance, index) found so far and enters a node if the least distance to its box is not above
it. Nodes of just that distance are entered too: an entry in one may be as near and have a lower index.

Defined cases: vectors that are null or hold null or non-finite components are dropped, and so are those of another
length than the vector with the smallest vec_id, which no codebook fits; a length that is no multiple of the number of
parts is filled up with zeros; vectors of length 0 have code 00.. and error 0. Rows without vec_id are coded like others
and come last among the first entries' candidates; rows that repeat a vec_id are candidates each. With fewer vectors
than entries there are fewer entries. Components beyond 2^17 are computed with unbounded integers, more slowly; an error
above the largest long is given as the largest long. Null labels are one label; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, salted_join, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Entries of a tree's leaf.
LEAF = 2
#: Below this size of integers, sums of a task's squares and components fit 64 bits.
NARROW = 1 << 29
BROADCAST_LABELS = 100_000
MOST = 2**63 - 1


def is_usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~odd


def integers(vectors: pa.Array, length: int, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x), as rows x parts x components; 64-bit integers where they are narrow, else Python's."""
    flat = scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    low = np.floor(flat)
    if np.abs(low).max(initial=0) < NARROW:
        found = low.astype(np.int64)
    else:
        found = np.array([int(x) for x in low.tolist()], object)
    found = found.reshape(len(vectors), length)
    if length % parts:
        found = np.hstack([found, np.zeros((len(found), -length % parts), found.dtype)])
    return found.reshape(len(vectors), parts, -(-length // parts))


class Tree:
    """A kd-tree over the entries of one codebook: boxes, leaves of entry indexes, cuts at the median of the widest side."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray):
        points = self.entries[own]
        low, high = points.min(axis=0), points.max(axis=0)
        if len(own) <= LEAF or points.shape[1] == 0:
            return low, high, own, None
        side = int(np.argmax(high - low))
        own = own[np.argsort(points[:, side], kind="stable")]
        half = len(own) // 2
        return low, high, None, (self._node(own[:half]), self._node(own[half:]))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, the lowest index of equal ones."""
        best = np.full(len(x), -1, x.dtype)
        index = np.zeros(len(x), np.int64)
        self._search(self.root, x, np.arange(len(x)), self._bound(self.root, x), best, index)
        return index, best

    @staticmethod
    def _bound(node, x: np.ndarray) -> np.ndarray:
        """Least squared distance of each row to the node's box."""
        out = np.maximum(np.maximum(node[0] - x, x - node[1]), 0)
        return (out * out).sum(axis=1)

    def _search(self, node, x: np.ndarray, rows: np.ndarray, bound: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        open_ = (best[rows] < 0) | (bound <= best[rows])
        rows = rows[open_.astype(bool)]
        if not len(rows):
            return
        _, _, own, children = node
        if own is not None:
            for e in own.tolist():
                d = x[rows] - self.entries[e]
                d = (d * d).sum(axis=1)
                old = best[rows]
                better = ((old < 0) | (d < old) | ((d == old) & (e < index[rows]))).astype(bool)
                best[rows[better]], index[rows[better]] = d[better], e
            return
        own = x[rows]
        left, right = (self._bound(child, own) for child in children)
        first = (left <= right).astype(bool)
        for child, at, b in ((0, first, left), (1, ~first, right), (1, first, right), (0, ~first, left)):  # the nearer box first
            self._search(children[child], x, rows[at], b[at], best, index)


def trees(books: list[np.ndarray]) -> list[Tree]:
    return [Tree(b) for b in books]


def as_numbers(values: list[int]) -> np.ndarray:
    narrow = all(abs(v) < NARROW for v in values)
    return np.array(values, np.int64 if narrow else object)


def coded(x: np.ndarray, of: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Entry indexes (rows x parts) and squared distances of each part."""
    found = []
    for k, tree in enumerate(of):
        own, entries = x[:, k], tree.entries
        if own.dtype != entries.dtype:  # one side is wide
            own, tree = own.astype(object), Tree(entries.astype(object))
        found.append(tree.nearest(own))
    return np.stack([i for i, _ in found], axis=1), [d for _, d in found]


def _sums(vectors: DataFrame, length: int, books: list[np.ndarray], scale: int) -> list[tuple[int, int, int, list[int]]]:
    """part, entry, count and sums of components, over all vectors: one round's work. Sums travel as digits in base 2^60,
    of which floats need at most four."""
    parts, width = len(books), books[0].shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(trees(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        counts = np.zeros((parts, ENTRIES_MAX), np.int64)
        totals = np.zeros((parts, ENTRIES_MAX, width), object)
        for batch in batches:
            x = integers(batch.column(0), length, parts, scale)
            codes, _ = coded(x, of)
            for k in range(parts):
                order = np.argsort(codes[:, k], kind="stable")
                used, starts, n = np.unique(codes[order, k], return_index=True, return_counts=True)
                counts[k, used] += n
                if len(used) and width:
                    totals[k, used] += np.add.reduceat(x[order, k], starts, axis=0).astype(object)
        rows = [(k, e, int(counts[k, e]), c, int(totals[k, e, c]) if width else 0) for k, e in zip(*np.nonzero(counts), strict=True) for c in range(max(1, width))]
        digits = [[(v >> (60 * j)) & (2**60 - 1) if j < 3 else v >> 180 for _, _, _, _, v in rows] for j in range(4)]
        columns = [[r[j] for r in rows] for j in range(4)] + digits
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", "place", "d0", "d1", "d2", "d3"])

    sums = vectors.select("vector").mapInArrow(run, "part long, entry long, n long, place long, d0 long, d1 long, d2 long, d3 long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    # parts x entries x components rows come to the driver, whatever the table's size
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), *map(exact, ("d0", "d1", "d2", "d3"))).orderBy("part", "entry", "place").collect():
        value = sum(int(r[f"d{j}"]) << (60 * j) for j in range(4))
        out.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(value)
    shared.destroy()
    return [(k, e, n, values) for (k, e), (n, values) in out.items()]


#: Codes have two hex digits, so a codebook has at most so many entries.
ENTRIES_MAX = 256


def fitted(vectors: DataFrame, length: int, first: list[np.ndarray], rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """Codebooks (entries x components, one a part) after the rounds."""
    books = first
    for _ in range(rounds):
        values = [b.astype(object) for b in books]
        for k, e, n, sums in _sums(vectors, length, books, scale):
            if books[k].shape[1]:
                values[k][e] = [s // n for s in sums]
        books = [as_numbers(b.ravel().tolist()).reshape(b.shape) for b in values]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def code_vectors(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every usable vector."""
    if not 0 < entries <= ENTRIES_MAX:
        raise ValueError(f"a codebook has 1 to {ENTRIES_MAX} entries")
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    vectors = vectors.where(is_usable(F.col("vector")))
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    length = len(first[0]["vector"]) if first else 0
    vectors = vectors.where(F.size("vector") == length)
    seeds = pa.array([r["vector"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()], pa.list_(pa.float64()))
    start = integers(seeds, length, parts, scale)
    books = [start[:, k] for k in range(parts)]
    if len(seeds):
        books = fitted(vectors, length, books, rounds, scale)
    shared = embeddings.sparkSession.sparkContext.broadcast(trees(books) if len(seeds) else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, distances = coded(integers(batch.column(2), length, parts, scale), shared.value)
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            error = [min(sum(map(int, d)), MOST) for d in zip(*(d.tolist() for d in distances), strict=True)]
            arrays = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    rows = materialize(vectors.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), "codes")
    key = F.struct(F.col("label").isNull().alias("none"), "label")
    by = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    by = by.select(F.to_json(key, {"ignoreNullFields": "false"}).alias("key"), F.least("label_error", F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    rows = rows.withColumn("key", F.to_json(key, {"ignoreNullFields": "false"}))
    rows = salted_join(rows, by, ["key"], "inner", F.xxhash64("vec_id", "code"), BROADCAST_LABELS)
    return rows.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(table(spark, sf_dir, "embeddings")).drop("label")


def _sql() -> str:
    """The same in SQL, a pair of steps a round; distances are compared with every entry."""
    pick = """a{k} AS MATERIALIZED (SELECT vec_id, p, v, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (
  SELECT x.vec_id, x.p, x.v, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: cast((z[1] - z[2]) * (z[1] - z[2]) AS hugeint))) AS d FROM x JOIN b{k} b ON b.p = x.p) GROUP BY vec_id, p, v)"""
    mean = """b{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, e, list(m ORDER BY c) AS v FROM (
  SELECT p, e, c, cast(floor(sum(y) / count(*)) AS bigint) AS m FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS c FROM a{k}) GROUP BY ALL) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""
    mean = mean.replace("floor(sum(y) / count(*))", "(sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*)")
    steps = ",\n".join(f"{pick.format(k=k)},\n{mean.format(k=k, n=k + 1)}" for k in range(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda y: cast(floor({SCALE} * cast(y AS double)) AS bigint)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS v FROM kept, range({PARTS}) AS r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
b0 AS MATERIALIZED (SELECT x.p, f.e, x.v FROM x JOIN first f ON f.vec_id = x.vec_id),
{steps},
{pick.format(k=ROUNDS)},
done AS (SELECT vec_id, string_agg(printf('%02x', cast(e AS int)), '' ORDER BY p) AS code, cast(sum(d) AS bigint) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT d.vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error,
  (SELECT sha256(string_agg(cast(y AS varchar), ',' ORDER BY p, e, c)) FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS c FROM b{ROUNDS})) AS codebooks_sha256
FROM done d JOIN kept k ON k.vec_id = d.vec_id
"""


OP12_SQL = _sql()
