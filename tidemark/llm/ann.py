"""Nearest neighbours by a block matrix join: int8 product tiles bound distances, survivors are recomputed exactly.

What is dealt out are int8 codes with a step and bounds on the error per vector, an eighth of the vectors' bytes. A group of
candidate tiles meets every tile of queries; pairs whose lower bound lies beyond the k-th upper bound go. The vectors of the
pairs that are left are fetched, their distances computed in double precision, and merged by bounded heaps.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Vectors of one tile; bytes of codes in one group of candidate tiles, at most about, and the least bytes for which a group
#: of its own is made until there are FEW_GROUPS (each group gets all queries once, so groups are large where vectors are
#: many); pairs that one query tile holds before they are thinned out.
CANDIDATES, QUERIES, GROUP_BYTES, LEAST_BYTES, FEW_GROUPS, PAIRS = 2048, 512, 32_000_000, 64_000, 32, 1 << 20


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, dims, v (array of double) of the rows that take part: no null id, and a vector that is neither null nor
    empty nor zero and holds only finite numbers."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(vector).alias("dims"), v.alias("v"))


_TILE = "dims int, part int, kind int, rows binary, ids binary, same binary, codes binary, step binary, error binary, square binary"


def _tiles(rows: DataFrame, most: int, kind: int) -> DataFrame:
    """Vectors of equal length, up to ``most`` to a row, as codes; rows, ids and hashes of vectors along with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, ids, same, dims, part = (batch.column(i).to_numpy() for i in range(5))
            flat = batch.column(5).flatten().to_numpy()
            begin = np.append(0, np.cumsum(dims))
            for d, p in sorted(set(zip(dims.tolist(), part.tolist(), strict=True))):
                at = np.flatnonzero((dims == d) & (part == p))
                for i in range(0, len(at), most):
                    own = at[i : i + most]
                    q = Quantised.of(flat[begin[own][:, None] + np.arange(d)])
                    data = [number[own], ids[own], same[own], q.codes, q.step, q.error, q.square]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (d, p, kind)] + [pa.array([x.tobytes()], pa.binary()) for x in data], names=[c.split()[0] for c in _TILE.split(", ")])

    return rows.select("row", "vec_id", "same", "dims", "part", "v").mapInArrow(run, _TILE)


class Quantised:
    """Vectors as int8 multiples of a step per vector, with bounds on what that leaves out."""

    def __init__(self, codes: np.ndarray, step: np.ndarray, error: np.ndarray, square: np.ndarray):
        self.codes, self.step, self.error, self.square = codes, step, error, square

    @staticmethod
    def of(x: np.ndarray) -> Quantised:
        with np.errstate(all="ignore"):  # what overflows becomes infinite, and bounds nothing
            step = np.abs(x).max(1) / 127.0
            step[step == 0] = 1.0
            codes = np.clip(np.rint(x / step[:, None]), -127, 127).astype(np.int8)
            rest = x - codes * step[:, None]
            error = np.sqrt((rest * rest).sum(1)) * (1 + 1e-9) + 1e-150
            return Quantised(codes, step, error, (codes.astype(np.float64) ** 2).sum(1) * step**2)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 vectors: exact, since sums of so many products fit a float's integers (or a double's)."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def bounds(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Below and above the distance of each query and candidate: the quantised vectors' distance, less and plus both errors."""
    with np.errstate(all="ignore"):
        square = q.square[:, None] + c.square[None, :] - 2.0 * _products(q.codes, c.codes) * q.step[:, None] * c.step[None, :]
        slack = 1e-12 * (q.square[:, None] + c.square[None, :])
        error = q.error[:, None] + c.error[None, :]
        low = np.maximum(np.sqrt(np.maximum(square - slack, 0)) - error, 0) * (1 - 1e-12)
        high = (np.sqrt(np.maximum(square + slack, 0)) + error) * (1 + 1e-12)
    fine = np.isfinite(low) & np.isfinite(high)  # squares beyond what doubles hold say nothing
    return np.where(fine, low, 0.0), np.where(fine, high, np.inf)


class Survivors:
    """Of each query of a tile, the candidates that may be among its k nearest.

    ``far`` is the k-th smallest upper bound so far; what lies beyond it for certain is dropped. Equal vectors (by their
    hash) are equally far, so no more than k of them are needed, those of smallest id.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, codes: Quantised, k: int):
        self.rows, self.ids, self.codes, self.k = rows, ids, codes, k
        self.far = np.full(len(ids), np.inf)
        self.highs = np.full((len(ids), k), np.inf)
        self.found: list[tuple] = []
        self.held = 0

    def meet(self, rows: np.ndarray, ids: np.ndarray, same: np.ndarray, codes: Quantised) -> None:
        low, high = bounds(self.codes, codes)
        own = self.ids[:, None] == ids[None, :]
        high[own] = np.inf
        both = np.concatenate([self.highs, high], 1)
        self.highs = np.partition(both, self.k - 1, axis=1)[:, : self.k]
        self.far = self.highs.max(1)
        q, c = np.nonzero((low <= self.far[:, None]) & ~own)
        self.found.append((q, rows[c], ids[c], same[c], low[q, c], high[q, c]))
        self.held += len(q)
        if self.held > PAIRS:
            self.thin()

    def thin(self) -> None:
        columns = [np.concatenate(x) for x in zip(*self.found, strict=True)]
        fine = columns[4] <= self.far[columns[0]]
        columns = [x[fine] for x in columns]
        order = np.lexsort((columns[1], columns[2], columns[3], columns[0]))
        columns = [x[order] for x in columns]
        fine = _leading((columns[0], columns[3]), self.k)
        self.found, self.held = [tuple(x[fine] for x in columns)], int(fine.sum())

    def pairs(self) -> pa.RecordBatch:
        self.thin()
        q, rows, ids, same, low, high = self.found[0]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.rows[q], self.ids[q], rows, ids, same)] + [pa.array(low), pa.array(high)], names=_PAIR_NAMES)


_PAIR_NAMES = ["query_row", "query_id", "row", "vec_id", "same", "low", "high"]
_PAIRS = "query_row long, query_id long, row long, vec_id long, same long, low double, high double"


def _leading(groups: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Of rows sorted by groups: whether each is among the first ``k`` of its group."""
    n = len(groups[0])
    first = np.flatnonzero(np.append(True, np.any([g[1:] != g[:-1] for g in groups], axis=0))) if n else np.empty(0, int)
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n))) < k


def _closest(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs that may still be among the query's ``k`` nearest when all groups' bounds are known: those whose lower
    bound is not beyond the k-th upper one, and of equal vectors the ``k`` of smallest id. A query's pairs, some per group,
    meet in order, one query at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            of = table.column(0).to_numpy()
            begin = int(np.searchsorted(of, of[-1])) if len(of) else 0
            yield from few(table.slice(0, begin))
            rest = table.slice(begin)
        if rest is not None:
            yield from few(rest)

    def few(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        of, low, high = (table.column(i).to_numpy() for i in (0, 5, 6))
        order = np.lexsort((high, of))
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        counts = np.diff(np.append(first, len(of)))
        limit = np.where(counts >= k, high[order][np.minimum(first + k - 1, len(of) - 1)], np.inf)
        table = table.filter(pa.array(low <= np.repeat(limit, counts)))
        of, row, ids, same = (table.column(i).to_numpy() for i in (0, 2, 3, 4))
        order = np.lexsort((row, ids, same, of))
        yield from table.take(pa.array(order[_leading((of[order], same[order]), k)])).to_batches()

    return pairs.repartition("query_row").sortWithinPartitions("query_row").mapInArrow(run, _PAIRS)


def distance(a: str, b: str) -> Column:
    """The Euclidean distance of two vectors in double precision, summed from the first component to the last."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def nearest(scored: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` smallest scores of each query, by heaps of ``k``; ties to the smaller vec_id.

    Each task thins out the queries of its rows; what is left of a query, k rows a task at most, meets in order.
    """

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, heap = None, []

        def rows() -> pa.RecordBatch:
            best = sorted((-s, -v) for s, v in heap)
            return pa.RecordBatch.from_arrays([pa.array([own] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([v for _, v in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for query, vec, score in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if query != own:
                    if heap:
                        yield rows()
                    own, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, (-score, -vec))
                elif (-score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (-score, -vec))
        if heap:
            yield rows()

    schema = "query_id long, rank int, vec_id long, score double"
    few = scored.select("query_id", "vec_id", "score").sortWithinPartitions("query_id").mapInArrow(heaps, schema)
    return few.select("query_id", "vec_id", "score").repartition("query_id").sortWithinPartitions("query_id").mapInArrow(heaps, schema)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest of ``vectors`` for each row of ``queries`` (vec_id, embedding): query_id, rank, vec_id, score.

    Candidates are dealt into groups of tiles; each query tile meets each group once, as rows of a join on the group,
    so neither side is ever held as a whole. A query's own vec_id is no candidate; vectors of other lengths than the
    query's are none; repeated rows are candidates each, and repeated queries are one. Ties go to the smaller vec_id;
    distances beyond what doubles hold are infinite and tie. Rows that can't take part (see :func:`usable`) are neither
    queries nor candidates. Other columns play no part; an empty table on either side gives no rows.
    """
    numbered = lambda df: df.withColumn("same", F.xxhash64("v"))
    held = cut(numbered(usable(vectors)))
    held = held.withColumn("row", F.monotonically_increasing_id())  # places in a written table: they do not change
    asked = cut(numbered(usable(queries)).dropDuplicates(["vec_id", "same"])).withColumn("row", F.monotonically_increasing_id())
    size = held.agg(F.sum(F.col("dims").cast("long"))).first()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES), min(FEW_GROUPS, math.ceil(size / LEAST_BYTES)))
    spread = held.withColumn("part", F.pmod(F.xxhash64("vec_id", "same"), F.lit(groups)).cast("int"))
    candidates = _tiles(spread.sortWithinPartitions("part") if groups > 1 else spread, CANDIDATES, 1)
    tiles = _tiles(asked.withColumn("part", F.lit(0)).coalesce(max(1, groups // 8)), QUERIES, 0)
    tiles = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*candidates.columns)
    together = candidates.unionByName(tiles).repartition(groups, "part").sortWithinPartitions("part", "dims", F.desc("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if place != (row["part"], row["dims"]):
                    place, block = (row["part"], row["dims"]), []
                rows, ids, same = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "same"))
                step, error, square = (np.frombuffer(row[c], np.float64) for c in ("step", "error", "square"))
                codes = Quantised(np.frombuffer(row["codes"], np.int8).reshape(len(ids), -1), step, error, square)
                if row["kind"]:
                    block.append((rows, ids, same, codes))
                elif block:
                    left = Survivors(rows, ids, codes, k)
                    for tile in block:
                        left.meet(*tile)
                    yield left.pairs()

    pairs = _closest(together.mapInArrow(run, _PAIRS), k)
    pairs = pairs.join(asked.select(F.col("row").alias("query_row"), F.col("v").alias("q")), "query_row").select("query_id", "q", "row", "vec_id")
    return nearest(pairs.join(held.select("row", "v"), "row").select("query_id", "vec_id", distance("q", "v").alias("score")), k)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every vec_id divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
