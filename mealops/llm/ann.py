"""Approximate nearest neighbours by adaptive dimension scans (operator 12).

Nearness is the inner product, in double precision.

1. *Fit.* A bounded sample (``sample_rows`` rows, chosen by a hash of the id)
   gives the centroids of the lists (k-means) and the number of lists to
   probe: the fewest at which the sample's own neighbours are found with the
   wanted recall. A random rotation is drawn from a fixed seed.
2. *Index.* Every valid row is in the index. Equal vectors are one point with
   its ``k + 1`` smallest ids (an id beyond those can never be among the k
   nearest, since ties go to smaller ids), so copies multiply no work. A
   point goes to the list of its nearest centroid; lists are cut into blocks
   of about ``block_rows`` points, so a hot list is many tasks.
3. *Scan.* Different query vectors travel in packets to the blocks of their
   probed lists. A block holds its vectors rotated, in column blocks. After
   the first column block all (query, vector) pairs have a partial distance;
   a hypothesis test abandons a pair if its partial distance is larger than
   any vector among the k nearest would show, but for ``epsilon`` standard
   deviations. Only pairs that stay read the next column block. The threshold
   is the query's (k + 1)-th best exact score among the *pivots*, a sixteenth
   of the rows, ``most_pivots`` at most; pivots are found rows, too.
4. Pairs that reach the end are scored exactly on the original vectors (a sum
   in the order of the components, in doubles); per query the best ids of all
   blocks are merged by a window with a group limit, and the query's own id
   is taken out.

With q.x >= t as |q - x|^2 <= |q|^2 + |x|^2 - 2 t, the threshold of a pair's
distance follows from the query's threshold and both norms, so vectors of any
length are searched by inner product.

Defined cases: vectors that are null, all zero, hold null or non-finite
components, or have another number of components than most take no part;
neither do rows without an id; rows with equal id and vector count once;
rows that share the query's id are its own; ties go to the smaller id; fewer
candidates than k -> all; empty table -> empty result; other columns are not
carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_small, rows_named, written

_PACKET = 512


@dataclass(frozen=True)
class Index:
    """What a search needs beside the vectors: at most the sample's size."""

    centroids: np.ndarray          # (lists, dims)
    rotation: np.ndarray           # (dims, dims), orthogonal
    pivots: np.ndarray             # (pivots, dims): rows of the sample, scored exactly for the first thresholds
    pivot_ids: np.ndarray
    probes: int
    step: int                      # components in a column block
    epsilon: float


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part."""
    d = rows_named(vectors, vec_id, embedding)
    v = d.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vec", lambda x: x != 0))
    sizes = v.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    dims = sizes.agg(F.max_by("dims", F.struct("n", "dims"))).first()[0]
    return v.where(F.size("vec") == F.lit(dims if dims is not None else 0))


def _kmeans(x: np.ndarray, lists: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (2 * x @ centroids.T - (centroids ** 2).sum(axis=1)).argmax(axis=1)


def _probes(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, rng: np.random.Generator) -> int:
    """The fewest probed lists at which sampled queries find ``recall`` of their k nearest within the sample."""
    q = rng.permutation(len(x))[:256]
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(centroids)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order = np.argsort(-(x[q] @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, nearest(x, centroids)[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def fit(points: DataFrame, k: int = 20, sample_rows: int = 16_384, most_lists: int = 512, most_pivots: int = 4096,
        recall: float = 0.96, step: int = 16, epsilon: float = 2.1, seed: int = 7) -> Index | None:
    """An index over valid rows (id, vec); None if there is no row.

    The sample is bounded by ``sample_rows``: rows whose hash falls below its share, the smallest hashes first.
    Lists: half the root of the number of rows, ``most_lists`` and one for 64 rows at most.
    """
    n = points.count()
    if not n:
        return None
    h = F.xxhash64(F.col("id"), F.lit(seed))
    share = min(1.0, 1.1 * sample_rows / n + 64 / n)
    low = points.where(F.shiftrightunsigned(h, 1) < F.lit(int(share * (2 ** 63 - 1)))) if share < 1 else points
    rows = low.orderBy(h, "id").limit(sample_rows).collect()
    x = np.array([r.vec for r in rows], np.float64)
    rng = np.random.default_rng(seed)
    lists = int(max(1, min(most_lists, round(np.sqrt(n) / 2), len(x) // 64)))
    centroids = _kmeans(x, lists, 8, rng)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    pivots = min(most_pivots, n // 16, len(x))
    pivots = pivots if pivots > k else 0
    ids = np.array([r.id for r in rows[:pivots]], np.int64)
    return Index(centroids, rotation, x[:pivots], ids, _probes(x, centroids, k, recall, rng), step, epsilon)


def _listed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value.centroids
        for batch in batches:
            x = _rows(batch.column(1), centroids.shape[1])
            ids = [np.array(i, np.int64) for i in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(nearest(x, centroids), pa.int32()), pa.array([i[0] for i in ids], pa.int64()),
                                   pa.array([i.tobytes() for i in ids], pa.binary()), _cells(x)],
                                  names=["list", "low", "ids", "vec"])
    return run


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _cells(x: np.ndarray) -> pa.Array:
    """One binary value a row: its components as doubles."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, np.float64)], pa.binary())


def _packets(shared, points: dict[int, int], blocks: dict[int, int], k: int):
    """Batches of different query vectors -> packets (list, block, ids, thresholds, vectors).

    A query probes the index's number of lists, and more until they hold ``k + 2`` points.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        size = np.array([points.get(c, 0) for c in range(len(ix.centroids))])
        for batch in batches:
            x = _rows(batch.column(1), ix.centroids.shape[1])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(x), _PACKET):
                q, own = np.ascontiguousarray(x[a:a + _PACKET]), ids[a:a + _PACKET]
                least = np.full(len(q), -np.inf)
                if len(ix.pivots):                        # the query itself may be a pivot: one more than k
                    least = -np.partition(-(q @ ix.pivots.T), k, axis=1)[:, k]
                    least -= 1e-9 * np.abs(least)         # rounding never hides a tie
                order = np.argsort(-(q @ ix.centroids.T), axis=1)
                before = np.cumsum(size[order], axis=1) - size[order]
                wanted = (np.arange(len(size)) < ix.probes) | (before < k + 2)
                out = []
                for one in range(len(size)):
                    rows = np.flatnonzero((wanted & (order == one)).any(axis=1))
                    if len(rows):
                        cells = (own[rows].tobytes(), least[rows].tobytes(), q[rows].tobytes())
                        out += [(one, b, *cells) for b in range(blocks.get(one, 0))]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (
                    pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                    names=["list", "block", "ids", "least", "vec"])
    return run


def _products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of q and j of x, summed in the order of the components."""
    score = np.zeros(len(i))
    for c in range(q.shape[1]):
        score += q[i, c] * x[j, c]
    return score


def _pivot_hits(shared, k: int):
    """Batches of query vectors -> (query, id, score): their k + 1 best pivots and ties."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            x = _rows(batch.column(1), ix.centroids.shape[1])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(x) if len(ix.pivots) else 0, _PACKET):
                q = x[a:a + _PACKET]
                near = np.argpartition(-(q @ ix.pivots.T), k, axis=1)[:, :k + 1]
                i, j = np.repeat(np.arange(len(q)), k + 1), near.ravel()
                yield pa.record_batch([pa.array(ids[a + i]), pa.array(ix.pivot_ids[j]),
                                       pa.array(_products(q, ix.pivots, i, j))], names=["query", "id", "score"])
    return run


class Block:
    """The points of a block: rotated vectors in column blocks, original vectors, ids."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], index: Index):
        self.x, self.ids, self.epsilon = vectors, ids, index.epsilon
        self.rotation, self.step = index.rotation, index.step
        turned = vectors @ index.rotation
        self.columns = [np.ascontiguousarray(turned[:, a:a + index.step]) for a in range(0, turned.shape[1], index.step)]
        self.squares = (vectors ** 2).sum(axis=1)
        self.norms = [(c ** 2).sum(axis=1) for c in self.columns]

    def stays(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs that no test abandons.

        Partial distances are matrices while over a seventh of the pairs stay, and lists of pairs afterwards.
        """
        dims, seen = q.shape[1], 0
        turned = q @ self.rotation
        # a pair's largest squared distance, were it among the nearest
        far = ((q ** 2).sum(axis=1) - 2 * least)[:, None] + self.squares[None, :]
        slack = 1e-9 * (1 + np.abs(far))
        part, i, j = np.zeros_like(far), None, None
        for column, squares in zip(self.columns, self.norms, strict=True):
            own = turned[:, seen:seen + self.step]
            seen += column.shape[1]
            if i is None:
                part += (own ** 2).sum(axis=1)[:, None] + squares[None, :] - 2 * own @ column.T
                on = part <= self._limit(seen, dims) * far + slack
                if 7 * np.count_nonzero(on) < on.size or seen == dims:
                    i, j = np.nonzero(on)
                    part, far, slack = part[i, j], far[i, j], slack[i, j]
            else:
                part = part + ((own[i] - column[j]) ** 2).sum(axis=1)
                on = part <= self._limit(seen, dims) * far + slack
                i, j, part, far, slack = i[on], j[on], part[on], far[on], slack[on]
        return i, j

    def _limit(self, seen: int, dims: int) -> float:
        """A partial distance over ``seen`` of ``dims`` components is at most this share of a distance, by the test."""
        return 1.0 if seen >= dims else (seen / dims) * (1 + self.epsilon / np.sqrt(seen)) ** 2

    def search(self, ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, chunk: int = 64) -> list[tuple]:
        """(query id, id, score): the k + 1 best ids of every query in this block, of those at or over its threshold."""
        out = []
        for a in range(0, len(q), chunk):
            i, j = self.stays(q[a:a + chunk], least[a:a + chunk])
            if not len(i):
                continue
            score = _products(q, self.x, a + i, j)
            on = score >= least[a + i]
            i, j, score = i[on], j[on], score[on]
            order = np.lexsort((j, -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, np.arange(i.max() + 1)) if len(i) else np.zeros(0, np.int64)
            place = np.arange(len(i)) - first[i] if len(i) else first
            near = np.flatnonzero(place <= k)              # points: each has one id at least ...
            if len(near):                                  # ... and so have the points that tie with the last of them
                last = np.full(len(first), -np.inf)
                last[i[place == k]] = score[place == k]
                near = np.flatnonzero((place <= k) | (score == last[i]))
            for p in near.tolist():
                for one in self.ids[j[p]].tolist():
                    out.append((int(ids[a + i[p]]), one, float(score[p])))
        return out


def _scanned(shared, k: int):
    """Rows sorted by (list, block, kind): the block's points, then packets of queries -> (query, id, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        dims, at, vectors, ids, block = ix.centroids.shape[1], None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            for one, b, kind, own, least, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (one, b) != at:
                    at, vectors, ids, block = (one, b), [], [], None
                if kind == 0:
                    vectors.append(np.frombuffer(vec))
                    ids.append(np.frombuffer(own, np.int64))
                    continue
                if block is None:
                    block = Block(np.array(vectors).reshape(-1, dims), ids, ix)
                out += block.search(np.frombuffer(own, np.int64), np.frombuffer(vec).reshape(-1, dims),
                                    np.frombuffer(least), k)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                    pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "id", "score"])
    return run


def _same_vector() -> list[Column]:
    """Keys of equal vectors: a hash, on which the sort decides, then the vector."""
    return [F.xxhash64("vec"), F.col("vec")]


def search(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20,
           block_rows: int = 4096, **fitting) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``queries`` (a condition on
    ``id``) holds, among all other rows. ``fitting`` goes to ``fit``."""
    spark = vectors.sparkSession
    rows = valid(vectors, vec_id, embedding)
    index = fit(rows, k, **fitting)
    if index is None:
        return spark.createDataFrame([], f"query_id long, rank int, {vec_id} long, score double")
    shared = spark.sparkContext.broadcast(index)
    cores = spark.sparkContext.defaultParallelism

    # Points: only the k + 1 smallest ids of a vector are shuffled (the limit runs before the exchange).
    place = F.dense_rank().over(Window.partitionBy(*_same_vector()).orderBy("id"))
    points = (rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy(*_same_vector())
              .agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids", "vec"))
    listed = written(points.mapInArrow(_listed(shared), "list int, low long, ids binary, vec binary"), "ann-points")
    sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()        # one row a list
    blocks = {r["list"]: -(-r["n"] // block_rows) for r in sizes}
    cut = F.broadcast(spark.createDataFrame(list(blocks.items()), "list int, blocks int"))
    held = listed.join(cut, "list").select(
        "list", F.pmod(F.xxhash64("low"), F.col("blocks").cast("long")).cast("int").alias("block"),
        F.lit(0).alias("kind"), "ids", F.lit(None).cast("binary").alias("least"), "vec")

    # Queries: equal vectors ask once, under their smallest id.
    asked = rows.where(queries).distinct()
    asks = written(asked.groupBy(*_same_vector()).agg(F.min("id").alias("query")).select("query", "vec"), "ann-queries")
    packets = asks.mapInArrow(_packets(shared, {r["list"]: r["n"] for r in sizes}, blocks, k),
                              "list int, block int, ids binary, least binary, vec binary").select(
        "list", "block", F.lit(1).alias("kind"), "ids", "least", "vec")
    tasks = max(cores, sum(blocks.values()) // 2)
    found = (held.unionByName(packets).repartition(tasks, "list", "block")
             .sortWithinPartitions("list", "block", "kind").mapInArrow(_scanned(shared, k), "query long, id long, score double"))
    # A pivot may be found twice: as a pivot and in its list.
    found = found.unionByName(asks.mapInArrow(_pivot_hits(shared, k), "query long, id long, score double"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id"))
    top = (found.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k + 1)
           .groupBy("query").agg(F.sort_array(F.collect_set(F.struct("rank", "id", "score"))).alias("near")))
    # A table of its own, so that the join can split a vector that very many queries share.
    answers = written(top.join(asks, "query").select("vec", "near"), "ann-answers")
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    joined = asked.select(F.col("id").alias("query_id"), "vec").join(broadcast_small(answers), "vec")
    return joined.select("query_id", F.posexplode(near).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias(vec_id), "one.score")

