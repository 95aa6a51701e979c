"""Operator 5: exact top-k inner-product search by multi-resolution segment statistics.

Vectors are turned by an orthogonal matrix learned from the table, which keeps inner products and puts most of their
weight into the first components, and cut into segments. With a segment's means and deviations of two vectors,
Cauchy-Schwarz bounds their inner product there by length * (mean * mean + deviation * deviation). Levels go from
few segments, doubling in length, to more and more single components; at each, candidates whose bound stays under
the k-th score that a query has already are ruled out. Exact scores, from the untouched integers, are taken of the pairs that
are left and of no others.

Vectors are packed into blocks of bounded size; each block of queries meets the blocks of candidates of a slot one
after another, and its k-th scores rise from block to block. A query starts with its k-th score in one block.

Components become floor(256 * x). Vectors that are null or hold null or non-finite components take no part; vectors
are compared with those of their length only. Ties go to the smaller vec_id. A query never meets rows of its own
vec_id; other repeated rows each count. Fewer than k candidates: all of them. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import map_arrow, materialise, shuffle_partitions

BLOCK_ROWS, QUERY_ROWS = 2048, 512
#: The matrix is learned from at most about so many vectors, chosen by a hash of vec_id. Bounds hold with any such matrix.
LEARN_ROWS = 4_096
#: For so many vector lengths at most a first block of candidates is held against all queries; others start without a floor.
SEED_DIMS = 16
#: A level that rules out less than this share of the pairs is the last one.
LEAST_GAIN = 0.02
BLOCK = "slot int, dim int, number long, ids binary, data binary"


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256 * vectors.astype(np.float64))


def _vectors(batches):
    """(dim, ids, integer vectors) of each batch, for each length in it; unfit rows left out."""
    for b in batches:
        ids, vec = b.column(0), b.column(1)
        for dim in pa.compute.unique(pa.compute.list_value_length(vec)).to_pylist():
            if not dim:
                continue
            keep = pa.compute.fill_null(pa.compute.and_(pa.compute.equal(pa.compute.list_value_length(vec), dim), pa.compute.is_valid(ids)), False)
            values = vec.filter(keep).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            fine = np.isfinite(values).all(1)
            if fine.any():
                yield dim, ids.filter(keep).to_numpy()[fine], integers(values[fine])


def _pack(rows: int, slots: int):
    def over(batches):
        from pyspark import TaskContext

        held: dict[int, list] = {}
        part, sent = TaskContext.get().partitionId(), 0

        def send(dim):
            nonlocal sent
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            order = np.argsort(-(data * data).sum(1), kind="stable")  # blocks of like length, so some fall as a whole
            ids, data = ids[order], data[order]
            out = []
            for i in range(0, len(ids), rows):
                out.append(((part + sent) % max(slots, 1), dim, part << 32 | sent, ids[i : i + rows].astype("<i8").tobytes(), data[i : i + rows].astype("<f8").tobytes()))
                sent += 1
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["slot", "dim", "number", "ids", "data"])

        for dim, ids, data in _vectors(batches):
            held.setdefault(dim, []).append((ids, data))
            if sum(len(x[0]) for x in held[dim]) >= rows:
                yield send(dim)
        for dim in list(held):
            yield send(dim)

    return over


def blocks(vectors: DataFrame, rows: int, slots: int) -> DataFrame:
    """Blocks of at most `rows` vectors of one length, dealt over slots in turn."""
    return map_arrow(vectors.select("vec_id", "embedding"), lambda: _pack(rows, slots), BLOCK)


def learn_basis(vectors: DataFrame, max_rows: int = LEARN_ROWS) -> dict[int, np.ndarray]:
    """For each length met in a bounded sample, an orthogonal matrix whose first columns carry most of the vectors' weight."""
    total = vectors.count()
    part = vectors if total <= max_rows else vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_rows / total)))
    batches = part.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).toArrow().to_batches()
    seen: dict[int, np.ndarray] = {}
    for dim, _, data in _vectors(batches):
        seen[dim] = seen.get(dim, 0) + data.T @ data
    return {dim: np.linalg.eigh(m)[1][:, ::-1] for dim, m in seen.items()}


def levels(dim: int) -> list[int]:
    """How many first components each level holds singly."""
    return [n for n in (0, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024) if n < dim]


def segment_features(x: np.ndarray, single: int) -> np.ndarray:
    """The first components, then means and deviations of segments of doubling length, so weighted that two rows' product is the bound."""
    out, at, size = [x[:, :single]], single, max(1, single // 4)
    while at < x.shape[1]:
        seg = x[:, at : at + size]
        n = np.sqrt(seg.shape[1])
        out += [seg.mean(1)[:, None] * n, seg.std(1)[:, None] * n]
        at, size = at + size, size * 2
    return np.concatenate(out, 1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where all sums stay below 2**53, else by integers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2**53:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return q @ x.T


class Asked:
    """A block of queries with the best k of the candidates met so far, and their k-th scores."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, floor: np.ndarray, basis: np.ndarray | None, k: int) -> None:
        self.ids, self.data, self.floor, self.basis, self.k = ids, data, floor.copy(), basis, k
        self.turned = data if basis is None else data @ basis
        self.norm = np.sqrt((data * data).sum(1))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.pairs = self.scored = 0

    def survivors(self, x: np.ndarray) -> np.ndarray:
        """Which pairs of queries and candidates x no bound rules out."""
        mask = np.ones((len(self.ids), len(x)), bool)
        norm = np.sqrt((x * x).sum(1))
        slack = 1e-9 * self.norm[:, None] * norm[None, :] + 1e-3  # the turned vectors are rounded
        rows = np.flatnonzero(np.isfinite(self.floor))
        if not len(rows):
            return mask
        mask[rows] = (self.norm[rows][:, None] * norm[None, :] + slack[rows]) >= self.floor[rows][:, None]
        turned = x if self.basis is None else x @ self.basis
        for single in levels(x.shape[1]):
            part = mask[rows]
            rows, cols = rows[part.any(1)], np.flatnonzero(part.any(0))
            if not len(rows) or not len(cols):
                break
            old = mask[np.ix_(rows, cols)]
            bound = segment_features(self.turned[rows], single) @ segment_features(turned[cols], single).T
            new = old & (bound + slack[np.ix_(rows, cols)] >= self.floor[rows][:, None])
            mask[np.ix_(rows, cols)] = new
            if old.sum() - new.sum() < LEAST_GAIN * old.sum():
                break
        return mask

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        mask = self.survivors(x) & (self.ids[:, None] != ids[None, :])
        self.pairs += mask.size
        self.scored += int(mask.sum())
        counts = mask.sum(1)
        # Queries that are left with nearly all candidates share one product, which is of those pairs; others take their own rows.
        dense = np.flatnonzero(counts >= len(ids) - (self.ids[:, None] == ids[None, :]).sum(1))
        scores = dict(zip(dense.tolist(), _products(self.data[dense], x))) if len(dense) else {}
        for i in np.flatnonzero(counts).tolist():
            at = np.flatnonzero(mask[i])
            s = scores[i][at] if i in scores else _products(self.data[i : i + 1], x[at])[0]
            good = s >= self.floor[i]
            s, c = s[good], ids[at[good]]
            if len(s) > 4 * self.k:
                least = np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, c = s[s >= least], c[s >= least]
            if len(s):
                best = sorted([*self.found[i], *zip((-s.astype(np.int64)).tolist(), c.tolist())])[: self.k]
                self.found[i] = best
                if len(best) == self.k:
                    self.floor[i] = max(self.floor[i], -best[-1][0])

    def rows(self) -> list[tuple[int, int, int]]:
        return [(int(q), c, -s) for q, mine in zip(self.ids.tolist(), self.found) for s, c in mine]


def _matrix(dim: int, ids: bytes, data: bytes):
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, dim)


def first_floor(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among some candidates."""
    s = np.where(qids[:, None] == cids[None, :], -np.inf, _products(q, x))
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] >= k else np.full(len(q), -np.inf)


def _start(seeds: dict[int, tuple[bytes, bytes]], k: int):
    def over(batches):
        for b in batches:
            floors = []
            for dim, ids, data in zip(*(b.column(i).to_pylist() for i in (1, 3, 4))):
                qids, q = _matrix(dim, ids, data)
                floor = first_floor(qids, q, *_matrix(dim, *seeds[dim]), k) if dim in seeds else np.full(len(q), -np.inf)
                floors.append(floor.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), b.column(4), pa.array(floors, pa.binary())], ["dim", "q_number", "q_ids", "q_data", "q_floor"])

    return over


def _meet(basis: dict[int, np.ndarray], k: int):
    def over(batches):
        at, asked = None, None

        def out():
            found = asked.rows() if asked is not None else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                dim, number = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if (dim, number) != at:
                    yield from out()
                    at = (dim, number)
                    qids, q = _matrix(dim, b.column(2)[i].as_py(), b.column(3)[i].as_py())
                    asked = Asked(qids, q, np.frombuffer(b.column(4)[i].as_py(), "<f8"), basis.get(dim), k)
                asked.meet(*_matrix(dim, b.column(5)[i].as_py(), b.column(6)[i].as_py()))
        yield from out()

    return over


def slot_keys(spark: SparkSession, slots: int) -> DataFrame:
    """slot, place: for each of `slots` partitions a number that hash partitioning deals to it, so that slots are dealt evenly. A row for each."""
    n = 16 * slots + 64
    while True:
        tried = spark.range(n).select(F.col("id").cast("int").alias("place"))
        keys = tried.groupBy(F.pmod(F.hash("place"), F.lit(slots)).alias("slot")).agg(F.min("place").alias("place"))
        rows = keys.collect()
        if len(rows) == slots:
            return spark.createDataFrame([(r.slot, r.place) for r in rows], "slot int, place int")
        n *= 2


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for each of `queries` against all of `vectors`."""
    slots = shuffle_partitions(vectors.sparkSession)
    basis = learn_basis(vectors.select("vec_id", "embedding"))
    candidates = materialise(blocks(vectors, BLOCK_ROWS, slots), "vectors")
    first = candidates.groupBy("dim").agg(F.min("number").alias("number")).orderBy("dim").limit(SEED_DIMS).collect()
    seeds: dict[int, tuple[bytes, bytes]] = {}
    for r in first:
        s = candidates.where((F.col("dim") == r.dim) & (F.col("number") == r.number)).select("ids", "data").first()
        seeds[r.dim] = (bytes(s.ids), bytes(s.data))
    asked = materialise(map_arrow(blocks(queries.coalesce(max(1, slots // 4)), QUERY_ROWS, 0), lambda: _start(seeds, k), "dim int, q_number long, q_ids binary, q_data binary, q_floor binary"), "queries")
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    # The join is on the slot's key alone, so that each slot is a partition; lengths are compared without being a key. A merge
    # join takes one row of its left side after another, so a query block meets all blocks of its slot in a row.
    keys = slot_keys(vectors.sparkSession, slots)
    asked = asked.join(F.broadcast(keys), "slot").drop("slot").repartition(slots, "place")
    candidates = candidates.join(F.broadcast(keys), "slot").select("place", F.col("dim").alias("c_dim"), "ids", "data").repartition(slots, "place")
    pairs = asked.join(candidates.hint("merge"), "place").where(F.col("dim") - F.col("c_dim") == 0).select("dim", "q_number", "q_ids", "q_data", "q_floor", "ids", "data")
    found = map_arrow(pairs, lambda: _meet(basis, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vector_search(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50."""
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
