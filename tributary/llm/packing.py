"""Operator 10: packing documents into sequences of a set capacity by the linear grouping scheme.

All that a plan needs is how many pieces there are of each length, at most `capacity` numbers, whatever the input.
From these the driver (1) sorts large lengths into groups of equal cardinality and rounds each up to its group's
longest, (2) finds the best configurations of these few sizes by column generation, (3) puts the actual lengths in
the places of the rounded ones, and (4) best-fits what is left, longest first, counting equal bins and equal
lengths in bulk. The plan is a list of runs: pieces of one length, by rank, go to bins in a row. Each piece then
finds its place from its length and rank alone; ranks come from counts by part and length, so nothing is sorted.

Null text is empty: one piece, the end id. A length that divides evenly is cut into full pieces; else the first
piece is the shorter one. Rows that repeat a doc_id are packed each. An empty table gives no rows. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import map_arrow, materialise, small_batches
from tributary.llm.encoding import WINDOW_BYTES, spaced_encoder

CAPACITY = 1024
#: Schemes tried, as (groups, share of the capacity above which a length is large); the plan with the fewest bins wins.
SCHEMES = ((48, 0.5), (48, 0.4), (96, 0.34))

PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long"


def _cut(path: str, end_id: int, capacity: int):
    def over(batches):
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), defaultdict(int), spaced_encoder(path)
        for b in small_batches(batches, "text", WINDOW_BYTES):
            ids, bounds = encoder.encode(b.column(1), end_id)
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            cols: list[list] = [[] for _ in range(6)]
            for doc, begin, end in zip(b.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                n, at = end - begin, 0
                first = n % capacity or capacity
                for k in range(-(-n // capacity)):
                    size = min(n, first if k == 0 else capacity)
                    for c, v in zip(cols, (doc, k, at, size, zlib.crc32(data[4 * (begin + at) : 4 * (begin + at + size)]), seen[size])):
                        c.append(v)
                    seen[size] += 1
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(cols[0]), pa.int32())] + [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], ["part", "doc_id", "piece", "start", "length", "ids_crc32", "local_rank"])

    return over


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece; local_rank counts the pieces of its length before it in its part."""
    return map_arrow(docs.select("doc_id", "text"), lambda: _cut(tokenizer_path, end_id, capacity), PIECES)


class _Plan:
    """Bins by what room they have, and the runs so far. rank: how many pieces of each length have a place."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins, self.runs = capacity, 0, []
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def run(self, length: int, rank: int, count: int, first: int, offset: int, each: int = 1) -> None:
        """`count` pieces of `length` from `rank` on go to bins from `first` on, `each` to a bin, from `offset` on."""
        self.runs.append((length, rank, count, first, offset, each))

    def open(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """What taking the fullest bin with room for each piece in turn gives, for `count` equal pieces at once."""
        for room in sorted(r for r, x in self.room.items() if r >= length and x):
            spans, each = self.room[room], room // length
            while spans and count:
                first, bins = spans.pop()
                full = min(bins, count // each)
                if full:
                    self.run(length, rank, full * each, first, self.capacity - room, each)
                    rank, count = rank + full * each, count - full * each
                    self.room[room - each * length].append((first, full))
                if full < bins and count:
                    self.run(length, rank, count, first + full, self.capacity - room, count)
                    self.room[room - count * length].append((first + full, 1))
                    full, count = full + 1, 0
                if full < bins:
                    spans.append((first + full, bins - full))
            if not count:
                return
        each = self.capacity // length
        bins = -(-count // each)
        first = self.open(bins)
        self.run(length, rank, count, first, 0, each)
        if bins > 1:
            self.room[self.capacity - each * length].append((first, bins - 1))
        self.room[self.capacity - (count - (bins - 1) * each) * length].append((first + bins - 1, 1))


def best_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (pieces of each size in a bin) with how often each is used, rounded down, by column generation."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, float)
    for _ in range(40 * k):
        value = np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        s = np.array(sizes)
        for c in range(1, capacity + 1):
            fits = c >= s
            gain = np.where(fits, best[np.maximum(c - s, 0)] + value, -1.0)
            j = int(gain.argmax())
            best[c], pick[c] = (gain[j], j) if gain[j] > best[c - 1] else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
            else:
                c -= 1
        step, use = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int), int(use[j] + 1e-6)) for j in range(k) if use[j] + 1e-6 >= 1]


def _scheme(counts: dict[int, int], capacity: int, groups: int, large_share: float) -> _Plan:
    plan, rank = _Plan(capacity), defaultdict(int)
    large = sorted((n for n in counts if capacity * large_share < n < capacity), reverse=True)
    total = sum(counts[n] for n in large)
    grouped: list[list[list[int]]] = []  # for each group its (length, rank, count), longest first
    if total:
        each, room = -(-total // groups), 0
        for n in large:
            left = counts[n]
            while left:
                if not room:
                    grouped.append([])
                    room = each
                take = min(left, room)
                grouped[-1].append([n, rank[n], take])
                rank[n], left, room = rank[n] + take, left - take, room - take
        merged: list[list[list[int]]] = []
        for g in grouped:
            if merged and merged[-1][0][0] == g[0][0]:
                merged[-1] += g
            else:
                merged.append(g)
        grouped = merged
        for config, times in best_configurations([g[0][0] for g in grouped], [sum(x[2] for x in g) for g in grouped], capacity):
            slots = [j for j, n in enumerate(config) for _ in range(n)]
            times = min([times, *(sum(x[2] for x in grouped[j]) // config[j] for j in set(slots))])
            if not times:
                continue
            parts = []
            for j in slots:
                need, mine = times, []
                while need:
                    n, r, c = grouped[j][0]
                    take = min(need, c)
                    mine.append((n, r, take))
                    need -= take
                    if take == c:
                        grouped[j].pop(0)
                    else:
                        grouped[j][0] = [n, r + take, c - take]
                parts.append(mine)
            first, done, at = plan.open(times), 0, [[0, 0] for _ in parts]
            while done < times:
                span = min(p[i][2] - used for p, (i, used) in zip(parts, at))
                offset = 0
                for p, a in zip(parts, at):
                    n, r, c = p[a[0]]
                    plan.run(n, r + a[1], span, first + done, offset)
                    offset += n
                    a[1] += span
                    if a[1] == c:
                        a[0], a[1] = a[0] + 1, 0
                plan.room[capacity - offset].append((first + done, span))
                done += span
    left = defaultdict(list)
    for g in grouped:
        for n, r, c in g:
            left[n].append((r, c))
    for n in counts:
        if rank[n] < counts[n]:
            left[n].append((rank[n], counts[n] - rank[n]))
    for n in sorted(left, reverse=True):
        for r, c in left[n]:
            plan.best_fit(n, r, c)
    return plan


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs, ordered by length and rank, and the number of bins."""
    plan = min((_scheme(counts, capacity, *s) for s in SCHEMES), key=lambda p: p.bins)
    return np.array(sorted(plan.runs), np.int64).reshape(-1, 6), plan.bins


def _place(runs: np.ndarray):
    def over(batches):
        key = (runs[:, 0] << 44) + runs[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            run = runs[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            nth = rank - run[:, 1]
            bins, slot = run[:, 3] + nth // run[:, 5], nth % run[:, 5]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bins), pa.array(run[:, 4] + slot * length)], [*b.schema.names[:5], "sequence_id", "offset"])

    return over


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A place for each piece of a written table of pieces: sequence_id and offset."""
    tallies = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = make_plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tallies.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    return map_arrow(ranked, lambda: _place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(materialise(cut_pieces(docs, tokenizer_path), "pieces"))
