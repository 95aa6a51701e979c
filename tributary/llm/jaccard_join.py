"""Operator 4: n-gram Jaccard join by partitioning the universe of shingles (pigeonhole), verified exactly.

Set sizes fall into bands. Of two sets with 100 * intersection >= 80 * union, the symmetric difference is at most
a ninth of their sizes' sum, H. A band's scheme cuts the universe of hashed shingles into segments. A set indexes
its subset of each segment under its own band's scheme, and the larger set of a pair probes under the scheme of the
smaller one's band. Small sets use few segments, each with its one-deletion neighbourhood (which covers a
difference of one in a segment); large ones use more segments than H + 1, exact subsets alone.

Costs decide which segments a set probes with: first by their size, as subsets of few shingles are common; then, when
it is known how many sets share each subset, those that many share are left out as long as H + 1 remain. A pair
must share as many of the probed subsets as exceed H.

Each set also has an odd sketch, a bit for the parity of its hashes in each of SKETCH_BITS cells: two sketches differ in
at most as many bits as the sets differ in shingles, so pairs whose sketches differ by more than H never leave a join.

Equal sets are one vertex, under the fingerprint of the set. In a first round each set is verified against the sets
that share most subsets in its groups (stars, so a large group of near copies costs one verification or a few for each
member); in a second one, pairs that share a subset but are in no common component yet. Verification counts the
intersection of the two texts' sets. No group is ever gathered whole, no pair inside a component is formed.

Null text counts as empty; an empty text is linked with nothing and is its own component. Rows that repeat a doc_id
share its class. An empty table gives no rows. Columns other than doc_id and text are ignored. Shingles and
fingerprints are 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import bins_for, join_by_class, map_arrow, materialise, shuffle_partitions, small_batches
from tributary.llm.shingles import mix, shingle_sets

#: Sets up to this size use one-deletion neighbourhoods.
DELETION_SIZE = 40
#: Segments of a scheme, and segments probed with, for each that the pigeonhole principle needs.
SEGMENTS, PROBES = 1.2, 1.1
#: Subsets that more sets share are left out of probing where enough others remain.
COMMON = 64
STARS = 3
#: A subset that so many sets of one block share goes past the bins, but for HOT_KEPT of them.
HOT_LOCAL, HOT_KEPT = 16, 3
#: Up to so many ids of candidates (16 bytes each) are broadcast to fetch their texts; beyond it their join is shuffled.
BROADCAST_IDS = 1_000_000
OWN, PROBE, LOW, PAST = 1, 2, 4, 8
SKETCH_BITS = 512
#: Signatures of a block; a worker takes some 60 bytes for each.
BLOCK_SIGNATURES = 2_000_000
SKETCH = [f"o{i}" for i in range(SKETCH_BITS // 64)]
_BANDS = [1]
while _BANDS[-1] < 1 << 31:
    _BANDS.append(max(_BANDS[-1] + 1, _BANDS[-1] * 5 // 4))
_BANDS = np.array(_BANDS)


def band_of(n: int) -> int:
    return int(np.searchsorted(_BANDS, n, "right")) - 1


class Scheme:
    """Segments of a band: their bounds among hashes, and whether they have one-deletion neighbourhoods."""

    def __init__(self, band: int) -> None:
        self.band, self.top = band, int(_BANDS[band + 1]) - 1
        most = (self.top + self.top * 5 // 4) // 9 + 1
        self.deletions = self.top <= DELETION_SIZE
        self.count = -(-most // 2) if self.deletions else int(np.ceil(SEGMENTS * most))
        edge = (np.arange(1, self.count, dtype=np.uint64) << np.uint64(32)) // np.uint64(self.count)
        self.bounds = edge << np.uint64(32)
        self.names = mix(np.arange(self.count, dtype=np.uint64) + np.uint64(band << 32) + np.uint64(1))

    def probes(self, n: int) -> int:
        """Segments that a set of n shingles probes with."""
        return min(self.count, int(np.ceil(PROBES * ((n + min(n, self.top)) // 9 + 1))))


_SCHEMES: dict[int, Scheme] = {}


def scheme(band: int) -> Scheme:
    if band not in _SCHEMES:
        _SCHEMES[band] = Scheme(band)
    return _SCHEMES[band]


def signatures(s: np.ndarray, total: np.ndarray, sch: Scheme, own: bool):
    """Hashes of the subsets (and neighbourhoods) of a set under a scheme, their flags, and how many are probed with.

    total: sums of the scrambled hashes of s up to each place.
    """
    at = np.concatenate(([0], np.searchsorted(s, sch.bounds), [len(s)]))
    subset = total[at[1:]] - total[at[:-1]]
    if sch.deletions:
        segment = np.repeat(np.arange(sch.count), np.diff(at))
        less = subset[segment] - (total[1:] - total[:-1])
        sig = np.concatenate((mix(subset ^ sch.names), mix(less ^ sch.names[segment])))
        return sig, np.full(len(sig), OWN | PROBE if own else PROBE | LOW, np.uint8), 0
    sizes, probes = np.diff(at), sch.probes(len(s))
    used = np.argsort(-sizes, kind="stable")[:probes]
    sig = mix(subset ^ sch.names)
    if not own:
        return sig[used], np.full(probes, PROBE | LOW, np.uint8), probes
    flags = np.full(sch.count, OWN, np.uint8)
    flags[used] |= PROBE
    return sig, flags, probes


def _signed(s: np.ndarray):
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)))))
    fp = mix(total[-1:] + np.uint64(len(s)))[0]
    band = band_of(len(s))
    own = signatures(s, total, scheme(band), True)
    if band and 5 * (int(_BANDS[band]) - 1) >= 4 * len(s):
        low = signatures(s, total, scheme(band - 1), False)
        return fp, np.concatenate((own[0], low[0])), np.concatenate((own[1], low[1])), own[2], low[2]
    return fp, own[0], own[1], own[2], 0


def fingerprint(s: np.ndarray) -> int:
    total = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(s))], np.uint64))[0].astype(np.int64))


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes by cell, as signed 64-bit numbers."""
    cell = ((s * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - (SKETCH_BITS - 1).bit_length())).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=SKETCH_BITS).astype(np.uint8) & 1).view("<i8")


def _classify(batches):
    for b in small_batches(batches, "text", 1 << 20):
        sets = shingle_sets([t or "" for t in b.column(1).to_pylist()])
        odd = np.array([odd_sketch(s) for s in sets]).reshape(-1, len(SKETCH))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), *map(pa.array, np.ascontiguousarray(odd.T))], ["doc_id", "n", "fp", *SKETCH])


def _emit(bins: int, most: int = BLOCK_SIGNATURES):
    """Signatures packed by bin; a pack has each set once, with how many of its signatures follow.

    Signatures that many sets of the block share are known to be shared already: only a few of them go to the bin,
    to stand for the block there, and the others go past it, spread over all bins. So a bin gets at most HOT_LOCAL
    entries of a signature from a block, however many sets share it.
    """

    def packed(held):
        fp, n, f_own, f_low = (np.array(x) for x in zip(*held["docs"]))
        sig, flag = np.concatenate(held["sig"]), np.concatenate(held["flag"])
        doc = np.repeat(np.arange(len(fp), dtype=np.int32), held["count"])
        bin_ = (sig % np.uint64(bins)).astype(np.int32)
        order = np.lexsort((-(flag & (OWN | PROBE)).astype(np.int64), sig))
        first = np.flatnonzero(np.concatenate(([True], sig[order][1:] != sig[order][:-1])))
        size = np.diff([*first, len(sig)])
        # Sorted by flags: the first has both flags if any has; else the first and the last have one each.
        place = np.arange(len(sig)) - np.repeat(first, size)
        past = (np.repeat(size, size) >= HOT_LOCAL) & (place >= HOT_KEPT - 1) & (place < np.repeat(size, size) - 1)
        past = order[past]
        flag[past] |= PAST
        bin_[past] = (fp[doc[past]] % np.uint64(bins)).astype(np.int32)
        order = np.argsort(bin_, kind="stable")
        ends = np.searchsorted(bin_[order], np.arange(bins + 1))
        z = zstandard.ZstdCompressor(level=1)
        for k in range(bins):
            mine = order[ends[k] : ends[k + 1]]
            if len(mine):
                docs, counts = np.unique(doc[mine], return_counts=True)
                parts = [fp[docs].astype("<u8"), n[docs].astype("<u4"), f_own[docs].astype("<u4"), f_low[docs].astype("<u4"), counts.astype("<u4"), flag[mine]]
                yield k, np.array([len(docs), len(mine)], "<u4").tobytes() + sig[mine].astype("<u8").tobytes() + z.compress(b"".join(x.tobytes() for x in parts))

    def over(batches):
        held, seen = defaultdict(list), set()
        total = 0

        def send():
            for k, data in packed(held):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["bin", "payload"])

        for b in small_batches(batches, "text", 1 << 20):
            for s in shingle_sets([t or "" for t in b.column(0).to_pylist()]):
                if len(s):
                    fp, sig, flag, f_own, f_low = _signed(s)
                    if fp not in seen:
                        seen.add(fp)
                        held["docs"].append((fp, len(s), f_own, f_low)), held["sig"].append(sig), held["flag"].append(flag), held["count"].append(len(sig))
                        total += len(sig)
            if total >= most:
                yield from send()
                held, total = defaultdict(list), 0
                seen.clear()
        if total:
            yield from send()

    return over


def _shared(batches):
    """Of each bin, the signatures that different sets share, with one that probes and one that is indexed."""

    def found(packs):
        cols: list[list] = [[] for _ in range(5)]
        for data in packs:
            nd, ne = np.frombuffer(data, "<u4", 2).tolist()
            raw = zstandard.ZstdDecompressor().decompress(data[8 + 8 * ne :])
            at = 8 * nd
            n, f_own, f_low, counts = (np.frombuffer(raw, "<u4", nd, at + 4 * nd * i) for i in range(4))
            flag = np.frombuffer(raw, np.uint8, ne, at + 16 * nd)
            doc = np.repeat(np.arange(nd), counts)
            for c, v in zip(cols, (np.frombuffer(data, "<u8", ne, 8), np.frombuffer(raw, "<u8", nd)[doc], n[doc], np.where(flag & LOW, f_low[doc], f_own[doc]), flag)):
                c.append(v)
        sig, fp, n, f, flag = (np.concatenate(c) for c in cols)
        past = flag & PAST != 0
        known = [c[past] for c in (sig, fp, n, f, flag & ~np.uint8(PAST))]
        sig, fp, n, f, flag = (c[~past] for c in (sig, fp, n, f, flag))
        order = np.argsort(sig, kind="stable")
        near = sig[order]
        same = np.concatenate(([False], near[1:] == near[:-1], [False])) if len(near) else np.zeros(1, bool)
        order = order[same[1:] | same[:-1]] if len(near) else order
        sig, fp, n, f, flag = sig[order], fp[order], n[order], f[order], flag[order]
        order = np.lexsort((flag, fp, sig))
        sig, fp, n, f, flag = sig[order], fp[order], n[order], f[order], flag[order]
        once = np.concatenate((np.any([sig[1:] != sig[:-1], fp[1:] != fp[:-1]], axis=0), [True])) if len(sig) else np.zeros(0, bool)  # of equal ones the last, which has most flags
        sig, fp, n, f, flag = sig[once], fp[once], n[once], f[once], flag[once]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
        g = np.diff([*first, len(sig)]) if len(sig) else first
        good = (g > 1) & (np.bitwise_or.reduceat(flag, first) & (OWN | PROBE) == OWN | PROBE) if len(sig) else first.astype(bool)
        keep, g = np.repeat(good, g), np.repeat(g, g)
        cols = [np.concatenate((c[keep], k)) for c, k in zip((sig, fp, n, f, flag, g), (*known, np.full(int(past.sum()), HOT_LOCAL)))]
        if not len(cols[0]):
            return None
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(cols, kinds)], ["sig", "fp", "n", "f", "flag", "g"])

    at, packs = None, []
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != at and packs:
                if (out := found(packs)) is not None:
                    yield out
                packs = []
            at = k
            packs.append(data)
    if packs and (out := found(packs)) is not None:
        yield out


def _verify(batches):
    last, kept = None, None
    for batch in batches:
        for b in small_batches(iter([batch]), "text_a", 1 << 20):
            a_id, b_id, a_text, b_text = (b.column(i).to_pylist() for i in range(4))
            linked = []
            for x, s in enumerate(shingle_sets(a_text)):
                if b_id[x] != last:
                    last, kept = b_id[x], shingle_sets([b_text[x]])[0]
                both = len(np.intersect1d(s, kept, assume_unique=True))
                linked.append(100 * both >= 80 * (len(s) + len(kept) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b: fingerprints) whose sets are similar. Texts come from each set's first document."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes.select("fp", "doc_id"), "fp")
    ids = materialise(ids, "candidates")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids) if few else ids, "doc_id").groupBy("fp").agg(F.first("text").alias("text"))
    texts = materialise(texts, "texts")
    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return materialise(map_arrow(both.select("a", "b", "text_a", "text_b"), lambda: _verify, "a long, b long"), "links")


def components(links: DataFrame, what: str = "labels") -> DataFrame:
    """fp, label: the smallest fp that links reach, for each fp with a link. Each round passes the smallest label on
    to neighbours, then takes the label's own label."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.col("fp"), F.min("b")).alias("label")), what)
    while True:
        near = both.join(labels, both.b == labels.fp).groupBy("a").agg(F.min("label").alias("near"))
        passed = labels.join(near, labels.fp == near.a).select("fp", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = labels.select(F.col("fp").alias("label"), F.col("label").alias("next"))
        new = materialise(passed.join(own, "label").select("fp", "old", F.least("label", "next").alias("label")), what)
        if not new.where("label <> old").limit(1).count():
            return new.select("fp", "label")
        labels = new.select("fp", "label")


def _allowed(n_a, n_b):
    return F.floor((n_a + n_b) / 9)


def link(docs: DataFrame, shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links between sets, enough of them to connect whatever similar sets connect."""
    total = shared.count()
    hub = shared.groupBy("fp").agg(F.sum("g").alias("weight"))
    useful = F.bit_or(F.col("flag").bitwiseAND(OWN | PROBE)).alias("use")  # what goes past the bins may be probed by no set
    top = shared.join(hub, "fp").groupBy("sig").agg(F.max(F.struct("weight", "fp", "n")).alias("top"), F.count(F.lit(1)).alias("g"), useful)
    top = materialise(top.where(F.col("use") == (OWN | PROBE)).select("sig", F.col("top.fp").alias("hub"), F.col("top.n").alias("hub_n"), "g"), "hubs")
    star = join_by_class(shared.select("sig", "fp", "n"), top, "sig", "g", total, F.col("fp")).where("fp <> hub and 5 * least(n, hub_n) >= 4 * greatest(n, hub_n)")
    star = star.groupBy(F.col("fp").alias("a"), F.col("hub").alias("b")).count()
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("count"), "b"))
    star = materialise(star.withColumn("r", best).where(F.col("r") <= STARS).select("a", "b"), "stars")
    links = verify(star, docs, classes)
    labels = components(links)

    placed = shared.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    open_ = placed.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("g"), useful).where((F.col("lo") != F.col("hi")) & (F.col("use") == (OWN | PROBE))).select("sig", "g", F.lit(True).alias("open"))
    open_ = materialise(open_, "open")
    rest = materialise(join_by_class(placed.drop("g").withColumnRenamed("sig", "_s").withColumn("sig", F.col("_s")), open_, "sig", "g", total, F.col("fp")).where("open").drop("_s", "open"), "rest")
    rest = rest.join(classes.select("fp", *SKETCH), "fp")
    by_cost = Window.partitionBy("fp", F.col("flag").bitwiseAND(LOW)).orderBy(F.desc("g"), "sig")
    spare = F.col("f") - F.col("must")
    must = F.floor((F.col("n") + F.col("n")) / 9) + 1
    probing = rest.where(F.col("flag").bitwiseAND(PROBE) != 0).withColumn("must", must).withColumn("r", F.row_number().over(by_cost))
    left_out = (F.col("g") > COMMON) & (F.col("r") <= spare)
    dropped = F.sum(left_out.cast("int")).over(Window.partitionBy("fp", F.col("flag").bitwiseAND(LOW)))
    probing = probing.withColumn("dropped", dropped).where(~left_out).select("sig", F.col("fp").alias("a"), F.col("n").alias("n_a"), (F.col("f") - F.col("dropped")).alias("f"), F.col("label").alias("label_a"), *(F.col(o).alias(f"a_{o}") for o in SKETCH))
    indexed = rest.where(F.col("flag").bitwiseAND(OWN) != 0).select(F.col("sig").alias("sig_b"), F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), *(F.col(o).alias(f"b_{o}") for o in SKETCH))
    apart = sum((F.bit_count(F.col(f"a_{o}").bitwiseXOR(F.col(f"b_{o}"))) for o in SKETCH[1:]), F.bit_count(F.col("a_o0").bitwiseXOR(F.col("b_o0"))))
    fits = (F.col("label_a") != F.col("label_b")) & ((F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b")))) & (5 * F.col("n_b") >= 4 * F.col("n_a")) & (apart <= _allowed(F.col("n_a"), F.col("n_b")))
    met = probing.join(indexed.hint("merge"), (F.col("sig") == F.col("sig_b")) & fits)
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.max("f").alias("f"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    pairs = materialise(pairs.where(F.col("common") >= F.col("f") - _allowed(F.col("n_a"), F.col("n_b"))).select("a", "b"), "pairs")
    return materialise(links.union(verify(pairs, docs, classes)), "all-links")


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    spark = docs.sparkSession
    texts, parts = docs.select("doc_id", "text"), shuffle_partitions(spark)
    bins = parts * -(-bins_for(docs.select("text")) // parts)  # a bin is held whole, so there are as many as the input asks for
    sets = materialise(map_arrow(texts, lambda: _classify, "doc_id long, n long, fp long, " + ", ".join(f"{o} long" for o in SKETCH)), "sets")
    total = sets.count()
    classes = materialise(sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("size"), *(F.max(o).alias(o) for o in SKETCH)), "classes")
    packs = map_arrow(docs.select("text"), lambda: _emit(bins), "bin int, payload binary").repartitionById(parts, "bin").sortWithinPartitions("bin")
    shared = materialise(map_arrow(packs, lambda: _shared, "sig long, fp long, n long, f int, flag int, g long"), "shared")
    labels = components(link(texts, shared, classes), "components")
    smallest = labels.join(classes, "fp").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    roots = labels.join(smallest, "label").select("fp", "component_id")
    places = classes.join(roots, "fp", "left").select("fp", "size", F.coalesce("component_id", "doc_id").alias("component_id"))
    places = materialise(places, "places")
    joined = join_by_class(sets.select("doc_id", "n", "fp"), places, "fp", "size", total, F.coalesce("doc_id", F.lit(0)))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that are similar to another and not the smallest doc_id of their component.

    A document without words is its own component and stays; so does one whose doc_id is null.
    """
    spare = materialise(similar_components(docs).where("doc_id <> component_id").select("doc_id").distinct(), "spare")
    few = spare.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(spare) if few else spare, "doc_id", "left_anti")


def op4_jaccard_join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return similar_components(docs)
