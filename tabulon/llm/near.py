"""Near-duplicates by one-permutation MinHash.

A document's set holds its distinct shingles of consecutive words. One permutation (the shingles'
64-bit hashes) is dealt into ``bands * rows`` bins; a bin keeps its smallest hash. An empty bin
takes the value of the non-empty bin that comes first in an order of its own (optimal
densification). Bands of ``rows`` bins make buckets. Documents of equal sets are one node from the
start, so copies never meet in a bucket.

Candidate pairs are stars: in each bucket its centre, the member that meets most others in all its
buckets, against the other members; pairs of one centre are dealt over tasks by the size of their
sets. Each pair is confirmed on the full sets, and linked ones make components.

That leaves pairs of members that two stars' ends make. Any two that share a bucket share its
centre, so they meet in that centre's star. A pair of one component adds nothing; of any other pair
at least one lies outside the largest component of the star. Those, the star's outsiders, are
compared with its other members in tiles of about ``TILE`` shingles, so no group has to fit a task:
within a tile what can't reach the similarity by its size, or by how many of its shingles the tile
has at all, goes first, and the rest is one matrix product. Only links leave a tile, one for each
outsider and component. So two passes settle every pair that shares a bucket, whatever the size of
the groups; no bucket is capped and no pairs are listed. At a similarity of 0.8, 100 bands of 8 rows
miss a pair with probability 1e-8.

Null and word-less texts have the empty set and are linked with nothing; texts of fewer words than
a shingle are one shingle; rows that repeat an id are one node; rows with a null id are linked
with nothing and kept. Whole texts count. An empty table gives an empty result. Columns other than
id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, released, slices
from tabulon.llm.graph import components

BANDS, ROWS = 100, 8
#: Bins that an empty one looks at before it looks at all.
TRIES = 32
#: Shingles of either side of a tile, about; and cells of a matrix that counts shared ones.
TILE, CELLS = 250_000, 4_000_000
#: Words that a worker keeps the hashes of; about 150 bytes each.
TABLE_ENTRIES = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of shingles."""

    def __init__(self, n: int):
        import xxhash

        self.n, self.hash, self.table = n, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if len(self.table) > TABLE_ENTRIES:
            self.table = {}
        table, hash_ = self.table, self.hash
        try:
            h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in table:
                    table[w] = hash_(w)
            h = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        if not n:
            return h
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = mix(s * _MIX[0] + h[k : len(h) - n + 1 + k])
        return np.unique(s)


class Sketcher:
    """Bucket keys of a set, one a band."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, bins = bands, rows, bands * rows
        self.edges = np.array([(i << 64) // bins for i in range(bins)], np.uint64)
        self.order = np.random.default_rng(20).random((bins, bins)).astype(np.float32)
        self.first = np.argsort(self.order, axis=1, kind="stable")[:, :TRIES].copy()
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * _MIX[0])

    def signature(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(s, self.edges)  # of sorted hashes, the first in a bin is its smallest
        full = np.append(at[1:], len(s)) > at
        out = s[np.minimum(at, len(s) - 1)]
        if not full.all():
            empty, used = np.flatnonzero(~full), np.flatnonzero(full)
            if len(used) > TRIES:  # most find one among the first of their order
                tries = self.first[empty]
                hit = full[tries]
                place = np.argmax(hit, axis=1)
                rows = np.arange(len(empty))
                ok = hit[rows, place]
                out[empty[ok]] = out[tries[rows, place][ok]]
                empty = empty[~ok]
            out[empty] = out[used[np.argmin(self.order[np.ix_(empty, used)], axis=1)]]
        return out

    def __call__(self, s: np.ndarray) -> np.ndarray:
        v, h = self.signature(s).reshape(self.bands, self.rows), self.salt
        for k in range(self.rows):
            h = mix(h * _MIX[0] + v[:, k])
        return h


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)))


def sketches(rows: DataFrame, shingle: int, bands: int, rows_: int) -> DataFrame:
    """rows (id, text): id, n (size of the set), key (of the whole set), buckets."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, sketcher = Shingler(shingle), Sketcher(bands, rows_)
        for batch in slices(batches):
            n, key, buckets = [], [], []
            for t in batch.column("text").to_pylist():
                s = shingler(t)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                buckets.append(sketcher(s) if len(s) else s)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), _lists(buckets)], names=["id", "n", "key", "buckets"])

    return rows.mapInArrow(run, "id long, n long, key binary, buckets array<long>")


def full_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """rows (id, text): id, shingles array<long>."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists([shingler(t) for t in batch.column("text").to_pylist()])], names=["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles array<long>")


def _dense(values: np.ndarray, of: np.ndarray, n: int, low: int, width: int) -> np.ndarray:
    """values: columns, of: their rows. The 0/1 matrix of columns low to low + width."""
    out = np.zeros((n, width), np.float32)
    some = (values >= low) & (values < low + width)
    out[of[some], values[some] - low] = 1
    return out


def similar(q: list[np.ndarray], m: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in q, in m) of similar sets of sorted shingles, a block of q's at a time."""
    size_q, size_m = np.array([len(x) for x in q], np.int64), np.array([len(x) for x in m], np.int64)
    if len(q) == 1:
        ends = np.cumsum(size_m)
        flat, s = np.concatenate(m), q[0]
        shared = np.add.reduceat(s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat, ends - size_m, dtype=np.int64)
        hit = np.flatnonzero(100 * shared >= percent * (size_q[0] + size_m - shared))
        yield np.zeros(len(hit), np.int64), hit
        return
    # Columns are the shingles that both sides have. A set that lacks too many of them for any partner of its size goes, which takes more columns away.
    at_q, at_m = np.argsort(size_q, kind="stable"), np.argsort(size_m, kind="stable")
    while len(at_q) and len(at_m):
        flat_q, flat_m = np.concatenate([q[i] for i in at_q]), np.concatenate([m[i] for i in at_m])
        of_q, of_m = np.repeat(np.arange(len(at_q)), size_q[at_q]), np.repeat(np.arange(len(at_m)), size_m[at_m])
        columns = np.intersect1d(flat_q, flat_m)
        if not len(columns):
            return
        keep = []
        for flat, of, size, other in ((flat_q, of_q, size_q[at_q], size_m[at_m]), (flat_m, of_m, size_m[at_m], size_q[at_q])):
            n = np.bincount(of, columns[np.minimum(np.searchsorted(columns, flat), len(columns) - 1)] == flat, len(size))
            least = np.searchsorted(other, -(-percent * size // 100))
            keep.append((least < len(other)) & ((100 + percent) * n >= percent * (size + other[np.minimum(least, len(other) - 1)])))
        if keep[0].all() and keep[1].all():
            break
        at_q, at_m = at_q[keep[0]], at_m[keep[1]]
    else:
        return
    found = []
    for flat, of in ((flat_q, of_q), (flat_m, of_m)):
        place = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
        same = columns[place] == flat
        found.append((place[same], of[same]))
    (col_q, of_q), (col_m, of_m) = found
    size_q, size_m, step = size_q[at_q], size_m[at_m], 256
    begin_q, begin_m = np.searchsorted(of_q, np.arange(len(at_q) + 1)), np.searchsorted(of_m, np.arange(len(at_m) + 1))
    for k in range(0, len(at_q), step):
        end = min(k + step, len(at_q))
        low, high = np.searchsorted(size_m, -(-percent * size_q[k] // 100)), np.searchsorted(size_m, 100 * size_q[end - 1] // percent, side="right")
        if low >= high:
            continue
        cq, rq = col_q[begin_q[k] : begin_q[end]], of_q[begin_q[k] : begin_q[end]] - k
        cm, rm = col_m[begin_m[low] : begin_m[high]], of_m[begin_m[low] : begin_m[high]] - low
        used, cq = np.unique(cq, return_inverse=True)
        place = np.minimum(np.searchsorted(used, cm), len(used) - 1)
        same = used[place] == cm
        cm, rm = place[same], rm[same]
        shared = np.zeros((end - k, high - low), np.float32)
        width = max(1, CELLS // max(high - low, end - k))
        for c in range(0, len(used), width):
            shared += _dense(cq, rq, end - k, c, width) @ _dense(cm, rm, high - low, c, width).T
        total = size_q[k:end, None] + size_m[None, low:high]
        a, b = np.nonzero((100 + percent) * shared.astype(np.int64) >= percent * total)
        yield at_q[a + k], at_m[b + low]


def _tile_links(percent: int):
    """Rows (star, i, j, asks, id, component, shingles) in order of the first three: links (a, b) between those that ask and those that don't, one for each asker and other component."""

    def links(ids, of, asks, sets):
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        q, m = q[[len(sets[i]) > 0 for i in q]], m[[len(sets[i]) > 0 for i in m]]
        if not len(q) or not len(m):
            return np.zeros((0, 2), np.int64)
        out = [np.zeros((0, 2), np.int64)]
        for x, y in similar([sets[i] for i in q], [sets[i] for i in m], percent):
            x, y = q[x], m[y]
            apart = of[x] != of[y]
            x, y = x[apart], y[apart]
            if len(x):
                _, first = np.unique(np.stack([ids[x], of[y]], 1), axis=0, return_index=True)
                out.append(np.stack([ids[x[first]], ids[y[first]]], 1))
        return np.concatenate(out)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush():
            parts = list(zip(*held, strict=True))
            pairs = links(*[np.concatenate(p) for p in parts[:3]], [s for p in parts[3] for s in p])
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("star", "i", "j")], 1).astype(np.int64)
            ids, of, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "asks"))
            column = batch.column("shingles")
            flat, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if now is not None and tuple(key[low]) != now:
                    yield flush()
                    held = []
                now = tuple(key[low])
                # A copy, as a tile may go on in the next batch.
                held.append((ids[low:high], of[low:high], asks[low:high], np.split(flat[ends[low] : ends[high]].copy(), (ends[low + 1 : high] - ends[low]).tolist())))
        if held:
            yield flush()

    return run


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rows (star, i, j, asks, id, component): links in each tile (star, i, j)."""
    full = rows.join(sets, "id").select("star", "i", "j", "asks", "id", "component", "shingles")
    return full.repartition("star", "i", "j").sortWithinPartitions("star", "i", "j").mapInArrow(_tile_links(percent), "a long, b long").distinct()


def _tiles(shingles: Column) -> Column:
    return F.ceil(shingles / TILE).cast("int")


def centre_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """stars (a, b, n: size of b's set): the pairs that are similar."""
    total = stars.groupBy("a").agg(_tiles(F.sum("n")).alias("tiles"))
    ends = stars.join(total, "a").select(F.col("a").alias("star"), F.lit(0).alias("i"), F.pmod(F.xxhash64("b"), "tiles").cast("int").alias("j"), F.lit(False).alias("asks"), F.col("b").alias("id"), F.col("b").alias("component"))
    centres = total.select(F.col("a").alias("star"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"), F.lit(True).alias("asks"), F.col("a").alias("id"), F.col("a").alias("component"))
    return _links(ends.unionByName(centres), sets, percent)


def outsider_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """stars (a, b, n, component: of b): links between ends of a star that lie in different components."""
    parts = stars.groupBy("a", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
    largest = F.max(F.struct("members", (-F.col("component")).alias("component"), "n")).alias("most")
    mixed = parts.groupBy("a").agg(largest, F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = mixed.select("a", (-F.col("most.component")).alias("main"), _tiles(F.col("n")).alias("across"), _tiles(F.col("n") - F.col("most.n")).alias("down"))
    both = stars.join(mixed, "a").withColumn("outside", F.col("component") != F.col("main"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(F.xxhash64("b"), n).cast("int"))
    place = lambda i, j, asks: F.struct(i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"))
    # An outsider asks in its row of tiles; all members answer in their column.
    asked = F.when(F.col("outside"), F.transform(every("across"), lambda j: place(F.element_at(own("down"), 1), j, True))).otherwise(F.array())
    answers = F.transform(every("down"), lambda i: place(i, F.element_at(own("across"), 1), False))
    rows = both.select(F.col("a").alias("star"), F.col("b").alias("id"), "component", F.explode(F.concat(answers, asked)).alias("t"))
    return _links(rows.select("star", "t.i", "t.j", "t.asks", "id", "component"), sets, percent)


def _stars(members: DataFrame, weight: DataFrame) -> DataFrame:
    """members (bucket, rep, n): distinct (a, b, n), each bucket's centre and its other members."""
    weighed = members.select("bucket", "rep").join(weight, "rep")
    centres = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("c")).select("bucket", (-F.col("c.rep")).alias("a"))
    return members.join(centres, "bucket").where("rep != a").select("a", F.col("rep").alias("b"), "n").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_shingles, component_id (smallest id reachable over links), kept (it is that one)."""
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = scratch.save(sketches(texts, shingle, bands, rows), "sketches")
    nodes = every.where("id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))

    # Buckets of one member are no use.
    dealt = nodes.select("rep", "n", F.explode("buckets").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    live = scratch.save(dealt.join(shared, "bucket"), "live")
    weight = scratch.save(live.groupBy("rep").agg(F.sum("size").alias("weight")), "weight")
    stars = scratch.save(_stars(live, weight), "stars")
    wanted = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # One plan at every size: texts are shuffled once. Beyond 10 GB of texts Spark filters them by a Bloom filter of the ids first.
    sets = scratch.save(full_sets(texts.join(wanted.hint("merge"), "id", "left_semi"), shingle), "sets")

    links = scratch.save(centre_links(stars, sets, percent), "links")
    label = scratch.save(components(links, scratch, "component"), "label")
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    known = stars.join(of("b"), "b", "left").select("a", "b", "n", F.coalesce("cb", "b").alias("component"))
    more = scratch.save(outsider_links(known, sets, percent), "more")
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = scratch.save(components(between, scratch, "between"), "joined").select(F.col("node").alias("component"), F.col("component").alias("into"))
    old = label.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    own = joined.select(F.col("component").alias("node"), F.col("into").alias("component"))
    label = scratch.save(old.unionByName(own).distinct(), "labels")

    of_key = nodes.select("key", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("found"))
    component = F.when(F.col("id").isNotNull(), F.least(F.coalesce("found", "id"), "id"))
    out = every.select("id", "n", "key").join(of_key, "key", "left").select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    out = scratch.save(out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))), "result")
    scratch.keep("result")
    return out.withColumnRenamed("id", id_col)
