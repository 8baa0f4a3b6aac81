"""Near duplicates by HyperMinHash: bands of compressed registers propose links, full shingle sets confirm them.

A sketch deals a document's shingle hashes into BANDS * ROWS buckets and keeps, of each bucket's least hash, the count of
leading zeros and MANTISSA bits after the first one. For the bands an empty bucket takes the register of the first filled
one in a random order of its own, so a band rests on ROWS random elements however small the set is, and one element that
many documents have brings no two together. Documents meet if a band of ROWS registers is equal: with 64 bands of 5, sets
of Jaccard similarity 0.75 meet in none with probability (1 - 0.75**5)**64 = 3e-8.

Groups aren't expanded into pairs. Members of a bucket are first compared with one of its members, and what that has
linked counts as one component from then on; at last all pairs of a bucket that are still in different components are
compared, in blocks, so that a task holds two of them however many documents share a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, map_arrow, staged

SHINGLE, BANDS, ROWS, MANTISSA = 5, 64, 5, 10
BUCKETS, NONE = BANDS * ROWS, np.uint16(0xFFFF)
#: A link needs SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (75, 100)
#: Ids are broadcast up to this many (8 bytes each); beyond, they are joined in a shuffle.
BROADCAST_IDS = 500_000
#: Members of a block: a task compares two blocks of one key at a time, whatever the key's size.
PAIR_BLOCK = 4096
#: Sets of up to so many shingles are compared by the last 16 bits of their hashes before they are compared in full.
BRIEF = 2048
#: Words of which a worker remembers the hash.
MEMO = 100_000

_rng = np.random.default_rng(5)
PLACE = _rng.integers(1, 1 << 63, 2 * SHINGLE, dtype=np.uint64) | np.uint64(1)
BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)
#: Where an empty bucket looks: the buckets in an order of its own, itself first; most look no further than PROBES.
ORDER, PROBES = np.argsort(_rng.random((BUCKETS, BUCKETS)) + 1 - np.eye(BUCKETS) * 2, axis=1).astype(np.int16), 16


class Hashes(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = Hashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes with all bits depending on all: multiply and shift, twice."""
    for odd in (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(31))) * odd
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> tuple[np.ndarray, int, int]:
    """Sorted distinct 64-bit hashes of a text's shingles, and a 128-bit hash of its words.

    A-Z are lower-cased and words are split at ASCII white space. With fewer words than a shingle has, all of them are
    one; without any there is none.
    """
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h, 0, 0
    n = len(h)
    if n < SHINGLE:
        s = (h * PLACE[SHINGLE : SHINGLE + n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)
    else:
        s = h[: n - SHINGLE + 1] * PLACE[0]
        for i in range(1, SHINGLE):
            s += h[i : n - SHINGLE + 1 + i] * PLACE[i]
    whole = xxhash.xxh3_128_intdigest(h.tobytes())
    return np.unique(mixed(s)), whole & (1 << 63) - 1, whole >> 65


def registers(s: np.ndarray) -> np.ndarray:
    """A sketch of sorted hashes: leading zeros and mantissa of the least value in each bucket, NONE in an empty one."""
    out = np.full(BUCKETS, NONE)
    if len(s):
        bucket = ((s >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        least = np.minimum.reduceat(s & np.uint64(0xFFFFFFFF), start)
        mantissa, exponent = np.frexp(least.astype(np.float64) + 1)
        out[bucket[start]] = ((33 - exponent).astype(np.uint16) << np.uint16(MANTISSA)) | ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return out


def filled(sketch: np.ndarray) -> np.ndarray:
    """The sketch with a register in every bucket; one bucket at least must have one."""
    full = sketch != NONE
    first = full[ORDER[:, :PROBES]]
    step = first.argmax(1)
    far = np.flatnonzero(~first[np.arange(BUCKETS), step])
    if len(far):
        step[far] = full[ORDER[far]].argmax(1)
    return sketch[ORDER[np.arange(BUCKETS), step]]


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = filled(sketch).reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((rows * BAND[:, :ROWS]).sum(1, dtype=np.uint64) + BAND[:, ROWS]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of pairs of sketches [pair, bucket], corrected for chance matches, and the registers it rests on."""
    used = ((a != NONE) | (b != NONE)).sum(1)
    same = ((a == b) & (a != NONE)).sum(1)
    chance = 0.17 / (1 << MANTISSA)
    return np.clip((same / np.maximum(used, 1) - chance) / (1 - chance), 0, 1), used


def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of sketches are within six standard errors of a link."""
    j, used = estimate(a, b)
    share = SHARE[0] / SHARE[1]
    return j >= share - 6 * np.sqrt(share * (1 - share) / np.maximum(used, 1))


def stacked(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(-1, BUCKETS)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, w1, w2, sketch) of each document with an id; w1 and w2 are the hash of the words."""

    def run(batches):
        for b in batches:
            n, w1, w2, regs = [], [], [], []
            for text in b.column(1).to_pylist():
                s, one, two = shingles(text)
                n.append(len(s))
                w1.append(one)
                w2.append(two)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "w1", "w2", "sketch"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, w1 long, w2 long, sketch binary")


def banded(classes: DataFrame) -> DataFrame:
    """(node, key) of each class: the keys of its bands."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                keys = [band_keys(np.frombuffer(x, np.uint16)) for x in b.column(1)[at : at + 2000].to_pylist()]
                nodes = np.repeat(b.column(0)[at : at + 2000].to_numpy(zero_copy_only=False), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(keys))], ["node", "key"])

    return map_arrow(classes.select("node", "sketch"), run, "node long, key long")


def only(rows: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The rows whose col is among ids (distinct, in a column `node`), by broadcast if the ids are few."""
    ids = ids.select(F.col("node").alias(col))
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, col, "left_semi")


def brief(s: np.ndarray) -> bytes:
    """What stands for a set where many are compared: 16-bit hashes, or the sketch if it is too large for them."""
    return (np.unique(s.astype(np.uint16)) if len(s) <= BRIEF else registers(s)).tobytes()


def candidates(i: int, others: np.ndarray, sizes: np.ndarray, briefs: list[np.ndarray]) -> np.ndarray:
    """Those of others that may be linked with i.

    For 16-bit hashes no link is lost: the intersection has at most as many elements more than the hashes have in common as
    the smaller loss of a set to equal hashes. A small set and a large one aren't ruled out but by their sizes.
    """
    n, m = sizes[i], sizes[others]
    others = others[SHARE[1] * np.minimum(n, m) >= SHARE[0] * np.maximum(n, m)]
    alike = (sizes[others] <= BRIEF) == (n <= BRIEF)
    near, rest = others[alike], others[~alike]
    if len(near) and n > BRIEF:
        near = near[may_link(np.stack([briefs[j] for j in near]), briefs[i][None])]
    elif len(near):
        held = np.zeros(1 << 16, bool)
        held[briefs[i]] = True
        counts = np.array([len(briefs[j]) for j in near])
        common = np.add.reduceat(held[np.concatenate([briefs[j] for j in near])], np.append(0, np.cumsum(counts)[:-1]), dtype=np.int64)
        most = common + np.minimum(n - len(briefs[i]), sizes[near] - counts)
        near = near[SHARE[1] * most >= SHARE[0] * (n + sizes[near] - most)]
    return np.concatenate([near, rest])


def tiles(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, size, tile, left, right, block, main, above, node, component, n, brief): who meets whom, two blocks at a time.

    Linked sets differ in size by a factor of 4/3 at most, so a key's members are dealt by classes of that width; a member is
    also `above` the class below its own. In a class the key's largest component (main) is never compared with itself. Its
    other members are dealt into blocks of PAIR_BLOCK, which meet each other in tiles of kind 0 (blocks left <= right) and the
    blocks of main (left) in tiles of kind 1. So no tile holds more than about two blocks, and none is made of main alone.
    """
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("_n"))
    largest = counts.groupBy("key").agg(F.max_by("component", F.struct("_n", "component")).alias("_main"))
    own = F.floor(F.log("n") / F.log(F.lit(SHARE[1] / SHARE[0])) + 1e-9).cast("int")
    rows = placed.select("key", "node", "component").join(sets.select("node", "n", "brief"), "node").join(largest, "key")
    rows = rows.withColumn("main", F.col("component") == F.col("_main")).drop("_main").withColumn("_own", own)
    classes = F.explode(F.array(F.struct(F.col("_own").alias("size"), F.lit(False).alias("above")), F.struct((F.col("_own") - 1).alias("size"), F.lit(True).alias("above"))))
    rows = rows.withColumn("_class", classes).select("key", "_class.size", "_class.above", "main", "node", "component", "n", "brief")
    blocks = lambda which: F.ceil(F.count(F.when(which, 1)) / PAIR_BLOCK).cast("int")
    held = rows.groupBy("key", "size").agg(blocks(~F.col("main")).alias("_minor"), blocks(F.col("main")).alias("_main"), F.count(F.when(~F.col("above"), 1)).alias("_own"))
    rows = rows.join(held.where("_minor > 0 AND _own > 0"), ["key", "size"])
    block = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("_main")).otherwise(F.col("_minor"))).cast("int")
    rows = rows.withColumn("block", block)
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda kind, left, right: F.struct(F.lit(kind).alias("tile"), left.alias("left"), right.alias("right"))
    b = F.col("block")
    of_main = F.transform(numbers(F.col("_minor")), lambda j: tile(1, b, j))
    of_minor = F.concat(F.transform(numbers(F.col("_minor")), lambda j: tile(0, F.least(b, j), F.greatest(b, j))), F.transform(numbers(F.col("_main")), lambda j: tile(1, j, b)))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("main"), of_main).otherwise(of_minor)))
    return rows.select("key", "size", "_to.tile", "_to.left", "_to.right", "block", "main", "above", "node", "component", "n", "brief")


def across(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the nodes that share a key of placed (key, node, component), are in different components and may be linked.

    Pairs are made and ruled out where they meet, in the tiles of a key.
    """

    def pairs(group):
        _, _, tile, left, right, block, main, above, node, component, n, short = zip(*group, strict=True)
        block, main, above = np.array(block), np.array(main), np.array(above)
        node, component, n = np.array(node, np.int64), np.array(component, np.int64), np.array(n, np.int64)
        short, found = [np.frombuffer(x, np.uint16) for x in short], []
        for i in np.flatnonzero(~main & ((tile[0] == 1) | (block == left[0]))):
            other = main if tile[0] else (block == right[0]) & ((left[0] != right[0]) | (np.arange(len(node)) > i))
            other = candidates(i, np.flatnonzero(other & (component != component[i]) & ~(above & above[i])), n, short)
            found.append(np.stack([np.minimum(node[i], node[other]), np.maximum(node[i], node[other])]))
        return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)

    def run(batches):
        held, at = [], None
        for b in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:5] != at:
                    if held:
                        out.append(pairs(held))
                    held, at = [], row[:5]
                held.append(row)
            if out:
                a, c = np.concatenate(out, 1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])
        if held:
            a, c = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    by = ["key", "size", "tile", "left", "right"]
    return map_arrow(tiles(placed, sets).repartition(*by).sortWithinPartitions(*by), run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, regs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of those pairs that are links: the estimate rules out what it can, then the full sets are intersected."""

    def likely(batches):
        for b in batches:
            keep = pa.array(may_link(stacked(b.column(2).to_pylist()), stacked(b.column(3).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    def linked(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    one = lambda t, side, col: t.select(F.col("node").alias(side), F.col(col).alias(f"{col}_{side}"))
    some = map_arrow(pairs.join(one(regs, "a", "sketch"), "a").join(one(regs, "b", "sketch"), "b").select("a", "b", "sketch_a", "sketch_b"), likely, "a long, b long")
    both = some.join(one(sets, "a", "set"), "a").join(one(sets, "b", "set"), "b").select("a", "b", "set_a", "set_b")
    return map_arrow(both, linked, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have edges (a, b): the least node that each reaches.

    Stars by turns: every node links its larger neighbours, then its smaller ones, to the least of them, until nothing
    changes. Each round is written to the shared folder.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, edges = edges, staged(small.where("a != b").distinct())
        discard(before)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    # Then every edge leads to its component's least node, which has none itself.
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    Documents are linked if their sets of 5-word shingles have a Jaccard similarity of 0.75 or more; component_id is the
    smallest doc_id that links lead to. Texts without words are linked with nothing. Rows of equal doc_id are one
    document with several texts. A row with a null doc_id is linked with nothing, has a null component_id and is kept.
    Other columns are ignored.
    """
    all_ = staged(sketches(docs))
    # Equal texts are one node, under their smallest id; its registers are any of theirs.
    classes = staged(all_.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("w1", "w2").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")))
    bands = banded(classes)
    shared = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = staged(bands.join(shared, "key"))
    active = staged(shared.select("node").distinct())
    regs = staged(only(classes.select("node", "sketch"), "node", active))

    def set_of(batches):
        for b in batches:
            found = [shingles(t)[0] for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array(map(len, found), pa.int64()), pa.array(map(brief, found), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "set", "n", "brief"])

    sets = staged(map_arrow(only(docs.select(F.col("doc_id").alias("node"), "text").where("text IS NOT NULL"), "node", active), set_of, "node long, set array<long>, n long, brief binary"))
    # First each node with the least of its buckets' members, then with the least that is in another component.
    links = staged(confirmed(shared.groupBy("node").agg(F.min("low").alias("low")).where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")), regs, sets))
    for last in (False, True):
        found = staged(components(links))
        placed = shared.select("node", "key").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if last:
            unlike = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
            pairs = across(placed.join(unlike, "key"), sets)
        else:
            first = placed.groupBy("key").agg(F.min(F.struct("component", "node")).alias("first"), F.max("component").alias("high")).where("first.component < high")
            pairs = placed.join(first, "key").where("component > first.component").select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
        before, links = links, staged(links.unionByName(confirmed(pairs, regs, sets)))
        discard(before)
    discard(shared, active, regs, sets)
    node = all_.select("doc_id", "n_shingles", "w1", "w2").join(classes.select("w1", "w2", "node"), ["w1", "w2"], "left")
    node = staged(node.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("node"))).alias("node")))
    discard(all_, classes)
    # A document of several texts links the nodes of all of them; its rows are all where the least of them is.
    least = node.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a IS NOT NULL")
    several = node.join(least.where("a < high").select("doc_id", "a"), "doc_id").where("a < node").select("a", F.col("node").alias("b"))
    found = components(links.unionByName(several))
    reached = node.drop("node").join(least.select("doc_id", F.col("a").alias("node")), "doc_id", "left").join(found, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return reached.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates() keeps: one document of each group."""
    gone = staged(near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("node")).distinct())
    gone_ids = gone.select(F.col("node").alias("doc_id"))
    return docs.join(F.broadcast(gone_ids) if gone.count() <= BROADCAST_IDS else gone_ids, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])
