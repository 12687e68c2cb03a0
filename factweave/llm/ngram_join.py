"""N-gram Jaccard join with signature trees.

1. Documents with equal shingle sets are one class; sets are equal if their sizes and 128 bits of hash are.
2. Two sets that are similar enough share one of their rarest shingles (the prefix filter, in the order of a sketch of
   shingle counts over all documents). A pass over the classes, sorted by these keys, finds the groups of classes that
   share a key; keys shared by the same classes are one group.
3. Each group is a signature tree, whose nodes hold the OR and the AND of their sets' token bitmaps and the range of
   their sizes. A dual traversal of the tree with itself drops all pairs of nodes whose largest possible overlap is too
   small, or whose sets are connected already, and returns a spanning forest of the pairs that may be similar, never
   all of them. The forests' components are clusters: similar sets are always in one cluster.
4. Clusters are dealt into blocks by size. A task builds signature trees of two blocks' whole sets and traverses them
   alike, but compares exactly what is left, and returns a spanning forest of the links. A first round joins each block
   with itself and its neighbours. In the second round only clusters that are not yet one component go on, and blocks of
   a cluster's largest component meet all others, but not one another: of near copies, whose blocks the first
   round has linked, no further pairs are left.
5. Components of the links give each document its class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .graph import components

#: Words of a shingle and least percentage of the union that two sets share: of the query, and by default.
QUERY_K, QUERY_PERCENT, K, PERCENT = 3, 90, 5, 80
#: Counters of the sketch (a power of two); classes of a key that a task holds at once, more of them being one cluster
#: without a look at their bitmaps; sets and shingles of a block.
SKETCH, GROUP, BLOCK_SETS, BLOCK_SHINGLES = 2**22, 256, 128, 400_000
#: Sets of a leaf, children of a node; the most hot keys that are broadcast.
LEAF, FANOUT, BROADCAST_KEYS = 16, 8, 1_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 2**16


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct ``k``-word shingles; of fewer words all are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for j in range(width):
        h = (h ^ w[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h * np.uint64(0xD6E8FEB86659FD93))


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """The token bitmap of a set as ``bits`` / 64 words; a smaller bitmap is the OR of the halves of a larger one."""
    out = np.zeros(bits, np.uint8)
    out[((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def _folded(b: np.ndarray, words: int) -> np.ndarray:
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] | b[..., half:]
    return b


def _bits_for(n: int, least: int = 256, most: int = 65536) -> int:
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


def similar(na, nb, overlap, percent: int):
    """Whether sets of these sizes with this overlap are linked: 100 * intersection >= percent * union."""
    return 100 * overlap >= percent * (na + nb - overlap)


class Node:
    """A node of a signature tree over the sets ``lo`` to ``hi`` of a block."""

    __slots__ = ("lo", "hi", "any", "all", "least", "most", "children")

    def __init__(self, lo, hi, any_, all_, least, most, children=()):
        self.lo, self.hi, self.any, self.all, self.least, self.most, self.children = lo, hi, any_, all_, least, most, children


def signature_tree(bits: np.ndarray, sizes: np.ndarray) -> Node:
    """A tree over sets in the order given."""
    level = [Node(i, min(i + LEAF, len(sizes)), np.bitwise_or.reduce(bits[i : i + LEAF]), np.bitwise_and.reduce(bits[i : i + LEAF]), int(sizes[i : i + LEAF].min()), int(sizes[i : i + LEAF].max())) for i in range(0, len(sizes), LEAF)]
    while len(level) > 1:
        level = [
            Node(part[0].lo, part[-1].hi, np.bitwise_or.reduce([x.any for x in part]), np.bitwise_and.reduce([x.all for x in part]), min(x.least for x in part), max(x.most for x in part), part)
            for part in (level[i : i + FANOUT] for i in range(0, len(level), FANOUT))
        ]
    return level[0]


def _lacks(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens at least that every set with the bits ``a`` has and no set with the bits ``b`` has."""
    return int(np.bitwise_count(a & ~b).sum())


def possible(a: Node, b: Node, percent: int) -> bool:
    """Whether sets of the nodes can be linked, by their sizes and the largest overlap that the bitmaps allow."""
    if a.most * 100 < percent * b.least or b.most * 100 < percent * a.least:
        return False
    return 100 * a.most - (100 + percent) * _lacks(a.all, b.any) >= percent * b.least and 100 * b.most - (100 + percent) * _lacks(b.all, a.any) >= percent * a.least


class Forest:
    """Disjoint sets of the numbers below ``n``."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = self.find(i), self.find(j)
        self.parent[i] = j
        return i != j


class Block:
    """Sets with their bitmaps (all of one width), sizes, numbers and tree; ``order`` says which are next to one another."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, order: list[int], base: int = 0):
        at = np.array(order)
        self.ids, self.maps, self.sizes = at + base, maps[at], sizes[at]
        self.root = signature_tree(self.maps, self.sizes)


def dual_traversal(a: Block, b: Block, forest: Forest, percent: int, confirm) -> list[tuple[int, int]]:
    """The pairs of ``a`` and ``b`` that connect what was apart: those that may be similar and that ``confirm`` accepts."""
    out, stack = [], [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        if not possible(x, y, percent):
            continue
        first = forest.find(int(a.ids[x.lo]))
        if all(forest.find(int(i)) == first for i in a.ids[x.lo : x.hi]) and all(forest.find(int(i)) == first for i in b.ids[y.lo : y.hi]):
            continue
        if x.children or y.children:
            if x is y:
                stack += [(p, q) for i, p in enumerate(x.children) for q in x.children[i:]]
            elif x.children and (not y.children or x.hi - x.lo >= y.hi - y.lo):
                stack += [(p, y) for p in x.children]
            else:
                stack += [(x, q) for q in y.children]
            continue
        ma, mb = a.maps[x.lo : x.hi, None], b.maps[None, y.lo : y.hi]
        na, nb = a.sizes[x.lo : x.hi, None], b.sizes[None, y.lo : y.hi]
        most = np.minimum(na - np.bitwise_count(ma & ~mb).sum(2), nb - np.bitwise_count(mb & ~ma).sum(2))
        for p, q in zip(*np.nonzero(similar(na, nb, most, percent))):
            i, j = int(a.ids[x.lo + p]), int(b.ids[y.lo + q])
            if i != j and forest.find(i) != forest.find(j) and confirm(i, j):
                forest.join(i, j)
                out.append((i, j))
    return out


def signature_links(maps: list[np.ndarray], sizes: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may be similar by their bitmaps and sizes."""
    words = min(map(len, maps))
    block = Block(np.array([_folded(m, words) for m in maps]), np.array(sizes), sorted(range(len(sizes)), key=lambda i: sizes[i]))
    return dual_traversal(block, block, Forest(len(sizes)), percent, lambda i, j: True)


def tree_links(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks, or within one if ``sets_b`` is None; second indices count on from the first block."""
    sets = sets_a + (sets_b or [])
    bits = _bits_for(2 * max(map(len, sets)), most=16384)

    def block(part: list[np.ndarray], base: int) -> Block:
        order = sorted(range(len(part)), key=lambda i: (part[i][0], len(part[i])))  # sets with the same smallest hash are often alike
        return Block(np.array([bitmap(s, bits) for s in part]), np.array([len(s) for s in part]), order, base)

    a = block(sets_a, 0)
    b = block(sets_b, len(sets_a)) if sets_b is not None else a
    alike = lambda i, j: bool(similar(len(sets[i]), len(sets[j]), np.intersect1d(sets[i], sets[j], assume_unique=True).size, percent))
    return dual_traversal(a, b, Forest(len(sets)), percent, alike)


def _sketch(docs: DataFrame, k: int, width: int) -> np.ndarray:
    """Counts of shingles over all documents, by their hash's last bits; its size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = _WordHashes(), np.zeros(width, np.uint32)
        for batch in batches:
            got = [shingle_set(t.as_py(), k, hashes) for t in batch.column(0)]
            if got:
                at = (np.concatenate(got) & np.uint64(width - 1)).astype(np.int64)
                np.add.at(total, at, np.uint32(1)) if len(at) < width // 8 else np.add(total, np.bincount(at, minlength=width).astype(np.uint32), out=total)
        step = min(_CHUNK, width)
        parts = [total[i : i + step] for i in range(0, width, step)]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["chunk", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, d in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(d.as_py()), np.uint32)
                sums[c] = sums[c] + x if c in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], names=["chunk", "data"])

    schema = "chunk int, data binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition(16, "chunk").mapInArrow(merge, schema).collect()
    out = np.zeros(width, np.uint32)
    step = min(_CHUNK, width)
    for r in rows:
        out[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(zlib.decompress(r["data"]), np.uint32)
    return out


def _class_of(s: np.ndarray) -> tuple[int, int]:
    """A class's id, and what tells it from other classes with that id."""
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _profiles(docs: DataFrame, k: int, percent: int, width: int) -> DataFrame:
    """doc_id, cid, chk, n, keys, bits of each document; cid is null and n 0 for an empty set."""
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(docs, k, width))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), counts.value
        for batch in batches:
            cid, chk, n, keys, bits = [], [], [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), k, hashes)
                n.append(len(s))
                if not len(s):
                    cid.append(None), chk.append(None), keys.append([]), bits.append(b"")
                    continue
                prefix = len(s) - (percent * len(s) + 99) // 100 + 1
                rare = np.argsort(seen[(s & np.uint64(width - 1)).astype(np.int64)], kind="stable")[:prefix]
                for out, x in zip((cid, chk), _class_of(s)):
                    out.append(x)
                keys.append(s[rare].view(np.int64)), bits.append(bitmap(s, _bits_for(len(s))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cid, pa.int64()), pa.array(chk, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "cid", "chk", "n", "keys", "bits"])

    return docs.mapInArrow(profile, "doc_id long, cid long, chk long, n long, keys array<long>, bits binary")


def _hot_keys(reps: DataFrame, crowd: int) -> DataFrame:
    """(hot_key): the keys that more than ``crowd`` of the classes in one Arrow batch share.

    Each is crowded indeed; a key that no batch shows has a small share of the classes, and ``_meetings`` judges it.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            if (n > crowd).any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[n > crowd], pa.int64())], names=["hot_key"])

    return staged(reps.select("keys").mapInArrow(find, "hot_key long").distinct(), "hot")


def _entries(reps: DataFrame, crowd: int, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(key, n, cid, hot): the keys of each class, dealt by key, but those of a hot key by class too, and sorted."""
    hot = _hot_keys(reps, crowd)
    if hot.count() <= broadcast_keys:  # beyond it, both sides are shuffled
        hot = F.broadcast(hot)
    rows = reps.select(F.explode("keys").alias("key"), "n", "cid").join(hot, F.col("key") == F.col("hot_key"), "left")
    rows = rows.select("key", "n", "cid", F.col("hot_key").isNotNull().alias("hot"))
    return rows.repartition("key", F.when(F.col("hot"), F.col("cid"))).sortWithinPartitions("key", "n", "cid")


def _meetings(percent: int, most: int):
    """Over rows sorted by key and size: (group, class) of groups that share a key (kind 0), (key, class) of hot keys and larger groups (kind 1).

    A group ends where the next size is too far from the last one, and is named by its members.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, full = None, [], False  # the key at hand, its classes while they are few

        def groups():
            start = 0
            for i in range(1, len(held) + 1):
                if i == len(held) or held[i - 1][0] * 100 < percent * held[i][0]:
                    members = sorted({c for _, c in held[start:i]})
                    if len(members) > 1:
                        name = int.from_bytes(xxhash.xxh3_64_digest(np.array(members, np.int64).tobytes()), "little", signed=True)
                        yield from ((0, name, c) for c in members)
                    start = i

        for batch in batches:
            ks, ns, cs, hot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "cid", "hot"))
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(hot.sum(), np.int32)), pa.array(ks[hot]), pa.array(cs[hot])], names=["kind", "a", "b"])
                ks, ns, cs = ks[~hot], ns[~hot], cs[~hot]
            if not len(ks):
                continue
            new = np.r_[True, ks[1:] != ks[:-1]]
            alone = new & np.r_[new[1:], False]  # the last row's key may go on
            if key is not None:
                alone[0] = alone[0] and ks[0] != key
            out = []
            for i in np.flatnonzero(~alone):
                if ks[i] != key:
                    if not full:
                        out += groups()
                    key, held, full = ks[i], [], False
                if full:
                    out.append((1, int(key), int(cs[i])))
                    continue
                held.append((int(ns[i]), int(cs[i])))
                if len(held) > most:
                    out += [(1, int(key), c) for _, c in held]
                    held, full = [], True
            if out:
                yield _rows(out)
        if not full and (out := list(groups())):
            yield _rows(out)

    def _rows(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        kind, a, b = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    return meet


def _group_trees(percent: int):
    """Over rows (grp, n, cid, bits) sorted by group: the signature tree of each group, and the pairs that its traversal leaves."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, cids, sizes, maps = None, [], [], []
        for batch in batches:
            out = []
            for g, n, c, data in zip(batch.column("grp").to_pylist(), batch.column("n").to_pylist(), batch.column("cid").to_pylist(), batch.column("bits")):
                if g != grp:
                    out += [(cids[i], cids[j]) for i, j in signature_links(maps, sizes, percent)] if len(cids) > 1 else []
                    grp, cids, sizes, maps = g, [], [], []
                cids.append(c), sizes.append(n), maps.append(np.frombuffer(data.as_py(), np.uint64))
            yield _pairs(out)
        yield _pairs([(cids[i], cids[j]) for i, j in signature_links(maps, sizes, percent)] if len(cids) > 1 else [])

    def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return links


def _block_links(percent: int):
    def links(group: pa.Table) -> pa.Table:
        sides, cids = ([], []), ([], [])
        for side, cid, s in zip(group.column("side").to_pylist(), group.column("cid").to_pylist(), group.column("set").to_pylist()):
            sides[side].append(np.frombuffer(s, np.uint64))
            cids[side].append(cid)
        if group.column("inner")[0].as_py():
            sides, cids = (sides[0] + sides[1], None), (cids[0] + cids[1], [])
        found = tree_links(sides[0], sides[1], percent) if sides[0] and (sides[1] is None or sides[1]) else []
        all_ids = cids[0] + cids[1]
        return pa.table({"a": pa.array([all_ids[i] for i, _ in found], pa.int64()), "b": pa.array([all_ids[j] for _, j in found], pa.int64())})

    return links


def _tasks(clustered: DataFrame, percent: int, block_sets: int, block_shingles: int, first: bool) -> DataFrame:
    """(label, band, i, j, side, inner, up, cid): the pairs of blocks that can hold similar sets, with their members.

    ``clustered`` has cid, n, label, the cluster, and core, whether a class is in the cluster's largest component. Sets
    are linked only if their sizes are within the percentage, that is, in one size band or two neighbouring ones. A
    band's core members fill its first blocks. In the ``first`` round there are no core members, and a block meets itself,
    the next block of its band and one of either neighbouring band; later all blocks meet, but core blocks one another.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    rows = clustered.withColumn("band", band)
    blocks = lambda c: F.greatest(F.ceil(F.count_if(c) / block_sets), F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / block_shingles)).cast("int")
    cells = rows.groupBy("label", "band").agg(blocks(F.col("core")).alias("cores"), blocks(~F.col("core")).alias("others"), F.count(F.lit(1)).alias("members"))

    def near(step: int, name: str) -> DataFrame:
        return cells.select(F.col("label").alias(f"{name}_label"), (F.col("band") - step).alias(f"{name}_band"), (F.col("cores") + F.col("others")).alias(name), F.col("cores").alias(f"{name}_cores"), F.col("members").alias(f"{name}_members"))

    for step, name in ((0, "own"), (1, "up"), (-1, "down")):
        side = near(step, name)
        rows = rows.join(side, (F.col("label") == F.col(f"{name}_label")) & (F.col("band") == F.col(f"{name}_band")), "left").drop(f"{name}_label", f"{name}_band")
    core = F.col("core")
    own_cores = F.col("own_cores")
    deal = F.xxhash64("cid")
    i = F.when(core, F.pmod(deal, F.greatest(own_cores, F.lit(1)))).otherwise(own_cores + F.pmod(deal, F.greatest(F.col("own") - own_cores, F.lit(1)))).cast("int")
    rows = rows.withColumn("i", i)
    numbers = lambda c: F.when(F.col(c).isNotNull(), F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda b, i, j, side, inner, up: F.struct(b.alias("band"), i.alias("i"), j.alias("j"), side.alias("side"), inner.alias("inner"), F.lit(up).alias("up"))
    b, i, no = F.col("band"), F.col("i"), F.lit(False)
    if first:
        after = lambda x: (x + 1) % F.col("own")
        meets = {"own": lambda j: (j == i) | (j == after(i)) | (i == after(j)), "up": lambda j: j == i % F.col("up"), "down": lambda j: i == j % F.col("own")}
    else:
        apart = lambda c: lambda j: ~(core & (j < F.col(f"{c}_cores")))
        meets = {c: apart(c) for c in ("own", "up", "down")}
    partners = {c: F.filter(numbers(c), meets[c]) for c in meets}
    alone = F.col("own_members") == 1
    tasks = F.concat(
        F.transform(F.when(alone, F.array().cast("array<int>")).otherwise(partners["own"]), lambda j: task(b, F.least(i, j), F.greatest(i, j), (i > j).cast("int"), i == j, False)),
        F.transform(partners["up"], lambda j: task(b, i, j, F.lit(0), no, True)),
        F.transform(partners["down"], lambda j: task(b - 1, j, i, F.lit(1), no, True)),
    )
    return rows.select("label", "cid", F.explode(tasks).alias("t")).select("label", "cid", "t.*")


def _links(clustered: DataFrame, sets: DataFrame, percent: int, block_sets: int, block_shingles: int, first: bool) -> DataFrame:
    """(a, b): spanning forests of the links of each task."""
    tasks = _tasks(clustered, percent, block_sets, block_shingles, first).join(sets.withColumnRenamed("cid", "s_cid"), F.col("cid") == F.col("s_cid"))
    return staged(tasks.groupBy("label", "band", "i", "j", "up").applyInArrow(_block_links(percent), "a long, b long"), "links")


def _unsettled(clustered: DataFrame, links: DataFrame, percent: int, block_sets: int, block_shingles: int) -> DataFrame:
    """Of ``clustered`` the clusters that have pairs of blocks which have not met, and are not one component yet; core marks their largest one."""
    wide = F.greatest(F.count(F.lit(1)) / block_sets, F.sum("n") / block_shingles) > 1
    large = clustered.groupBy(F.col("label").alias("w_label")).agg(wide.alias("wide")).where("wide")
    rows = clustered.drop("core").join(large, F.col("label") == F.col("w_label"), "left_semi")
    if rows.isEmpty():
        return rows.withColumn("core", F.lit(False))
    parts = components(links).withColumnsRenamed({"node": "p_node", "label": "part"})
    rows = staged(rows.join(parts, F.col("cid") == F.col("p_node"), "left").select("cid", "n", "label", F.coalesce("part", "cid").alias("part")), "parts")
    sizes = rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("m"))
    best = sizes.groupBy(F.col("label").alias("b_label")).agg(F.max_by("part", F.struct("m", "part")).alias("best"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return staged(rows.join(best, F.col("label") == F.col("b_label")).select("cid", "n", "label", (F.col("part") == F.col("best")).alias("core")), "unsettled")


def similarity_classes(docs: DataFrame, k: int = K, percent: int = PERCENT, width: int = SKETCH, group: int = GROUP, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    A document's set are its distinct shingles of ``k`` words, A-Z lower-cased; of fewer words, all of them are one
    shingle. Documents are linked if 100 * intersection >= percent * union. component_id is the smallest doc_id that
    links lead to, the document itself included.

    Cases: null texts and texts without words have an empty set and are linked with nothing. Repeated rows are
    documents with equal sets. A null doc_id takes part in links, but is never the smallest, unless a component has no
    other; then it is null. Very long texts are shingled whole. An empty table gives an empty table. Other columns are
    left alone.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    profiles = staged(_profiles(docs, k, percent, width), "profiles")
    reps = profiles.where("cid is not null").groupBy("cid", "chk").agg(F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits"), F.min("doc_id").alias("rep"))
    reps = staged(reps, "classes")
    twice = staged(reps.groupBy(F.col("cid").alias("t_cid")).agg(F.min("chk").alias("kept"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "twice")
    if not twice.isEmpty():  # different sets with one id: all but one of them get another
        other = F.when(F.col("chk") != F.col("kept"), F.xxhash64("cid", "chk")).otherwise(F.col("cid"))
        profiles, reps = (x.join(twice, F.col("cid") == F.col("t_cid"), "left").withColumn("cid", F.coalesce(other, "cid")).drop("t_cid", "kept") for x in (profiles, reps))
    met = staged(_entries(reps, group).mapInArrow(_meetings(percent, group), "kind int, a long, b long"), "meetings")

    # Groups that share a key: their trees give pairs that may be similar.
    members = met.where("kind = 0").select(F.col("a").alias("grp"), F.col("b").alias("g_cid")).distinct()
    members = members.join(reps.select("cid", "n", "bits"), F.col("g_cid") == F.col("cid")).select("grp", "n", "cid", "bits")
    near = members.repartition("grp").sortWithinPartitions("grp", "n", "cid").mapInArrow(_group_trees(percent), "a long, b long")

    # Keys of more classes than a task holds: all of them are in one cluster.
    crowds = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("cid"))
    least = staged(crowds.groupBy(F.col("key").alias("k")).agg(F.min("cid").alias("least")), "least")  # the join can then split a hot key
    near = near.unionByName(crowds.join(least, F.col("key") == F.col("k")).select(F.col("cid").alias("a"), F.col("least").alias("b")))
    clusters = staged(components(near), "labels")
    clustered = clusters.join(reps.select("cid", "chk", "n", "rep"), F.col("node") == F.col("cid")).select("cid", "chk", "n", "rep", "label")
    clustered = staged(clustered, "clusters")

    # The sets of the classes that take part; a doc_id that other texts have too gives other sets, which are dropped.
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            cid, data = [], []
            for want, check, t in zip(batch.column("cid").to_pylist(), batch.column("chk").to_pylist(), batch.column("text")):
                s = shingle_set(t.as_py(), k, hashes)
                if len(s) and _class_of(s)[1] == check:
                    cid.append(want), data.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(data, pa.binary())], names=["cid", "set"])

    # a merge join at every size: it spills, and the classes that take part are too many to be sent to all
    texts = docs.join(clustered.select("cid", "chk", "rep").hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "chk", "text")
    sets = staged(texts.mapInArrow(make, "cid long, set binary").dropDuplicates(["cid"]), "sets")

    clustered = clustered.select("cid", "n", "label", F.lit(False).alias("core"))
    links = _links(clustered, sets, percent, block_sets, block_shingles, True)
    rest = _unsettled(clustered, links, percent, block_sets, block_shingles)
    if not rest.isEmpty():
        links = links.unionByName(_links(rest, sets, percent, block_sets, block_shingles, False))
    labels = components(links).withColumnsRenamed({"node": "l_node", "label": "l_label"})

    ids = profiles.select("doc_id", "cid", "n")
    groups = reps.select("cid", "rep").join(labels, F.col("cid") == F.col("l_node"), "left").select("cid", "rep", F.coalesce("l_label", "cid").alias("group"))
    firsts = groups.groupBy(F.col("group").alias("g")).agg(F.min("rep").alias("component_id"))
    groups = groups.join(firsts, F.col("group") == F.col("g")).select(F.col("cid").alias("g_cid"), "component_id")
    out = ids.join(groups, F.col("cid") == F.col("g_cid"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"), QUERY_K, QUERY_PERCENT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id.

    Cases are those of ``similarity_classes``. Rows that share a doc_id, null among them, stay together: all of them
    if one of them stays. Extra columns stay, whatever their names.
    """
    keep = similarity_classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]), "left_semi")


OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + least(len(w), {QUERY_K}) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), {QUERY_K}) + 2)]) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= {QUERY_PERCENT} * (a.n + b.n - o)),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
