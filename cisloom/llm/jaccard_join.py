"""Exact Jaccard self-join of shingle sets by signature trees, between leaves of sets that share a rare shingle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .common import documents, few, files_for, stored, text_of
from .graph import components

SHINGLE, PERCENT = 3, 90
#: Most sets and most shingles in a leaf; bits of a node's signature; sets in the smallest node; longs of the signature by which pairs of sets are left out; leaves that meet one leaf in one task.
LEAF_SETS, LEAF_SHINGLES, BITS, TIP, SIGNATURE, MEET = 256, 100_000, 1 << 13, 8, 32, 16
#: Cells of the table that orders shingles by how many sets still apart have them; most sets and most shingles of such a block.
CELLS, BLOCK_SETS, BLOCK_SHINGLES = 1 << 20, 512, 250_000
#: Rows of the input for each file of a table: of one whose tasks read texts or compare sets, and of a slim one.
ROWS, SLIM_ROWS = 1 << 10, 1 << 13
#: Most keys that are broadcast to pick rows by; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def share_of(percent: int) -> int:
    """One shingle in so many takes part in the search for candidates: twice as many as linked sets may differ in."""
    return max(1, min(8, 50 // max(1, 100 - percent) + 1))


def _sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each row, their hashes): distinct and sorted within a row; a row of fewer than ``k`` words has one, its whole sequence."""
    data = R.lower(data)
    starts, ends, before = R.words(data, at)
    words, count = R.word_hashes(data, starts, ends, 1), np.diff(before)
    row = np.repeat(np.arange(len(at) - 1), count)
    i = np.arange(max(0, len(row) - k + 1))
    i = i[row[i] == row[i + k - 1]]
    h = R.windows(words, k)[i]
    n = np.bincount(row[i], minlength=len(count))
    few = [(r, R.combine(R.windows(words[before[r] : before[r + 1]], int(count[r])), np.full(1, count[r], np.uint64))) for r in np.flatnonzero((count > 0) & (count < k))]
    parts, edge = [], np.concatenate([[0], np.cumsum(n)])
    own = dict(few)
    for r in range(len(n)):
        s = own[r] if r in own else np.sort(h[edge[r] : edge[r + 1]])
        if len(s) > 1:
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            s = s[new]
        parts.append(s)
    return np.array([len(s) for s in parts], np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _fingerprints(n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the set of each row, from two sums over its shingles and its size."""
    start = np.concatenate([[0], np.cumsum(n)])
    out = []
    for x in (0x51ED270B, 0xA3C59AC3):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(R.mix(h ^ np.uint64(x)))])
        out.append(R.mix(s[start[1:]] - s[start[:-1]] + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _sampled(n: np.ndarray, h: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 48 bits) of shingles, distinct within a row, and which of them are in the sample."""
    row, token = np.repeat(np.arange(len(n)), n), (h >> np.uint64(16)).astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return row[new], token[new], token[new] % share == 0


def _describe(shingle: int, share: int):
    """id and mark of every row, with the size, the sampled shingles and the id of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in R.chunks(batch, "text"):
                n, h = _sets(data, at, shingle)
                row, _, sampled = _sampled(n, h, share)
                part = batch.slice(lo, hi - lo)
                told = (n.astype(np.int32), np.bincount(row[sampled], minlength=hi - lo).astype(np.int32), *_fingerprints(n, h))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), *map(pa.array, told)], names=["id", "mark", "size", "sampled", "a", "b"])

    return run


def _postings(shingle: int, percent: int, share: int):
    """(token, a) of the sampled shingles of every set, once a chunk; a set whose sample is smaller than the part of it that must be looked
    at has some of its other shingles too, in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in R.chunks(batch, "text"):
                n, h = _sets(data, at, shingle)
                a = _fingerprints(n, h)[0]
                first = np.zeros(len(n), bool)
                first[np.unique(a, return_index=True)[1]] = True
                row, token, sampled = _sampled(n, h, share)
                missing = n - (n * percent + 99) // 100 + 1 - np.bincount(row[sampled], minlength=len(n))
                other = np.flatnonzero(~sampled)
                nth = R.within(np.bincount(row[other], minlength=len(n)))
                pick = np.sort(np.concatenate([np.flatnonzero(sampled), other[nth < missing[row[other]]]]))
                pick = pick[first[row[pick]]]
                yield pa.RecordBatch.from_arrays([pa.array(token[pick]), pa.array(a[row[pick]])], names=["token", "a"])

    return run


@dataclass
class Node:
    """Some sets: OR of their bitmaps, range of sizes, and most shingles of a set that share its bits with others."""

    members: np.ndarray
    bits: np.ndarray
    least: int
    most: int
    hidden: int
    parts: tuple[Node, Node] | None = None


class Forest:
    """Union-find over the sets of a task's leaves."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


class Tree:
    """Signature trees over sets (sorted hashes) and their dual traversal."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        _, self.token = np.unique(every, return_inverse=True)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        bit = (every % np.uint64(BITS)).astype(np.int64)
        self.bitmap = np.zeros((len(sets), BITS), bool)
        self.bitmap[self.owner, bit] = True
        self.hidden = self.size - self.bitmap.sum(1)

    def build(self, members: np.ndarray) -> Node:
        members = members[np.argsort(self.size[members], kind="stable")]
        node = Node(members, np.packbits(self.bitmap[members].any(0)), int(self.size[members[0]]), int(self.size[members[-1]]), int(self.hidden[members].max()))
        if len(members) > TIP:
            half = len(members) // 2
            node.parts = self.build(members[:half]), self.build(members[half:])
        return node

    def possible(self, a: Node, b: Node) -> bool:
        """Whether a set of ``a`` and one of ``b`` can be linked: by their sizes, and by the overlap that the bitmaps allow."""
        if 100 * a.most < self.percent * b.least or 100 * b.most < self.percent * a.least:
            return False
        need = self.percent * (a.least + b.least) / (100 + self.percent)
        return int(np.bitwise_count(a.bits & b.bits).sum()) + min(a.hidden, b.hidden) >= need

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact sizes of the intersections of the sets ``a`` with the sets ``b``."""
        ta = [self.token[self.start[i] : self.start[i + 1]] for i in a]
        vocabulary, place = np.unique(np.concatenate(ta), return_inverse=True)
        left = np.zeros((len(a), len(vocabulary)), np.float32)
        left[np.repeat(np.arange(len(a)), self.size[a]), place] = 1
        right = np.zeros((len(vocabulary), len(b)), np.float32)
        tb = np.concatenate([self.token[self.start[i] : self.start[i + 1]] for i in b])
        rows = np.repeat(np.arange(len(b)), self.size[b])
        at = np.searchsorted(vocabulary, tb)
        hit = at < len(vocabulary)
        hit[hit] = vocabulary[at[hit]] == tb[hit]
        right[at[hit], rows[hit]] = 1
        return np.rint(left @ right).astype(np.int64)

    def join(self, a: Node, b: Node, forest: Forest) -> None:
        """Links between the sets of ``a`` and ``b``; node pairs that are connected already, or too far apart, are left out."""
        if a is b and len(a.members) == 1:
            return
        roots = {forest.root(int(i)) for i in a.members} | {forest.root(int(i)) for i in b.members}
        if len(roots) == 1 or not self.possible(a, b):
            return
        if a.parts is None and b.parts is None:
            both = self.common(a.members, b.members)
            union = self.size[a.members][:, None] + self.size[b.members][None, :] - both
            for i, j in zip(*np.nonzero(100 * both >= self.percent * union), strict=True):
                if a.members[i] != b.members[j]:
                    forest.link(int(a.members[i]), int(b.members[j]))
        elif a is b:
            x, y = a.parts
            self.join(x, x, forest)
            self.join(y, y, forest)
            self.join(x, y, forest)
        else:
            for x in a.parts or (a,):
                for y in b.parts or (b,):
                    self.join(x, y, forest)


SET = "sid bigint, size int, shingles binary, bits array<bigint>, hidden int, us array<bigint>, vs array<bigint>"


def _make_leaves(shingle: int):
    """Gather the sets of a leaf (its rows follow each other; those with one ``sid`` are one set) and link them; one row a set, with its signature, and the leaf's links beside its first."""

    def run(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            tree, forest = Tree(sets, percent), Forest(len(sets))
            root = tree.build(np.arange(len(sets)))
            tree.join(root, root, forest)
            bits = np.zeros((len(sets), SIGNATURE * 64), bool)
            bits[tree.owner, (np.concatenate(sets) % np.uint64(SIGNATURE * 64)).astype(np.int64)] = True
            links = [[[ids[link[side]] for link in forest.links]] + [[]] * (len(ids) - 1) for side in (0, 1)]
            longs = pa.list_(pa.int64())
            told = [pa.array(ids, pa.int64()), pa.array(tree.size.astype(np.int32)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(list(np.packbits(bits, 1).view(np.int64)), longs)]
            return pa.RecordBatch.from_arrays([*told, pa.array((tree.size - bits.sum(1)).astype(np.int32)), *[pa.array(x, longs) for x in links]], names=[x.split()[0] for x in SET.split(", ")])

        key, ids, sets = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("low", "part", "sid")), strict=True))
            for lo, hi, data, at in R.chunks(batch, "text"):
                n, h = _sets(data, at, shingle)
                for (low, part, sid), s in zip(keys[lo:hi], np.split(h, np.cumsum(n)[:-1]), strict=True):
                    if (low, part) != key:
                        if key is not None:
                            yield packed(ids, sets)
                        key, ids, sets = (low, part), [], []
                    if not ids or ids[-1] != sid:
                        ids.append(sid)
                        sets.append(s.copy())
        if key is not None:
            yield packed(ids, sets)

    return run


def _meet(percent: int):
    """Links between the sets of a group on side 0 and those of each of its leaves on side 1; sets with one root are linked already."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("x_leaf", "ascending"), ("sid", "ascending")])
        ids, roots = group.column("sid").to_pylist(), group.column("root").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        tree, forest = Tree(sets, percent), Forest(len(sets))
        first: dict[int, int] = {}
        for i, r in enumerate(roots):
            forest.link(first.setdefault(r, i), i)
        forest.links = []
        side, leaf = group.column("side").to_numpy(), group.column("x_leaf").to_numpy()
        ends = [*(np.flatnonzero((side[1:] != side[:-1]) | (leaf[1:] != leaf[:-1])) + 1).tolist(), len(ids)]
        one = tree.build(np.arange(ends[0]))
        for lo, hi in zip(ends, ends[1:], strict=False):
            tree.join(one, tree.build(np.arange(lo, hi)), forest)
        us, vs = [ids[i] for i, _ in forest.links], [ids[j] for _, j in forest.links]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _fits(percent: int) -> Column:
    """Whether sets of the sizes of ``x`` and of ``y`` can be linked."""
    return (100 * F.col("x.most") >= percent * F.col("y.least")) & (100 * F.col("y.most") >= percent * F.col("x.least"))


def _possible(percent: int) -> Column:
    """Whether sets of ``x`` and of ``y`` can be linked, by the overlap that their signatures allow."""
    both = F.aggregate(F.zip_with("x.bits", "y.bits", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda s, c: s + c)
    return (both + F.least("x.hidden", "y.hidden")) * (100 + percent) >= percent * (F.col("x.least") + F.col("y.least"))


def _meeting(sets: DataFrame, entries: DataFrame, pairs: DataFrame, percent: int, rows: int | None = None) -> DataFrame:
    """(y_leaf, task, side, x_leaf, sid): the sets that must meet for ``pairs`` (token, x, y: structs that begin with a leaf, and least and most size of its sets with the token).

    Only sets that bear the token meet, and only if the signatures of both leaves' sets with it allow a link: texts that share a passage by chance stay where they are.
    The y sets of a leaf travel once for every MEET leaves that they are paired with.  ``rows``, where known, are those of the input.
    """
    files = files_for(rows, SLIM_ROWS)
    pairs = stored(few(pairs.select("token", *[F.struct(f"{s}.leaf", f"{s}.least", f"{s}.most").alias(s) for s in "xy"]), files))
    wanted = pairs.select("token", F.col("x.leaf").alias("leaf")).unionByName(pairs.select("token", F.col("y.leaf").alias("leaf"))).distinct()
    bearers = stored(few(entries.select("token", "leaf", "sid").join(wanted, ["token", "leaf"]), files))
    signed = bearers.join(sets.select("sid", "bits", "hidden"), "sid").groupBy("token", "leaf").agg(F.array(*[F.bit_or(F.col("bits")[i]) for i in range(SIGNATURE)]).alias("bits"), F.max("hidden").alias("hidden"))
    signed = stored(few(signed, files))
    for s in "xy":
        told = signed.select("token", F.col("leaf").alias(f"{s}_leaf"), F.struct("bits", "hidden").alias("told"))
        pairs = pairs.withColumn(f"{s}_leaf", F.col(f"{s}.leaf")).join(told, ["token", f"{s}_leaf"]).withColumn(s, F.struct(f"{s}.least", f"{s}.most", "told.*")).drop("told")
    left = stored(few(pairs.where(_possible(percent)).select("token", "x_leaf", "y_leaf"), files))
    tasks = left.select("x_leaf", "y_leaf").distinct().groupBy("y_leaf").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("tasks"))
    dealt = left.join(tasks, "y_leaf").withColumn("task", F.pmod(F.xxhash64("x_leaf"), F.col("tasks")))
    ways = dealt.select("token", "y_leaf", "task").distinct(), dealt
    sides = [d.join(bearers.withColumnRenamed("leaf", f"{s}_leaf"), ["token", f"{s}_leaf"]) for s, d in zip("yx", ways, strict=True)]
    none = F.struct(F.lit(0).cast("bigint").alias("low"), F.lit(0).alias("part"))
    y, x = (d.select("y_leaf", "task", F.lit(i).alias("side"), (F.col("x_leaf") if i else none).alias("x_leaf"), "sid").distinct() for i, d in enumerate(sides))
    return y.unionByName(x)


def _linked(sets: DataFrame, entries: DataFrame, pairs: DataFrame, roots: DataFrame | None, percent: int, n: int | None = None) -> DataFrame:
    """Links (u, v) between the sets of every pair (token, x, y), of an input of ``n`` rows; see :func:`_meeting`."""
    rows = stored(few(_meeting(sets, entries, pairs, percent, n).withColumn("x_leaf", F.xxhash64("x_leaf")), files_for(n, SLIM_ROWS)))
    moved = picked(sets.select("sid", "shingles"), stored(few(rows.select("sid").distinct(), files_for(n, SLIM_ROWS))), "sid", "inner")
    rows = rows.join(moved, "sid")
    rows = rows.withColumn("root", F.col("sid")) if roots is None else rows.join(roots.withColumnRenamed("u", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return stored(few(rows.groupBy("y_leaf", "task").applyInArrow(_meet(percent), "u bigint, v bigint"), files_for(n, ROWS)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows of sets at once, and their shingles one after the other."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield part, np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n): shingles of a task's sets, by cell of the table."""
    n = np.zeros(CELLS, np.int64)
    for _, h in _slices(batches):
        cell, more = np.unique(h % np.uint64(CELLS), return_counts=True)
        n[cell.astype(np.int64)] += more
    cell = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n[cell])], names=["cell", "n"])


def _prefixes(percent: int, table: np.ndarray):
    """(token, sid, root, size, kind, short): the first shingles of every set in the order of ``table`` and hash.

    The first shingle that two linked sets share is among them, and among the ``short`` ones of the smaller set.  Linked sets are of one
    ``kind``, by size, or of kinds that follow each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h in _slices(batches):
            n = batch.column("size").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            h = h[np.lexsort((h, table[(h % np.uint64(len(table))).astype(np.int64)], row))]
            at, long, short = R.within(n), n - (n * percent + 99) // 100 + 1, n + 1 + (-2 * percent * n) // (100 + percent)
            pick = np.flatnonzero(at < long[row])
            of = row[pick]
            kind = np.floor(np.log(n) / np.log(100.1 / percent)).astype(np.int32)
            told = [h[pick].view(np.int64), batch.column("sid").to_numpy()[of], batch.column("root").to_numpy()[of], n[of].astype(np.int32), kind[of], at[pick] < short[of]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in told], names=["token", "sid", "root", "size", "kind", "short"])

    return run


def _meet_blocks(percent: int):
    """Links between the sets of one block, or of two: those of the group's kind with each other and with the smaller ones that visit."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("visits", "ascending"), ("sid", "ascending")])
        ids, roots = group.column("sid").to_pylist(), group.column("root").to_pylist()
        tree, forest = Tree([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")], percent), Forest(len(ids))
        first: dict[int, int] = {}
        for i, r in enumerate(roots):
            forest.link(first.setdefault(r, i), i)
        forest.links = []
        part = 2 * group.column("side").to_numpy() + group.column("visits").to_numpy()
        own, guests, other, others = (tree.build(m) if len(m := np.flatnonzero(part == i)) else None for i in range(4))
        one = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        for a, b in ((own, own), (own, guests)) if one else ((own, other), (guests, other), (own, others)):
            if a is not None and b is not None:
                tree.join(a, b, forest)
        us, vs = [ids[i] for i, _ in forest.links], [ids[j] for _, j in forest.links]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _dealt(prefixes: DataFrame) -> DataFrame:
    """(token, kind, lo, hi, side, visits, sid, root): prefixes (stored) in groups by token and kind of size, cut into blocks that meet two by two.

    A set stands in the group of its kind, and visits that of the next with its short prefix.  Groups of one component stay where they are.
    """
    both = prefixes.withColumn("visits", F.lit(0)).unionByName(prefixes.where("short").withColumn("visits", F.lit(1)).withColumn("kind", F.col("kind") + 1))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_SHINGLES) / F.max("size"))))
    told = [F.min("root").alias("first"), F.max("root").alias("last"), F.min("visits").alias("least"), F.max("short").alias("some"), F.ceil(F.count(F.lit(1)) / room).cast("int").alias("blocks")]
    groups = both.groupBy("token", "kind").agg(*told).where("first < last AND least = 0 AND some").select("token", "kind", "blocks")
    cut = both.join(groups, ["token", "kind"]).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("token", "kind", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "visits", "sid", "root")


def _linked_apart(sets: DataFrame, apart: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (u, v) between all sets of ``apart`` (sid, root), of an input of ``n`` rows, whose roots differ.

    The rarest shingles of these sets are taken anew, over all of their shingles and counted among them alone: what many of them share comes last, so
    that sets with words of their own meet only in those.  Counts are kept by cell, so that the order needs no join and is the same everywhere.
    """
    apart = stored(few(apart, files_for(n, SLIM_ROWS)))
    live = stored(few(picked(sets.select("sid", "size", "shingles"), apart, "sid", "inner"), files_for(n, ROWS)))
    counts = live.select("shingles").mapInArrow(_tally, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CELLS, np.int32)
    table[counts.column("cell").to_numpy()] = np.minimum(counts.column("n").to_numpy(), (1 << 31) - 1)
    prefixes = stored(few(live.mapInArrow(_prefixes(percent, table), "token bigint, sid bigint, root bigint, size int, kind int, short boolean"), files_for(n, ROWS)))
    rows = stored(few(_dealt(prefixes), files_for(n, ROWS))).join(live.select("sid", "shingles"), "sid")
    return stored(few(rows.groupBy("token", "kind", "lo", "hi").applyInArrow(_meet_blocks(percent), "u bigint, v bigint"), files_for(n, ROWS)))


def picked(rows: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """``rows`` joined with ``keys`` (stored, one row a key): broadcast up to BROADCAST_KEYS keys, beyond that by a shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def _candidates(own: DataFrame, rows: DataFrame, shingle: int, percent: int, files: int) -> DataFrame:
    """(token, a): what sets must be compared for.

    Linked sets differ in few shingles, so that of the rarest of each, a few more than these, one is shared; passages that
    many texts share are not among the rarest.  Rarity is counted within a sample of the shingles, which comes first in the order.
    """
    share = share_of(percent)
    posts = own.select("text").mapInArrow(_postings(shingle, percent, share), "token bigint, a bigint")
    counts = posts.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posts.join(counts, "token").groupBy("a", "token").agg(F.first("n").alias("n")).groupBy("a").agg(F.collect_list(F.struct("n", "token")).alias("s"))
    sets = rows.where("size > 0").groupBy("a").agg(F.max("size").alias("size"), F.min("sampled").alias("sampled"), (F.min("b") != F.max("b")).alias("several"))
    inside = F.filter("s", lambda x: x["token"] % share == 0)
    known = shared.join(sets, "a").withColumns({"inside": F.sort_array(inside), "outside": F.filter("s", lambda x: x["token"] % share != 0)})
    look = F.col("size") - F.floor((F.col("size") * percent + 99) / 100) + 1 - (F.col("sampled") - F.size("inside"))
    rare = F.when(F.col("several"), F.col("inside")).otherwise(F.slice("inside", 1, F.greatest(F.lit(0), look.cast("int"))))
    return stored(few(known.select("a", F.explode(F.concat(rare, "outside")).alias("x")).select("x.token", "a"), files))


@dataclass
class Groups:
    """``rows``: id, mark, size, a, b of every row; ``best``: for every set (a, b) its component's best row (without, id, mark); ``files`` for a slim table of them."""

    rows: DataFrame
    best: DataFrame
    files: int


def find_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> Groups:
    """Components of the links between all rows of ``docs``; see :func:`jaccard_components`."""
    own = marked(docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")), "id", "text")
    told = f"id {own.schema['id'].dataType.simpleString()}, mark binary, size int, sampled int, a bigint, b bigint"
    rows = stored(own.mapInArrow(_describe(shingle, share_of(percent)), told))
    n = rows.agg(F.greatest(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint") / 256).cast("bigint")).first()[0]  # a long text counts as several rows
    files, slim = files_for(n, ROWS), files_for(n, SLIM_ROWS)
    posts = _candidates(own, rows, shingle, percent, files)
    met = posts.groupBy("token").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo < hi").select("token")
    posts = stored(few(posts.join(met, "token"), files))
    classes = rows.where("size > 0").groupBy("a", "b").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "mark")).alias("best"), F.first("size").alias("size"))
    both = classes.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi").select("a")
    # the least of the shared rare shingles: like sets agree in it, and one that no other set has cannot be it
    near = posts.select("a", F.xxhash64("token").alias("low")).unionByName(both.select("a", F.col("a").alias("low")))
    wanted = near.groupBy("a").agg(F.min("low").alias("low"))
    chosen = stored(few(classes.join(wanted, "a").withColumn("sid", F.monotonically_increasing_id()), slim))
    room = F.greatest(F.lit(1), F.least(F.lit(LEAF_SETS), F.floor(F.lit(LEAF_SHINGLES) / F.max("size"))))
    leaves_of = chosen.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("leaves"))
    placed = chosen.join(leaves_of, "low").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("leaves")).cast("int"))
    placed = stored(few(placed.select("sid", "a", "b", "low", "part", "size", F.col("best.mark").alias("mark")), slim))
    texts = picked(own.select("mark", "text"), placed.select("mark", "sid", "low", "part"), "mark", "inner").select("low", "part", "sid", "text")
    make = _make_leaves(shingle)
    sets = stored(few(texts.repartition("low", "part").sortWithinPartitions("low", "part", "sid").mapInArrow(lambda x: make(percent, x), SET), files))
    links = sets.select(F.explode(F.arrays_zip(F.col("us").alias("u"), F.col("vs").alias("v"))).alias("l")).select("l.u", "l.v")
    # sets whose first 64 bits agree meet too, whatever they share
    tokens = posts.select("token", "a").unionByName(both.select((-F.col("a").bitwiseAND(F.lit((1 << 62) - 1)) - 1).alias("token"), "a"))
    where = placed.select("a", "sid", "size", F.struct("low", "part").alias("leaf"))
    entries = stored(few(tokens.join(where, "a").select("token", "leaf", "sid", "size"), files))
    of_leaf = [F.min("size").alias("least"), F.max("size").alias("most")]
    groups = entries.groupBy("token", "leaf").agg(*of_leaf)
    heads = groups.groupBy("token").agg(F.min(F.struct("leaf", "least", "most")).alias("y"), F.max("leaf").alias("last")).where("y.leaf < last").select("token", "y")
    star = groups.select("token", F.struct("leaf", "least", "most").alias("x")).join(heads, "token").where("x.leaf <> y.leaf").where(_fits(percent))
    links = links.unionByName(_linked(sets, entries, star, None, percent, n))
    roots = components(links, files=slim)
    # sets that share a token with one of another component; a token's first leaf has met the others
    state = entries.join(roots.withColumnRenamed("u", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    apart = state.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("leaf").alias("head")).where("lo < hi").select("token", "head")
    state = state.join(apart, "token").where("leaf <> head").select("token", "sid", "root")
    still = state.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    more = _linked_apart(sets, state.join(still, "token").select("sid", "root").distinct(), percent, n)
    if not more.isEmpty():
        roots = components(links.unionByName(more), files=slim)
    linked = stored(placed.select("a", "b", "sid").join(roots.withColumnRenamed("u", "sid"), "sid"))
    joined = classes.select("a", "b", "best").join(linked.select("a", "b", "root"), ["a", "b"])
    of_root = joined.groupBy("root").agg(F.min("best").alias("first"))
    best = classes.select("a", "b", "best").join(linked.join(of_root, "root").select("a", "b", "first"), ["a", "b"], "left")
    return Groups(rows, stored(few(best.select("a", "b", F.coalesce("first", "best").alias("best")), slim)), slim)


def marked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with ``mark``, 128 bits of hash of id and text."""
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return df.withColumn("mark", F.unhex(F.md5(F.concat(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), name))))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Component of every row under links ``100 * |A and B| >= percent * |A or B|`` between sets of ``shingle``-word shingles.

    1. Rows with one shingle set (128 bits of hash) are one class.
    2. Of the rarest shingles of a set, a few more than linked sets differ in, linked sets share one; only classes that share one
       with another class go on.  Rarity is counted over all rows, within a sample of shingles that comes first in the order.
    3. Classes are dealt to leaves of bounded size by the least shared one of these shingles, so that like sets stand together.  Each leaf is a signature tree (OR-combined
       bitmaps, size ranges), joined with itself by dual traversal, which leaves out node pairs whose largest possible overlap
       is too small or whose sets are connected already; what is left is counted exactly.
    4. The sets of a leaf that bear a rare shingle meet those of its first leaf that do.  Pairs are left out by sizes and signatures before sets move.
    5. Of the sets that still share such a shingle with one of another component, the rarest shingles among themselves are taken, of all that they have;
       sets of like sizes that share one of these meet, in blocks of bounded size.  No link between components is missed.

    Cases: a null text or one without words has no set: its component is its own id.  Repeated rows are linked.  A null id is
    no candidate for ``component_id``, which is null if no row of the component has an id.  Very long texts have leaves of their own; other
    columns are not read.  An empty table gives an empty result.

    Returns id, ``n_shingles``, ``component_id``.  Links within a component are not counted: the join stops where sets are connected.
    """
    g = find_groups(docs, id_col, text_col, shingle, percent)
    out = g.rows.join(g.best, ["a", "b"], "left")
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("best.id")).otherwise(F.col("id")).alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that with the smallest id, with all columns; rows without words all stay.

    Of rows that share both id and text one stays.  Ids that are null count as largest.  Rows that go are picked by ``mark``: the rows that stay
    cross no exchange unless more than BROADCAST_KEYS go.
    """
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    i, t = (f"c{docs.columns.index(x)}" for x in (id_col, text_col))
    g = find_groups(flat, i, t, shingle, percent)
    each = g.rows.where("size > 0").groupBy("mark", "a", "b").agg(F.count(F.lit(1)).alias("n")).join(g.best, ["a", "b"])
    stays = F.col("mark") == F.col("best.mark")
    fate = stored(few(each.where(~stays | (F.col("n") > 1)).select("mark", stays.alias("once")).groupBy("mark").agg(F.max("once").alias("once")), g.files))
    met = picked(marked(flat, i, t), fate, "mark", "left")
    out = met.where("once IS NULL").select(*flat.columns).unionByName(met.where("once").dropDuplicates(["mark"]).select(*flat.columns))
    return out.toDF(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS v FROM g UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM g JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY u) c ON c.u = g.doc_id
"""
