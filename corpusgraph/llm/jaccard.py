"""N-gram Jaccard join with signature trees.

A document's set is its distinct word shingles, as 64-bit hashes. Two documents link when the Jaccard similarity of
their sets reaches a threshold, and the classes are the connected components of the links. The result is that of
comparing all pairs, without doing so:

1. Equal sets become one representative (pre-aggregated, so thousands of copies cost one row each).
2. Blocking, exact. Linked sets of sizes a <= b differ in at most H = (a + b)(1 - t) / (1 + t) elements. Hash space is
   cut into more than H ranges, so at least one range holds the same elements in both. A set publishes a fingerprint
   for each range, under size classes so that both use the same ranges. Ranges with very few elements say little and
   are published only by sets that have too few others. What links shares a fingerprint; a fingerprint's sets are tied
   to the smallest of them, and the ties' components are the groups in which links can lie. A set has one row for each
   range, so even a fingerprint that all sets share is a small part of the rows. A fingerprint of more than `hot_sets` sets
   (a passage that many documents hold) ties only sets that need it: as linked sets differ in no more than `reach` ranges,
   a set with more than reach fingerprints that are not hot shares one of those with whatever it links with.
3. Signature trees. Members of a group get blocks of bounded size by size class. Each block is a tree whose nodes hold
   the OR of their members' token bitmaps and their range of sizes. Two blocks are joined by traversing both trees at
   once: a pair of nodes is dropped when their size ranges, or the largest overlap their bitmaps allow, rule out a
   link, and when all their members are known to be in one class. Leaves are compared exactly.
4. Components of the links found.

A group of any size is cut into blocks of bounded rows and elements, and a task holds two blocks at most. Blocks are
joined with themselves first, then one set of each class so far with those of the group's other classes, and last only
those pairs of blocks of equal or neighbouring size steps that by their sizes can still link and that hold different
classes.

Defined results. A null or empty text has size 0 and links with nothing. A text of fewer words than a shingle is one
shingle as a whole. Rows with the same id are one document as regards links; rows with a null id link with nothing and
have a null class. Every row of the input is in the result. Very long texts are sets like others. An empty table gives
an empty result. Columns other than id and text are not read; `keep_one` returns them untouched, whatever their names.
Ids are whole numbers, or texts of such; others are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import components, cut, hinted, joined_few, portions, without
from corpusgraph.llm.decontaminate import WordHashes
from corpusgraph.operators.state import release

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U = np.uint64


@dataclass(frozen=True)
class JaccardParams:
    shingle: int = 5
    percent: int = 80
    class_ratio: float = 1.5
    light: int = 2
    spread: float = 2.0
    block_rows: int = 512
    block_elements: int = 1_000_000
    leaf_rows: int = 16
    bits: int = 2048
    fanout: int = 8
    hot_sets: int = 1000
    broadcast_rows: int = 200_000

    @property
    def t(self) -> float:
        return self.percent / 100

    def most_apart(self, size: int) -> int:
        """Elements by which a set of this size and one that links with it can differ, at most."""
        return math.floor(size * (1 - self.t) / self.t + 1e-9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[bytes | None], k: int, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes): the sorted distinct shingle hashes of each text, one text after the other."""
    lists = [(t or b"").translate(LOWER).split() for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = [w for ws in lists for w in ws]
    hashes = np.fromiter(map(memo.__getitem__, flat), U, len(flat))
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(lists)), n)
    first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    values = np.zeros(len(first), U)
    short = counts[owner] < k
    for j in range(k):
        inside = ~short | (j < counts[owner])
        step = mixed(values * U(0x9E3779B97F4A7C15) + hashes[np.minimum(first + j, max(len(flat) - 1, 0))]) if len(flat) else values
        values = np.where(inside, step, values)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.bincount(owner, minlength=len(lists))


def size_class(sizes: np.ndarray, p: JaccardParams) -> np.ndarray:
    return np.searchsorted(class_bounds(p), sizes, side="right") - 1


def class_bounds(p: JaccardParams) -> np.ndarray:
    """Smallest size of each class: classes are at least class_ratio wide, and as wide as linked sizes reach."""
    ratio = max(p.class_ratio, 1 / p.t)
    bounds = [0, 1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * ratio)))
    return np.array(bounds)


def fingerprints(values: np.ndarray, sizes: np.ndarray, p: JaccardParams) -> Iterator[tuple[np.ndarray, list[int]]]:
    """For each set its published fingerprints: in its own class, and in lower ones while smaller sets there can link. The
    last three bits of a fingerprint number its class.

    Class c cuts the hash space into more ranges than its largest set, as the smaller of two, can differ in. A set that
    can differ in `reach` elements publishes its ranges of `light` or more elements if these are more than reach; else
    all that are not empty if these are; else all of them. Of two sets that link, one range is equal and published by
    both: either has more than reach of the better kind, or both publish the next kind as well.

    Beside them, for classes of which it publishes the best kind only: 8 times the number of fingerprints beyond reach,
    plus the class's number. A set with fewer hot fingerprints than that in the class does without those: of the others
    more than reach remain, so one of them is equal in whatever links, which publishes it whatever its own kind.
    """
    bounds = class_bounds(p)
    own = size_class(sizes, p)
    at = 0
    for size, c in zip(sizes.tolist(), own.tolist(), strict=True):
        v = values[at : at + size]
        at += size
        out, spare = [np.zeros(0, U)], []
        reach = p.most_apart(size)
        if reach:  # else only equal sets link
            low = math.ceil(size * p.t - 1e-9)
            for k in range(c, 0, -1):
                top = int(bounds[k + 1]) - 1
                if k < c and top < low:
                    break
                m = math.ceil(p.spread * (p.most_apart(top) + 1))
                part = ((v >> U(32)) * U(m)) >> U(32)
                full = np.bincount(part.astype(np.int64), minlength=m)
                ends = np.cumsum(full)
                sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed(v), dtype=U)])
                prints = mixed(sums[ends] - sums[ends - full] + mixed(np.arange(m, dtype=U) + U(k << 40)) + full.astype(U))
                prints = (prints & ~U(7)) | U(k & 7)
                best, some = full >= p.light, full > 0
                if best.sum() > reach:
                    spare.append(8 * int(best.sum() - reach) + (k & 7))
                out.append(prints[best] if best.sum() > reach else prints[some] if some.sum() > reach else prints)
        yield np.concatenate(out), spare


SET = ["print1", "print2", "n_shingles"]
PROFILE = "id long, n_shingles long, print1 long, print2 long, spare array<long>"


def _profiler(p: JaccardParams):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in portions(batches, "text"):
            ids, texts = batch.column("id"), batch.column("text").cast(pa.binary()).to_pylist()
            values, sizes = shingle_sets(texts, p.shingle, memo)
            upto = np.cumsum(sizes)
            one, two = (np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)]) for x in (values, mixed(values + U(1))))
            spare = [x for _, x in fingerprints(values, sizes, p)]
            of = lambda s: pa.array((s[upto] - s[upto - sizes]).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), of(one), of(two), pa.array(spare, pa.list_(pa.int64()))], ["id", "n_shingles", "print1", "print2", "spare"])

    return profile


def _publisher(p: JaccardParams):
    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in portions(batches, "text"):
            values, sizes = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), p.shingle, memo)
            prints = [x for x, _ in fingerprints(values, sizes, p)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prints])]).astype(np.int32)
            flat = np.concatenate([*prints, np.zeros(0, U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "prints"])

    return publish


def _set_maker(p: JaccardParams):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in portions(batches, "text"):
            values, sizes = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), p.shingle, memo)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("block"), sets], ["id", "block", "shingles"])

    return make


class Classes:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class SignatureTree:
    """Sets in order of size and fingerprint; every node: members [first, after), OR-ed bitmap, sizes, collisions."""

    def __init__(self, sets: list[np.ndarray], rows: list[int], p: JaccardParams):
        self.p, self.sets = p, sets
        self.maps = np.zeros((len(rows), p.bits // 64), U)
        for i, r in enumerate(rows):
            bit = sets[r] & U(p.bits - 1)
            np.bitwise_or.at(self.maps[i], (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
        sizes = np.array([len(sets[r]) for r in rows], np.int64)
        # The smallest hashes of a set are a min-hash of it: near sets fall side by side.
        order = np.lexsort(([int(sets[r][0]) for r in rows], sizes // max(1, int(sizes.max() * (1 - p.t)))))
        self.rows = [rows[i] for i in order]
        self.maps, self.sizes = self.maps[order], sizes[order]
        self.spare = self.sizes - np.bitwise_count(self.maps).sum(axis=1)
        level = [self._node(a, min(a + p.leaf_rows, len(rows)), []) for a in range(0, len(rows), p.leaf_rows)]
        while len(level) > 1:
            level = [self._node(x[0][0], x[-1][1], x) for x in (level[i : i + p.fanout] for i in range(0, len(level), p.fanout))]
        self.root = level[0]

    def _node(self, a: int, b: int, below: list) -> tuple:
        return a, b, below, np.bitwise_or.reduce(self.maps[a:b]), int(self.sizes[a:b].min()), int(self.sizes[a:b].max()), int(self.spare[a:b].max())


def needed(a: int, b: int, percent: int) -> int:
    """The smallest overlap with which sets of sizes a and b link: 100 I >= percent (a + b - I)."""
    return -(-percent * (a + b) // (100 + percent))


def may_link(x: tuple, y: tuple, p: JaccardParams) -> bool:
    """Whether some member of node x can link with one of node y, by sizes and by the bits they share."""
    if 100 * x[5] < p.percent * y[4] or 100 * y[5] < p.percent * x[4]:
        return False
    return int(np.bitwise_count(x[3] & y[3]).sum()) + min(x[6], y[6]) >= needed(x[4], y[4], p.percent)


def exact_overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by one sort and one product of 0/1 matrices."""
    flat = np.concatenate([*left, *right])
    values, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    both = np.zeros(len(values), np.int8)
    both[code[owner < len(left)]] |= 1
    both[code[owner >= len(left)]] |= 2
    shared = both == 3
    place = np.cumsum(shared) - 1
    inside = shared[code]
    row, column, width = owner[inside], place[code[inside]], int(shared.sum())
    total = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, width, 1 << 16):
        grid = np.zeros((len(left) + len(right), min(1 << 16, width - a)), np.float32)
        here = (column >= a) & (column < a + (1 << 16))
        grid[row[here], column[here] - a] = 1
        total += (grid[: len(left)] @ grid[len(left) :].T).astype(np.int64)
    return total


def traverse(one: SignatureTree, two: SignatureTree, classes: Classes, p: JaccardParams) -> Iterator[tuple[int, int]]:
    """Rows of linked sets, enough of them to connect all that link: pairs of one class already are passed over."""
    stack = [(one.root, two.root)]
    while stack:
        x, y = stack.pop()
        if one is two and x[0] > y[0]:
            continue
        xr, yr = one.rows[x[0] : x[1]], two.rows[y[0] : y[1]]
        if len({classes.root(r) for r in xr} | {classes.root(r) for r in yr}) == 1 or not may_link(x, y, p):
            continue
        if x[2] or y[2]:
            stack.extend((a, b) for a in x[2] or [x] for b in y[2] or [y])
            continue
        apart = np.bitwise_count(one.maps[x[0] : x[1], None] & two.maps[None, y[0] : y[1]]).sum(axis=2).astype(np.int64)
        nx, ny = one.sizes[x[0] : x[1]], two.sizes[y[0] : y[1]]
        least = -(-p.percent * (nx[:, None] + ny[None]) // (100 + p.percent))
        can = apart + np.minimum(one.spare[x[0] : x[1], None], two.spare[None, y[0] : y[1]]) >= least
        use_x, use_y = np.flatnonzero(can.any(axis=1)), np.flatnonzero(can.any(axis=0))
        if not len(use_x):
            continue
        overlap = exact_overlaps([one.sets[xr[i]] for i in use_x], [two.sets[yr[j]] for j in use_y])
        for i, j in np.argwhere((overlap >= least[np.ix_(use_x, use_y)]) & (np.array([[xr[i] != yr[j] for j in use_y] for i in use_x]))).tolist():
            a, b = xr[use_x[i]], yr[use_y[j]]
            if classes.join(a, b):
                yield a, b


def _block_joiner(p: JaccardParams):
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(x, np.int64).view(U) for x in pdf["shingles"]]
        ids, known, side = pdf["id"].tolist(), pdf["known"].tolist(), pdf["side"].tolist()
        classes, first = Classes(len(ids)), {}
        for i, (d, k) in enumerate(zip(ids, known, strict=True)):
            classes.join(first.setdefault(("id", d), i), i)
            classes.join(first.setdefault(("known", k), i), i)
        trees = [SignatureTree(sets, [i for i, s in enumerate(side) if s == at], p) for at in sorted(set(side))]
        links = list(traverse(trees[0], trees[-1], classes, p))
        return pd.DataFrame({"a": [ids[a] for a, _ in links], "b": [ids[b] for _, b in links]}, dtype="int64")

    return join


def _profiles(docs: DataFrame, p: JaccardParams) -> DataFrame:
    """(id, text) -> one row for each document, in the shared folder."""
    return cut(docs.select("id", "text").mapInArrow(_profiler(p), PROFILE))


def _copied(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets that are not empty, and of those that several ids have the smallest one: (print1, print2, n_shingles, rep)."""
    sets = profiles.where("id is not null and n_shingles > 0")
    return sets, sets.groupBy(*SET).agg(F.min("id").alias("rep"), F.max("id").alias("far")).where("rep < far").drop("far")


def _candidates(docs: DataFrame, profiles: DataFrame, p: JaccardParams) -> DataFrame:
    """(node, root) of the representatives that share a fingerprint with another, group by group.

    Fingerprints are many bytes for each byte of input, so they are made from the texts again and only shuffled once; ids of
    which no set is a representative publish none."""
    sets, reps = _copied(profiles)
    copies = sets.join(hinted(reps, p.broadcast_rows), SET, "left").groupBy("id").agg(F.min(F.coalesce(F.col("id") != F.col("rep"), F.lit(False))).alias("copy"))
    own = without(docs.where("id is not null").select("id", "text"), F.col("id"), cut(copies.where("copy").select(F.col("id").alias("copy"))), "copy", p.broadcast_rows)
    published = own.mapInArrow(_publisher(p), "id long, prints array<long>").select("id", F.explode("prints").alias("print"))
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # With the conditions that the join below infers stated here, both uses of this exchange are the same and share it.
    published = published.where("id is not null and print is not null").repartition(n, "print")
    hubs = published.groupBy("print").agg(F.min("id").alias("hub"), F.max("id").alias("far"), F.count(F.lit(1)).alias("n")).where("hub < far").drop("far")
    ties = published.join(hubs.hint("merge"), "print").where((F.col("id") != F.col("hub")) | (F.col("n") > p.hot_sets))  # both sides spill
    ties = cut(ties.select("id", "hub", (F.col("n") > p.hot_sets).alias("hot"), F.col("print").bitwiseAND(7).alias("k")))
    del own, published, hubs
    release(sets.sparkSession)
    return components(_needed(ties, sets).select(F.col("id").alias("a"), F.col("hub").alias("b")))


def _needed(ties: DataFrame, sets: DataFrame) -> DataFrame:
    """The ties without those by hot fingerprints that their set can do without."""
    hot = ties.where("hot").groupBy(F.col("id").alias("i"), F.col("k").alias("c")).agg(F.count(F.lit(1)).alias("n_hot"))
    if hot.isEmpty():
        return ties
    # An id with several texts stands for several sets: it keeps all its ties.
    spare = sets.groupBy("id").agg(F.min(F.struct("print1", "print2")).alias("lo"), F.max(F.struct("print1", "print2")).alias("hi"), F.first("spare").alias("spare")).where("lo = hi")
    spare = spare.join(hot.select(F.col("i").alias("id")).distinct(), "id", "left_semi").select("id", F.explode("spare").alias("s"))
    free = hot.join(spare, (F.col("i") == F.col("id")) & (F.col("c") == F.col("s").bitwiseAND(7))).where(F.col("n_hot") < F.shiftright("s", 3)).select("i", "c")
    free = cut(free)
    return ties.where("not hot").union(ties.where("hot").join(free, (F.col("id") == F.col("i")) & (F.col("k") == F.col("c")), "left_anti"))


def _blocks(members: DataFrame, by: list[str], p: JaccardParams) -> DataFrame:
    """members (node, root, step, n_shingles) with block: a group, or a size step of it, in parts of bounded size."""
    size = F.greatest(F.count(F.lit(1)) / F.lit(p.block_rows), F.sum("n_shingles") / F.lit(p.block_elements))
    parts = members.groupBy(*by).agg(F.ceil(size).alias("parts"))
    placed = members.join(hinted(parts, p.broadcast_rows), by).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    step = F.col("step") if "step" in by else F.lit(-1)
    return placed.select("node", "root", "step", "n_shingles", F.struct("root", step.alias("step"), "part").alias("block"))


BLOCK = "block struct<root:long,step:int,part:int>"


def _join_within(sets: DataFrame, p: JaccardParams) -> DataFrame:
    rows = sets.select("block", "id", F.col("id").alias("known"), F.lit(0).alias("side"), "shingles")
    found = cut(rows.groupBy("block").applyInPandas(_block_joiner(p), "a long, b long"))
    del rows
    release(found.sparkSession)
    return found


def _with_class(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """rows with `class`: the smallest set that the links found connect with `key`."""
    got = components(found).withColumnsRenamed({"node": "__n", "root": "class"})
    return rows.join(got, F.col(key) == F.col("__n"), "left").withColumn("class", F.coalesce("class", key)).drop("__n")


def links(docs: DataFrame, profiles: DataFrame, p: JaccardParams) -> DataFrame:
    """Links (a, b) between representatives that connect all that link."""
    sizes = profiles.where("id is not null and n_shingles > 0").groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    # A little wider than the ratio of sizes that link: they are of one step or of neighbouring ones.
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / (1.001 * math.log(1 / min(p.t, 0.999)))).cast("int").alias("step")
    groups = _candidates(docs, profiles, p)
    release(docs.sparkSession)
    members = groups.join(sizes, groups["node"] == sizes["id"]).select("node", "root", "n_shingles", step)
    members = cut(_blocks(members, ["root", "step"], p))
    texts = joined_few(docs.where("id is not null"), F.col("id"), members.select("node", "block"), "node", p.broadcast_rows).select("id", "block", "text")
    sets = cut(texts.mapInArrow(_set_maker(p), f"id long, {BLOCK}, shingles array<long>").where(F.size("shingles") > 0))
    del texts
    release(docs.sparkSession)
    found = _join_within(sets, p)

    # One set of each class against those of the group's other classes.
    classed = cut(_with_class(members, "node", found))
    many = classed.groupBy("root").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).where("c1 < c2").select("root")
    heads = _blocks(classed.where(F.col("node") == F.col("class")).join(hinted(many, p.broadcast_rows), "root").select("node", "root", "step", "n_shingles"), ["root"], p)
    heads = hinted(heads.select("node", F.col("block").alias("head_block")), p.broadcast_rows)
    found = found.union(_join_within(sets.join(heads, sets["id"] == heads["node"]).select("id", F.col("head_block").alias("block"), "shingles"), p))

    # Pairs of blocks that can still link: of one group, of near sizes, not both of one and the same class.
    classed = cut(_with_class(members, "node", found))
    blocks = classed.groupBy("block").agg(*[f(c).alias(n) for f, c, n in ((F.min, "class", "least"), (F.max, "class", "most"), (F.min, "n_shingles", "small"), (F.max, "n_shingles", "large"))])
    blocks = cut(blocks)
    x, y = (blocks.select(*[F.col(c).alias(f"{c}{i}") for c in blocks.columns], F.col("block.root").alias(f"root{i}"), F.col("block.step").alias(f"step{i}")) for i in (1, 2))
    y = y.withColumn("near", F.explode(F.array("step2", F.col("step2") - 1)))
    pairs = x.join(y, (F.col("root1") == F.col("root2")) & (F.col("step1") == F.col("near")) & (F.col("block1") < F.col("block2")))
    pairs = pairs.where(100 * F.col("large1") >= p.percent * F.col("small2")).where(100 * F.col("large2") >= p.percent * F.col("small1"))
    pairs = cut(pairs.where("not (least1 = most1 and least2 = most2 and least1 = least2)").select("block1", "block2"))
    if pairs.isEmpty():
        return found
    known = sets.join(classed.select("node", "class"), sets["id"] == classed["node"]).select("block", "id", F.col("class").alias("known"), "shingles")
    sides = F.explode(F.array(F.struct(F.col("block1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block2").alias("block"), F.lit(1).alias("side"))))
    sides = pairs.select("block1", "block2", sides.alias("x")).select("block1", "block2", "x.*")
    across = cut(known.join(sides, "block").groupBy("block1", "block2").applyInPandas(_block_joiner(p), "a long, b long"))
    del known, sides
    release(docs.sparkSession)
    return found.union(across)


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: JaccardParams | None = None) -> DataFrame:
    """One row for each document: id, n_shingles and component_id (the smallest id of its class)."""
    p = p or JaccardParams()
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    profiles = _profiles(own, p)
    sets, reps = _copied(profiles)
    # Copies are tied to their representative, and with them the sets of one id, as each of them is some group's.
    same_id = sets.join(hinted(reps, p.broadcast_rows), SET).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    root = components(links(own, profiles, p).union(same_id))
    out = profiles.join(root, profiles["id"] == root["node"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("root", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: JaccardParams | None = None) -> DataFrame:
    """The documents without near duplicates: of each class the one with the smallest id stays, with all its columns.

    Rows that repeat the id that stays all stay; rows with a null id stay."""
    gone = classes(docs, id_col, text, p).where(f"`{id_col}` <> component_id").select(F.col(id_col).alias("__gone")).distinct()
    gone = cut(gone)
    release(docs.sparkSession)
    return without(docs, docs[id_col].cast("long"), gone, "__gone", (p or JaccardParams()).broadcast_rows)


def oracle_sql(p: JaccardParams) -> str:
    """DuckDB SQL of `classes`: all pairs that share a shingle, and the closure of the links. For small tables."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + {p.shingle - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {p.shingle - 2}, least(len(w), 1) + 1))) AS i FROM d)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS MATERIALIZED (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT dx.doc_id AS x, dy.doc_id AS y FROM i JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y JOIN d dx ON dx.r = x JOIN d dy ON dy.r = y
  WHERE 100 * k >= {p.percent} * (nx.n + ny.n - k) AND dx.doc_id IS NOT NULL AND dy.doc_id IS NOT NULL),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
m AS (SELECT x, min(y) AS root FROM c GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m ON m.x = doc_id"""
