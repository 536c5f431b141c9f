"""N-gram Jaccard join of documents, by signature trees.

Texts with the same shingle set are one class. Linked classes share a shingle among the first few of each in one common
order (all shingles by hash, the corpus's most frequent ones last), so classes meet in the groups of those shingles and
no link is lost. Within a group, a signature tree holds the OR of its members' bitmaps and the range of their sizes at
every node; a traversal of the tree against itself drops pairs of nodes whose largest possible overlap is too small.
Members that some pair is left for meet once more with their sets: a second traversal verifies pairs as it goes and
leaves out those that are joined by then, so a group gives fewer links than it has members.

Before that, classes that share a minimum hash are tried against one of them each. Members of a group that this has
already joined need not meet again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import shingles
from wattloom.llm.common import extended, forget, read, worker_of, written

#: Two sets link when DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
MIN_HASHES = 4
#: Shingles that come last in the order, at most; they only make groups smaller, whichever they are.
MAX_FREQUENT, LEAST_FREQUENT = 200_000, 3
PART_ROWS = 2500
#: Bits of a bitmap for each element, at least (up to a width of 2 ** 20); those of short sets, where a width of SHORT allows it.
BITS, MORE_BITS, SHORT = 4, 32, 1 << 12
#: Groups of a class, smallest first, that its rows carry: a pair met in an earlier one of both is not met again.
EARLIER = 16
#: Shingles, in all, of a block of a group whose bitmaps meet, and of one whose sets meet.
BITS_BLOCK, SETS_BLOCK = 1 << 18, 1 << 17
#: Members of a tree's bottom nodes, nodes of its other nodes, and bytes of bitmaps that are tested at a time.
BOTTOM, LEAF, PAIR_BYTES = 32, 8, 1 << 22
#: A frequent shingle of more documents than HOT makes its group row by row; keys of more rows take their least value from a broadcast,
#: up to MAX_HUBS of them.
HOT, MAX_HUBS = 1024, 10_000
#: Buckets of first shingles for each shuffle partition; a task holds one at a time.
BUCKETS = 16
#: Names a row by its id and text.
PLACE = "_place"
#: Bits of the bitmap that tells which texts need no shuffle (a broadcast of a row for 64 of them at most); of more places it tells less.
PLACE_BITS = 1 << 25


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection with which sets of these sizes link."""
    return -(-NUM * (a + b) // (DEN + NUM))


def prefix_length(n: np.ndarray) -> np.ndarray:
    """So many first shingles of a set of size n: a linked set holds one of them among its own first ones."""
    return n - -(-NUM * n // DEN) + 1


def size_code(n: np.ndarray) -> np.ndarray:
    """Sizes of linked sets have the same code or neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(DEN / NUM) + 1e-9).astype(np.uint8)


def bitmap(hashes: np.ndarray) -> bytes:
    """A set's bitmap, of BITS (a short set's: MORE_BITS) to twice as many bits for each element; a narrower one is its halves ORed together."""
    wanted = max(BITS * len(hashes), min(MORE_BITS * len(hashes), SHORT), 64)
    width = 1 << (wanted - 1).bit_length()
    bits = np.zeros(min(width, 1 << 20), bool)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size), 0)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to PART_ROWS, which bounds what a worker holds of their shingles."""
    for b in batches:
        for k in range(0, b.num_rows, PART_ROWS):
            yield b.slice(k, PART_ROWS)


def class_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each of several sets, from all its elements and its size."""
    size, total = np.diff(at), np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        total[full] = np.add.reduceat(shingles.mixed(h, 9), at[full])
    return shingles.mixed(total + size.astype(np.uint64), 10)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, PLACE, n, class, bits, keys, frequent) of docs (doc_id, PLACE, text): set size, hash of the set (null for an empty
    one), bitmap, minimum hashes, and (on one row of each batch) the shingles that several of the batch hold, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("ngram_join")
        for b in parts(batches):
            n, cls, bits, keys, everything = [], [], [], [], []
            for _, h, at in shingles.sets(b.column("text").to_pylist()):
                size = np.diff(at)
                full = np.flatnonzero(size)
                least = np.zeros((len(size), MIN_HASHES), np.uint64)
                if len(full):
                    for k in range(MIN_HASHES):
                        least[full, k] = np.minimum.reduceat(shingles.mixed(h, 20 + k), at[full])
                n.append(size)
                cls.append(class_of(h, at))
                keys.append(least)
                bits += [bitmap(h[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                everything.append(h)
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            value, count = np.unique(np.concatenate(everything), return_counts=True) if everything else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = count >= LEAST_FREQUENT
            pairs = [{"key": int(v), "n": int(c)} for v, c in zip(value[often].view(np.int64), count[often], strict=True)]
            columns = [
                b.column("doc_id"),
                b.column(PLACE),
                pa.array(n, pa.int64()),
                pa.array(np.concatenate(cls).view(np.int64) if cls else [], pa.int64(), mask=n == 0),
                pa.array(bits, pa.binary()),
                pa.array(list(np.concatenate(keys).view(np.int64)) if keys else [], pa.list_(pa.int64())),
                pa.array([pairs if k == 0 else None for k in range(len(n))], pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", PLACE, "n", "class", "bits", "keys", "frequent"])

    schema = extended(docs.select("doc_id", PLACE).schema, "n long, class long, bits binary, keys array<long>, frequent array<struct<key:long,n:long>>")
    return docs.select("doc_id", PLACE, "text").mapInArrow(run, schema)


def posted(docs: DataFrame, frequent: np.ndarray, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, deal, keys, classes, codes): the first shingles of every set, packed by bucket, once for each class in a batch.

    Those that are hot lie in bucket -1 with their whole key and are dealt by row, as no task needs to see all of one.
    """
    sent = docs.sparkSession.sparkContext.broadcast((np.sort(frequent), np.sort(shingles.mixed(hot, 11))))  # at most MAX_FREQUENT hashes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("ngram_join")
        last, hottest = sent.value
        for b in parts(batches):
            key, cls, code = [], [], []
            for _, h, at in shingles.sets(b.column("text").to_pylist()):
                size = np.diff(at)
                if not len(h):
                    continue
                own = class_of(h, at)
                of = np.repeat(np.arange(len(size)), size)
                late = np.zeros(len(h), bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                early = np.concatenate([[0], np.cumsum(~late)])
                before = early[:-1] - early[at[of]]  # others before it that are not frequent
                place = np.where(late, early[at[of + 1]] - early[at[of]] + (np.arange(len(h)) - at[of]) - before, before)
                mine = place < prefix_length(size)[of]
                key.append(shingles.mixed(h[mine], 11))
                cls.append(own[of[mine]])
                code.append(size_code(size)[of[mine]])
            if not key:
                continue
            key, cls, code = np.concatenate(key), np.concatenate(cls), np.concatenate(code)
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            if len(hottest):
                bucket[hottest[np.minimum(np.searchsorted(hottest, key), len(hottest) - 1)] == key] = -1
            order = np.lexsort((cls, key, bucket))
            bucket, key, cls, code = bucket[order], key[order], cls[order], code[order]
            new = np.ones(len(cls), bool)
            new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            bucket, key, cls, code = bucket[new], key[new], cls[new], code[new]
            which, start = np.unique(bucket, return_index=True)
            ends = [*start[1:], len(bucket)]
            cut = lambda v: [v[x:y].tobytes() for x, y in zip(start, ends, strict=True)]  # noqa: E731, B023
            keys = cut((key & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            if which[0] < 0:
                keys[0] = key[: ends[0]].tobytes()
            deal = np.where(which < 0, cls[start] >> np.uint64(33), 0).astype(np.int32)
            blobs = [pa.array(v, pa.binary()) for v in (keys, cut(cls), cut(code))]
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(deal), *blobs], names=["bucket", "deal", "keys", "classes", "codes"])

    return docs.select("text").mapInArrow(run, "bucket int, deal int, keys binary, classes binary, codes binary")


def groups_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(group, class) of a bucket's packed postings: groups of two or more classes of fitting sizes, equal ones once."""
    key, cls, code = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((cls, code, key))
    key, cls, code = key[order], cls[order], code[order].astype(np.int16)
    new = np.ones(len(cls), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls, code = key[new], cls[new], code[new]
    fits = (key[1:] == key[:-1]) & (code[1:] - code[:-1] <= 1)  # sizes that fit, in a chain
    part = np.concatenate([[0], np.cumsum(~fits)])
    keep = np.bincount(part)[part] > 1
    part, cls = part[keep], cls[keep]
    if not len(part):
        return np.zeros(0, np.uint64), cls
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(part)]]))
    name = shingles.mixed(np.add.reduceat(shingles.mixed(cls, 30), starts) + lengths.astype(np.uint64), 31)
    chosen = np.zeros(len(starts), bool)
    chosen[np.unique(name, return_index=True)[1]] = True
    mine = np.repeat(chosen, lengths)
    return np.repeat(name, lengths)[mine], cls[mine]


def grouped(posts: DataFrame) -> DataFrame:
    """(group, class): the distinct groups that share a first shingle."""

    def given(group: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(group), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000].view(np.int64)) for x in (group, cls)], names=["group", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for k, *blobs in zip(*(b.column(c).to_pylist() for c in ("bucket", "keys", "classes", "codes")), strict=True):
                if k < 0:
                    yield from given(shingles.mixed(np.frombuffer(blobs[0], "<u8"), 32), np.frombuffer(blobs[1], "<u8"))
                    continue
                if k != now and held:
                    yield from given(*groups_of(held))
                    held = []
                now = k
                held.append(tuple(np.frombuffer(x, kind) for x, kind in zip(blobs, ("<u4", "<u8", "u1"), strict=True)))
        if held:
            yield from given(*groups_of(held))

    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_ = posts.repartition(n, "bucket", "deal").sortWithinPartitions("bucket")
    return dealt_.mapInArrow(run, "group long, class long").distinct()


class Node:
    """Of a signature tree: sizes lo to hi, the OR of the bitmaps, the most elements of one member beyond its set bits, the component if it is one.

    A bottom node has its members' own numbers, sizes, components, bitmaps (in the narrowest one's width) and spare elements
    in arrays. `done`: its members need not meet those of another done node.
    """

    __slots__ = ("bits", "component", "done", "each", "hi", "kids", "lo", "members", "n", "parts", "spare", "spares")

    def __init__(self, kids: list[Node]):
        self.kids, self.members, self.done = kids, kids[0].members[:1], False
        self.lo, self.hi = min(k.lo for k in kids), max(k.hi for k in kids)
        seen = [k.at(min(len(x.bits) for x in kids)) for k in kids]
        self.bits = np.bitwise_or.reduce([bits for bits, _ in seen])
        self.spare = max(spare for _, spare in seen)
        self.component = kids[0].component if all(k.component == kids[0].component for k in kids) else None

    @classmethod
    def bottom(cls, members: list[tuple[int, int, bytes, int]]) -> Node:
        """Of (member, n, bitmap, component)."""
        self = cls.__new__(cls)
        self.members, self.n, self.parts = (np.array([m[k] for m in members], np.int64) for k in (0, 1, 3))
        width = min(len(m[2]) for m in members)
        self.each = np.stack([folded(np.frombuffer(m[2], np.uint8), width) for m in members])
        self.spares = self.n - np.bitwise_count(self.each).sum(1, dtype=np.int64)
        self.kids, self.done, self.lo, self.hi = [], False, int(self.n.min()), int(self.n.max())
        self.bits, self.spare = np.bitwise_or.reduce(self.each), int(self.spares.max())
        self.component = members[0][3] if (self.parts == members[0][3]).all() else None
        return self

    def at(self, width: int) -> tuple[np.ndarray, int]:
        """The bitmap at a width, and what is spare there. Of a node of several members, no more is known than their sizes."""
        if len(self.bits) == width:
            return self.bits, self.spare
        bits = folded(self.bits, width)
        return bits, self.hi - (int(np.bitwise_count(bits).sum()) if not self.kids and len(self.members) == 1 else 1)

    def each_at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The members' bitmaps at a width, and what is spare there."""
        if self.each.shape[1] == width:
            return self.each, self.spares
        each = np.bitwise_or.reduce(self.each.reshape(len(self.members), -1, width), 1)
        return each, self.n - np.bitwise_count(each).sum(1, dtype=np.int64)


def may_link(a: Node, b: Node) -> bool:
    """Whether some member of a may link with one of b: by sizes, then by the largest possible overlap.

    Common elements lie on bits that both have set; elements beyond one on each bit number no more than the spare of either.
    """
    if DEN * a.hi < NUM * b.lo or DEN * b.hi < NUM * a.lo or (a.component is not None and a.component == b.component):
        return False
    width = min(len(a.bits), len(b.bits))
    (x, more), (y, other) = a.at(width), b.at(width)
    return int(np.bitwise_count(x & y).sum()) + min(more, other) >= -(-NUM * (a.lo + b.lo) // (DEN + NUM))


def pairs_left(a: Node, b: Node) -> list[tuple[int, int]]:
    """The pairs of members of two bottom nodes (or of one with itself, each once) that may link, by the same tests for all at once."""
    width = min(a.each.shape[1], b.each.shape[1])
    (x, more), (y, other) = a.each_at(width), b.each_at(width)
    step = max(1, PAIR_BYTES // (width * len(y)))
    common = np.concatenate([np.bitwise_count(x[k : k + step, None] & y[None]).sum(2, dtype=np.int64) for k in range(0, len(x), step)])
    n, m = a.n[:, None], b.n[None]
    fits = common + np.minimum(more[:, None], other[None]) >= needed(n, m)
    fits &= (DEN * n >= NUM * m) & (DEN * m >= NUM * n) & (a.parts[:, None] != b.parts[None])
    if a is b:
        fits = np.triu(fits, 1)
    i, j = np.nonzero(fits)
    return list(zip(a.members[i].tolist(), b.members[j].tolist(), strict=True))


def tree(members: list[tuple[int, int, bytes, int]]) -> Node:
    """(member, n, bitmap, component), by component and size, so that nodes hold alike ones."""
    members = sorted(members, key=lambda m: (m[3], m[1], m[0]))
    level = [Node.bottom(members[k : k + BOTTOM]) for k in range(0, len(members), BOTTOM)]
    while len(level) > 1:
        level = [Node(level[k : k + LEAF]) if len(level[k : k + LEAF]) > 1 else level[k] for k in range(0, len(level), LEAF)]
    return level[0]


def candidates(a: Node, b: Node, settled: Callable[[Node, Node], bool] = lambda a, b: False) -> Iterator[tuple[int, int]]:
    """Pairs of members that the traversal of both trees leaves; one tree against itself gives each pair once.

    Pairs of nodes that are `settled` when their turn comes are left out.
    """
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if settled(a, b):
            continue
        if a is b:
            if a.component is None:
                if a.kids:
                    todo += [(x, y) for k, x in enumerate(a.kids) for y in a.kids[k:]]
                else:
                    yield from pairs_left(a, a)
        elif may_link(a, b):
            if not a.kids and not b.kids:
                yield from pairs_left(a, b)
            elif a.kids and (not b.kids or a.hi - a.lo >= b.hi - b.lo):
                todo += [(x, b) for x in a.kids]
            else:
                todo += [(a, y) for y in b.kids]


class Meeting:
    """The members of a block of a group, or of two blocks. A pair that meets in an earlier group of both is left to that."""

    def __init__(self, key: tuple[int, int, int], rows: list[tuple]):
        """key: (group, left, right); rows: (class, side, n, bitmap, component, groups)."""
        self.group, left, right = key
        self.shared = [frozenset(r[5]) for r in rows]
        sides: dict[int, list[tuple]] = {left: [], right: []}
        first: dict[int, int] = {}
        self.root = []
        for k, (_, side, n, bits, component, _) in enumerate(rows):
            sides[side].append((k, n, bits, component))
            self.root.append(first.setdefault(component, k))
        self.trees = [tree(x) for x in sides.values()] if all(sides.values()) else []

    def pairs(self, settled: Callable[[Node, Node], bool]) -> Iterator[tuple[int, int]]:
        if self.trees:
            for x, y in candidates(self.trees[0], self.trees[-1], settled):
                if min(self.shared[x] & self.shared[y], default=self.group) >= self.group:
                    yield x, y

    def awake(self) -> list[int]:
        """Members that the traversal leaves some pair for. Nodes of members that are known to be such need not meet."""
        found: set[int] = set()

        def known(node: Node) -> bool:
            node.done = node.done or (all(map(known, node.kids)) if node.kids else found.issuperset(node.members.tolist()))
            return node.done

        for pair in self.pairs(lambda a, b: known(a) and known(b)):
            found.update(pair)
        return sorted(found)

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = k = self.root[self.root[k]]
        return k

    def one(self, node: Node) -> bool:
        """Whether all members of a node are joined."""
        if not node.done:
            firsts = [x.members[0] for x in node.kids] or node.members
            node.done = all(map(self.one, node.kids)) and len({self.find(int(k)) for k in firsts}) == 1
        return node.done

    def links(self, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Pairs that link, each of which joins two parts that were not joined before."""
        for x, y in self.pairs(lambda a, b: self.one(a) and self.one(b) and self.find(int(a.members[0])) == self.find(int(b.members[0]))):
            i, j = self.find(x), self.find(y)
            if i != j and len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= needed(len(sets[x]), len(sets[y])):
                self.root[max(i, j)] = min(i, j)
                yield x, y


KEYS = ["group", "left", "right"]


def dealt(members: DataFrame, block: int) -> DataFrame:
    """members (group, class, component, n) of the groups with several components, with KEYS and side: the blocks of a group that meet.

    The members of a group's main component (that with most shingles) need to meet the others only, not each other. Where they and the
    others are a block each, all meet at once, so that a small group's members are sent once.
    """
    by_component = members.groupBy("group", "component").agg(F.sum("n").alias("n"))
    top = F.max(F.struct("n", "component"))
    found = by_component.groupBy("group").agg(top.alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda c: F.ceil(c / block).cast("int")
    found = found.select("group", F.col("top.component").alias("main"), blocks(F.col("top.n")).alias("bm"), blocks(F.col("all") - F.col("top.n")).alias("br"))
    inside = members.join(written(found, "several"), "group")  # a table of its own, so that a large group's join can be split
    inside = inside.withColumn("small", F.expr("bm = 1 and br = 1"))
    is_main = F.col("component") == F.col("main")
    inside = inside.withColumn("side", F.when(F.col("small"), F.lit(0)).when(is_main, F.pmod(F.xxhash64("class"), F.col("bm"))).otherwise(F.col("bm") + F.pmod(F.xxhash64("class"), F.col("br"))).cast("int"))
    inside = inside.withColumn("other", F.explode(F.when(F.col("small"), F.array(F.lit(0))).when(is_main, F.expr("sequence(bm, bm + br - 1)")).otherwise(F.expr("sequence(0, bm + br - 1)"))))
    inside = inside.withColumns({"left": F.least("side", "other"), "right": F.greatest("side", "other")})
    return inside.select(*KEYS, "side", "class", "component", "n")


def met(members: DataFrame, columns: list[str], work: Callable[[tuple, list[tuple]], Iterable[tuple[int, int]]], names: list[str]) -> DataFrame:
    """What `work` gives (columns `names`, all long) for the members (`columns`) of each value of KEYS; a task holds one of them at a time."""

    def as_batch(out: list) -> pa.RecordBatch:
        table = np.array(out, np.int64).reshape(-1, len(names))
        return pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for b in batches:
            for g, left, right, *row in zip(*(b.column(c).to_pylist() for c in (*KEYS, *columns)), strict=True):
                if (g, left, right) != now:
                    if rows:
                        out += work(now, rows)
                    now, rows = (g, left, right), []
                rows.append(tuple(row))
            if len(out) > 50_000:
                yield as_batch(out)
                out = []
        if rows:
            out += work(now, rows)
        yield as_batch(out)

    rows = members.select(*KEYS, *columns).repartition(*KEYS).sortWithinPartitions(*KEYS)
    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names)).distinct()


def traversed(members: DataFrame) -> DataFrame:
    """(group, class) of the members (KEYS, class, side, n, bits, component, groups) that some pair is left for."""

    def work(key: tuple, rows: list[tuple]) -> Iterable[tuple[int, int]]:
        return [(key[0], rows[k][0]) for k in Meeting(key, rows).awake()]

    return met(members, ["class", "side", "n", "bits", "component", "groups"], work, ["group", "class"])


def joined(members: DataFrame) -> DataFrame:
    """(a, b): links among members (KEYS, class, side, n, hashes, component, groups), fewer for each value of KEYS than it has members."""

    def work(key: tuple, rows: list[tuple]) -> Iterable[tuple[int, int]]:
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        meeting = Meeting(key, [(*r[:3], bitmap(h), *r[4:]) for r, h in zip(rows, sets, strict=True)])
        return [(rows[x][0], rows[y][0]) for x, y in meeting.links(sets)]

    return met(members, ["class", "side", "n", "hashes", "component", "groups"], work, ["a", "b"])


def parted(docs: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (with PLACE) in two: rows that may be among the places (PLACE), and rows that are not, as a bitmap of the places tells."""
    bit = F.pmod(F.col(PLACE), F.lit(PLACE_BITS))
    rows = lambda df: df.withColumns({"_word": F.shiftright(bit, 6), "_mask": F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))})
    words = rows(places).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))  # PLACE_BITS / 64 rows at most
    marked = rows(docs).join(F.broadcast(words), "_word", "left")
    among = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")), F.lit(0)) != 0
    return marked.where(among).select(docs.columns), marked.where(~among).select(docs.columns)


def set_table(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, hashes) of the classes (class, PLACE) asked for, once each: hashes as packed sorted 64-bit numbers."""
    asked = written(classes.select(PLACE, "class"), "asked")
    maybe, _ = parted(docs.select(PLACE, "text"), asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, h, at in shingles.sets(b.column("text").to_pylist()):
                blobs = [h[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("class").slice(first, len(blobs)), pa.array(blobs, pa.binary())], names=["class", "hashes"])

    return maybe.join(asked, PLACE).mapInArrow(run, "class long, hashes binary")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of classes that link."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = set_table(docs, classes.join(asked, "class", "left_semi"))
    both = pairs.join(sets.select(F.col("class").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("ha")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, xs, ys = (b.column(k) for k in ("a", "b", "ha", "hb"))
            fits = []
            for x, y in zip(xs, ys, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                fits.append(len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y)))
            keep = pa.array(fits, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), c.filter(keep)], names=["a", "b"])

    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with `least`, the smallest value of their key, and `m`, how many rows the key has.

    Rows of the keys that have the most take theirs from a broadcast, so that no task has to see all of one.
    """
    found = rows.groupBy(key).agg(F.min(value).alias("least"), F.count(F.lit(1)).alias("m"))
    hubs = found.where(F.col("m") > HOT).orderBy(F.desc("m"), key).limit(MAX_HUBS)  # at most MAX_HUBS rows of 24 bytes
    marked = rows.join(F.broadcast(hubs), key, "left")
    return marked.where("m is not null").unionByName(marked.where("m is null").drop("least", "m").join(found, key))


def is_settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: every u has one v, which is no u itself."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("u")).unionByName(edges.select(F.col("v").alias("k"), F.lit(0).alias("u")))
    uses = ends.groupBy("k").agg(F.sum("u").alias("as_u"), F.count(F.lit(1)).alias("m"))
    return uses.where("as_u > 1 or (as_u = 1 and m > 1)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is a component's smallest node. Large and small stars in turn, till stars are left; no group is gathered."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    while not is_settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct()
        small = with_least(large, "u", "v").select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.*")
        before, now = now, written(small.where("u > v").distinct(), "stars")
        forget(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def placed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(PLACE, F.xxhash64("doc_id", "text"))


def rooted(docs: DataFrame) -> DataFrame:
    """(doc_id, PLACE, n, class, root) of every row of docs (doc_id, text, PLACE): its set's size and class (null for an empty
    set), and the smallest class of its component."""
    spark = docs.sparkSession
    sketch = written(sketched(docs), "sketches")
    classes = sketch.where("class is not null").groupBy("class").agg(F.min(PLACE).alias(PLACE), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    classes = written(classes, "classes")

    # Stars: every class against the smallest class with the same minimum hash.
    by_key = classes.select(F.explode("keys").alias("key"), "class")
    near = with_least(by_key, "key", "class").where("m > 1 and class > least").select(F.col("least").alias("a"), F.col("class").alias("b")).distinct()
    facts = classes.select("class", "n", "bits")
    star = near.join(facts.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
    star = star.join(facts.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    star = star.where(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [[Node.bottom([(0, n, x, k)]) for n, x in zip(b.column(f"n{s}").to_pylist(), b.column(f"b{s}").to_pylist(), strict=True)] for k, s in enumerate("ab")]
            keep = pa.array([may_link(x, y) for x, y in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    ids = classes.select("class", PLACE)
    star = written(star.mapInArrow(prune, "a long, b long"), "star-pairs")
    first = written(verified(star, docs, ids), "star-links")
    forget(star)
    known = components(first)

    # All others: groups of classes with a common first shingle, but those that are one component already.
    often = sketch.select(F.explode("frequent").alias("f")).groupBy("f.key").agg(F.sum("f.n").alias("n")).orderBy(F.desc("n"), "key").limit(MAX_FREQUENT)
    often = often.collect()  # at most MAX_FREQUENT
    frequent, hot = (np.array([r["key"] for r in often if r["n"] > more], np.int64).view(np.uint64) for more in (0, HOT))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = grouped(posted(docs, frequent, hot, buckets)).join(known.select(F.col("node").alias("class"), F.col("root").alias("component")), "class", "left")
    members = members.withColumn("component", F.coalesce("component", "class")).join(classes.select("class", "n"), "class")
    members = written(members, "groups")
    meeting = dealt(members, BITS_BLOCK)
    own = meeting.select("group", "class").distinct().groupBy("class").agg(F.slice(F.array_sort(F.collect_list("group")), 1, EARLIER).alias("groups"))  # of no more than its first shingles
    own = written(own, "earlier")
    awake = traversed(meeting.join(classes.select("class", "bits"), "class").join(own, "class"))
    awake = written(awake.join(members, ["group", "class"]), "awake")

    # Those that may link with another: once more, with their sets.
    sets = set_table(docs, ids.join(awake.select("class").distinct(), "class", "left_semi"))
    rest = joined(dealt(awake, SETS_BLOCK).join(own, "class").join(sets, "class"))
    roots = components(first.unionByName(rest))
    named = ids.join(roots, ids["class"] == roots["node"], "left").select("class", F.coalesce("root", "class").alias("root"))
    return sketch.select("doc_id", PLACE, "n", "class").join(named, "class", "left")


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    Null texts and texts without words have an empty set and are alone. Repeated rows are copies of each other; rows that
    share an id are documents of their own. A row with a null id can link others; alone, its component is null. No
    documents give no rows.
    """
    rows = written(rooted(placed(docs.select("doc_id", "text"))), "rooted")
    lowest = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(written(lowest, "lowest"), "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id (null last; of rows that share it, one). Rows with an empty set stay."""
    rows = written(rooted(placed(docs.select("doc_id", "text"))), "rooted")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", PLACE)
    chosen = rows.where("root is not null").groupBy("root").agg(F.min_by(PLACE, order).alias(PLACE)).select(PLACE)
    repeated = rows.where("root is not null").groupBy(PLACE).agg(F.count(F.lit(1)).alias("_repeats")).where("_repeats > 1")
    empty = rows.where("root is null").select(PLACE).distinct().withColumn("_repeats", F.lit(None).cast("long"))
    fates = written(chosen.join(repeated, PLACE, "left").unionByName(empty), "kept")
    dropped = rows.where("root is not null").select(PLACE).join(fates, PLACE, "left_anti")
    doubtful, sure = parted(placed(docs), dropped.unionByName(fates.where("_repeats is not null").select(PLACE)))
    kept = doubtful.join(fates, PLACE)
    once = kept.where("_repeats is not null").dropDuplicates([PLACE])  # rows that are equal in id and text
    return sure.select(docs.columns).unionByName(kept.where("_repeats is null").unionByName(once).select(docs.columns))


QUERIES = {"op1_ngram_join": query}
ORACLES = {
    "op1_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS s FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
}
