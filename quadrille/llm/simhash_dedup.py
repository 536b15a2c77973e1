"""Near-duplicates by SimHash and BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat, stage, trim, word_spans
from .components import components


def _fingerprint(text: bytes, starts: list[int], ends: list[int], width: int) -> int:
    """starts, ends: of the words in text, which has one space between two words."""
    n = len(starts)
    if not n:
        return 0
    hash64 = xxhash.xxh64_intdigest
    last = max(0, n - width)
    view = memoryview(text)
    h = np.fromiter((hash64(view[a:b], 42) for a, b in zip(starts[: last + 1], ends[min(width, n) - 1 :])), np.uint64, last + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):  # 64 bits of each as bytes
        ones += np.unpackbits(h[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(h)).astype(np.uint8))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long): the SimHash of the XXH64 values of all shingles of `width` words, repeats included."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "t"):
                data, at = flat(part.column("t"))
                start, end, row = word_spans(data, at)
                first = np.searchsorted(row, np.arange(len(part) + 1))
                data = lower[data]
                # the text anew with one space after each word
                long = end - start
                to = np.cumsum(long + 1) - long - 1
                joined = np.full(int((long + 1).sum()), 32, np.uint8)
                shift = np.repeat(to - start, long)
                where = np.arange(len(shift)) - np.repeat(np.cumsum(long) - long, long) + np.repeat(start, long)
                joined[where + shift] = data[where]
                text, out = joined.tobytes(), []
                for i in range(len(part)):
                    a, b = first[i], first[i + 1]
                    if a == b:
                        out.append(0)
                        continue
                    low, high = int(to[a]), int(to[b - 1] + long[b - 1])
                    out.append(_fingerprint(text[low:high], (to[a:b] - low).tolist(), (to[a:b] + long[a:b] - low).tolist(), width))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["id", "fp"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


class BKTrees:
    """One BK-tree for each group of 64-bit numbers, built and searched level by level over whole arrays.

    Each number is a node.  The children of a node are keyed by their Hamming distance to it, so all below the
    edge k lie at distance k; a search with radius r at distance d from a node follows the edges d-r to d+r."""

    def __init__(self, values: np.ndarray, group: np.ndarray):
        """group: numbers from 0, ascending."""
        self.values = values
        members = np.arange(len(values))
        keys, nodes, under = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], group
        self.roots, self.size = np.full(int(group.max(initial=-1)) + 1, -1), np.bincount(group)
        while len(members):
            first = np.r_[True, under[1:] != under[:-1]]
            head = members[first]
            if under is group:
                self.roots[group[first]] = head
            else:
                keys.append(under[first])
                nodes.append(head)
            parent = np.repeat(head, np.diff(np.r_[np.flatnonzero(first), len(members)]))[~first]
            members = members[~first]
            under = self._edge(parent, np.bitwise_count(values[members] ^ values[parent]).astype(np.int64))
            order = np.argsort(under, kind="stable")
            members, under = members[order], under[order]
        self.keys, self.nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(self.keys)
        self.keys, self.nodes = self.keys[order], self.nodes[order]

    @staticmethod
    def _edge(node: np.ndarray, key: np.ndarray) -> np.ndarray:
        return node * 65 + key

    def pairs(self, probes: np.ndarray, group: np.ndarray, radius: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (place in probes, place in values) of one group, at most `radius` apart; so many probes are on
        their way at a time that these meet at most `most` nodes, or one probe."""
        work = np.cumsum(self.size[group])
        i = 0
        while i < len(probes):
            j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + most, "right")))
            which, at = np.arange(i, j), self.roots[group[i:j]]
            while len(which):
                far = np.bitwise_count(probes[which] ^ self.values[at]).astype(np.int64)
                near = far <= radius
                if near.any():
                    yield which[near], at[near]
                found = []
                for key in range(-radius, radius + 1):
                    edge = self._edge(at, far + key)
                    place = np.minimum(np.searchsorted(self.keys, edge), max(0, len(self.keys) - 1))
                    hit = (self.keys[place] == edge) & (far + key >= 0) & (far + key <= 64) if len(self.keys) else np.zeros(len(edge), bool)
                    found.append((which[hit], self.nodes[place[hit]] if len(self.keys) else at[hit]))
                which, at = (np.concatenate(x) for x in zip(*found))
            i = j


class _Forest:
    """Union-find that keeps only the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            top = self.roots()
            ra, rb = top[a], top[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            _, one = np.unique(high, return_index=True)  # one new parent for each root
            self.up[high[one]] = low[one]
            self.kept.append((a[one], b[one]))


def _links(fp: np.ndarray, part: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint links that keep the components of all links within each group.  A group of one part is probed with
    itself; of two parts, the tree of the lower is probed with the other."""
    start = np.r_[True, group[1:] != group[:-1]]
    number = np.cumsum(start) - 1
    low = np.minimum.reduceat(part, np.flatnonzero(start))[number]
    high = np.maximum.reduceat(part, np.flatnonzero(start))[number]
    tree, probe = np.flatnonzero(part == low), np.flatnonzero((part != low) | (low == high))
    forest = _Forest(len(fp))
    for p, k in BKTrees(fp[tree], number[tree]).pairs(fp[probe], number[probe], radius):
        own = probe[p] != tree[k]
        forest.add(probe[p[own]], tree[k[own]])
    if not forest.kept:
        return fp[:0], fp[:0]
    a, b = (np.concatenate(x) for x in zip(*forest.kept))
    return fp[a], fp[b]


def linked(fps: DataFrame, radius: int = 4, blocks: int = 6, shard: int = 16384) -> DataFrame:
    """fps: distinct `fp`.  Returns (a, b): links of at most `radius` differing bits, enough of them that
    the components are those of all such links.

    The 64 bits are cut in `blocks` parts; two fingerprints within the radius agree in some
    blocks - radius of them, so every choice of that many parts gives one shard key.  A shard holds
    equal keys, has a BK-tree, and is searched with its members; the trees of all shards are as many as the
    data and go to the tasks of their probes, not to every executor.  A shard of over `shard` members is dealt to
    several trees, and every pair of these meets in a task of its own; so what a tree holds, and what it is
    sent, is bounded, and no link is lost."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])).alias("choice", "key")).select("fp", "key")
    many = keyed.groupBy("key").count().where("count > 1").withColumn("q", F.ceil(F.col("count") / shard).cast("int")).select("key", "q")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("q")).cast("int")
    dealt = (
        keyed.join(many, "key")
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        .select("fp", "key", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, low, high); a group may go over a batch's end."""

        def solve(*rows: np.ndarray) -> pa.RecordBatch:
            a, b = _links(*rows, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        group_no, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            key, low, high = (batch.column(c).to_numpy() for c in ("key", "low", "high"))
            new = np.r_[last is not None and (key[0], low[0], high[0]) != last, (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)]
            group = group_no + np.cumsum(new)
            group_no, last = int(group[-1]), (key[-1], low[-1], high[-1])
            held.append((batch.column("fp").to_numpy().view(np.uint64), batch.column("part").to_numpy(), group))
            fp, part, g = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(g, group_no))
            if whole:
                yield solve(fp[:whole], part[:whole], g[:whole])
            held = [(fp[whole:], part[whole:], g[whole:])]
        if held:
            yield solve(*held[0])

    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """One row for each row of docs: (doc_id, fingerprint, component_id).

    Equal fingerprints are one vertex, named by its smallest id, so a group of copies of any size is a
    single row before anything is compared; links and components are found between such vertices.
    Null or empty text: fingerprint zero, linked like any other.  A null id is kept as a row, has its
    fingerprint, and is the smallest of its component only if that holds no other id (then null).
    An empty table gives no rows.  A very long text is hashed in blocks of shingles.  A bit set in just half of the
    shingles is 0.  Ids are integers.  Other columns are not read, so their names do not matter; repeated rows are
    repeated in the result."""
    made, _ = stage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct, _ = stage(made.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links, _ = stage(linked(distinct.select("fp"), radius), "fplinks")
    tied = components(links).withColumnsRenamed({"node": "fp", "component_id": "root"})
    rooted, _ = stage(distinct.join(tied, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(low, "root").select("fp", "component_id")
    return made.join(named, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """docs without those that are not the smallest id of their component; null ids stay.  All columns of docs stay,
    whatever their names."""
    found = simhash_components(docs, radius=radius, width=width)
    drop = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti")
