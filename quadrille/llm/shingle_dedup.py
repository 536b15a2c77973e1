"""Near-duplicates by the Jaccard similarity of their shingles: SimHash and MinHash propose, shingles decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat, mix, span_hashes, stage, trim, word_spans
from .components import components
from .simhash_dedup import _Forest, fingerprints, linked

#: A pair of similarity 0.8 agrees in none of 24 bands of 4 with chance (1 - 0.8**4)**24, 3 in a million.
BANDS, ROWS = 24, 4


def _shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes of the shingles of each text, one text after another, and where each begins.

    A text of fewer words is one shingle of them all; one without words has none."""
    data, at = flat(column)
    start, end, row = word_spans(data, at)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    words = span_hashes(lower[data], start, end)
    n = len(at) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    place = np.arange(len(words)) - first[row]
    size = np.diff(first)[row]
    begins = np.flatnonzero((place + width <= size) | (place == 0))
    h = np.zeros(len(begins), np.uint64)
    for i in range(width):
        there = place[begins] + i < size[begins]
        h[there] += mix(words[begins[there] + i] + np.uint64(i + 1))
        h = mix(h)
    owner = row[begins]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(n + 1))


def _set_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set."""
    total = np.r_[np.uint64(0), np.cumsum(mix(h), dtype=np.uint64)]
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, v, n, keys): hash and size of each document's set, and the keys of its bands."""
    factors = np.random.default_rng(20240607).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "t"):
                h, first = _shingle_sets(part.column("t"), width)
                n = np.diff(first)
                some = np.flatnonzero(n)
                keys = np.zeros((len(some), BANDS), np.uint64)
                if len(some):
                    for b in range(BANDS):
                        key = np.full(len(some), b + 1, np.uint64)
                        for f in factors[b * ROWS : (b + 1) * ROWS]:
                            key = mix(key + np.minimum.reduceat(h * f, first[some]))
                        keys[:, b] = key
                at = np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_set_hashes(h, first).view(np.int64)), pa.array(n.astype(np.int64)), listed], ["id", "v", "n", "keys"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null").mapInArrow(run, "id long, v long, n long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """wanted: (v, id).  (v, s): the sets of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "t"):
                h, first = _shingle_sets(part.column("t"), width)
                listed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_set_hashes(h, first).view(np.int64)), listed], ["v", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(wanted.select("id"), "id", "left_semi")
    # rows of one id may have other texts
    return texts.select("t").mapInArrow(run, "v long, s array<long>").join(wanted.select("v"), "v", "left_semi").dropDuplicates(["v"])


def _solver(similarity: float):
    """Links that join the trees of a group, of all pairs of its parts that are similar."""

    def solve(group: pa.Table) -> pa.Table:
        v, root, part = (group.column(c).to_numpy() for c in ("v", "root", "part"))
        sets = group.column("s").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        _, word = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(v)), size)
        order = np.argsort(word, kind="stable")
        posted = owner[order]
        begin = np.searchsorted(word[order], np.arange(int(word.max()) + 2 if len(word) else 1))
        cut = np.r_[0, np.cumsum(size)]
        _, one = np.unique(root, return_inverse=True)
        head = np.zeros(int(one.max()) + 1, np.int64)
        head[one[::-1]] = np.arange(len(v))[::-1]
        forest = _Forest(len(v))
        forest.up = head[one]
        probe = np.arange(len(v)) if (part == part[0]).all() else np.flatnonzero(part == part.max())
        for x in probe.tolist():
            top = forest.roots()
            open_ = top != top[x]
            if not open_.any():
                continue
            mine = word[cut[x] : cut[x + 1]]
            low, long = begin[mine], begin[mine + 1] - begin[mine]
            where = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long) + np.repeat(low, long)
            both = np.bincount(posted[where], minlength=len(v))
            near = np.flatnonzero(open_ & (both >= similarity * (size + size[x] - both)))
            forest.add(np.full(len(near), x), near)
        a, b = (np.concatenate(x) for x in zip(*forest.kept)) if forest.kept else (probe[:0], probe[:0])
        return pa.table({"a": pa.array(v[a]), "b": pa.array(v[b])})

    return solve


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 4, small: int = 32, chunk: int = 1024) -> DataFrame:
    """(id, component_id) of each row with an id; components are those of pairs whose sets of `width`-word
    shingles have the Jaccard `similarity` or more, under the smallest id.

    Equal sets are one vertex.  Pairs are proposed by SimHash links of at most `radius` bits and by bands of
    MinHash values, and verified by the sets.  In a band's group of over `small` members each is first compared
    with one of them; what is not one component then is dealt in chunks, and all pairs of these are compared."""
    made, _ = stage(_signed(docs, id_col, text_col, width), "signed")
    vertices, _ = stage(made.groupBy("v").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "vertices")
    keyed = vertices.select("v", "n", F.explode("keys").alias("key"))
    # the centre of a group is another one in each band
    many = keyed.groupBy("key").agg(F.count("*").alias("k"), F.min_by("v", F.xxhash64("v", "key")).alias("centre")).where("k > 1")
    met, _ = stage(keyed.join(many, "key"), "met")
    few = met.where(F.col("k") <= small).select("key", "v", "n")
    other = few.select("key", F.col("v").alias("w"), F.col("n").alias("m"))
    fits = F.least("n", "m") >= similarity * F.greatest("n", "m")
    pairs = few.join(other, "key").where("v < w").where(fits).select("v", "w")
    stars = met.where(F.col("k") > small).where("v <> centre").select(F.least("v", "centre").alias("v"), F.greatest("v", "centre").alias("w"))
    # SimHash: equal fingerprints meet at one vertex, linked ones by theirs
    printed, _ = stage(fingerprints(docs, id_col, text_col, width).join(made.select("id", "v"), "id").select("fp", "v").distinct(), "printed")
    lows, _ = stage(printed.groupBy("fp").agg(F.min("v").alias("low")), "lows")
    equal = printed.join(lows, "fp").select("v", F.col("low").alias("w"))
    at = lambda end, name: lows.select(F.col("fp").alias(end), F.col("low").alias(name))
    close = linked(lows.select("fp"), radius).join(at("a", "v"), "a").join(at("b", "w"), "b").select("v", "w")
    prints = equal.unionByName(close).where("v <> w").select(F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w"))
    asked, _ = stage(pairs.unionByName(stars).unionByName(prints).distinct(), "asked")

    def sets(of: DataFrame) -> DataFrame:
        return _sets(docs, vertices.select("v", "id").join(of, "v", "left_semi"), id_col, text_col, width)

    known, known_path = stage(sets(asked.select(F.explode(F.array("v", "w")).alias("v")).distinct()), "sets")
    both = F.size(F.array_intersect("s", "z"))
    found = asked.join(known, "v").join(known.select(F.col("v").alias("w"), F.col("s").alias("z")), "w")
    links, _ = stage(found.where(both >= similarity * (F.size("s") + F.size("z") - both)).select(F.col("v").alias("a"), F.col("w").alias("b")), "links")
    # large groups of more than one component
    rooted = met.where(F.col("k") > small).select("key", "v", "k").join(components(links).withColumnsRenamed({"node": "v", "component_id": "root"}), "v", "left").withColumn("root", F.coalesce("root", "v"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    left, _ = stage(rooted.join(mixed, "key", "left_semi"), "left")
    q = F.ceil(F.col("k") / chunk).cast("int")
    dealt = (
        left.withColumn("part", F.pmod(F.xxhash64("v", F.lit(7)), q).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), q - 1)))
        .select("v", "root", "key", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        .join(known, "v")
    )
    more, _ = stage(dealt.groupBy("key", "low", "high").applyInArrow(_solver(similarity), "a long, b long"), "more")
    tied = components(links.unionByName(more)).withColumnsRenamed({"node": "v", "component_id": "root"})
    named = vertices.select("v", "id").join(tied, "v", "left").select("v", "id", F.coalesce("root", "v").alias("root"))
    low = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return made.select("id", "v").join(named.select("v", "root"), "v").join(low, "root").select("id", "component_id")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those that are not the smallest id of their component; rows without an id stay.

    Null and empty texts have equal sets, empty ones, so one of them stays.  Repeated rows of one id stay or go
    together.  An empty table gives no rows.  All columns of docs stay, whatever their names."""
    drop = similar_components(docs, id_col, text_col, **how).where("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(drop, id_col, "left_anti")
