"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components
from .simhash_dedup import _Forest


def _vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a usable vector, these vectors): of `dims` finite components, not all zero."""
    long = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(long == dims)
    values = column.take(pa.array(right)).flatten()
    v = values.to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null component: nan
    good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    return right[good], v[good]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 5) -> np.ndarray:
    """Iterative quantisation: principal directions, then the rotation that brings them nearest to the
    corners of a cube.  Returns dims x bits; a code's bits are the signs of v @ it."""
    u = _unit(sample)
    values, basis = np.linalg.eigh(u.T @ u)
    basis = basis[:, np.argsort(-values)[:bits]]
    low = u @ basis
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((basis.shape[1],) * 2))
    for _ in range(rounds):
        a, _, b = np.linalg.svd(np.where(low @ rotation >= 0, 1.0, -1.0).T @ low)
        rotation = (a @ b).T
    return basis @ rotation


def part_width(n: int, bucket: int) -> int:
    """Bits of a part: with n vectors about `bucket` of them have one value of it; 8 at least and 24 at most."""
    return int(np.clip(np.ceil(np.log2(max(1, n) / bucket)), 8, 24))


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, sample: int = 10_000, tables: int = 8, chunk: int = 8192, bucket: int = 256,
    neighbours: int = 8,
) -> DataFrame:
    """One row for each row of vectors: (vec_id, n_links, component_id, kept).

    Links: pairs with a cosine of `least` or more, computed in double precision from the vectors
    themselves.  Candidates: pairs whose codes meet in one of `tables` parts.  A part is as wide as the logarithm of
    the number of vectors asks for, so that a bucket has about `bucket` of them; a wider code takes further
    rotations.  Of parts of over 8 bits a vector also looks at neighbouring values, with one of its `neighbours` least
    certain bits turned.  The rotations are fitted on the `sample` vectors of the least id hashes; every vector is
    indexed.  A bucket of over `chunk` vectors is cut in chunks, each pair of which is one task's group, and tasks return
    sums and spanning links, not pairs.  A pair that meets several times is counted once.  Equal vectors are one
    vertex, named by its smallest id and weighted by their number, so a group of copies of any size is a single row.

    Null, zero, non-finite and null-holding vectors and rows with a null id link with nothing; vectors of different
    lengths do not link, and those of a length that is not the commonest are compared with all of their length.
    Every row is a vector of its own, so a repeated row links with its copy.  An empty table gives no rows.  Ids are
    integers; other columns are not read, so their names do not matter."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    usual = rows.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims, width = (usual["n"], part_width(usual["count"], bucket)) if usual else (1, 8)
    fit = rows.where(F.size("v") == dims).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    usable = _vectors(fit, dims)[1] if len(fit) else np.zeros((0, dims))
    turned = -(-tables * width // dims)
    turn = np.concatenate([learn_rotation(usable, dims, seed=5 + i) if len(usable) else np.zeros((dims, dims)) for i in range(turned)], axis=1)[:, : tables * width]
    near = min(neighbours, width) if width > 8 else 0
    kind = np.float32 if "float" in dict(rows.dtypes)["v"] else np.float64

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, v, keys, flips): the vector's bytes; a bucket in each table, then those of its neighbours; the bits that it turns."""
        for batch in batches:
            n = len(batch)
            bytes_, keys, flips = np.full(n, None, object), np.full(n, None, object), np.full(n, None, object)
            long = pc.fill_null(pc.list_value_length(batch.column("v")), 0).to_numpy(zero_copy_only=False)
            for size in np.unique(long[long > 0]):
                which, v = _vectors(batch.column("v"), int(size))
                named = pc.is_valid(batch.column("id").take(pa.array(which))).to_numpy(zero_copy_only=False)
                which, v = which[named], v[named]
                bytes_[which] = [x.tobytes() for x in np.ascontiguousarray(v.astype(kind))]
                if size != dims:  # one bucket for all of a length
                    keys[which] = [[-int(size)]] * len(which) if len(which) else []
                    flips[which] = [[0] * tables for _ in which]
                    continue
                side = (_unit(v) @ turn).reshape(-1, tables, width)
                value = ((side >= 0) << np.arange(width)).sum(axis=2)
                order = np.argsort(np.abs(side), axis=2)[:, :, :near]
                turns = 1 << order
                home = (np.arange(tables) << 32) + value
                beside = (np.arange(tables)[None, :, None] << 32) + (value[:, :, None] ^ turns)
                own = np.concatenate([home, beside.reshape(len(v), -1)], axis=1)
                for at, k, f in zip(which.tolist(), own.tolist(), turns.sum(axis=2).tolist()):
                    keys[at], flips[at] = k, f
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bytes_, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(flips, pa.list_(pa.int32()))], ["id", "v", "keys", "flips"])

    coded, _ = stage(rows.mapInArrow(encode, "id long, v binary, keys array<long>, flips array<int>"), "codes")
    distinct, _ = stage(coded.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("keys").alias("keys"), F.first("flips").alias("flips")), "vectors")
    homes = F.slice("keys", 1, tables)
    keyed = distinct.select("id", "v", "w", homes.alias("code"), "flips", F.posexplode("keys").alias("at", "key")).withColumn("home", F.col("at") < tables)
    # a bucket of two, one of them at home
    many = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("home")).where("n > 1 and home").select("key", F.ceil(F.col("n") / chunk).cast("int").alias("q"))
    dealt = (
        keyed.join(many, "key")
        .withColumn("part", F.pmod(F.xxhash64("id", F.lit(9)), F.col("q")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
        .select("id", "v", "w", "code", "flips", "key", "home", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    )

    def solve(key: int, ids: np.ndarray, v: np.ndarray, w: np.ndarray, code: np.ndarray, flips: np.ndarray, home: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        n, t = len(ids), key >> 32
        counts, forest = np.zeros(n, np.int64), _Forest(n)
        u = _unit(v)
        cross = (part != part[0]).any()
        for i in range(0, n, 512):
            a, b = np.nonzero(u[i : i + 512] @ u[i:].T >= least - 1e-9)
            a, b = a + i, b + i
            keep = (a < b) & (home[a] | home[b])
            if cross:
                keep &= part[a] != part[b]
            a, b = a[keep], b[keep]
            exact = np.einsum("ij,ij->i", u[a], u[b]) >= least
            for s in range(max(0, t)):  # met in an earlier table, at one's home or beside it
                differ = code[a, s] ^ code[b, s]
                exact &= (differ != 0) & ~((np.bitwise_count(differ) == 1) & ((differ & (flips[a, s] | flips[b, s])) != 0))
            if t >= 0:  # if each looks at the other's home, that of the less id counts
                differ = code[a, t] ^ code[b, t]
                both = (differ != 0) & ((differ & flips[a, t] & flips[b, t]) != 0)
                exact &= ~both | (home[a] == (ids[a] < ids[b]))
            a, b = a[exact], b[exact]
            counts += (np.bincount(a, weights=w[b], minlength=n) + np.bincount(b, weights=w[a], minlength=n)).astype(np.int64)
            forest.add(a, b)
        hit = np.flatnonzero(counts)
        x, y = (np.concatenate(z) for z in zip(*forest.kept)) if forest.kept else (hit[:0], hit[:0])
        kinds = np.r_[np.zeros(len(hit), np.int32), np.ones(len(x), np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.r_[ids[hit], ids[x]]), pa.array(np.r_[counts[hit], ids[y]])], ["kind", "a", "b"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, which may go over a batch's end."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(c).to_numpy() for c in ("key", "low", "high")]
            cut = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in cols])) + 1
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(batch)]):
                group = tuple(c[s] for c in cols)
                if held and group != last:
                    yield done(held)
                    held = []
                held.append(batch.slice(s, e - s))
                last = group
        if held:
            yield done(held)

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        got = pa.Table.from_batches(held).combine_chunks()
        key, n = got.column("key")[0].as_py(), len(got)
        v = np.frombuffer(b"".join(got.column("v").to_pylist()), kind).reshape(n, -1)
        listed = lambda c: got.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1)
        code = listed("code") & 0xFFFFFFFF if key >= 0 else np.zeros((n, 0), np.int64)
        flag = got.column("home").to_numpy(zero_copy_only=False).astype(bool)
        return solve(key, got.column("id").to_numpy(), v, got.column("w").to_numpy(), code, listed("flips").astype(np.int64), flag, got.column("part").to_numpy())

    group = ["key", "low", "high"]
    found, _ = stage(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(match, "kind int, a long, b long"), "veclinks")
    links = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n_links"))
    tied = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "id")
    told = (
        distinct.join(links, "id", "left")
        .join(tied, "id", "left")
        .select("v", (F.col("w") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )
    return (
        coded.join(told, "v", "left")
        .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
