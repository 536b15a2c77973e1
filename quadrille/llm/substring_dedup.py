"""Substring deduplication over a log-structured index of fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, discard, flat, mix, pack, pack_sorted, partitions, release, span_hashes, stage, trim, unpack, unpack_sorted, word_spans

_NONE = np.zeros(0, np.uint64)
#: Kinds of rows: an index entry still to be compared, one that comes from a run, what a document is told.
_ENTRY, _RUN, _TOLD = 0, 1, 2
_ROWS = "kind int, bucket int, id long, h binary, g binary, ids binary, many binary"
_NAMES = ["kind", "bucket", "id", "h", "g", "ids", "many"]


def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _rolled(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The hash of every `width` words in a row (multilinear, so order counts)."""
    n = len(words) - width + 1
    if n <= 0:
        return _NONE
    out = np.full(n, seed, np.uint64)
    for j, c in enumerate(_factors(width, seed)):
        out += words[j : j + n] * c
    return mix(out)


class _Windows:
    """Words of some documents, with the windows and anchors that lie in one document."""

    def __init__(self, column: pa.Array, window: int, anchor: int):
        self.data, self.at = flat(column)
        self.start, self.end, self.row = word_spans(self.data, self.at)
        self.words = span_hashes(self.data, self.start, self.end)
        n = max(0, len(self.words) - window + 1)
        self.where = np.flatnonzero(self.row[:n] == self.row[len(self.row) - n :]) if n else np.zeros(0, int)
        self.window, self.anchor = window, anchor

    def anchors(self) -> np.ndarray:
        """Of each window in self.where: the least hash of its runs of `anchor` words.  Equal windows have
        equal anchors, and neighbouring windows mostly share one."""
        if not len(self.where):
            return _NONE
        short = _rolled(self.words, self.anchor, 11)
        n = len(short) - (self.window - self.anchor)
        low = short[:n].copy()
        for j in range(1, self.window - self.anchor + 1):
            np.minimum(low, short[j : j + n], out=low)
        return low[self.where]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each window in self.where, independent down to the bytes of its words: words that
        are one to the first are not to the second."""
        if not len(self.where):
            return _NONE, _NONE
        other = span_hashes(self.data, self.start, self.end, 1)
        return _rolled(self.words, self.window, 12)[self.where], _rolled(other, self.window, 13)[self.where]


def _rows(kind: int, bucket, ids, h, g=None, docs=None, many=None) -> pa.RecordBatch:
    n = len(h)
    blank = [None] * n
    cols = [pa.array([kind] * n, pa.int32()), pa.array(bucket, pa.int32()), pa.array(ids if ids is not None else blank, pa.int64())]
    cols += [pa.array(x if x is not None else blank, pa.binary()) for x in (h, g, docs, many)]
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def _by_id(ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs: (distinct ids, how many hashes each has, the hashes)."""
    order = np.lexsort((h, ids))
    ids, h = ids[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])
    own, counts = np.unique(ids[keep], return_counts=True)
    return own, counts, h[keep]


def _told(ids: np.ndarray, h: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """What documents are told, one row for each of `buckets` groups of documents."""
    if not len(ids):
        return
    group = (ids % buckets).astype(np.int32)
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.diff(group[order])) + 1
    made = [_by_id(ids[part], h[part]) for part in np.split(order, cut)]
    yield _rows(
        _TOLD, group[order[np.r_[0, cut]]], None, [pack_sorted(x[2]) for x in made], [pack(x[1].astype(np.uint64)) for x in made], [pack(x[0].view(np.uint64)) for x in made]
    )


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after another; a task's rows come sorted by bucket, so it holds one bucket at a time."""
    held: list[dict] = []
    for batch in batches:
        for i in range(0, len(batch), 64):
            for row in batch.slice(i, 64).to_pylist():
                if held and row["bucket"] != held[0]["bucket"]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a group, with all the hashes that it is told of."""
    for rows in _by_bucket(batches):
        got = [(np.repeat(unpack(row["ids"]).view(np.int64), unpack(row["g"]).astype(np.int64)), unpack_sorted(row["h"])) for row in rows]
        own, counts, h = _by_id(*(np.concatenate(x) for x in zip(*got)))
        cut = np.cumsum(counts)
        for i in range(0, len(own), 1024):
            ends = cut[i : i + 1024]
            starts = ends - counts[i : i + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(own[i : i + 1024]), pa.array([pack_sorted(h[a:b]) for a, b in zip(starts, ends)], pa.binary())], ["_id", "_told"])
    trim()


def _sorted_entries(ids: np.ndarray, h: np.ndarray, g: np.ndarray | None, many: np.ndarray | None):
    order = np.lexsort((ids, h) if g is None else (ids, g, h))
    return ids[order], h[order], None if g is None else g[order], None if many is None else many[order]


def _group_starts(h: np.ndarray, g: np.ndarray | None) -> np.ndarray:
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if g is not None:
        new[1:] |= g[1:] != g[:-1]
    return new


def _index_rows(kind: int, ids, h, g, many, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted entries as one row for each bucket of the hash range."""
    if not len(h):
        return
    bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(h)]
    parts = list(zip(cut[:-1], cut[1:]))
    yield _rows(
        kind, bucket[cut[:-1]].astype(np.int32), None, [pack_sorted(h[a:b]) for a, b in parts], None if g is None else [pack(g[a:b]) for a, b in parts],
        [pack(ids[a:b].astype(np.uint64)) for a, b in parts], None if many is None else [np.packbits(many[a:b]).tobytes() for a, b in parts],
    )


def _combine(ids: np.ndarray, h: np.ndarray, g: np.ndarray | None, buckets: int, tell_least: bool) -> Iterator[pa.RecordBatch]:
    """What a task knows before the shuffle: a hash that two of its documents share needs no other
    task to be settled for all but the least of them, so one entry a hash leaves the task, however
    many documents hold it.  tell_least: the least one is told as well."""
    ids, h, g, _ = _sorted_entries(ids, h, g, None)
    keep = _group_starts(h, g)
    keep[1:] |= ids[1:] != ids[:-1]
    ids, h, g = ids[keep], h[keep], None if g is None else g[keep]
    new = _group_starts(h, g)
    size = np.diff(np.r_[np.flatnonzero(new), len(h)])
    shared = np.repeat(size > 1, size)
    mine = shared if tell_least else shared & ~new
    yield from _told(ids[mine], h[mine], buckets)
    yield from _index_rows(_ENTRY, ids[new], h[new], None if g is None else g[new], size > 1, buckets)


def _entries(rows: list[dict]) -> tuple:
    """The entries of a bucket in order: ids, hashes, second hashes or None, whether shared, whether from a run."""
    got = []
    for row in rows:
        h = unpack_sorted(row["h"])
        many = np.unpackbits(np.frombuffer(row["many"], np.uint8), count=len(h)).astype(bool)
        got.append((unpack(row["ids"]).view(np.int64), h, None if row["g"] is None else unpack(row["g"]), many, np.full(len(h), row["kind"] == _RUN)))
    g = None if got[0][2] is None else np.concatenate([x[2] for x in got])
    ids, h, many, old = (np.concatenate([x[k] for x in got]) for k in (0, 1, 3, 4))
    order = np.lexsort((ids, h) if g is None else (ids, g, h))
    return ids[order], h[order], None if g is None else g[order], many[order], old[order]


def _merge(buckets: int, tell_least: bool, history_told: bool):
    """A task of the merge: the sorted entries of ranges of hashes, from tasks of the new batch and from runs, are
    merge-joined; documents that share a hash are told, and what no run holds yet is the new run.

    history_told: an entry of a run that no document shared so far is told too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            ids, h, g, many, old = _entries(rows)
            begin = np.flatnonzero(_group_starts(h, g))
            size = np.diff(np.r_[begin, len(h)])
            each = lambda x: np.repeat(x, size)
            any_of = lambda x: np.logical_or.reduceat(x, begin)
            was_many, held = any_of(old & many), any_of(old)
            now_many = (size > 1) | any_of(many)
            tell = each(size > 1) & ~(old & each(was_many) if history_told else old)
            if not tell_least:
                tell &= ids != each(ids[begin])
            yield from _told(ids[tell], h[tell], buckets)
            new = any_of(~old) & (~held | (now_many & ~was_many))
            at = begin[new]
            yield from _index_rows(_RUN, ids[at], h[at], None if g is None else g[at], now_many[new], buckets)
        trim()

    return run


def _compact(buckets: int):
    """Several runs as one: each hash once, with its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            ids, h, g, many, _ = _entries(rows)
            begin = np.flatnonzero(_group_starts(h, g))
            yield from _index_rows(_RUN, ids[begin], h[begin], None if g is None else g[begin], np.logical_or.reduceat(many, begin), buckets)
        trim()

    return run


#: Bytes of text for each bucket of hashes, buckets for each task, and entries that a task sorts at a time.
_BUCKET, _DEAL, _HELD = 2 << 20, 8, 1 << 18


class FingerprintIndex:
    """A log-structured index of what earlier batches held.

    Two logs of sorted immutable runs: anchors (hash, first document, whether shared) and windows (two hashes,
    first document).  A new batch is sorted and merge-joined with the runs, range by range of the hashes; what no
    run holds yet becomes one more run.  Over `most_runs` of a log are compacted to one.

    A window of `window` words is found by its anchor, the least hash of its runs of `anchor` words.  Only windows
    whose anchor lies in two documents or more can repeat; these are verified by all their words, with two 64-bit
    hashes that have nothing in common.  Of earlier texts only documents with a newly shared anchor are
    hashed again.  Batches must come in ascending order of ids.

    `size`: bytes of all texts to come, about.  The ranges follow from it, so that a task holds some MB at any
    size; the runs of one index keep the same ranges."""

    def __init__(self, spark: SparkSession, size: int = 0, window: int = 13, anchor: int = 6, most_runs: int = 3):
        self.spark, self.window, self.anchor, self.most_runs = spark, window, anchor, most_runs
        self.runs: dict[str, list[tuple[DataFrame, str]]] = {"anchors": [], "windows": []}
        self.buckets = max(partitions(spark), -(-size // _BUCKET))
        self.tasks = max(partitions(spark), -(-self.buckets // _DEAL))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.tasks, "bucket").sortWithinPartitions("bucket")

    def _round(self, log: str, rows: DataFrame, tell_least: bool, history_told: bool) -> tuple[DataFrame, str]:
        """Merge a batch's rows with the runs of a log; returns what documents are told, staged, and its path."""
        told = rows.where(F.col("kind") == _TOLD)
        entries = rows.where(F.col("kind") != _TOLD)
        for run, _ in self.runs[log]:
            entries = entries.unionByName(run)
        made, path = stage(self._dealt(entries).mapInArrow(_merge(self.buckets, tell_least, history_told), _ROWS), log)
        self.runs[log].append((made.where(F.col("kind") == _RUN), path))
        told = told.unionByName(made.where(F.col("kind") == _TOLD))
        release(self.spark)
        found, where = stage(self._dealt(told).mapInArrow(_gather, "_id long, _told binary"), "told")
        release(self.spark)
        if len(self.runs[log]) > self.most_runs:
            runs = self.runs[log][0][0]
            for run, _ in self.runs[log][1:]:
                runs = runs.unionByName(run)
            one, path = stage(self._dealt(runs).mapInArrow(_compact(self.buckets), _ROWS), log)
            for _, old in self.runs[log]:
                discard(self.spark, old)
            self.runs[log] = [(one, path)]
        return found, where

    def add(self, batch: DataFrame, history: DataFrame | None) -> DataFrame:
        """batch, history: (_id, _t), the new documents and all earlier ones.  Returns (_id, _told): for documents of
        the batch the first hashes of windows that an earlier document holds."""
        n, window, anchor = self.buckets, self.window, self.anchor

        def tasks(find, tell_least: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held, size = [], 0
                for b in batches:
                    for part in by_bytes(b, "_t"):
                        ids, h, g = find(part, _Windows(part.column("_t"), window, anchor))
                        held.append((ids, h, g))
                        size += len(h)
                        if size > _HELD:
                            yield from _combine(*_joined(held), n, tell_least)
                            held, size = [], 0
                if size:
                    yield from _combine(*_joined(held), n, tell_least)
                trim()

            return run

        def anchors(part: pa.RecordBatch, w: _Windows):
            low = w.anchors()
            row = w.row[w.where]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
            return part.column("_id").to_numpy()[row[new]], low[new], None

        def windows(part: pa.RecordBatch, w: _Windows):
            low, row = w.anchors(), w.row[w.where]
            hit = np.zeros(len(low), bool)
            first = np.searchsorted(row, np.arange(len(part) + 1))
            for i, told in enumerate(part.column("_told").to_pylist()):
                a, b = first[i], first[i + 1]
                hit[a:b] = np.isin(low[a:b], unpack_sorted(told))
            w.where = w.where[hit]
            h, g = w.hashes()
            return part.column("_id").to_numpy()[row[hit]], h, g

        made, path = stage(batch.mapInArrow(tasks(anchors, True), _ROWS), "new")
        flagged, flags = self._round("anchors", made, True, True)
        discard(self.spark, path)
        texts = batch if history is None else batch.unionByName(history)
        made, path = stage(texts.join(flagged.hint("merge"), "_id").mapInArrow(tasks(windows, False), _ROWS), "new")
        discard(self.spark, flags)
        found, where = self._round("windows", made, False, False)
        discard(self.spark, path)
        if history is None:
            return found
        new, _ = stage(found.join(batch.select("_id").distinct().hint("merge"), "_id", "left_semi"), "told")
        discard(self.spark, where)
        return new

    def close(self) -> None:
        """Delete the runs, when no batch is to come."""
        for log in self.runs.values():
            for _, path in log:
                discard(self.spark, path)
            log.clear()


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), None if held[0][2] is None else np.concatenate([x[2] for x in held])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, batches: int = 2, keep_text: bool = False, names: tuple[str, ...] = (), most_runs: int = 3) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, and kept_sha256 or, with keep_text, kept_text: the
    kept words joined by one space, or the text as it is if all are kept.  `names` are further columns
    of docs that go along, before those.

    A word goes if a window of `window` words covers it whose words also stand in a document with a smaller id,
    an integer.  docs are added to a FingerprintIndex in `batches` ranges of ids.

    Null or empty text, or fewer words than a window: nothing goes.  Rows of one id are one document's parts and never
    remove from one another.  A row with a null id is compared with nothing and keeps all its words.  An
    empty table gives no rows.  A very long text is a slice of its own, and its hashes are dealt out like those of
    many.  Columns of docs that are not named are not read, so none clashes; named ones may have any name
    but those of the result."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    size = base.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    index = FingerprintIndex(spark, size, window, most_runs=most_runs)
    bounds = base.where("_id is not null").approxQuantile("_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = [None, *sorted({int(x) for x in bounds}), None]
    results: list[DataFrame] = []
    for low, high in zip(cuts, cuts[1:]):
        new, past = F.col("_id").isNotNull(), None
        if low is not None:
            new, past = new & (F.col("_id") > low), base.where(F.col("_id") <= low)
        if high is not None:
            new = new & (F.col("_id") <= high)
        results.append(index.add(base.where(new), past))
        release(spark)
    index.close()
    told = results[0]
    for more in results[1:]:
        told = told.unionByName(more)
    anchor, last = index.anchor, "kept_text" if keep_text else "kept_sha256"
    carried = [id_col, *names]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in by_bytes(batch, "_t"):
                w = _Windows(part.column("_t"), window, anchor)
                gone = _covered(w, part.column("_told").to_pylist(), window)
                first_word = np.searchsorted(w.row, np.arange(len(part) + 1))
                text = w.data.tobytes()
                start, end, bounds = w.start.tolist(), w.end.tolist(), w.at.tolist()
                out, removed = [], []
                for i in range(len(part)):
                    a, b = int(first_word[i]), int(first_word[i + 1])
                    removed.append(int(gone[a:b].sum()))
                    if keep_text and not removed[-1]:
                        out.append(text[bounds[i] : bounds[i + 1]].decode())
                        continue
                    kept = range(a, b) if not removed[-1] else (np.flatnonzero(~gone[a:b]) + a).tolist()
                    words = b" ".join([text[start[k] : end[k]] for k in kept])
                    out.append(words.decode() if keep_text else hashlib.sha256(words).hexdigest())
                cols = [part.column(i) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(first_word), pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], [*carried, "n_words", "n_removed", last])
        trim()

    # numbers for names on the way, so that no column of docs clashes with another
    own = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)], F.col(text_col).alias("_t"), F.col(id_col).cast("long").alias("_id"))
    joined = own.join(told.hint("merge"), "_id", "left").select(*[f"_c{i}" for i in range(len(carried))], "_t", "_told")
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in carried) + f", n_words long, n_removed long, {last} string"
    return joined.mapInArrow(run, schema)


def _covered(w: _Windows, told: list[bytes | None], window: int) -> np.ndarray:
    """Which words lie in a window that its document is told of."""
    covered = np.zeros(len(w.words) + 1, np.int64)
    if any(told):
        first = np.searchsorted(w.row[w.where], np.arange(len(told) + 1))
        h = w.hashes()[0]
        for i, blob in enumerate(told):
            if blob:
                a, b = first[i], first[i + 1]
                hit = w.where[a:b][np.isin(h[a:b], unpack_sorted(blob))]
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + window, -1)
    return np.cumsum(covered[:-1]) > 0
