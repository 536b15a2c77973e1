"""Vector best-fit packing of token sequences."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, stage, trim, worker_cache

#: Words and parts whose ids a worker remembers; beyond it forgets all and begins anew.
_REMEMBERED = 600_000
#: Texts in the letters of western Europe, printable ASCII and its white space: there the normaliser only
#: lower-cases, and this is what the pre-tokenizer of word_bpe_49k.json finds.
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: itself if printable, else the next from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


class WordTokens:
    """Ids of whole texts by a `tokenizers` file with a pre-tokenizer that drops white space.

    Words, and the parts that the pre-tokenizer finds in them, are remembered with their ids.  A text with
    letters of other scripts, or with the string of an added token, is encoded as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.added = [x.content for x in t.get_added_tokens_decoder().values()]
        self.model, self.letters = t.model.tokenize, _byte_letters()
        # the short way holds for the pre-tokenizer that it was written for
        self.short = "'ll|'d|[\\p{L}]+|[\\p{N}]|" in repr(t.pre_tokenizer)

    def _part(self, part: str) -> bytes:
        ids = array("I", [x.id for x in self.model(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self.known[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        known = self.known
        ids = known[word] = b"".join([known[p] if p in known else self._part(p) for p in _PARTS.findall(word)])
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known, get, word, out = self.known, self.known.get, self._word, []
        for t in texts:
            if len(known) > _REMEMBERED:
                known.clear()
            if not self.short or _OTHER.search(t) or any(a in t for a in self.added):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join([get(w) or word(w) for w in t.lower().split()]))
        return out


def _tokens(path: str) -> WordTokens:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    held = worker_cache("word_tokens")
    if path not in held:
        held[path] = WordTokens(path)
    return held[path]


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, most: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: Callable[[], str] = word_bpe_path) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and end_id, cut if longer than `most`."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens(path())
        for batch in batches:
            for part in by_bytes(batch, "t", 1 << 20):
                out: list[tuple[int | None, int, int, int, int]] = []
                texts = part.column("t").to_pylist()
                for id_, ids in zip(part.column("id").to_pylist(), encoder.ids([t or "" for t in texts])):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * most)):
                        own = ids[a : a + 4 * most]
                        out.append((id_, k, a // 4, len(own) // 4, zlib.crc32(own)))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["id", "piece", "start", "length", "ids_crc32"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Open bins with the same residual vector, as ranges of bin numbers."""

    def __init__(self, capacity: np.ndarray, weights: np.ndarray, rule: str):
        self.capacity, self.weights, self.rule = capacity, weights, rule
        self.residual = np.zeros((1024, len(capacity)))
        self.ranges: list[list[list[int]]] = []  # by place in residual; all of them hold bins
        self.at: dict[tuple, int] = {}
        self.opened = 0

    def put(self, residual: np.ndarray, first: int, n: int) -> None:
        key = tuple(residual.tolist())
        if key not in self.at:
            k = self.at[key] = len(self.ranges)
            self.ranges.append([])
            if k == len(self.residual):
                self.residual = np.concatenate([self.residual, np.zeros_like(self.residual)])
            self.residual[k] = residual
        self.ranges[self.at[key]].append([first, n])

    def take(self, k: int, most: int) -> tuple[np.ndarray, int, int]:
        """Up to `most` bins of class k; a class that is left empty gives its place to the last one."""
        residual, (first, n) = self.residual[k].copy(), self.ranges[k].pop()
        if n > most:
            self.ranges[k].append([first + most, n - most])
        elif not self.ranges[k]:
            del self.at[tuple(residual.tolist())]
            last = len(self.ranges) - 1
            if k < last:
                self.residual[k], self.ranges[k] = self.residual[last], self.ranges[last]
                self.at[tuple(self.residual[k].tolist())] = k
            self.ranges.pop()
        return residual, first, min(n, most)

    def best(self, item: np.ndarray) -> int | None:
        """The class that fits the item best, under every constraint; ties: the fullest in tokens."""
        residual = self.residual[: len(self.ranges)]
        fits = np.flatnonzero((residual >= item).all(axis=1))
        if not len(fits):
            return None
        free = residual[fits] / self.capacity
        if self.rule == "dot":  # the bin whose free room points most along the item
            score = -(free * (item / self.capacity) * self.weights).sum(axis=1) / np.linalg.norm(free, axis=1)
        else:  # the least room left over
            score = ((free - item / self.capacity) ** 2 * self.weights).sum(axis=1)
        return int(fits[np.lexsort((residual[fits, 0], score))[0]])

    def place(self, item: np.ndarray, count: int) -> Iterator[tuple[int, int, int]]:
        """(first bin, number of bins, offset): one item to each of so many bins, till all are placed."""
        while count:
            k = self.best(item)
            if k is None:  # open bins that this item alone fills, or one for the rest
                n = max(1, count // int((self.capacity // item).min()))
                self.put(self.capacity, self.opened, n)
                self.opened += n
                continue
            residual, first, n = self.take(k, count)
            yield first, n, int(self.capacity[0] - residual[0])
            self.put(residual - item, first, n)
            count -= n


#: What free room counts: tokens first; among bins with as many tokens free, documents and attention decide.
WEIGHTS = (1.0, 0.001, 0.001)


def plan(histogram: dict[int, int], tokens: int, documents: int, attention: int, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> list[tuple[int, int, int, int, int]]:
    """Vector best-fit decreasing over the histogram of lengths: (length, first rank, first bin, count, offset).

    An item is (length, 1, length squared); bins have `tokens`, `documents` and `attention` of these.
    Equal items go to bins of equal residuals a range at a time, so the work and the plan depend on
    the number of different lengths, not on the number of items."""
    capacity = np.array([tokens, documents, attention], float)
    # a constraint that tokens imply and that has no weight tells no bins apart
    bind = [True, documents < tokens or weights[1] > 0, attention < tokens * tokens or weights[2] > 0]
    bins, out = _Bins(capacity[bind], np.array(weights)[bind], rule), []
    for length in sorted(histogram, reverse=True):
        rank = 0
        for first, n, offset in bins.place(np.array([length, 1, float(length) ** 2])[bind], histogram[length]):
            out.append((length, rank, first, n, offset))
            rank += n
    return out


def pack_documents(docs: DataFrame, tokens: int = 4096, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, salts: int = 256, **how) -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Sequences have room for `tokens`, and if given for so many `documents` (pieces) and so much
    `attention` (sum of squared lengths).  Only the histogram of lengths, at most `tokens` numbers for
    each of `salts` parts, reaches the driver; the plan, which it bounds, goes back.  Ranks among
    pieces of one length are counted within the parts, so a common length is not one task's work.

    Null or empty text: the one end id.  Rows of one id are packed each; null ids as well.  Pieces of one length are
    alike to the plan, so ties go by (id, piece).  A very long text is cut into pieces; an empty table gives no rows.
    Ids are integers; other columns are not read, so their names do not matter."""
    documents, attention = documents or tokens, attention or tokens * tokens
    if attention < tokens * tokens:
        raise ValueError("a piece of full length must fit: attention >= tokens * tokens")
    made, _ = stage(pieces(docs, tokens, **how).withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    counts = {(r["length"], r["salt"]): r["count"] for r in made.groupBy("length", "salt").count().collect()}
    before: dict[tuple[int, int], int] = {}
    histogram: dict[int, int] = {}
    for length, salt in sorted(counts):
        before[length, salt] = histogram.get(length, 0)
        histogram[length] = before[length, salt] + counts[length, salt]
    rows = plan(histogram, tokens, documents, attention, rule, weights)
    keys = sorted(before)
    by_key = np.array([a * salts + b for a, b in keys], np.int64)
    base = np.array([before[k] for k in keys], np.int64)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    span = int(table[:, 1].max(initial=0) + table[:, 3].max(initial=0) + 1)
    shared = made.sparkSession.sparkContext.broadcast((by_key, base, table))
    del counts, before, rows, keys
    trim()  # the driver goes on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_, base_, t = shared.value
        at = t[:, 0] * span + t[:, 1]
        for b in batches:
            length, salt = b.column("length").to_numpy(), b.column("salt").to_numpy()
            rank = base_[np.searchsorted(keys_, length * salts + salt)] + b.column("rn").to_numpy() - 1
            row = np.searchsorted(at, length * span + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")] + [pa.array(t[row, 2] + rank - t[row, 1]), pa.array(t[row, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = made.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")).cast("long"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
