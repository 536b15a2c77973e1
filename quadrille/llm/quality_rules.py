"""Quality rules: plain counts, and a likelihood ratio between trusted text and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat, mix, partitions, span_hashes, stage, trim, word_spans

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: Buckets of the histogram of scores, and the range that it covers.
_STEPS, _LOW, _HIGH = 4096, -8.0, 8.0


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    breaks = np.ones(256, bool)
    breaks[:] = False
    breaks[10] = True
    return word_spans(data, at, breaks)


def _repeats(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the same (row, key) stands earlier, and whether it stands anywhere else."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    size = np.diff(np.r_[np.flatnonzero(new), len(r)])
    later, many = np.zeros(len(r), bool), np.zeros(len(r), bool)
    later[order], many[order] = ~new, np.repeat(size > 1, size)
    return later, many


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, at = flat(column)
    n = len(column)
    start, end, row = word_spans(data, at)
    letters = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points: bytes that do not go on another
    symbols = np.r_[0, np.cumsum(_SYMBOLS[data])]
    words = span_hashes(data, start, end)
    count = lambda which, **k: np.bincount(which, minlength=n, **k).astype(np.int64)
    # lines with a word, equal to an earlier line
    ls, le, lrow = _lines(data, at)
    has_word = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le, lrow = ls[has_word], le[has_word], lrow[has_word]
    again, _ = _repeats(lrow, span_hashes(data, ls, le))
    # words in windows of three that stand twice or more in the text
    m = max(0, len(words) - 2)
    where = np.flatnonzero(row[:m] == row[2:]) if m else np.zeros(0, int)
    three = mix(words[where] + mix(words[where + 1] + mix(words[where + 2]))) if len(where) else words[:0]
    _, many = _repeats(row[where], three)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, where[many], 1)
    np.add.at(covered, where[many] + 3, -1)
    return {
        "n_words": count(row),
        "word_chars": count(row, weights=letters[end] - letters[start]),
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": count(lrow[again]),
        "n_repeat_words": count(row[np.cumsum(covered[:-1]) > 0]),
    }


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _grams(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word, A to Z in lower case, and of each pair of neighbouring words of a text."""
    data, at = flat(column)
    start, end, row = word_spans(data, at)
    if not len(start):
        return row, np.zeros(0, np.int64)
    word = span_hashes(_LOWER[data], start, end)
    same = row[1:] == row[:-1]
    pair = mix(word[:-1] * np.uint64(3) + mix(word[1:]))[same]
    shift = np.uint64(64 - bits)
    return np.r_[row, row[:-1][same]], np.r_[word >> shift, pair >> shift].astype(np.int64)


#: The n-grams of all texts, and of trusted ones in either fold; buckets in a row that is shuffled.
_RAW, _GOOD, _BLOCK = 0, (1, 2), 1024


def _fold(text: pa.Array) -> np.ndarray:
    """0 or 1 for each row, by a hash of its text: copies are in one fold, so none is told from itself."""
    data, at = flat(text)
    return (span_hashes(data, at[:-1], at[1:]) >> np.uint64(63)).astype(np.int64) if len(data) else np.zeros(len(text), np.int64)


def ngram_counts(marked: DataFrame, bits: int) -> np.ndarray:
    """marked: (t, quality).  How often each bucket of hashed n-grams occurs in all texts, and in those of quality 1 in
    either fold: three rows of 2**bits numbers, which reach the driver as blocks."""
    block = min(1 << bits, _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 << bits), np.int64)
        for batch in batches:
            for part in by_bytes(batch, "t"):
                row, bucket = _grams(part.column("t"), bits)
                good = part.column("quality").fill_null(0).to_numpy(zero_copy_only=False)[row] == 1
                kind = 1 + _fold(part.column("t"))[row[good]]
                total[_RAW] += np.bincount(bucket, minlength=1 << bits)
                total += np.bincount((kind << bits) | bucket[good], minlength=3 << bits).reshape(total.shape)
        yield from _blocks(total.reshape(-1, block))
        trim()

    def _blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([total[i].astype("<i8").tobytes() for i in some], pa.binary())], ["block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(((3 << bits) // block, block), np.int64)
        for batch in batches:
            for i, n in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist()):
                total[i] += np.frombuffer(n, "<i8")
        yield from _blocks(total)

    form = "block int, n binary"
    made = marked.mapInArrow(run, form).repartition(partitions(marked.sparkSession), "block").mapInArrow(add, form)
    out = np.zeros((3, 1 << bits), np.int64)
    for r in made.toLocalIterator():
        out.reshape(-1, block)[r["block"]] += np.frombuffer(r["n"], "<i8")
    return out


def log_ratios(counts: np.ndarray, smooth: float) -> np.ndarray:
    """For each fold log(p_trusted / p_raw) of each bucket, with the trusted texts of the other fold; p_trusted is
    mixed with `smooth` parts of p_raw, so a bucket that trusted texts lack has a finite ratio."""
    raw = (counts[_RAW] + 0.5) / (counts[_RAW].sum() + 0.5 * counts.shape[1])
    out = np.zeros((2, counts.shape[1]))
    for fold in (0, 1):
        good = counts[_GOOD[1 - fold]] if counts[_GOOD[1 - fold]].any() else counts[_GOOD[fold]]
        if good.any():
            out[fold] = np.log((good / good.sum() + smooth * raw) / (1 + smooth)) - np.log(raw)
    return np.clip(out, _LOW, _HIGH)


def _score(column: pa.Array, ratio: np.ndarray, bits: int) -> np.ndarray:
    row, bucket = _grams(column, bits)
    n = np.bincount(row, minlength=len(column))
    return np.bincount(row, weights=ratio[_fold(column)[row], bucket], minlength=len(column)) / np.maximum(n, 1)


def threshold(hist: np.ndarray, most_lost: float) -> float:
    """hist: labelled rows by step of score, of quality 0 and of quality 1.  The cut under which most of the first
    and at most `most_lost` of the second lie; of equally good ones that in the middle.  Without either: none."""
    if not hist.sum(axis=1).all():
        return _LOW
    bad, lost = (np.cumsum(h) / h.sum() for h in hist)
    gain = np.where(lost <= most_lost, bad - lost, -1.0)
    if gain.max() <= 0:
        return _LOW
    best = np.flatnonzero(gain == gain.max())
    return _LOW + (int(best[len(best) // 2]) + 1) * (_HIGH - _LOW) / _STEPS


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 16, most_lost: float = 0.002, smooth: float = 0.1) -> DataFrame:
    """One row for each row of docs: the counts, base_failed, the score, and kept.

    score: the mean over a text's hashed n-grams (words and pairs of words) of log(p_trusted / p_raw).  The raw corpus
    is all docs, trusted are those labelled quality 1.  Texts are in two folds by their hash; a text is scored
    with the trusted texts of the other fold, so one that is trusted has no better score for being so.  Counts
    cover every document, and so does the histogram of scores of all labelled ones, from which the threshold follows.

    The labels are joined by a sorted merge at any size: they grow with the documents, so neither is broadcast.
    Each text is read twice, once with its label and once for its score.

    Null or empty text: no words, so base_failed.  A very long text is a slice of its own.  Without trusted labels nothing
    but the base rules rejects.  Repeated ids in labels count once, the lowest quality; repeated rows are judged
    each, alike; a null id has no label.  A score equal to the threshold is kept.  An empty table gives no rows;
    other columns are not read, so their names do not matter."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    marked = texts.join(marks.hint("merge"), "id", "left").select("t", "quality")
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(ngram_counts(marked, bits), smooth))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "t"):
                c = base_counts(part.column("t"))
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c[k].astype(np.int64)) for k in names], pa.array(_score(part.column("t"), shared.value, bits))], ["id", *names, "score"])
        trim()

    kind = dict(texts.dtypes)["id"]
    scored, _ = stage(texts.mapInArrow(run, f"id {kind}, " + ", ".join(f"{k} long" for k in names) + ", score double"), "scores")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    step = F.greatest(F.lit(0), F.least(F.lit(_STEPS - 1), F.floor((F.col("score") - _LOW) / (_HIGH - _LOW) * _STEPS))).cast("int")
    told = scored.where(~failed).join(marks.hint("merge"), "id").groupBy(step.alias("step"), "quality").count().collect()  # two rows a step at most
    hist = np.zeros((2, _STEPS))
    for r in told:
        hist[int(r["quality"] == 1), r["step"]] += r["count"]
    cut = F.lit(threshold(hist, most_lost))
    return scored.select(F.col("id").alias("doc_id"), *names, failed.alias("base_failed"), (~failed & (F.col("score") >= cut)).alias("kept"), "score", cut.alias("threshold"))
