"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, flat, release, span_hashes, stage, trim, word_spans

#: Buckets of hashed words; features of a page that come from its layout; buckets of source and language.
BITS, LAYOUT, NAMED = 18, 10, 64
#: Scores are cut off at +- _MOST; steps of their histogram.
_MOST, _STEPS = 40.0, 16384
_LETTER = np.ones(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def text_view(column: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): the distinct hashed words of each text, lower-cased and without marks; of the `used` buckets only."""
    data, at = flat(column)
    data = _FOLD[data]
    start, end, row = word_spans(data, at, _LETTER)
    bucket = (span_hashes(data, start, end) >> np.uint64(64 - BITS)).astype(np.int64)
    if used is not None:
        some = used[bucket]
        row, bucket = row[some], bucket[some]
    both = np.unique((row.astype(np.int64) << BITS) | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


def metadata_view(batch: pa.RecordBatch) -> np.ndarray:
    """What a crawl knows of a page without reading its words: source, language, size, layout."""
    data, at = flat(batch.column("t"))
    n = len(batch)
    size = np.diff(at).astype(float)
    start, end, row = word_spans(data, at)
    words = np.bincount(row, minlength=n).astype(float)
    per = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][at])
    lines = per(data == 10) + 1.0
    some = np.maximum(size, 1)
    high, low = per((data >= 65) & (data <= 90)), per((data >= 97) & (data <= 122))
    marks = per((data > 32) & (data < 127) & _LETTER[data])
    out = np.zeros((n, LAYOUT + 2 * NAMED), np.float64)
    first = np.ones(len(row), bool)
    same = row[1:] == row[:-1]
    h = span_hashes(data, start, end)
    first[1:] = ~(same & (h[1:] == h[:-1]))
    again = np.bincount(row[~first], minlength=n)
    out[:, :LAYOUT] = np.column_stack(
        [np.log1p(size) / 10, np.log1p(words / lines) / 5, np.log1p(lines) / 5, 4 * high / some, low / some, 4 * marks / some, 4 * per(_SYMBOL[data]) / some, 10 * per((data >= 48) & (data < 58)) / some, size / np.maximum(words, 1) / 20, 2 * again / np.maximum(words, 1)]
    )
    for k, name in enumerate(("source", "lang")):
        names = pc.fill_null(batch.column(name).cast(pa.string()), "\x00")
        d, a = flat(names)
        h = span_hashes(d, a[:-1], a[1:]) if len(d) else np.zeros(n, np.uint64)
        out[np.arange(n), LAYOUT + k * NAMED + (h % np.uint64(NAMED)).astype(int)] = 0.3
    return out


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}=_~^\\")] = True


class _Logistic:
    """Logistic regression with a sparsity penalty, by accelerated proximal steps.  X: dense, or (row, column)
    pairs of ones among `width` columns."""

    def __init__(self, width: int, penalty: float, rounds: int = 120):
        self.w, self.b, self.penalty, self.rounds = np.zeros(width), 0.0, penalty, rounds

    @staticmethod
    def _times(x, w: np.ndarray) -> np.ndarray:
        return x @ w if isinstance(x, np.ndarray) else np.bincount(x[0], weights=w[x[1]], minlength=x[2]).astype(float)

    def raw(self, x) -> np.ndarray:
        return self._times(x, self.w) + self.b

    def fit(self, x, y: np.ndarray, count: np.ndarray | None = None) -> _Logistic:
        """count: what each row counts; good and bad rows together count the same."""
        count = np.ones(len(y)) if count is None else count
        weight = count * np.where(y, 0.5 / max((count * y).sum(), 1e-9), 0.5 / max((count * ~y).sum(), 1e-9))
        # a bound on the curvature, from the largest row sum and column sum
        if isinstance(x, np.ndarray):
            step = 4 / max(1e-9, (weight[:, None] * x * x).sum(axis=1).sum() + 1)
        else:
            v = np.random.default_rng(0).random(len(self.w))
            for _ in range(8):  # power iteration on X'WX
                v = np.bincount(x[1], weights=(weight * self._times(x, v))[x[0]], minlength=len(self.w)).astype(float)  # of no pairs: whole numbers
                norm = np.linalg.norm(v)
                v /= max(norm, 1e-12)
            step = 3 / (norm + 1)
        at, at_b, t, w, b = self.w.copy(), self.b, 1.0, self.w, self.b
        for _ in range(self.rounds):
            g = weight * (1 / (1 + np.exp(-np.clip(self._times(x, at) + at_b, -40, 40))) - y)
            down = x.T @ g if isinstance(x, np.ndarray) else np.bincount(x[1], weights=g[x[0]], minlength=len(w)).astype(float)
            new = at - step * down
            new = np.sign(new) * np.maximum(np.abs(new) - step * self.penalty, 0)
            new_b = at_b - step * g.sum()
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            at, at_b, t = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b), t2
            w, b = new, new_b
        self.w, self.b = w, b
        return self


def _pick(x, rows: np.ndarray):
    if isinstance(x, np.ndarray):
        return x[rows]
    place = np.full(x[2], -1)
    place[rows] = np.arange(len(rows))
    keep = place[x[0]] >= 0
    return place[x[0][keep]], x[1][keep], len(rows)


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    m = _Logistic(1, 0.0, 300).fit(np.clip(raw, -30, 30)[:, None] / 5, y)
    return m.w[0] / 5, m.b


def told_apart(x: tuple, y: np.ndarray, least: float) -> np.ndarray:
    """Which words stand in good and bad rows at different rates: a likelihood-ratio statistic of at least `least`."""
    n, width = len(y), 1 << BITS
    good, both = np.bincount(x[1], weights=y[x[0]], minlength=width), np.bincount(x[1], minlength=width).astype(float)
    term = lambda k, of, rate: k * np.log(np.maximum(k / max(of, 1), 1e-12) / rate)
    rate = np.clip(both / max(n, 1), 1e-12, 1 - 1e-12)
    total = 0.0
    for k, of in ((good, y.sum()), (both - good, n - y.sum())):
        total = total + term(k, of, rate) + term(of - k, of, 1 - rate)
    return 2 * total >= least


class _Head:
    """The classifiers of one target, of words and of metadata, and how their scores are added."""

    def __init__(self, name: str, seen: list[tuple], hold: tuple, truth: np.ndarray, penalties: tuple[float, float], least: float):
        """seen: rows, labels and what these count, of either view; hold, truth: both views of rows that calibrate, and their labels."""
        (words, y, count), (meta, z, count_z) = seen
        self.name, self.used = name, told_apart(words, y, least)
        some = self.used[words[1]]
        self.models = [_Logistic(1 << BITS, penalties[0]).fit((words[0][some], words[1][some], words[2]), y, count), _Logistic(meta.shape[1], penalties[1]).fit(meta, z, count_z)]
        held = hold[0][1]
        some = self.used[held]
        raw = [self.models[0].raw((hold[0][0][some], held[some], hold[0][2])), self.models[1].raw(hold[1])]
        fitted = [_platt(r, truth) for r in raw]
        # a view whose score does not rise with the truth has no say
        self.scale = [(a, b) if a > 0 else (0.0, 0.0) for a, b in fitted]

    def packed(self) -> tuple:
        at = np.flatnonzero(self.models[0].w)
        return self.name, (at, self.models[0].w[at], self.models[0].b), (self.models[1].w, self.models[1].b), self.scale


def _scores(part: pa.RecordBatch, heads: list[tuple]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each target the calibrated scores of the word view and of the metadata view, and their sum."""
    n, weights = len(part), np.zeros((len(heads), 1 << BITS))
    for k, (_, (at, w, _), _, _) in enumerate(heads):
        weights[k, at] = w
    row, bucket = text_view(part.column("t"), weights.any(axis=0))
    meta, out = metadata_view(part), {}
    for k, (name, (_, _, b), (v, c), ((a0, b0), (a1, b1))) in enumerate(heads):
        words, page = a0 * (np.bincount(row, weights=weights[k][bucket], minlength=n) + b) + b0, a1 * (meta @ v + c) + b1
        out[name] = words, page, np.clip(words + page, -_MOST, _MOST)
    return out


def threshold(hist: np.ndarray, most_lost: float, price: float) -> int:
    """hist: bad and good rows by step of score.  The first step that is kept: under it lie as large a share of bad rows
    less `price` times that of good ones as can be, and at most `most_lost` of the good ones; of equally good
    steps that in the middle.  Without either: 0."""
    if not hist.sum(axis=1).all():
        return 0
    bad, good = (np.r_[0, np.cumsum(h)] / h.sum() for h in hist)
    gain = np.where(good <= most_lost, bad - price * good, -1.0)
    best = np.flatnonzero(gain == gain.max())
    return int(best[len(best) // 2]) if gain.max() > 0 else 0


#: Targets, and the label that is good.
_TARGETS = (("quality", 1), ("toxic", 0))


def classify(
    docs: DataFrame, labels: DataFrame, labelled: int = 9000, exchanged: int = 400, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, most_lost: float = 0.01, price: float = 10.0,
    penalties: tuple[float, float] = (2e-4, 1e-5), least: float = 12.0, share: float = 0.2,
) -> DataFrame:
    """One row for each row of docs: (doc_id, p_quality, p_clean, kept).

    Two targets, quality and the absence of toxicity, each co-trained on two views of a page: its words, and
    its metadata (source and language, and what size and layout a crawl records).  Fitted on two thirds of at most
    `labelled` labelled documents, those of the least id hashes; the other third calibrates.  In each of `rounds` every
    view scores all documents that are not among these, and gives the `exchanged` different texts of which it is
    surest, by a calibrated chance of 95 % at least, good and bad in the proportion of the labels, as labels to the
    other view; each counts `share` of a label.  At last every document
    is scored by the sum of both calibrated views.  The thresholds come from a histogram of the scores of all
    labelled documents that were not fitted: under them lie most bad ones, a good one counting `price` times as much, and
    at most `most_lost` of the good ones.

    Null text: no words.  Null source or lang: a name of its own.  Without labels of both kinds a target rejects nothing.
    Repeated labels of an id count once, the worst; a label of one target alone counts for that one.  Repeated
    rows are scored each, alike; equal scores are kept alike.  An empty table gives no rows.  A very long text is a
    slice of its own.  Ids are integers, or null.  Columns that docs do not have (source, lang) count as null;
    others are not read, so their names do not matter."""
    spark = docs.sparkSession
    have = set(docs.columns)
    page = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), *[F.col(c).cast("string") if c in have else F.lit(None).cast("string").alias(c) for c in ("source", "lang")])
    marks = (
        labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    )
    ids = page.select("id").where("id is not null").distinct()
    # at most `labelled` rows of three numbers, of which those of `fitted` are kept out of the thresholds
    known = ids.join(marks.hint("merge"), "id").orderBy(F.xxhash64("id"), "id").limit(labelled).withColumn("held", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0).collect()
    seed, held = ({r["id"]: r for r in sorted(known, key=lambda r: r["id"]) if r["held"] == part} for part in (False, True))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "t"):
                row, bucket = text_view(part.column("t"))
                words = [x.astype("<u4").tobytes() for x in np.split(bucket, np.searchsorted(row, np.arange(1, len(part))))]
                meta = [x.astype("<f4").tobytes() for x in metadata_view(part)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words, pa.binary()), pa.array(meta, pa.binary())], ["id", "words", "meta"])
        trim()

    def views(of: list[int]) -> tuple[list[int], tuple, np.ndarray]:
        """Ids, and both views, of documents of so many given ids."""
        if not of:
            return [], (np.zeros(0, int), np.zeros(0, int), 0), np.zeros((0, LAYOUT + 2 * NAMED))
        wanted = spark.createDataFrame(pa.table({"id": pa.array(of, pa.int64())}))
        got = page.join(F.broadcast(wanted), "id").mapInArrow(features, "id long, words binary, meta binary").toArrow().sort_by("id")
        # repeated rows of an id count once
        first = np.r_[True, np.diff(got.column("id").to_numpy()) != 0] if len(got) else np.zeros(0, bool)
        got = got.filter(pa.array(first))
        words, n = got.column("words").to_pylist(), len(got)
        pairs = np.repeat(np.arange(n), [len(w) // 4 for w in words]), np.frombuffer(b"".join(words), "<u4").astype(np.int64), n
        return got.column("id").to_pylist(), pairs, np.frombuffer(b"".join(got.column("meta").to_pylist()), "<f4").reshape(n, LAYOUT + 2 * NAMED).astype(float)

    base, rest = views(list(seed)), views(list(held))
    given: dict[tuple[str, int], dict[int, bool]] = {(name, k): {} for name, _ in _TARGETS for k in (0, 1)}
    more: tuple = ([], (np.zeros(0, int), np.zeros(0, int), 0), np.zeros((0, LAYOUT + 2 * NAMED)))

    def fit() -> list[_Head]:
        heads = []
        for name, good in _TARGETS:
            own = np.array([seed[i][name] is not None for i in base[0]], bool)
            y = np.array([seed[i][name] == good for i in base[0]], bool)
            keep = np.array([held[i][name] is not None for i in rest[0]], bool)
            truth = np.array([held[i][name] == good for i in rest[0]], bool)[keep]
            if len(np.unique(y[own])) < 2 or len(np.unique(truth)) < 2:
                continue
            seen = []
            for k in (0, 1):  # what a view is fitted on: the labels, and what the other view gave
                also = given[name, k]
                extra = np.array([i in also for i in more[0]], bool)
                x = [_pick(base[1 + k], np.flatnonzero(own)), _pick(more[1 + k], np.flatnonzero(extra))]
                joint = np.concatenate(x) if k else (np.r_[x[0][0], x[1][0] + x[0][2]], np.r_[x[0][1], x[1][1]], x[0][2] + x[1][2])
                seen.append((joint, np.r_[y[own], np.array([also[i] for i, e in zip(more[0], extra) if e], bool)], np.r_[np.ones(own.sum()), np.full(extra.sum(), share)]))
            heads.append(_Head(name, seen, tuple(_pick(rest[1 + k], np.flatnonzero(keep)) for k in (0, 1)), truth, penalties, least))
        return heads

    heads = fit()
    for _ in range(rounds if heads else 0):
        surest = _surest(page, heads, np.array(sorted([*seed, *held]), np.int64), exchanged, {name: np.mean([r[name] == good for r in seed.values() if r[name] is not None]) for name, good in _TARGETS if name in [h.name for h in heads]})
        for name, k, i, good in surest:
            given[name, 1 - k].setdefault(i, good)
        more = views(sorted({i for x in given.values() for i in x}))
        heads = fit()
        trim()
        release(spark)

    shared = spark.sparkContext.broadcast([h.packed() for h in heads])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "t"):
                got = _scores(part, shared.value)
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(got[name][2] if name in got else np.full(len(part), np.nan), from_pandas=True) for name, _ in _TARGETS]], ["id", "quality", "toxic"])
        trim()

    scored, _ = stage(page.mapInArrow(score, "id long, quality double, toxic double"), "scored")
    step = lambda c: F.floor((F.col(c) + _MOST) / (2 * _MOST) * (_STEPS - 1)).cast("int")
    fitted = spark.createDataFrame(pa.table({"id": pa.array(list(seed), pa.int64())}))
    told = scored.join(marks.select("id", F.col("quality").alias("q"), F.col("toxic").alias("x")).hint("merge"), "id").join(F.broadcast(fitted), "id", "left_anti")
    kept = F.lit(True)
    for (name, good), label in zip(_TARGETS, ("q", "x")):
        if name in [h.name for h in heads]:
            hist = np.zeros((2, _STEPS))
            for r in told.where(F.col(label).isNotNull()).groupBy(step(name).alias("step"), (F.col(label) == good).cast("int").alias("good")).count().collect():  # two rows a step at most
                hist[r["good"], r["step"]] = r["count"]
            kept = kept & (step(name) >= threshold(hist, most_lost, price))
    del base, rest, more, heads
    trim()  # the driver goes on
    chance = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return scored.select(F.col("id").alias("doc_id"), chance("quality").alias("p_quality"), chance("toxic").alias("p_clean"), kept.alias("kept"))


def _surest(page: DataFrame, heads: list[_Head], without: np.ndarray, most: int, rates: dict[str, float]) -> list[tuple[str, int, int, bool]]:
    """(target, view, id, good): of all documents but the labelled sample the different texts of which a view is surest, at
    most `most` for each target and view.  A task returns its own surest, so the driver sees a bounded number."""
    shared = page.sparkSession.sparkContext.broadcast([h.packed() for h in heads])
    lists = [(h.name, k, good, max(1, int(most * (rates[h.name] if good else 1 - rates[h.name])))) for h in heads for k in (0, 1) for good in (True, False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, _SURE) for _ in lists]
        for batch in batches:
            for part in by_bytes(batch, "t"):
                got = _scores(part, shared.value)
                data, at = flat(part.column("t"))
                text = span_hashes(data, at[:-1], at[1:]).view(np.int64) if len(data) else np.zeros(len(part), np.int64)
                ids = part.column("id").fill_null(-1).to_numpy()
                open_ = part.column("id").is_valid().to_numpy(zero_copy_only=False) & ~np.isin(ids, without)
                for n, (name, k, good, many) in enumerate(lists):
                    sure = got[name][k] if good else -got[name][k]
                    rows = np.flatnonzero(open_ & (sure > _SURE_FROM))
                    both = np.r_[best[n], np.rec.fromarrays([sure[rows], text[rows], ids[rows]], dtype=_SURE)]
                    both = both[np.lexsort((both["id"], both["text"], -both["sure"]))]
                    _, one = np.unique(both["text"], return_index=True)  # copies count once
                    best[n] = both[np.sort(one)][:many]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(lists)), [len(b) for b in best]).astype(np.int32))] + [pa.array(np.concatenate([b[c] for b in best])) for c in _SURE.names], ["list", *_SURE.names]
        )
        trim()

    made, _ = stage(page.mapInArrow(run, "list int, sure double, text long, id long"), "surest")
    different = made.groupBy("list", "text").agg(F.max("sure").alias("sure"), F.min("id").alias("id"))
    out = []
    for n, (name, k, good, many) in enumerate(lists):
        out += [(name, k, r["id"], good) for r in different.where(F.col("list") == n).orderBy(F.desc("sure"), "id").limit(many).collect()]
    return out


#: A view is sure from a calibrated chance of 95 % on.
_SURE_FROM = float(np.log(19))
_SURE = np.dtype([("sure", "f8"), ("text", "i8"), ("id", "i8")])
