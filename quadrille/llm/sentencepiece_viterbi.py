"""SentencePiece encoding by a Viterbi search that an Aho-Corasick automaton drives, and decoding."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, worker_cache

SPACE = "▁"
#: What a literal SPACE becomes while a text is encoded: half of a surrogate pair, which no text holds; it goes by bytes.
_LITERAL = "\ud800"
#: Chunks and pairs of pieces that a worker remembers, and the characters of the longest such chunk.
_REMEMBERED, _LONG = 300_000, 64


class Pieces:
    """The vocabulary of a model file, and its division of texts: the ids of the model's own library.

    A text is a SPACE, then itself with SPACE for each blank.  The model merges neighbours, those of the best
    score first.  So a piece can follow another only if the two, written as one, are merged to just these two;
    of all divisions in which each neighbours do so, there is one.  The search relaxes a position from
    the pieces that end there (the output links of the automaton): each scores 0 if it may follow the last
    piece of the best division before it, else minus infinity.  A character that no piece holds goes as the
    pieces of its UTF-8 bytes."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []
        self.score: dict[str, float] = {}
        self.fits: dict[tuple[str, int], bool] = {}
        alphabet, crossing = set(), False
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.text.append(b"")
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.automaton.add_word(piece, (i, len(piece)))
                self.text[i] = piece.replace(SPACE, " ").encode()
                self.score[piece] = model.get_score(i)
                alphabet.update(piece)
                crossing |= re.search(f"[^{SPACE}]{SPACE}", piece) is not None
        self.automaton.make_automaton()
        # where no piece can go on, the search is cut: before a run of SPACE, and around a line's end
        lone = "" if "\n" in alphabet else "\n"
        self.chunks = None if crossing else re.compile(f"{lone or '(?!)'}|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best score first, of equal ones the left one."""
        parts, score = list(text), self.score
        while True:
            made = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
            if not made:
                return parts
            i = min(made)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _fit(self, both: str, long: int) -> bool:
        """Whether the last `long` characters are a piece that may follow the others (or begin a text)."""
        if len(self.fits) > _REMEMBERED:
            self.fits.clear()
        first = both[: len(both) - long]
        ok = self.fits[both, long] = self.merged(both) == ([first] if first else []) + [both[len(first) :]]
        return ok

    def search(self, chunk: str) -> list[int]:
        """The ids of the division of a chunk, in one pass."""
        n, fits = len(chunk), self.fits
        piece_at, long_at = [-1] * (n + 1), [0] * (n + 1)  # the last piece of the division up to a place
        for end, (piece, long) in self.automaton.iter(chunk):
            end += 1
            if long_at[end]:
                continue
            start = end - long
            key = chunk[start - (long_at[start] or 1 if start else 0) : end], long
            ok = fits.get(key)
            if ok is None:
                ok = self._fit(*key)
            if ok:
                piece_at[end], long_at[end] = piece, long
        out: list[int] = []
        while n:
            piece = piece_at[n]
            if piece < 0:
                c = chunk[n - 1]
                out += [self.bytes[b] for b in reversed((SPACE if c == _LITERAL else c).encode())]
                n -= 1
            else:
                out.append(piece)
                n -= long_at[n]
        return out[::-1]

    def _chunk(self, chunk: str) -> bytes:
        ids = array("I", self.search(chunk)).tobytes()
        if len(chunk) <= _LONG:  # a chunk as long as a text would fill the memory of the worker
            self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> array:
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        if not text:
            return array("I")
        shown = SPACE + text.replace(SPACE, _LITERAL).replace(" ", SPACE)
        get, new = self.known.get, self._chunk
        out = array("I")
        out.frombytes(b"".join([get(c) or new(c) for c in (self.chunks.findall(shown) if self.chunks else [shown])]))
        return out

    def decode(self, ids: array) -> str:
        text = self.text
        return b"".join([text[i] for i in ids]).decode()[1:]


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _pieces(path: str) -> Pieces:
    held = worker_cache("pieces")
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Callable[[], str] = piece_path, ids: bool = True) -> DataFrame:
    """One row for each row of docs: (doc_id, n_pieces, ids_crc32, round_trip) and, with ids, the ids.

    round_trip: whether decoding gives the text back.  Null or empty text: no ids.  Repeated rows and null ids
    are rows like others; an empty table gives none; other columns are not read, so their names do not matter.  No two
    divisions tie: just one has neighbours that all fit.  A very long text is one pass, whose tables grow with it."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path())
        for batch in batches:
            for part in by_bytes(batch, "t", 1 << 20):
                texts = [t or "" for t in part.column("t").to_pylist()]
                made = [model.encode(t) for t in texts]
                cols = [part.column("id"), pa.array([len(m) for m in made], pa.int64()), pa.array([zlib.crc32(m.tobytes()) for m in made], pa.int64()), pa.array([model.decode(m) == t for m, t in zip(made, texts)])]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([m.tolist() for m in made], pa.list_(pa.int32()))] if ids else []), ["doc_id", "n_pieces", "ids_crc32", "round_trip"] + ["ids"] * ids)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * ids)


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: Callable[[], str] = piece_path) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids: null."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(path())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([None if x is None else model.decode(array("I", x)) for x in batch.column("x").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("x")).mapInArrow(run, f"doc_id {kind}, text string")
