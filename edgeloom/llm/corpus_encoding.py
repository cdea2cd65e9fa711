"""Encoding of a whole corpus with a public tokenizer, by content-defined chunk reuse.

Texts are cut wherever a rolling hash of the last few characters fires, so
equal passages are cut alike wherever they stand and in any script. A join
between two chunks is repaired: the window round it is encoded anew, and it is
widened on both sides, over further joins if need be, until both sides agree,
which is at the nearest places that certainly part two tokens. Between two
windows a chunk's own ids stand. Chunks that many documents share are encoded
once for all of them and looked up from then on; windows are remembered too.

Places that certainly part two tokens follow from the classes of two
neighbouring characters, as the pre-tokenizer's pattern holds runs of letters,
of digits, of other signs and of white space, each with at most one space
before it: after a letter or digit, before anything of another class; after
another sign, before white space; and after a sign that is no apostrophe,
before a letter or digit. Its look-ahead concerns runs of white space only.
"""

from __future__ import annotations

import base64
import importlib.util
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.plans.durable import discard, materialise

#: A place cuts if the hash of the WINDOW characters before it is under this part of 2 ** 32.
CUT_RATE = 1 / 24
WINDOW = 6
_MULTIPLIER = np.uint32(0x9E3779B1)
#: The shared dictionary has pieces with at least this share of all pieces, so at most 1 / SHARE of them, each of PIECE_CHARS at most.
SHARE = 2.0**-17
PIECE_CHARS = 64
#: Pieces that one worker remembers beside the shared ones; then it starts anew.
REMEMBERED = 300_000
#: Bytes of text that are encoded together.
BATCH_BYTES = 4 << 20


def ranks_path(name: str = "byte_bpe_50k") -> str:
    """Where the installed public vocabulary lies; pass another path to the queries' operator to use another file."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / f"{name}.tiktoken")


#: Fixed value: the pre-tokenizer's pattern of the public byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points of white space as the pattern has it.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Classes of characters; what isn't assigned, or lies in the planes of rare ideographs, is UNSURE and parts nothing.
LETTER, DIGIT, SIGN, APOSTROPHE, SPACE, UNSURE = range(6)


def load(ranks: bytes):
    """The encoding of a vocabulary file's bytes, without special tokens."""
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    return tiktoken.Encoding("edgeloom", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})


@cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, UNSURE, np.uint8)
    of = {"L": LETTER, "N": DIGIT, "M": SIGN, "P": SIGN, "S": SIGN, "Z": SIGN, "C": SIGN}
    for c in range(0x20000):
        kind = unicodedata.category(chr(c))
        if kind != "Cn":
            out[c] = of[kind[0]]
    out[ord("'")] = APOSTROPHE
    out[list(SPACES)] = SPACE
    return out


@cache
def _parting() -> np.ndarray:
    """Whether two tokens certainly part between characters of two classes, at six times the first and the second."""
    out = np.zeros((6, 6), bool)
    for run in (LETTER, DIGIT):
        out[run, [x for x in (LETTER, DIGIT, SIGN, APOSTROPHE, SPACE) if x != run]] = True
    out[[SIGN, APOSTROPHE], SPACE] = True
    out[SIGN, [LETTER, DIGIT]] = True
    return out.ravel()


def cuts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ascending places where a chunk begins by the rolling hash, in the code points of texts that begin at ``begins``.

    A cut depends on the WINDOW characters before it alone, which must be of
    its own text.
    """
    if len(points) <= WINDOW:
        return np.empty(0, np.int64)
    h = np.zeros(len(points) - WINDOW, np.uint32)
    for k in range(WINDOW):
        h *= _MULTIPLIER
        h += points[k : len(points) - WINDOW + k]
    h ^= h >> np.uint32(15)
    h *= _MULTIPLIER
    at = np.flatnonzero(h < np.uint32(CUT_RATE * 2**32)) + WINDOW
    own = begins[np.searchsorted(begins, at, side="right") - 1]
    return at[at - own >= WINDOW]


def repaired(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ascending places where a piece begins: texts, and the ends of the windows round the joins of chunks.

    A window reaches from its join to the nearest certain parting on either
    side; windows that meet are one, as where a whole chunk has no parting.
    """
    kinds = _classes()[points]
    parts = np.ones(len(points) + 1, bool)  # the end parts as well
    parts[1:-1] = _parting()[kinds[:-1] * np.uint8(6) + kinds[1:]]
    parts[begins] = True
    sure = np.flatnonzero(parts)
    at = cuts(points, begins)
    right = np.searchsorted(sure, at, side="left")
    left = np.searchsorted(sure, at, side="right") - 1
    return np.unique(np.concatenate((begins, sure[left], sure[right])))


class Pieces:
    """The pieces of a batch of texts, and the first and last piece of each text."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        joined = "".join(texts)
        ends = np.cumsum(sizes)
        begins = np.unique((ends - sizes)[sizes > 0])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = repaired(points, begins) if len(points) else np.empty(0, np.int64)
        starts = starts[starts < len(points)]
        bounds = np.append(starts, len(points)).tolist()
        self.first = np.searchsorted(starts, ends - sizes)
        self.parts = [joined[a:b] for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Encodes batches of texts, each distinct piece once while it is remembered."""

    def __init__(self, ranks: bytes, shared: dict[str, np.ndarray] | None = None):
        self.encoding, self.shared = load(ranks), shared or {}
        #: Pieces met, and pieces encoded, so far.
        self.met = self.encoded = 0
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])
        for piece, ids in self.shared.items():
            self._add(piece, ids)

    def _add(self, piece: str, ids) -> int:
        at = self.known[piece] = len(self.ends) - 1
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the offset of each text and of the end."""
        if len(self.known) > REMEMBERED + len(self.shared):
            self._reset()
        pieces, known, encode, before = Pieces(texts), self.known, self.encoding.encode_ordinary, len(self.known)
        which = [known[c] if c in known else self._add(c, encode(c)) for c in pieces.parts]
        self.met, self.encoded = self.met + len(which), self.encoded + len(known) - before
        at = np.array(which, np.int64)
        ends = np.frombuffer(self.ends, np.int64)
        flat = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.empty(0, np.int32)
        begin, size = ends[at], ends[at + 1] - ends[at]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        offsets = np.append(total[pieces.first], total[-1]) if len(texts) else np.zeros(1, np.int64)
        out = ids.copy(), offsets
        del ends, flat  # the arrays may grow again
        return out


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    held, size, start = [], 0, 0
    for i, t in enumerate(texts.to_pylist()):
        held.append(t or "")
        size += len(t or "")
        if size >= BATCH_BYTES:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def _count_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's frequent pieces and their counts, and under a null piece the number of all.

    Pieces under half the dictionary's share of the task are left out, so a
    piece with the full share of the corpus keeps half its count at least.
    """
    counts: Counter[str] = Counter()
    total = 0
    for batch in batches:
        for _, texts in _batches(batch.column(0)):
            parts = Pieces(texts).parts
            total += len(parts)
            counts.update(parts)
            if len(counts) > 1_000_000:
                counts = Counter({c: n for c, n in counts.items() if n > max(1, total * SHARE / 2)})
    kept = [(c, n) for c, n in counts.items() if n > max(1, total * SHARE / 2) and len(c) <= PIECE_CHARS]
    rows = [*kept, (None, total)]
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["piece", "n"])


def shared_pieces(documents: DataFrame, text: str, ranks: bytes) -> dict[str, np.ndarray]:
    """The ids of the corpus's most shared pieces, encoded once; at most 1 / SHARE entries of PIECE_CHARS."""
    counted = materialise(documents.select(text).mapInArrow(_count_pieces, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    total = counted.filter("piece IS NULL").agg(F.sum("n")).first()[0] or 0
    frequent = counted.filter(F.col("piece").isNotNull() & (F.col("n") >= max(2, total * SHARE / 2))).orderBy(F.desc("n"), "piece").limit(int(1 / SHARE)).select("piece")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(ranks)
        for batch in batches:
            ids = [encoding.encode_ordinary(c) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["piece", "ids"])

    table = frequent.mapInArrow(encoded, "piece string, ids array<int>").toArrow()
    discard(counted)
    return {c.as_py(): np.asarray(ids.values.to_numpy(zero_copy_only=False), np.int32) for c, ids in zip(table.column("piece").combine_chunks(), table.column("ids").combine_chunks())} if table.num_rows else {}


def encode_corpus(documents: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the whole text of every row as ids of the vocabulary, without special tokens.

    The vocabulary's file is read here and sent to the workers. Empty and null
    texts both give the empty list; strings of special tokens are ordinary
    text. Rows come out as they stand, repeated ones too. A run of one class
    of characters, however long, is one piece.
    """
    ranks = Path(path or ranks_path()).read_bytes()
    shared = documents.sparkSession.sparkContext.broadcast((ranks, shared_pieces(documents, text, ranks)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            ids = batch.column(0)
            for start, texts in _batches(batch.column(1)):
                flat, offsets = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)), lists], ["doc_id", "ids"])

    kind = dict(documents.dtypes)[doc_id]
    return documents.select(doc_id, text).mapInArrow(encode, f"doc_id {kind}, ids array<int>")
