"""Evaluation texts leaking into training text, by pigeonhole edit matching.

Each passage of WORDS consecutive words of a test item is cut into ERRORS + 1
pieces; a passage found with at most ERRORS wrong, missing or further words
holds one piece exactly. Documents are searched for the pieces by a rolling
hash of word numbers, and a hit is verified by the bit-parallel edit distance
of Myers, over words, around it. The longest exact run through a hit is
measured beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12
ERRORS = 1
PIECE = WORDS // (ERRORS + 1)
#: Test items are taken in blocks of this many bytes of text; each block is one scan of the documents.
BLOCK_BYTES = 16 << 20
#: Bytes of document text searched at once.
BATCH_BYTES = 4 << 20

#: A word is a maximal run of letters and digits (Unicode L and N).
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """The words of a text in lower case."""
    # One capital's lower case has a mark that is no letter, so such texts are cut first.
    return [w.lower() for w in _WORD.findall(text)] if "İ" in text else _WORD.findall(text.lower())


def myers(pattern: list[int], text: list[int]) -> int:
    """The least edit distance of the pattern to any part of the text, bit-parallel over the pattern."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        best = min(best, score)
    return best


class Items:
    """Test items as word numbers, with the places of every piece by its hash, in packed arrays that are broadcast as they are."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        told = [[self.number.setdefault(w, len(self.number) + 1) for w in words(t or "")] for _, t in items]
        sizes = np.fromiter(map(len, told), np.int64, len(told))
        self.ends = np.cumsum(sizes)
        self.flat = np.fromiter((n for w in told for n in w), np.uint32, int(sizes.sum()))
        own = np.repeat(np.arange(len(told)), sizes)
        at = np.arange(len(self.flat))
        begin = at[(sizes[own] >= WORDS) & (at + PIECE <= self.ends[own])] if len(at) else at
        h = _roll(np.lib.stride_tricks.sliding_window_view(self.flat, PIECE)[begin].astype(np.uint64)) if len(begin) else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(order))
        self.item, self.begin = own[begin][order].astype(np.int32), begin[order]

    def words(self, k: int) -> list[int]:
        return self.flat[self.ends[k - 1] if k else 0 : self.ends[k]].tolist()

    def places(self, nth: int) -> Iterator[tuple[int, int]]:
        """(item, place in it) of the pieces with the nth hash."""
        for j in range(self.first[nth], self.first[nth + 1]):
            k = int(self.item[j])
            yield k, int(self.begin[j] - (self.ends[k - 1] if k else 0))


def _roll(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for k in range(PIECE):
        h = (h + windows[:, k]) * _BASE
        h ^= h >> np.uint64(29)
    return h


def search(items: Items, docs: list[list[str]]) -> list[tuple[int, int, int, int]]:
    """(document, item id, longest exact run, least errors) of each document that holds a passage of an item.

    Errors are counted over passages of WORDS words; a document of which no
    passage is within ERRORS doesn't come out.
    """
    get = items.number.get
    numbered = [[get(w, 0) for w in d] for d in docs]
    sizes = np.fromiter((len(d) for d in numbered), np.int64, len(numbered))
    flat = np.fromiter((n for d in numbered for n in d), np.uint64, int(sizes.sum()))
    if len(flat) < PIECE or not len(items.hashes):
        return []
    ends = np.cumsum(sizes)
    # Most words are of no item; a window with one can't be a piece.
    known = np.concatenate(([0], np.cumsum(flat > 0)))
    begin = np.flatnonzero(known[PIECE:] - known[:-PIECE] == PIECE)
    doc = np.searchsorted(ends, begin, side="right")
    keep = begin + PIECE <= ends[doc]
    begin, doc = begin[keep], doc[keep]
    h = _roll(np.lib.stride_tricks.sliding_window_view(flat, PIECE)[begin])
    at = np.searchsorted(items.hashes, h)
    hit = (at < len(items.hashes)) & (items.hashes[np.minimum(at, len(items.hashes) - 1)] == h)
    best: dict[tuple[int, int], list[int]] = {}
    held: dict[int, list[int]] = {}
    for b, d, nth in zip(begin[hit].tolist(), doc[hit].tolist(), at[hit].tolist()):
        text = numbered[d]
        p = b - int(ends[d] - sizes[d])
        for k, q in items.places(nth):
            item = held.get(k) or held.setdefault(k, items.words(k))
            if item[q : q + PIECE] == text[p : p + PIECE]:
                _verify(best, d, k, text, p, item, q)
    return [(d, items.ids[k], run, errors) for (d, k), (run, errors) in best.items()]


def _verify(best: dict, d: int, k: int, text: list[int], p: int, item: list[int], q: int) -> None:
    """Add what a run shows, given its piece at p of the text and q of the item; once a run."""
    if p > 0 and q > 0 and text[p - 1] == item[q - 1]:
        return  # a later piece of a run; its first piece is a hit as well
    left = right = 0
    while p - left > 0 and q - left > 0 and text[p - left - 1] == item[q - left - 1]:
        left += 1
    while p + right < len(text) and q + right < len(item) and text[p + right] == item[q + right]:
        right += 1
    run = left + right
    errors = WORDS
    # Passages that hold the run's first or last piece, where an error can only lie outside the run; those within the run first.
    passages = range(max(0, q - left - WORDS + PIECE), min(q + right - PIECE, len(item) - WORDS) + 1)
    for start in sorted(passages, key=lambda s: not q - left <= s <= q + right - WORDS):
        shift = p - q + start
        errors = min(errors, myers(item[start : start + WORDS], text[max(0, shift - ERRORS) : max(0, shift + WORDS + ERRORS)]))
        if not errors:
            break
    if errors <= ERRORS:
        if seen := best.get((d, k)):
            seen[0], seen[1] = max(seen[0], run), min(seen[1], errors)
        else:
            best[d, k] = [run, errors]


def _item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for row in items.select(item_id, text).filter(F.col(item_id).isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, run, errors): every document that holds a passage of WORDS words of an item, with at most ERRORS errors.

    run is the longest run of the item's words found exactly, errors the least
    number of wrong words of a passage. Words are compared in lower case,
    whatever stands between them. Items of fewer than WORDS words, and null or
    empty texts on either side, have no passages. Rows that repeat a document
    come out each. Items are a stated query set: they are taken in blocks of
    bounded size, each against all documents.
    """
    spark, kind, out = documents.sparkSession, dict(documents.dtypes)[doc_id], None
    schema = f"doc_id {kind}, item_id bigint, run int, errors int"
    for block in _item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(Items(block))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                start, held, size = 0, [], 0
                for i in range(len(texts) + 1):
                    if i == len(texts) or size >= BATCH_BYTES:
                        found = search(own, held)
                        docs, names, runs, errors = zip(*found) if found else ((), (), (), ())
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([start + d for d in docs], pa.int64())), pa.array(names, pa.int64()), pa.array(runs, pa.int32()), pa.array(errors, pa.int32())], ["doc_id", "item_id", "run", "errors"])
                        start, held, size = i, [], 0
                    if i < len(texts):
                        t = texts[i].as_py() or ""
                        held.append(words(t))
                        size += len(t)

        part = documents.select(doc_id, text).mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
