"""Missing or wrong document language labels, by nearest-centroid classification.

A segment's words give counts of character n-grams, weighted by inverse
document frequency and normalised; it is compared by cosine with several
clustered centroids of each language and takes the nearest one's language,
unless the cosine is under a limit. Words that hold a digit, and capitals among
ordinary text, are identifiers and say nothing of the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled samples a language that the centroids are fitted on, those of the smallest hashes: at most this many.
FIT_ROWS = 400
CENTROIDS = 3
#: A segment nearer to no centroid than this cosine has no language.
REJECT = 0.06
#: Letters, and words, that a segment must have beside identifiers.
LEAST_LETTERS = 8
LEAST_WORDS = 2
#: Places for n-grams that no sample holds; they count in a segment's length only.
UNSEEN = 512
SHARPNESS = 12.0
BATCH_CHARS = 2 << 20
WORDS_KEPT = 400_000

#: Names and codes of the languages told apart, in lower case.
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
}
_CODE = {name: code for code, names in NAMES.items() for name in names}

_DIGIT = re.compile(r"\d").search
_WORD = re.compile(r"[^\W\d_]+")


def label_code(label: str | None) -> str | None:
    """The code of a label in any spelling, region included; None if it names none of the languages told apart."""
    return _CODE.get(re.split(r"[-_]", (label or "").strip().lower())[0].strip())


def label_column(label: Column) -> Column:
    """``label_code`` as a column."""
    names = F.create_map(*[F.lit(x) for item in _CODE.items() for x in item])
    return F.try_element_at(names, F.trim(F.split(F.lower(F.trim(label)), "[-_]")[0]))


def segments(text: str) -> list[str]:
    """The paragraphs of a text: runs of lines that aren't white space only."""
    out, held = [], []
    for line in text.split("\n"):
        if line.strip():
            held.append(line)
        elif held:
            out.append("\n".join(held))
            held = []
    if held:
        out.append("\n".join(held))
    return out


def language_words(segment: str) -> list[str]:
    """The words of a segment that can tell its language, in lower case and in no certain order.

    What stands between white space and holds a digit is an identifier or a number.
    """
    found, mixed = [], []
    for t in segment.split():
        (found if t.isalpha() else mixed).append(t)
    found += _WORD.findall(" ".join([t for t in mixed if not _DIGIT(t)]))
    plain = [w for w in found if not (w.isupper() and len(w) > 1)]
    # Where capitals are the rule they are words, not identifiers.
    kept = plain if 2 * len(plain) >= len(found) else found
    return [w.lower() for w in kept]


def grams(word: str) -> list[str]:
    """The word with its ends, and its runs of three and four characters."""
    w = f" {word} "
    return [w, *(w[i : i + 3] for i in range(len(w) - 2)), *(w[i : i + 4] for i in range(len(w) - 3))]


@dataclass
class Model:
    languages: list[str]
    vocabulary: dict[str, int]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray



def _vector(ws: list[str], vocabulary: dict[str, int], idf: np.ndarray) -> np.ndarray:
    x = np.zeros(len(idf))
    for w in ws:
        for g in grams(w):
            if (at := vocabulary.get(g)) is not None:
                x[at] += idf[at]
    return x / max(np.linalg.norm(x), 1e-12)


def fit(samples: list[tuple[str, str]], centroids: int = CENTROIDS, seed: int = 0) -> Model:
    """Centroids of each language from (language, text) samples."""
    told = [(lang, language_words(text)) for lang, text in samples]
    told = [(lang, ws) for lang, ws in told if ws]
    seen: dict[str, int] = {}
    for _, ws in told:
        for g in {g for w in set(ws) for g in grams(w)}:
            seen[g] = seen.get(g, 0) + 1
    kept = sorted(g for g, n in seen.items() if n > 1)
    vocabulary = {g: i for i, g in enumerate(kept)}
    idf = np.log((1 + len(told)) / (1 + np.array([seen[g] for g in kept], float))) + 0.05
    languages = sorted({lang for lang, _ in told})
    rng, out, owner = np.random.default_rng(seed), [], []
    for k, lang in enumerate(languages):
        x = np.stack([_vector(ws, vocabulary, idf) for own, ws in told if own == lang])
        c = x[rng.choice(len(x), min(centroids, len(x)), replace=False)]
        for _ in range(10):
            at = (x @ c.T).argmax(1)
            sums = np.stack([x[at == j].sum(0) if (at == j).any() else c[j] for j in range(len(c))])
            c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        out.append(c)
        owner += [k] * len(c)
    return Model(languages, vocabulary, idf, np.concatenate(out) if out else np.zeros((0, len(idf))), np.array(owner, int))


class Classifier:
    """Classifies segments; each distinct word's n-grams and scores are made once while it is remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.ascontiguousarray((model.centroids * model.idf).T.astype(np.float32))
        self.weights = np.concatenate([model.idf, np.full(UNSEEN, model.idf.max() if len(model.idf) else 1.0)])
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.places: list[np.ndarray] = []
        self.scores: list[np.ndarray] = []

    def _learn(self, word: str) -> int:
        vocabulary, v = self.model.vocabulary, len(self.model.idf)
        # An unseen n-gram's place must be stable, so it isn't from Python's salted hash.
        places = [a if (a := vocabulary.get(g)) is not None else v + crc32(g.encode()) % UNSEEN for g in grams(word)]
        self.places.append(np.array(places, np.int32))
        self.scores.append(self.table[[a for a in places if a < v]].sum(0))
        self.number[word] = n = len(self.number)
        return n

    def classify(self, texts: list[list[str]]) -> list[tuple[str | None, float]]:
        """(language or None, confidence) of each segment, given by its words; 0 confidence without a language."""
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
        model = self.model
        use = [i for i, ws in enumerate(texts) if len(ws) >= LEAST_WORDS and sum(map(len, ws)) >= LEAST_LETTERS]
        if not use or not len(model.languages):
            return out
        if len(self.number) > WORDS_KEPT:
            self._reset()
        get, learn = self.number.get, self._learn
        numbers = np.array([n if (n := get(w)) is not None else learn(w) for i in use for w in texts[i]], np.int64)
        sizes = np.fromiter((len(texts[i]) for i in use), np.int64, len(use))
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        distinct, inverse = np.unique(numbers, return_inverse=True)
        score = np.stack([self.scores[n] for n in distinct])
        sums = np.add.reduceat(score[inverse], begins, axis=0)
        # Squared lengths: the counts of each n-gram in each segment, weighted.
        lists = [self.places[n] for n in distinct]
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, first = np.concatenate(lists), np.concatenate(([0], np.cumsum(length)[:-1]))
        each = length[inverse]
        base = np.concatenate(([0], np.cumsum(each)))
        place = flat[np.repeat(first[inverse] - base[:-1], each) + np.arange(base[-1])]
        segment = np.repeat(np.repeat(np.arange(len(use)), sizes), each)
        width = len(self.weights)
        norm = np.empty(len(use))
        edge = base[np.append(begins, len(numbers))]
        weight = self.weights[place]
        cell = segment * width + place
        for a in range(0, len(use), 16):
            b = min(a + 16, len(use))
            part = slice(edge[a], edge[b])
            x = np.bincount(cell[part] - a * width, weight[part], (b - a) * width).reshape(b - a, width)
            norm[a:b] = np.sqrt(np.einsum("ij,ij->i", x, x))
        cosine = sums / np.maximum(norm, 1e-12)[:, None]
        best = np.stack([cosine[:, model.owner == k].max(1) for k in range(len(model.languages))], axis=1)
        top = best.argmax(1)
        share = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        for j, i in enumerate(use):
            if best[j, top[j]] >= REJECT:
                out[i] = model.languages[top[j]], float(share[j, top[j]])
        return out


def fitted(samples: DataFrame, lang: str, text: str, seed: int = 0) -> Model:
    """The model of a table of labelled samples; of each language, however its label is spelled, the FIT_ROWS rows of the smallest hashes are used."""
    rows = samples.filter(F.col(text).isNotNull()).select(label_column(F.col(lang)).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5("text"), "text"))
    told = rows.withColumn("place", place).filter(F.col("place") <= FIT_ROWS).select("lang", "text").collect()
    return fit(sorted((r.lang, r.text) for r in told), seed=seed)


def language_segments(documents: DataFrame, doc_id: str, text: str, lang: str, model: Model) -> DataFrame:
    """(doc_id, segment, lang, confidence, label, is_case): one row for each segment with a language.

    Segments count from 1, those without a language included. label is the
    code that the document's own label names, or null. is_case says that the
    label is missing or names a language of none of the document's segments,
    or that these have more than one language. Texts that are null, empty or
    without a language give no rows; the whole text is read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "segment", "lang", "confidence", "label", "is_case"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            ids, texts, labels = batch.column(0), batch.column(1), batch.column(2)
            held: list[tuple[int, int]] = []
            held_words: list[list[str]] = []
            size = 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size >= BATCH_CHARS:
                    yield _emit(ids, labels, held, classifier.classify(held_words))
                    held, held_words, size = [], [], 0
                if i < len(texts) and (t := texts[i].as_py()):
                    size += len(t)
                    for k, s in enumerate(segments(t), 1):
                        held.append((i, k))
                        held_words.append(language_words(s))

    def _emit(ids: pa.Array, labels: pa.Array, held: list[tuple[int, int]], told: list[tuple[str | None, float]]) -> pa.RecordBatch:
        spoken: dict[int, set[str]] = {}
        for (i, _), (code, _c) in zip(held, told):
            if code:
                spoken.setdefault(i, set()).add(code)
        own = {i: label_code(labels[i].as_py()) for i in spoken}
        case = {i: len(codes) > 1 or own[i] not in codes for i, codes in spoken.items()}
        kept = [(i, k, code, c) for (i, k), (code, c) in zip(held, told) if code]
        columns = [
            ids.take(pa.array([r[0] for r in kept], pa.int64())), pa.array([r[1] for r in kept], pa.int32()), pa.array([r[2] for r in kept], pa.string()),
            pa.array([r[3] for r in kept], pa.float64()), pa.array([own[r[0]] for r in kept], pa.string()), pa.array([case[r[0]] for r in kept], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    kind = dict(documents.dtypes)[doc_id]
    return documents.select(doc_id, text, lang).mapInArrow(rows, f"doc_id {kind}, segment int, lang string, confidence double, label string, is_case boolean")
