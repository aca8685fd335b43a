"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram is bound by multiplying its letters' vectors, each permuted (rolled) by
its place from the end. A text is the bundle (sum) of its n-grams' vectors, a language prototype the bundle over its training texts; a text
gets the language whose prototype has the largest cosine with it.

Prototypes are summed per task and then per component in Spark, so a hot source or language moves no more than one vector per task. They are the only thing that is
broadcast: languages x dimensions, checked against ``MAX_LANGUAGES``. Both passes are scans; documents are never moved.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdiff.llm.common import release_memory

DIMENSIONS, GRAM, SEED = 1024, 3, 20250101
MAX_LANGUAGES = 20_000
UNKNOWN = "und"
DOCS_AT_ONCE = 8
DENSE_CODES = 1 << 22
CHARS_AT_ONCE = 1 << 20


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=200_000)
def letter_vector(code: int) -> np.ndarray:
    """The vector of a letter; code 0 stands for whatever lies between words."""
    return np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of other characters as one 0, with a 0 at both ends; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, 0)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]
    return codes if len(codes) > 1 else codes[:0]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams given as rows of code points."""
    alphabet, place = np.unique(grams, return_inverse=True)
    letters = np.stack([letter_vector(int(c)) for c in alphabet])
    place = place.reshape(grams.shape)
    bound = letters[place[:, -1]]
    for k in range(GRAM - 1):
        bound = bound * np.roll(letters, GRAM - 1 - k, axis=1)[place[:, k]]
    return bound


def gram_counts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of several letter sequences, as code points, and a matrix of counts (texts x n-grams)."""
    windows = [np.lib.stride_tricks.sliding_window_view(t, GRAM) if len(t) >= GRAM else np.empty((0, GRAM), np.int64) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in windows])
    flat = np.concatenate(windows) if windows else np.empty((0, GRAM), np.int64)
    seen = np.zeros(int(flat.max()) + 1 if flat.size else 1, bool)
    seen[flat.ravel()] = True
    alphabet = np.flatnonzero(seen)
    small = np.zeros(len(seen), np.int64)
    small[alphabet] = np.arange(len(alphabet))
    m = len(alphabet)
    code = np.zeros(len(flat), np.int64)
    for k in range(GRAM):
        code = code * m + small[flat[:, k]]
    if m**GRAM <= DENSE_CODES:
        present = np.zeros(m**GRAM, bool)
        present[code] = True
        distinct = np.flatnonzero(present)
        index = np.zeros(m**GRAM, np.int64)
        index[distinct] = np.arange(len(distinct))
        at = index[code]
    else:
        distinct, at = np.unique(code, return_inverse=True)
    counts = np.bincount(owner * len(distinct) + at, minlength=len(texts) * len(distinct)).reshape(len(texts), len(distinct))
    grams = np.empty((len(distinct), GRAM), np.int64)
    rest = distinct
    for k in reversed(range(GRAM)):
        grams[:, k] = alphabet[rest % m] if m else 0
        rest = rest // max(m, 1)
    return grams, counts


class Vectors:
    """Bound vectors of the n-grams a task has met, kept up to a bound."""

    def __init__(self, most: int = 60_000):
        self.most, self.rows, self.table = most, {}, np.empty((0, DIMENSIONS), np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        keys = ((grams[:, 0] << 42) | (grams[:, 1] << 21) | grams[:, 2]).tolist()
        new = [k for k, key in enumerate(keys) if key not in self.rows]
        if new:
            if len(self.rows) + len(new) > self.most:
                self.rows, self.table = {}, self.table[:0]
                if len(keys) > self.most:
                    return gram_vectors(grams)
                new = list(range(len(keys)))
            held = len(self.rows)
            self.rows.update((keys[k], held + i) for i, k in enumerate(new))
            self.table = np.concatenate((self.table, gram_vectors(grams[new])))
        return self.table[[self.rows[k] for k in keys]]


def bundle(texts: list[np.ndarray], vectors: Vectors) -> np.ndarray:
    """The vector of each letter sequence."""
    grams, counts = gram_counts(texts)
    if not len(grams):
        return np.zeros((len(texts), DIMENSIONS))
    total = np.zeros((len(texts), DIMENSIONS))
    for k in range(0, len(grams), 20_000):
        total += counts[:, k : k + 20_000].astype(np.float32) @ vectors.of(grams[k : k + 20_000]).astype(np.float32)
    return total


def _groups(texts: list[np.ndarray], most: int) -> Iterator[tuple[int, int]]:
    """Slices of at most ``most`` texts and about ``CHARS_AT_ONCE`` letters."""
    first = chars = 0
    for k, t in enumerate(texts):
        if k > first and (k - first == most or chars + len(t) > CHARS_AT_ONCE):
            yield first, k
            first, chars = k, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def prototypes(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their unit prototypes, from all rows with a text and a language."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(), {}
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                by_lang.setdefault(lang, []).append(letters_of(text))
            for lang, texts in by_lang.items():
                for i, j in _groups(texts, 1000):
                    own = np.concatenate(texts[i:j])  # texts meet at their 0 at both ends, which only adds n-grams with two gaps
                    sums[lang] = sums.get(lang, 0) + bundle([own], vectors)[0]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = training.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sums = rows.mapInArrow(add, "lang string, v array<double>").select("lang", F.posexplode("v").alias("place", "x"))
    summed = sums.groupBy("lang", "place").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v"))
    found = summed.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = [r["lang"] for r in found]
    table = np.array([[p["x"] for p in r["v"]] for r in found]).reshape(len(found), DIMENSIONS)
    sizes = np.linalg.norm(table, axis=1, keepdims=True)
    return names, table / np.where(sizes == 0, 1, sizes)


def predict(text: Column, names: list[str], table: np.ndarray) -> Column:
    """A struct column ``(lang_pred, score)``; score is the cosine, cut to 0 to 1."""

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = Vectors()
        for series in batches:
            texts = [letters_of(t or "") for t in series]
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for i, j in _groups(texts, DOCS_AT_ONCE):
                own = bundle(texts[i:j], vectors)
                size = np.linalg.norm(own, axis=1)
                if len(names):
                    cosines = own @ table.T / np.where(size == 0, 1, size)[:, None]
                    best[i:j] = cosines.argmax(axis=1)
                    score[i:j] = cosines.max(axis=1).clip(0, 1)
            known = np.array([len(t) > 0 and len(names) > 0 for t in texts], bool)
            lang = np.where(known, np.array([*names, UNKNOWN], object)[np.where(known, best, len(names))], UNKNOWN)
            yield pd.DataFrame({"lang_pred": lang, "score": np.where(known, score, 0.0)})
            del texts
            release_memory()
        del vectors
        release_memory()

    return of(text)


def identify(df: DataFrame, training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, learned from the texts and languages of ``training``.

    A null text, one without letters, and any text if nothing was learned get ``und`` and score 0. Equal cosines go to the first name. Texts
    of any length are read whole; repeated rows get equal results; columns of these two names are replaced, all others stay.
    """
    names, table = prototypes(training, text_col, lang_col)
    rest = [c for c in df.columns if c not in ("lang_pred", "score")]
    return df.select(*rest, predict(F.col(text_col), names, table).alias("found_")).select(*rest, "found_.lang_pred", "found_.score")
