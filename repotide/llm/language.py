"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repotide.llm.common import begin_task, keeps

#: Dimensions of a vector.
DIMENSIONS = 1024
#: About so many documents per language are bundled into its prototype (those with the smallest id hashes).
SAMPLE_PER_LANGUAGE = 2000
#: Documents whose vectors are bundled in one matrix product, and n-gram vectors kept by a worker.
TOGETHER, GRAMS_KEPT = 64, 40_000
#: Characters of a text looked at in one go (and about as many in one product), and n-gram vectors of a product.
PART, SLICE = 1 << 20, 16_384
UNKNOWN = "und"

_SPACE = 32
_STATE: dict[str, object] = {}
keeps("language", _STATE.clear)


@dataclass(frozen=True)
class Profiles:
    """Language prototypes: unit vectors, one a row."""

    languages: tuple[str, ...]
    vectors: np.ndarray


class GramVectors:
    """Vectors of letter trigrams: the letter vectors, permuted by their place, bound by products.

    A letter's vector is random signs seeded by its code point, so every worker has the same ones.
    """

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.int64)
        self.rows = np.zeros((0, self.dimensions), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng(code).choice(np.array([-1, 1], np.int8), self.dimensions)
        return self.letters[code]

    def _bind(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones((len(keys), self.dimensions), np.int8)
        for place, codes in enumerate((keys & 0x1FFFFF, keys >> 21 & 0x1FFFFF, keys >> 42)):
            letters, at = np.unique(codes, return_inverse=True)
            out *= np.roll(np.stack([self._letter(int(c)) for c in letters]), place, axis=1)[at]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of sorted different keys."""
        if len(self.keys) > GRAMS_KEPT:
            self._clear()
        new = np.setdiff1d(keys, self.keys, assume_unique=True)
        if len(new):
            merged = np.concatenate([self.keys, new])
            order = np.argsort(merged)
            self.keys, self.rows = merged[order], np.concatenate([self.rows, self._bind(new)])[order]
        return self.rows[np.searchsorted(self.keys, keys)]


def _letters() -> np.ndarray:
    """For every code point, itself if it is a letter and a blank otherwise."""
    if "letters" not in _STATE:
        _STATE["letters"] = np.fromiter((c if chr(c).isalpha() else _SPACE for c in range(0x110000)), np.int64, 0x110000)
    return _STATE["letters"]


def _trigram_parts(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different trigram keys and their counts for every PART characters of the lower-cased text, runs of
    other characters than letters being one blank; parts without a trigram are left out."""
    text = (text or "").lower()
    tail, before = np.array([_SPACE]), _SPACE
    for start in range(0, len(text), PART):
        codes = _letters()[np.frombuffer(text[start:start + PART].encode("utf-32-le", "surrogatepass"), "<u4")]
        keep = codes != _SPACE
        keep[1:] |= codes[:-1] != _SPACE  # the first blank of a run stays
        keep[0] |= before != _SPACE
        before = codes[-1]
        ends = [] if start + PART < len(text) else [_SPACE]
        codes = np.concatenate([tail, codes[keep], ends]).astype(np.int64)
        tail = codes[-2:]
        if len(codes) > 2:
            yield np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def _add_bundled(out: np.ndarray, parts: list[tuple[int, np.ndarray, np.ndarray]], grams: GramVectors) -> None:
    """Add the trigram vectors of (row, keys, counts) to the rows, SLICE different keys at a time."""
    keys = np.unique(np.concatenate([k for _, k, _ in parts]))
    for start in range(0, len(keys), SLICE):
        some = keys[start:start + SLICE]
        counts = np.zeros((len(parts), len(some)), np.float32)
        for i, (_, k, c) in enumerate(parts):
            low, high = np.searchsorted(k, some[0]), np.searchsorted(k, some[-1], "right")
            counts[i, np.searchsorted(some, k[low:high])] = c[low:high]
        for (row, _, _), vector in zip(parts, counts @ grams(some).astype(np.float32), strict=True):
            out[row] += vector


def bundle(texts: list[str | None]) -> np.ndarray:
    """Unit vector of every text: the sum of its trigram vectors; zeros without letters.

    Up to TOGETHER texts share a product. A product ends after PART trigrams and takes SLICE vectors at a
    time, so what is held besides the texts follows neither their length nor their number of letters.
    """
    grams: GramVectors = _STATE.setdefault("grams", GramVectors())
    out = np.zeros((len(texts), grams.dimensions), np.float32)
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0
    for row, text in enumerate(texts):
        for keys, counts in _trigram_parts(text):
            parts.append((row, keys, counts))
            size += len(keys)
            if len(parts) >= TOGETHER or size >= PART:
                _add_bundled(out, parts, grams)
                parts, size = [], 0
    if parts:
        _add_bundled(out, parts, grams)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; such rows are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn_profiles(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Prototypes from rows (doc_id, text, lang) without null langs.

    The sample of a language is the rows whose id hash is in the share of the range that holds about
    ``sample`` of its rows. The driver gets one count and one vector per language.
    """
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    limits = {r["lang"]: int(min(1, sample / r["n"]) * (2**64 - 1)) - 2**63 for r in counts}
    if not limits:
        return Profiles((), np.zeros((0, DIMENSIONS), np.float32))
    bound = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    chosen = labelled.select("text", "lang").filter(F.xxhash64("doc_id") <= bound[F.col("lang")])

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("language")
        total: dict[str, np.ndarray] = {}
        for rows in parts:
            langs = rows.column("lang").to_pylist()
            for lang, vector in zip(langs, bundle(rows.column("text").to_pylist()), strict=True):
                total[lang] = total.get(lang, 0) + vector.astype(np.float64)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(vector)), pa.array(range(len(vector)), pa.int32()), pa.array(vector)], names=["lang", "d", "v"])

    parts = chosen.mapInArrow(sums, "lang string, d int, v double")
    vectors: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "d").agg(F.sum("v").alias("v")).collect():
        vectors.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["d"]] = r["v"]
    names = tuple(sorted(vectors))
    stacked = np.stack([vectors[n] for n in names]) if names else np.zeros((0, DIMENSIONS))
    norms = np.linalg.norm(stacked, axis=1, keepdims=True)
    return Profiles(names, np.divide(stacked, norms, out=stacked, where=norms > 0).astype(np.float32))


def predict_language(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns in ``keep`` (under their names) for every row.

    The language is that of the prototype with the highest cosine, which is the score (0 to 1). Null texts,
    texts without a letter, and all texts if nothing was learnt are ``und`` with score 0. Ties go to the
    language that sorts first. Repeated rows get equal rows; an empty table gives an empty result.
    """
    kept = [F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"__{c}") for c in keep]]
    schema = docs.select(*kept).schema
    names = list(schema.names)
    text_name = f"__{text_col}" if text_col in keep else "__own_text"
    languages, vectors = profiles.languages, profiles.vectors

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("language")
        for rows in parts:
            for start in range(0, rows.num_rows, 512):
                part = rows.slice(start, 512)
                own = bundle(part.column(text_name).to_pylist())
                if languages:
                    cosines = own @ vectors.T
                    best, some = cosines.argmax(1), own.any(1)
                    lang = [languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                    score = np.clip(np.where(some, cosines.max(1), 0), 0, 1).astype(np.float64)
                else:
                    lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], pa.array(lang), pa.array(score)], names=[*names, "lang_pred", "score"])

    fed = docs.select(*kept) if text_col in keep else docs.select(*kept, F.col(text_col).alias("__own_text"))
    out = fed.mapInArrow(predict, schema.add("lang_pred", "string").add("score", "double"))
    return out.select(
        *([] if id_col in keep else ["doc_id"]), *[F.col(f"__{c}").alias(c) for c in keep], "lang_pred", "score")


def identify_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learnt from those that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    out = predict_language(docs, learn_profiles(known))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
