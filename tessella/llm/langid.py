"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point alone. A three-letter window is bound into one
vector: the letters' vectors, permuted (rolled) by their place, multiplied element by element. A text's vector is the
bundle (sum) of its windows' vectors; a language's prototype is the bundle of its training texts. A text gets the
language whose prototype has the largest cosine with it.

Letters are what Unicode calls letters, lower-cased; anything else is one boundary symbol, and windows whose middle is
the boundary are left out. Sums are of integers, so results don't depend on how rows are batched.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text if nothing can be
learned; a text with letters always gets a learned language, with score 0 if its letters were never seen; ties go to the
language that sorts first; a cosine below 0 counts as 0; texts of any length are bundled whole; repeated rows give repeated results;
null ids are never held out and never learned from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, pieces, table, texts_of

DIM = 1024
UNKNOWN = "und"
MAX_WINDOWS = 1 << 15  # window vectors that a worker keeps: 32 MB at 1024 dimensions
MAX_CELLS = 1 << 22  # of a matrix of texts by windows
MAX_LANGUAGES = 4096  # prototypes go to every worker: 32 MB at most


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Space:
    """Vectors of windows, kept between batches."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.dim), np.int8)
        self.rows = np.zeros(0, np.int64)

    def _letter(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([np.random.Generator(np.random.Philox(key=int(c))).integers(0, 2, self.dim, np.int8) * 2 - 1 for c in codes]).astype(np.int8)

    def _bind(self, keys: np.ndarray) -> np.ndarray:
        places = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF])
        codes, at = np.unique(places, return_inverse=True)
        letter = self._letter(codes)
        at = at.reshape(places.shape)
        return np.roll(letter, 2, 1)[at[0]] * np.roll(letter, 1, 1)[at[1]] * letter[at[2]]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """int8 vectors of sorted, different window keys."""
        if len(keys) > MAX_WINDOWS:
            return self._bind(keys)
        new = keys[~np.isin(keys, self.keys, assume_unique=True)]
        if len(new):
            if len(self.keys) + len(new) > MAX_WINDOWS:
                self.clear()
                new = keys
            self.vectors = np.concatenate([self.vectors, self._bind(new)])
            self.rows = np.concatenate([self.rows, np.arange(len(self.keys), len(self.keys) + len(new))])
            merged = np.concatenate([self.keys, new])
            order = np.argsort(merged, kind="stable")
            self.keys, self.rows = merged[order], self.rows[order]
        return self.vectors[self.rows[np.searchsorted(self.keys, keys)]]


@lru_cache(maxsize=2)
def space(dim: int) -> Space:
    return Space(dim)


def window_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows and the number of the text that each is from."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    owner = np.r_[owner, len(low) - 1]
    code[~_letters()[code]] = 0
    stay = np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]
    code, owner = code[stay], owner[stay]
    middle = np.flatnonzero(code[1:-1]) + 1
    return code[middle - 1] << 42 | code[middle] << 21 | code[middle + 1], owner[middle]


def bundle(texts: list[str], sp: Space, groups: np.ndarray | None = None, n: int | None = None) -> np.ndarray:
    """The vector of each text, or of each of ``n`` groups of texts."""
    n = len(texts) if n is None else n
    out = np.zeros((n, sp.dim), np.float64)
    if not texts:
        return out
    keys, owner = window_keys(texts)
    if not len(keys):
        return out
    kinds, column = np.unique(keys, return_inverse=True)
    owner = owner if groups is None else groups[owner]
    step = max(1, MAX_CELLS // n)
    for lo in range(0, len(kinds), step):
        hi = min(lo + step, len(kinds))
        inside = slice(None) if step >= len(kinds) else (column >= lo) & (column < hi)
        counts = np.bincount(owner[inside] * (hi - lo) + column[inside] - lo, minlength=n * (hi - lo)).reshape(n, hi - lo)
        for a in range(lo, hi, 4096):
            b = min(a + 4096, hi)
            # float32 holds the sums of one text exactly below 2**24 windows
            kind = np.float32 if len(keys) < 1 << 24 else np.float64
            out += counts[:, a - lo : b - lo].astype(kind) @ sp.of(kinds[a:b]).astype(kind)
    return out


def prototypes(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """The bundle of all texts of each language: every task sends one vector a language, added up by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        sp = space(dim)
        for rb in pieces(batches, "text", 1 << 20):
            langs = rb.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {x: k for k, x in enumerate(names)}
            made = bundle(texts_of(rb, "text"), sp, np.array([number[x] for x in langs]), len(names))
            for name, v in zip(names, made, strict=True):
                sums[name] = sums[name] + v if name in sums else v
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([v.astype(np.int64)], pa.list_(pa.int64()))], ["lang", "v"])

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    if known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: prototypes would outgrow the workers")
    parts = known.mapInArrow(run, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for row in summed.collect():  # languages x dimensions
        out.setdefault(row.lang, np.zeros(dim))[row.at] = row.v
    return {k: v / norm for k, v in sorted(out.items()) if (norm := np.linalg.norm(v))}


def predict(docs: DataFrame, learned: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), dim: int = DIM) -> DataFrame:
    """``keep`` columns with lang_pred and score."""
    names = list(learned)
    shared = docs.sparkSession.sparkContext.broadcast(np.stack([*learned.values()]) if learned else np.zeros((0, dim)))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = space(dim)
        for rb in pieces(batches, "text", 1 << 18, 48):
            texts = texts_of(rb, "text")
            v = bundle(texts, sp)
            size = np.linalg.norm(v, axis=1)
            pred, score = [UNKNOWN] * len(v), np.zeros(len(v))
            if names:
                cos = v @ shared.value.T / np.where(size > 0, size, 1)[:, None]
                best = cos.argmax(1)
                score = np.where(size > 0, np.clip(cos[np.arange(len(v)), best], 0, 1), 0)
                pred = [names[b] if s > 0 or any(map(str.isalpha, t)) else UNKNOWN for b, s, t in zip(best, size, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(np.round(score, 9))], [*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = crc_mod("doc_id", 4)
    learned = prototypes(docs.where((rest != 2) & (rest >= 0)))
    out = predict(docs.select("doc_id", "text", (rest == 2).alias("held_out")), learned, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
