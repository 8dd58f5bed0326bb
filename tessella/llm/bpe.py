"""Byte-level BPE by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks at every neighbouring pair inside a word; the
rank of a pair comes from a binary search over the sorted pair keys. In each word the pair of lowest rank is
merged wherever it stands, left to right and without overlap; words without a known pair leave the array.
Merging every occurrence at once is exact as a pair that holds the new symbol always has a higher rank.

Defined results: null text counts as empty; an empty text has no ids and decodes to the empty string; the
special token's string inside a text is that token; a word of any length is encoded whole; repeated rows give
repeated results; extra columns are dropped by :func:`encode_decode` and kept by :func:`encode_column`.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, table, texts_of

VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the split pattern of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in character of a byte-level vocabulary means."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class ByteBPE:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str, max_held: int = 96 << 20) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        byte_of = _byte_of_char()
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.special: dict[str, int] = {}
        for t in spec["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
            self.special[t["content"]] = t["id"]
        char_of = {b: c for c, b in byte_of.items()}
        self.first = np.array([vocab[char_of[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words: dict[str, bytes] = {}  # ids of words
        self.after_space: dict[str, bytes | None] = {}  # ids of pieces of text that follow a space
        self.held, self.max_held = 0, max_held  # bytes in both, roughly

    NONE = np.iinfo(np.int64).max

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(sym), self.NONE)  # of the pair that begins at a symbol
        if len(sym) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self._rank(sym[:-1], sym[1:]), self.NONE)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            if (done := low == self.NONE).any():
                flat = sym.astype("<u4").tobytes()
                for k in np.flatnonzero(done).tolist():
                    s = int(starts[k])
                    out[int(word[s])] = flat[4 * s : 4 * (s + int(size[k]))]
                stay = np.repeat(~done, size)
                sym, word, rank, low, size = sym[stay], word[stay], rank[stay], low[~done], size[~done]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, size)
            # In a run of neighbouring hits (one symbol repeated) every second one merges, counted from the run's start.
            at = np.flatnonzero(hit)
            fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new_at = at - np.arange(len(at))  # each earlier merge took one symbol away
            sym, word, rank = sym[keep], word[keep], rank[keep]
            mark = np.zeros(len(sym), bool)
            mark[new_at] = mark[np.maximum(new_at - 1, 0)] = True
            touched = np.flatnonzero(mark)
            nxt = np.minimum(touched + 1, len(sym) - 1)
            within = (touched + 1 < len(sym)) & (word[touched] == word[nxt])
            rank[touched] = np.where(within, self._rank(sym[touched], sym[nxt]), self.NONE)
        return out

    def _ids_of(self, texts: list[str], max_bytes: int = 2 << 20) -> list[bytes]:
        """The ids of texts without special tokens; only words not yet known are merged, a bounded number of bytes at a time."""
        split = [self.split.findall(t) for t in texts]
        todo: list[str] = []
        held = 0
        for w in {w for words in split for w in words if w not in self.words}:
            todo.append(w)
            held += len(w)
            if held >= max_bytes:
                self._learn(todo)
                todo, held = [], 0
        self._learn(todo)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _learn(self, words: list[str]) -> None:
        for w, ids in zip(words, self.merge_words([x.encode() for x in words]), strict=True):
            self.words[w] = ids
            self.held += len(w) + len(ids) + 200

    def _runs(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens.

        A space between two characters that aren't white space always begins a word, and no word reaches over it,
        so a text can be cut there and each piece be encoded and remembered alone. Texts with other white space beside
        a space are encoded whole.
        """
        if self.held > self.max_held:
            self.words.clear()
            self.after_space.clear()
            self.held = 0
        pieces = [t.split(" ") for t in texts]
        known = self.after_space
        unseen = list({p for own in pieces for p in own[1:]}.difference(known))
        plain = [p for p in unseen if p and not p[0].isspace() and not p[-1].isspace()]
        known.update(dict.fromkeys(unseen))  # None: needs its neighbours
        known.update(zip(plain, self._ids_of([" " + p for p in plain]), strict=True))
        self.held += sum(len(p) for p in unseen) + sum(len(known[p]) for p in plain) + 200 * len(unseen)
        heads = [own[0] if own[0] and not own[0][-1].isspace() else None for own in pieces]
        of_head = iter(self._ids_of([h for h in heads if h is not None]))
        out: list[bytes | None] = []
        for own, head in zip(pieces, heads, strict=True):
            first = next(of_head) if head is not None else None
            tail = [known[p] for p in own[1:]]
            out.append(None if first is None or None in tail else first + b"".join(tail))
        whole = iter(self._ids_of([t for t, ids in zip(texts, out, strict=True) if ids is None]))
        return [next(whole) if ids is None else ids for ids in out]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.at_special.split(t) if self.at_special and any(s in t for s in self.special) else [t] for t in texts]
        done = iter(self._runs([run for runs in cut for run in runs[::2]]))
        return [b"".join(self.special[run].to_bytes(4, "little") if k % 2 else next(done) for k, run in enumerate(runs)) for runs in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBPE:
    """One coder for each Python worker."""
    return ByteBPE(path)


def encode_column(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the token ids of a text column as an array of ints; a column named ``ids`` is replaced."""
    path = path or vocabulary_path()
    kept = [c for c in df.columns if c != ids]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{ids}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for rb in pieces(batches, text):
            flat = bpe.encode_batch(texts_of(rb, text))
            ends = np.cumsum([0, *(len(x) // 4 for x in flat)], dtype=np.int32)
            ids_col = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), "<i4")))
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in kept), ids_col], [*kept, ids])

    return df.select(*kept).mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of a column of token ids; null ids give the empty string."""
    path = path or vocabulary_path()
    kept = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for rb in batches:
            for start in range(0, rb.num_rows, 256):
                part = rb.slice(start, 256)
                out = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out, pa.string())], [*kept, text])

    return df.select(*kept).mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Round trip of every text: doc_id, n_tokens, and digests of the ids and of the decoded text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for rb in pieces(batches, "text"):
            flat = bpe.encode_batch(texts_of(rb, "text"))
            sha = [hashlib.sha256(x).hexdigest() for x in flat]
            back = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in flat]
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array([len(x) // 4 for x in flat], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLE_SQL: dict[str, str] = {}
