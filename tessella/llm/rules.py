"""Line-first quality rules.

Each line of a text is judged alone: it fails as a copy of an earlier line (long ones only), as navigation (by its words, unless it ends a sentence, or
by separators between short entries without a sentence's end, in any language), as boilerplate (phrases that are a good share of its words, so prose that mentions one stays), as shouting, or for its
punctuation and symbols. Words and phrases are those of English, German, French and Spanish pages; others can be given. Failing lines are removed. A document is rejected if it
fails the base rule over its whole text (too few words, or too many words in repeated three-word windows), or if it
loses too large a share of its words with the removed lines.

Words are runs of ``[^\\x20\\x09-\\x0D]``; lines end at ``\\n`` only.

Defined results: null counts as empty; a text without words fails the base rule; lines without words are neither
counted nor judged and stay; texts and lines of any length are judged whole; repeated rows give repeated results; an empty table
gives an empty result; extra columns are kept by :func:`clean`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, texts_of

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"
_NAVIGATION = frozenset(
    "home menu login sign in up log out next previous prev back top search share tweet print subscribe contact about privacy terms sitemap help cookies read more skip to content "
    "startseite menü anmelden registrieren weiter zurück suche teilen drucken kontakt über uns impressum datenschutz hilfe mehr lesen "
    "accueil connexion suivant précédent retour recherche partager imprimer contactez nous propos confidentialité aide lire suite "
    "inicio menú entrar registrarse siguiente anterior volver buscar compartir imprimir contacto nosotros privacidad ayuda leer más".encode().split()
)
_BOILERPLATE = tuple(
    x.encode()
    for x in (
        "all rights reserved", "lorem ipsum", "javascript", "enable javascript", "cookie policy", "terms of use", "privacy policy", "click here", "subscribe to our newsletter", "page not found", "copyright (c)", "©",
        "alle rechte vorbehalten", "datenschutzerklärung", "cookie-richtlinie", "hier klicken", "seite nicht gefunden", "newsletter abonnieren",
        "tous droits réservés", "politique de confidentialité", "politique de cookies", "cliquez ici", "page introuvable", "abonnez-vous",
        "todos los derechos reservados", "política de privacidad", "política de cookies", "haga clic aquí", "página no encontrada", "suscríbase",
    )
)
_SEPARATORS = frozenset(x.encode() for x in ("|", "||", ">", ">>", "»", "›", "·", "•", "::", "/"))
_STOPS = (b".", b"!", b"?")
_CLOSING = tuple(x.encode() for x in (".", "!", "?", "…", ":", ";", "\"", "”", "»", ")"))


@dataclass(frozen=True)
class LineRules:
    """Thresholds; shares are of a line's characters or words, or of a document's words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    line_min_words: int = 5  # shorter lines are judged as navigation and boilerplate only
    max_symbol_share: float = 0.08  # of _SYMBOLS
    max_mark_share: float = 0.30  # of all ASCII punctuation
    max_repeat_share: float = 0.60  # of a line's words in its repeated three-word windows
    max_upper_share: float = 0.80  # of ASCII letters
    copy_min_words: int = 5
    max_lost_share: float = 0.50  # of a document's words, in removed lines
    min_phrase_share: float = 0.20  # of a line's words, in phrases of boilerplate
    min_separators: int = 2  # words that only separate, in a line of navigation
    max_entry_words: float = 3.0  # words between them, on average
    navigation: frozenset[bytes] = _NAVIGATION
    boilerplate: tuple[bytes, ...] = _BOILERPLATE


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    if len(ids) == len(words):
        return 0
    k = len(ids)  # k**3 < 2**63 for fewer than two million different words
    if k < 2_000_000:
        key = (w[:-2] * k + w[1:-1]) * k + w[2:]
    else:
        _, pair = np.unique(w[:-1] * k + w[1:], return_inverse=True)
        key = pair[:-1].astype(np.int64) * k + w[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.r_[False, same] | np.r_[same, False]
    at = order[again]
    hit = np.zeros(len(w), bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))


def _left(line: bytes, drop: bytes) -> int:
    return len(line) - len(line.translate(None, drop))


def line_fault(line: bytes, words: list[bytes], rules: LineRules) -> str | None:
    """Why a line with words goes, or None."""
    low = line.lower()
    between = sum(w in _SEPARATORS for w in words)
    if between >= rules.min_separators and len(words) - between <= rules.max_entry_words * (between + 1) and not words[-1].endswith(_CLOSING):
        return "navigation"
    if len(words) <= 12 and not words[-1].endswith(_STOPS) and all(w.strip(b"|>-/.,:;") in rules.navigation or not w.strip(b"|>-/.,:;") for w in low.split()):
        return "navigation"
    phrases = [x for x in rules.boilerplate if x in low] if len(words) <= 30 else []
    if phrases and sum(low.count(x) * len(x.split()) for x in phrases) >= rules.min_phrase_share * len(words):
        return "boilerplate"
    if len(words) < rules.line_min_words:
        return None
    body = sum(map(len, words))
    if _left(line, _SYMBOLS) > rules.max_symbol_share * body or _left(line, _MARKS) > rules.max_mark_share * body:
        return "punctuation"
    upper = _left(line, _UPPER)
    if upper > rules.max_upper_share * (upper + _left(line, _LOWER)) and upper > 20:
        return "shouting"
    if len(words) >= 12 and repeated_words(words) > rules.max_repeat_share * len(words):
        return "repetition"
    return None


@dataclass
class Judged:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    text: str
    removed: Counter


def judge(text: str, rules: LineRules) -> Judged:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    repeat = repeated_words(words)
    base_failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    seen: set[bytes] = set()
    dups = lost = 0
    stay: list[bytes] = []
    why: Counter = Counter()
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            stay.append(line)
            continue
        fault = None
        if line in seen:
            dups += 1
            if len(own) >= rules.copy_min_words:
                fault = "copy"
        else:
            seen.add(line)
        fault = fault or line_fault(line, own, rules)
        if fault:
            lost += len(own)
            why[fault] += 1
        else:
            stay.append(line)
    kept = not base_failed and lost <= rules.max_lost_share * n
    chars = len(text) - _left(raw, _SPACE)
    return Judged(n, chars, _left(raw, _SYMBOLS), dups, repeat, base_failed, kept, b"\n".join(stay).decode(), why)


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_removed_lines long"
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]


def _row(j: Judged) -> tuple:
    return j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed, j.kept, sum(j.removed.values())


def report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row a document: doc_id and its figures; texts don't leave the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in pieces(batches, "text"):
            columns = zip(*(_row(judge(t, rules)) for t in texts_of(rb, "text")), strict=True)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], ["doc_id", *(x.split()[0] for x in _FIGURES.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FIGURES}")


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents without their failing lines, columns as they were; n_chars, if there, is counted anew."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in pieces(batches, "text"):
            done = [judge(t, rules) for t in texts_of(rb, "text")]
            mask = pa.array([j.kept for j in done])
            new = pa.array([j.text for j in done], pa.string())
            columns = [new if c == "text" else rb.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(mask)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE_SQL: dict[str, str] = {}
