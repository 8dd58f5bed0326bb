"""Shards, fill-in-middle and periodic runs against plain versions; defined results on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.llm import common, infill, periodic, shards

D = "/root/testdata/sf0.001"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# Shards


def test_shards_of_the_table(spark):
    docs = pd.read_parquet(f"{D}/documents.parquet")
    got = shards.op11_shards(spark, D).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    want = {k: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all(want[k] == (size, crc) for k, size, crc in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and set(got.shard) <= set(range(40))
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))


def dealt(spark, rows, **deal):
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string, extra string")
    return shards.shuffled(df, shards.Deal(**deal)).collect()


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(k, f"text {k} " * (k % 7), "s", "e") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string, extra string")
    a, b = ({(r.doc_id, r.shard, r.slot) for r in shards.shuffled(x, shards.Deal(shards=7)).collect()} for x in (df.repartition(3), df.repartition(11).sortWithinPartitions(F.desc("doc_id"))))
    assert a == b
    assert a != {(r.doc_id, r.shard, r.slot) for r in shards.shuffled(df, shards.Deal(shards=7, seed=8)).collect()}


def test_shards_are_well_mixed(spark):
    got = dealt(spark, [(k, "x" * (k % 50), "s", "e") for k in range(4000)], shards=4)
    at = np.array([r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))])
    assert abs(np.corrcoef(at, np.arange(4000))[0, 1]) < 0.06
    assert 800 < sum(r.doc_id < 1000 and r.shard < 2 or r.doc_id >= 3000 and r.shard >= 2 for r in got) < 1200


def test_many_equal_rows_are_dealt_again(spark):
    rows = [(None, None, "s", "e")] * 700 + [(1, "é" * 400, "s", "e")] * 900 + [(k, f"t{k}", "s", "e") for k in range(800)]
    got = dealt(spark, rows, shards=5, bucket_bytes=1 << 14)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == list(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_few_and_no_rows(spark, tmp_path):
    assert sorted((r.shard, r.slot) for r in dealt(spark, [(1, "a", "s", "e"), (2, None, "s", "e")], shards=5)) == [(0, 0), (1, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shards.write_shards(empty, str(tmp_path / "none")).collect() == []


def test_written_files_hold_their_slots_in_order(spark, tmp_path):
    docs = common.table(spark, D, "documents")
    shards.write_shards(docs, str(tmp_path / "out"), shards.Deal(shards=3))
    for f in (tmp_path / "out").glob("shard=*/*.parquet"):
        assert pd.read_parquet(f).slot.is_monotonic_increasing
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_fisher_yates_is_a_fair_order():
    seen = Counter(tuple(shards.fisher_yates(3, [7, k])) for k in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
    assert list(shards.fisher_yates(0, [1])) == [] and list(shards.fisher_yates(1, [1])) == [0]


# Fill-in-middle


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "one\ntwo\n", "a\n\nb\r\nc\x85d e", "😀\né\n퟿ \U0010ffff\n", "has <P> mark\nx\n", "<S\n>", "ends <\n<P\n<M", "x\n" * 5000, "long " * 100_000, "\x00\n\x00",
    "same\nrow\n", "same\nrow\n",
]


def test_infill_of_odd_texts(spark):
    rows = [(None if k == 5 else k // 2, t, "old", "e") for k, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, extra string")
    got = infill.restore(infill.transform(df)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.extra) for r in got) == Counter((k, *plain_infill(k, t), "e") for k, t, _, _ in rows)
    assert all(r.restored == (r.text or "") for r in got)


def test_infill_of_the_table(spark):
    docs = pd.read_parquet(f"{D}/documents.parquet")
    got = {r.doc_id: r for r in infill.op12_infill(spark, D).collect()}
    for k, t in zip(docs.doc_id, docs.text, strict=True):
        n, form, p, m, out = plain_infill(k, t)
        r = got[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(t or ""))


@pytest.mark.parametrize(
    ("units", "text", "want"),
    [
        (infill.WORDS, "  one two\t\tthree 😀 ", ["  ", "one ", "two\t\t", "three ", "😀 "]),
        (infill.SENTENCES, "A b. C? D.E! f", ["A b. ", "C? ", "D.E! ", "f"]),
        (infill.PARAGRAPHS, "a\nb\n\n\nc\n\nd", ["a\nb\n\n\n", "c\n\n", "d"]),
        (infill.LINES, "", []),
    ],
)
def test_unit_grammars(spark, units, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(infill.split_units(F.col("text"), units).alias("u")).first().u == want
    made = infill.restore(infill.transform(df.withColumn("doc_id", F.lit(3)), units, seed=1)).first()
    assert made.restored == text and made.n == len(want)


def test_infill_rates(spark):
    df = spark.createDataFrame([(k, "a\nb\nc") for k in range(400)], "doc_id long, text string")
    forms = Counter(r.form for r in infill.transform(df, fim_percent=50, spm_percent=0).collect())
    assert set(forms) == {"plain", "psm"} and 140 < forms["psm"] < 260
    assert infill.transform(df.limit(0)).collect() == []


# Periodic runs


def plain_runs(w):
    """All stretches by each period, longest ones, and of equal stretches the smallest period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(s <= i and i + length <= s + x and q % p == 0 for s, x, p in out):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(3)
    for k in range(600):
        letters = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            piece = [rng.randrange(letters + 3) for _ in range(rng.randrange(1, 30))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (piece * 9)[: rng.randrange(len(piece) * 9)]
        assert periodic.runs_of(np.array(w, np.int64)) == plain_runs(w), (k, w)


def test_runs_in_runs_and_long_texts():
    inner = [1] * 8 + [2]
    w = ([*inner * 5, 3] * 6) + list(range(10, 90))
    assert periodic.runs_of(np.array(w, np.int64)) == plain_runs(w)
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    period = np.random.Generator(np.random.PCG64(1)).integers(0, 1000, 70_001)
    assert periodic.runs_of(np.tile(period, 4)) == [(0, 280_004, 70_001)]
    assert periodic.runs_of(np.arange(300_000)) == []


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, x, q in runs for i in range(s + q, s + x)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{x},{q}\n" for s, x, q in runs)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_of_the_table(spark):
    docs = pd.read_parquet(f"{D}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in periodic.op13_periodic(spark, D).collect()}
    short = [(k, t) for k, t in zip(docs.doc_id, docs.text, strict=True) if len((t or "").split()) < 3000]
    assert len(got) == len(docs) and len(short) > 150
    assert any(got[k][0] for k, _ in short)
    for k, t in short:
        assert got[k] == plain_report(k, t)


def test_detect_on_odd_rows(spark):
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b " * 4, "x x " * 6, "a b a b a b a b c c c c c c", "a b a b a b a b c c c c c c"]
    df = spark.createDataFrame([(None if k == 1 else f"id{k}", t, "old", "e") for k, t in enumerate(texts)], "doc_id string, text string, runs string, extra string")
    got = periodic.detect(df).collect()
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert (r.n_words, [tuple(x) for x in r.runs], r.extra) == (len(words), plain_runs(words), "e")
    assert {r.doc_id: r.collapsed for r in got}["id8"] == "a b c"
    assert periodic.detect(df.limit(0)).collect() == []
    assert periodic.planted(None, np.arange(5)).tolist() == list(range(5))


# Mended operators


def test_letters_never_learned_still_get_a_language(spark):
    from tessella.llm import langid

    learned = langid.prototypes(spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund liegt im gras", "de")], "text string, lang string"))
    rng = random.Random(5)
    scripts = [(0x4E00, 0x9FA5), (0x0400, 0x044F), (0x05D0, 0x05EA), (0x0E01, 0x0E2E)]
    texts = ["".join(chr(rng.randint(*rng.choice(scripts))) for _ in range(rng.randrange(1, 40))) for _ in range(200)] + ["", None, "12 - 34", "é"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learned).collect()
    for r in got:
        has_letter = any(map(str.isalpha, texts[r.doc_id] or ""))
        assert (r.lang_pred in ("de", "en")) == has_letter and (has_letter or (r.lang_pred == "und" and r.score == 0)) and 0 <= r.score <= 1


def test_tokens_of_rows_with_string_ids(spark):
    from tessella.llm import bpe

    got = bpe.encode_decode(spark.createDataFrame([("a", "hello world"), (None, None)], "doc_id string, text string")).collect()
    assert {r.doc_id: (r.n_tokens > 0, r.decoded_sha256) for r in got} == {"a": (True, sha("hello world")), None: (False, sha(""))}
