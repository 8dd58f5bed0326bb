"""BPE, rules, decontamination, language and quality against plain versions; defined results on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import bpe, decontam, langid, quality, rules

D = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "é😀 <|endoftext|> x  y\u00a0\n", "word " * 5000, "x" * 30000, "A\x1cB\x85C", "A\x1cB\x85C"]


def odd(spark, ids="doc_id long"):
    rows = [(k if k != 5 else None, t, "en", f"q{k}") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, f"{ids}, text string, lang string, n_words string")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.vocabulary_path())


def ids_of(reference, text):
    return np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_query(spark, docs, reference):
    got = {r.doc_id: r for r in bpe.op7_bpe(spark, D).collect()}
    assert len(got) == len(docs)
    for k, t in zip(docs.doc_id, docs.text, strict=True):
        ids = ids_of(reference, t)
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_any_text(text):
    b = bpe.coder(bpe.vocabulary_path())
    t = Tokenizer.from_file(bpe.vocabulary_path()) if not hasattr(test_bpe_any_text, "t") else test_bpe_any_text.t
    test_bpe_any_text.t = t
    assert b.encode_batch([text])[0] == ids_of(t, text)
    assert b.decode(ids_of(t, text)) == t.decode(t.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_bpe_odd_rows(spark, reference):
    got = bpe.encode_decode(odd(spark)).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(ids_of(reference, t or "")) // 4 for t in ODD)
    back = bpe.decode_column(bpe.encode_column(odd(spark))).collect()
    assert all(r.decoded == (r.text or "") for r in back) and back[0].n_words == "q0"
    assert bpe.encode_decode(odd(spark).limit(0)).count() == 0


def plain_rules(t):
    t = t or ""
    words = re.findall(r"[^ \t-\r]+", t)
    hit = set()
    where = {}
    for k in range(len(words) - 2):
        where.setdefault(tuple(words[k : k + 3]), []).append(k)
    for at in where.values():
        if len(at) > 1:
            hit |= {k + j for k in at for j in range(3)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^ \t-\r]", line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dups, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_rules_query(spark, docs):
    labels = pd.read_parquet(f"{D}/labels.parquet").set_index("doc_id").quality
    got = {r.doc_id: r for r in rules.op4_quality_rules(spark, D).collect()}
    for k, t in zip(docs.doc_id, docs.text, strict=True):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_rules(t)
        if k in labels.index and not r.base_failed:
            assert r.kept == bool(labels[k])


def test_rules_odd_rows(spark):
    got = rules.report(odd(spark)).collect()
    assert sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)) == sorted(plain_rules(t) for t in ODD)
    assert rules.clean(odd(spark)).columns == odd(spark).columns
    body = "\n".join(" ".join(f"w{k}{j}" for j in range(12)) for k in range(8))
    page = spark.createDataFrame([(1, f"Home | About | Contact\n{body}\nAll rights reserved.", 0)], "doc_id long, text string, n_chars int")
    row = rules.clean(page).first()
    assert row.text == body and row.n_chars == len(body)


def plain_kept(t):
    """The verdict, line by line, on decoded text."""
    t, r = t or "", rules.LineRules()
    split = lambda x: re.findall(r"[^ \t-\r]+", x)
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    ascii_marks = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    navigation, boilerplate = {x.decode() for x in r.navigation}, [x.decode() for x in r.boilerplate]
    seen, lost = set(), 0
    for line in t.split("\n"):
        words, low = split(line), lower(line)
        n = len(words)
        if not n:
            continue
        bad = line in seen and n >= 5
        seen.add(line)
        cuts = sum(w in ("|", "||", ">", ">>", "»", "›", "·", "•", "::", "/") for w in words)
        bad |= cuts >= 2 and n - cuts <= 3 * (cuts + 1) and words[-1][-1] not in ".!?…:;\"”»)"
        bad |= n <= 12 and split(low)[-1][-1] not in ".!?" and all(w.strip("|>-/.,:;") in {*navigation, ""} for w in split(low))
        bad |= n <= 30 and any(x in low for x in boilerplate) and 5 * sum(len(x.split()) * low.count(x) for x in boilerplate) >= n
        if n >= 5:
            size = sum(len(w.encode()) for w in words)
            bad |= sum(c in "#*$%&|<>" for c in line) > 0.08 * size or sum(c in ascii_marks for c in line) > 0.3 * size
            upper, small = len(re.findall("[A-Z]", line)), len(re.findall("[a-z]", line))
            bad |= upper > 20 and upper > 0.8 * (upper + small)
            bad |= n >= 12 and plain_rules(line)[4] > 0.6 * n
        lost += n * bad
    return not plain_rules(t)[5] and lost <= 0.5 * len(split(t))


def test_a_phrase_in_prose_is_no_boilerplate():
    prose = [
        "The course starts with JavaScript because most of its students have already written some of it", "Our editors asked whether the new law makes a privacy policy longer than it was before",
        "He went in to.", "In. to.", "She had read nothing about the terms of use that the two towns once agreed on",
    ]
    waste = ["All rights reserved.", "© 2024 Example Corp.", "Please enable JavaScript to view this page.", "Privacy policy | Terms of use", "Read our privacy policy and click here to subscribe", "Home About Contact"]
    fault = lambda x: rules.line_fault(x.encode(), x.encode().split(), rules.LineRules())
    assert [fault(x) for x in prose] == [None] * len(prose) and [fault(x) for x in waste] == ["boilerplate"] * 5 + ["navigation"]


def test_kept_is_the_plain_verdict(spark, docs):
    menu = "\n".join(["Start | Über uns | Kontakt", "Home > Shop > Shoes", "a · b · c"] * 3)
    body = "\n".join(" ".join(f"w{k}{j}" for j in range(12)) for k in range(8))
    more = [f"{menu}\n{body}", f"{body}\n" + "\n".join(f"entry{k} one two | three four five | six seven eight {k}" for k in range(30)), f"{body}\nHe said yes | no | maybe.", None, ""]
    texts = [*docs.text, *more]
    got = {r.doc_id: r.kept for r in rules.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == [plain_kept(t) for t in texts]
    assert [got[len(docs) + k] for k in range(5)] == [True, False, True, False, False]


def plain_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, own = find(text), set(), set()
    for item, t in items:
        w = find(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            win = w[k : k + 10]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    own.add(str(item))
    return len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    long = " ".join(f"t{k}" for k in range(30))
    items = [(1, "alpha beta gamma"), (2, long), (3, None), (4, "..."), (5, long), (10, "Éa b")]
    texts = [None, "", "x ALPHA, beta-gamma y", "alpha betagamma", long[:20], f"pre {long} post {long}", " ".join(f"t{k}" for k in range(5, 17)), "éa b", "Éa-B", "alpha beta gamma alpha beta gamma"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [plain_hits(t, items) for t in texts]
    for bound in (decontam.MAX_PATTERN_BYTES, 50):
        found = decontam.scan(docs, bench, max_pattern_bytes=bound).orderBy("doc_id").collect()
        assert [(r.n_words, sum(x["end"] - x["first"] for x in r.ranges), len(r.items)) for r in found] == [w[:3] for w in want]
    got = decontam.report(docs, bench).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == want
    s = next(r for r in found if r.doc_id == 2)
    assert [texts[2][x["start"] : x["end"]] for x in s.spans] == ["ALPHA, beta-gamma"]
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(texts)
    assert decontam.decontaminate(odd(spark), bench).columns == odd(spark).columns


def test_items_without_an_id_hit_words(spark):
    items = [(None, "alpha beta gamma"), (7, "delta epsilon zeta"), (None, None)]
    texts = ["x alpha beta gamma y", "delta epsilon zeta", "alpha beta gamma delta epsilon zeta", "clean"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    none, seven = (hashlib.sha256(x).hexdigest() for x in (b"", b"7"))
    got = [tuple(r)[2:] for r in decontam.report(docs, bench).orderBy("doc_id").collect()]
    assert got == [(3, 0, none, True), (3, 1, seven, True), (6, 1, seven, True), (0, 0, none, False)]
    for bound in (decontam.MAX_PATTERN_BYTES, 50):
        assert [r.doc_id for r in decontam.decontaminate(docs, bench, max_pattern_bytes=bound).collect()] == [3]
    blocks = decontam.scan(docs, bench, max_pattern_bytes=50).orderBy("doc_id").collect()
    assert [(sum(x["end"] - x["first"] for x in r.ranges), list(r["items"])) for r in blocks] == [(3, []), (3, ["7"]), (6, ["7"]), (0, [])]


def test_language(spark, docs):
    got = langid.op9_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "123 !", "the"])], "doc_id long, text string")
    learned = langid.prototypes(spark.createDataFrame([("the cat", "en"), ("der hund", "de"), ("x", None), (None, "fr")], "text string, lang string"))
    assert sorted(learned) == ["de", "en"]
    assert [r.lang_pred for r in langid.predict(frame, learned).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]
    assert {r.lang_pred for r in langid.predict(frame, {}).collect()} == {"und"}


def test_bundles_are_sums():
    sp = langid.Space(64)
    one = langid.bundle(["abc", "hello world"], sp)
    both = langid.bundle(["abc", "hello world"], sp, np.array([0, 0]), 1)
    assert (one.sum(0) == both[0]).all() and (langid.bundle(["ABC"], sp) == one[:1]).all()


def test_quality(spark):
    got = quality.op2_quality(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.quality == held.predicted).mean() > 0.95 and got.score.between(0, 1).all()
    feats = quality.features(odd(spark))
    none = quality.fit(feats.limit(0).selectExpr("f", "1 label"))
    assert {r.score for r in quality.score(feats, none).collect()} == {0.5}
    one = quality.fit(feats.selectExpr("f", "1 label"))
    assert {r.predicted for r in quality.score(feats, one).collect()} == {1}


def test_discriminant_is_the_posterior():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    x = {c: rng.normal(c, 1 + c, (4000, d)) for c in (0, 1)}
    m = quality.discriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()}, shrink=0.0)
    f = np.concatenate([x[0][:50], x[1][:50]])
    logs = [-0.5 * ((f - c) ** 2).sum(1) / (1 + c) ** 2 - d * np.log(1 + c) for c in (0, 1)]
    assert np.corrcoef(m.score(f), 1 / (1 + np.exp(logs[0] - logs[1])))[0, 1] > 0.99


def plain_vector(text, dim, cache={}):  # noqa: B006
    """The sum of bound letters over all windows, one window at a time."""
    letter = lambda c: np.random.Generator(np.random.Philox(key=c)).integers(0, 2, dim, np.int8).astype(int) * 2 - 1
    codes = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    out = np.zeros(dim)
    for w in zip(codes, codes[1:], codes[2:], strict=False):
        if w[1]:
            if w not in cache:
                cache[w] = np.roll(letter(w[0]), 2) * np.roll(letter(w[1]), 1) * letter(w[2])
            out += cache[w]
    return out


def test_language_scores_are_the_plain_cosines(spark, docs):
    """The whole query, ties and empty texts included."""
    crc = [zlib.crc32(str(k).encode()) % 4 for k in docs.doc_id]
    made = [plain_vector(t or "", langid.DIM) for t in docs.text]
    sums = {}
    for v, lang, rest in zip(made, docs.lang, crc, strict=True):
        if rest != 2 and lang is not None:
            sums[lang] = sums.get(lang, 0) + v
    names = sorted(sums)
    protos = np.stack([sums[x] / np.linalg.norm(sums[x]) for x in names])
    got = {r.doc_id: r for r in langid.op9_language_id(spark, D).collect()}
    for k, v, rest in zip(docs.doc_id, made, crc, strict=True):
        r, size = got[k], np.linalg.norm(v)
        assert r.held_out == (rest == 2)
        if not size:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cos = protos @ v / size
        assert abs(r.score - max(0, cos.max())) < 1e-6 and cos[names.index(r.lang_pred)] > cos.max() - 1e-9
    assert langid.predict(docs_frame := spark.createDataFrame([], "doc_id long, text string"), {}).count() == 0 and langid.prototypes(docs_frame.selectExpr("text", "text lang")) == {}
    same = langid.prototypes(spark.createDataFrame([("abc", "b"), ("abc", "a")], "text string, lang string"))
    assert [r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), same).collect()] == ["a"]


def plain_statistics(t):
    words = re.findall(r"[^ \t-\r]+", t)
    if not words:
        return [0.0] * 13
    n, raw = len(words), t.encode()
    body = sum(len(w.encode()) for w in words) + 60
    share = lambda ok: sum(map(ok, t)) / body
    mark = lambda c: "!" <= c <= "~" and not c.isalnum()
    lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
    return [
        np.log(1 + n), np.log(body / (n + 12)), share(lambda c: c in "#*$%&|<>") ** 0.5, share(mark) ** 0.5, share(lambda c: "A" <= c <= "Z") ** 0.5, share(lambda c: "0" <= c <= "9") ** 0.5,
        plain_rules(t)[4] / (n + 12), np.log((n + 12) / (len(set(words)) + 12)), ((max(map(words.count, set(words))) - 1) / (n + 12)) ** 0.5,
        (len(lines) - len(set(lines))) / (len(lines) + 3), sum(mark(w[-1]) for w in words) / (n + 12), np.log((n + 12) / (len(lines) + 1)), (sum(b > 127 for b in raw) / body) ** 0.5,
    ]


def test_quality_scores_are_the_plain_densities(spark, docs):
    """The whole query from plain statistics, covariances and solved systems."""
    labels = pd.read_parquet(f"{D}/labels.parquet").set_index("doc_id").quality
    f = np.array([plain_statistics(t or "") for t in docs.text])
    rest = np.array([zlib.crc32(str(k).encode()) % 5 for k in docs.doc_id])
    label = np.array([labels.get(k, -1) for k in docs.doc_id])
    learn = (rest != 0) & (label >= 0)
    pooled = np.diag(f[learn].var(0).clip(1e-4))
    logs = []
    for c in (0, 1):
        own = f[learn & (label == c)]
        d = own - own.mean(0)
        a = (0.2 * len(own) + 13) / (len(own) + 13)
        cov = (1 - a) * d.T @ d / len(own) + a * pooled + 1e-4 * np.eye(13)
        z = f - own.mean(0)
        logs.append(np.log(len(own) / learn.sum()) - 0.5 * (z * np.linalg.solve(cov, z.T).T).sum(1) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    got = quality.op2_quality(spark, D).toPandas().set_index("doc_id").loc[docs.doc_id]
    assert (got.held_out.to_numpy() == (rest == 0)).all() and np.abs(got.score.to_numpy() - want).max() < 1e-6
    assert (got.predicted == (got.score >= 0.3)).all()
