"""Near-duplicates against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np

from tessella.llm import neardup


def brute(rows):
    """component_id of each row, by its place."""
    sets = [set(neardup.shingles(t or "").tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return [min((k for k in groups[find(i)] if k is not None), default=None) for i in range(len(rows))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**9)}"
    return " ".join(out)


def check(spark, rows, columns="doc_id long, text string"):
    out = neardup.components(spark.createDataFrame(rows, columns)).collect()
    want = sorted(zip((r[0] for r in rows), brute([(r[0], r[1]) for r in rows]), strict=True), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return out


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Buckets far above the bound, with members on both sides of the threshold, chains and variants of variants."""
    monkeypatch.setattr(neardup, "DIRECT", 4)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(5)
    rows, k = [], 0
    for _ in range(2):
        base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
        for n in [0, 1, 2, 3, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 10] * 3:
            words = edited(rng, base, n).split()
            rows.append((k, " ".join(words)))
            k += 1
            if n in (6, 8):  # variants that link with their parent, not with the base
                for _ in range(2):
                    rows.append((k, edited(rng, words, 2)))
                    k += 1
    passage = " ".join(f"p{j}" for j in range(60))
    for size in (5, 10, 20, 30, 60, 90) * 4:
        rows.append((k, passage + " " + " ".join(f"x{rng.randrange(10**9)}" for _ in range(size))))
        k += 1
    check(spark, rows)


def test_defined_results(spark):
    text = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, text), (4, text), (5, text.upper()), (6, "two words"), (7, "two words"), (8, "words two"), (None, text), (9, "Ä b c d e"), (10, "ä b c d e")]
    out = check(spark, rows)
    assert {r.n_shingles for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert next(r for r in out if r.doc_id == 4).n_shingles == 3


def test_empty_table_and_extra_columns(spark):
    assert neardup.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", "n1", b"h"), (2, "a b c d e f", "n2", b"g"), (2, "a b c d e f", "n2", b"g"), (3, None, None, None)], "doc_id long, text string, node string, hub binary")
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_repeated_id_is_kept_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v w")], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.deduplicate(docs).collect()) == [1, 2]


def test_texts_are_kept_by_component_not_by_id(spark):
    """Null ids, one id with texts of its own, an id that is kept in one component and lost in another, rows without words."""
    base = [f"b{j}" for j in range(60)]
    near = " ".join([*base[:-1], "other"])
    rows = [
        (None, "a b c d e f g"), (None, "h i j k l m n"), (None, "h i j k l m n"), (None, "H I j k l m n"), (1, "o p q r s t u"), (1, "v w x y z a b"), (1, "v w x y z a b"),
        (3, " ".join(base)), (5, near), (5, "its own text of this row"), (None, " ".join(base)), (None, None), (None, ""), (7, " \t"), (7, " \t"), (7, "c c d d e e"), (7, "C c d d e e"),
    ]
    docs = spark.createDataFrame([(k, t, f"r{n}") for n, (k, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text) if r.text and r.text.strip() else (r.doc_id, "") for r in neardup.deduplicate(docs).collect() if r.doc_id is not None and r.doc_id != 7)
    assert got == sorted([(1, "o p q r s t u"), (1, "v w x y z a b"), (3, " ".join(base)), (5, "its own text of this row")])
    rest = [(r.doc_id, (r.text or "").strip().lower()) for r in neardup.deduplicate(docs).collect() if r.doc_id in (None, 7)]
    assert sorted(rest, key=str) == sorted([(None, "a b c d e f g"), (None, "h i j k l m n"), (None, ""), (None, ""), (7, ""), (7, ""), (7, "c c d d e e")], key=str)


def test_overlaps_count_shared_shingles():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (0, 1, 30, 200, 350, 90)]
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:3]]
    assert neardup.overlaps(sets[:3], sets[2:]).tolist() == want


def test_a_group_above_the_bound_is_settled_in_its_buckets(spark, monkeypatch):
    for name, value in (("DIRECT", 3), ("GROUP", 10), ("BLOCK", 4)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(8)
    base = [f"b{j}" for j in range(150)]
    check(spark, [(k, edited(rng, base, k % 9)) for k in range(60)])
