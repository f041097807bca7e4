"""Whitening, manifest and language identification against brute force, and on odd tables; cases once missed elsewhere."""

import hashlib
import math
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import edit_embedding, language, line_alignment, merkle, whitening
from tidewatch.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


# --- whitening

VECTORS = "vec_id long, embedding array<double>, n int, component string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS).repartition(3)


def whitened(spark, rows):
    table = vectors(spark, rows)
    model = whitening.fit(table)
    return model, sorted(whitening.whiten(table, model).collect(), key=lambda r: (r.vec_id is not None, r.vec_id or 0, r.component))


def exact(rows):
    """Deviations, eigenvalues and vectors by exact centring and an eigensolver."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in rows]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    gaps = [[n * a - s for a, s in zip(row, sums)] for row in x]
    centred = np.array(gaps, dtype=float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return [sum(g * g for g in row) for row in gaps], centred, values[::-1], basis[:, ::-1]


def agrees(found, rows, components):
    deviations, centred, values, basis = exact(rows)
    want = centred @ basis[:, :components] / np.sqrt(values[:components])
    got = np.array([r.whitened for r in found]).reshape(len(rows), -1)[:, :components]
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-7
    assert [r.deviation for r in found if r.component == 1] == [v if v < 1 << 63 else None for v in deviations]
    for r in found:
        if r.component <= components:
            assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9 and r.n == len(rows)


@needs_tables
def test_whitening_agrees_with_an_eigensolver_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    rows = sorted((i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v))
    found = sorted(QUERIES["op11_embedding_whitening"](spark, FOLDER).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in found] == [(i, k) for i, _ in rows for k in range(1, 9)]
    agrees(found, [v for _, v in rows], 8)


def test_whitening_leaves_broken_vectors_out_and_keeps_repeats(spark):
    draw = np.random.default_rng(5)
    sound = [(k, draw.normal(size=3).tolist()) for k in range(40)]
    sound += [sound[7], sound[7], (None, sound[3][1])]
    broken = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, math.nan, 2.0]), (103, [math.inf, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    model, found = whitened(spark, sound + broken)
    kept = sorted(sound, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.vec_id for r in found if r.component == 1] == [i for i, _ in kept]
    assert model.n == 43
    cells = defaultdict(list)
    for r in found:
        cells[(r.vec_id, r.component)].append(r)
    # Rows of one id are equal here, so any order of them will do.
    ordered = [cells[(i, c)].pop() for i, _ in kept for c in (1, 2, 3)]
    agrees(ordered, [v for _, v in kept], 3)


def test_whitening_without_spread(spark):
    constant = [(k, [1.0, 2.0]) for k in range(5)]
    model, found = whitened(spark, constant)
    assert len(found) == 10 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in found)
    assert all(r.identity_error is None for r in found)
    # One line in three dimensions: one component with spread.
    draw = np.random.default_rng(2).integers(-50, 50, 30).tolist()
    model, found = whitened(spark, [(k, [float(t), 2.0 * t, -1.0 * t]) for k, t in enumerate(draw)])
    assert model.with_spread == 1 and model.identity_error < 1e-9
    assert all((r.whitened is None) == (r.component > 1) for r in found)
    assert {r.explained for r in found if r.component > 1} == {0.0}
    assert all(r.explained == pytest.approx(1.0) for r in found if r.component == 1)
    empty = vectors(spark, [])
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0
    broken = vectors(spark, [(1, None), (2, [None])])
    assert whitening.whiten(broken, whitening.fit(broken)).count() == 0


def test_whitening_of_badly_scaled_and_huge_entries(spark):
    draw = np.random.default_rng(9)
    base = draw.normal(size=(200, 4)) * np.array([1e6, 1e2, 1.0, 0.05])
    base[:, 1] += base[:, 0] * 3
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    model, found = whitened(spark, rows)
    assert len(model.triangles) > 1
    agrees(found, [v for _, v in rows], 4)
    huge = [(k, [1e300 * (-1) ** k, float(k)]) for k in range(6)]
    _, found = whitened(spark, huge)
    assert len(found) == 12 and all(r.deviation is None for r in found)


# --- manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests, fanout):
    paths, groups = [[] for _ in digests], [[k] for k in range(len(digests))]
    while len(digests) > 1:
        above, wider = [], []
        for start in range(0, len(digests), fanout):
            run = digests[start:start + fanout]
            for k in range(len(run)):
                for member in groups[start + k]:
                    paths[member].append((run[:k], run[k + 1:]))
            above.append(h(*run))
            wider.append(sum(groups[start:start + fanout], []))
        digests, groups = above, wider
    return digests[0], paths


def audited(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r.lang].append((r.doc_id, h(*[written(r[c]) for c in merkle.COLUMNS]), r))
    langs = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    below = {}
    for lang in langs:
        by[lang].sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        below[lang] = tree([t[1] for t in by[lang]], fanout)
    root, tops = tree([below[lang][0] for lang in langs], fanout)
    out = []
    for lang, top in zip(langs, tops):
        for (i, leaf, r), path in zip(by[lang], below[lang][1]):
            path, other = path + top, leaf
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r.n_chars is not None:
                other = h(*[written(r[c] + 1 if c == "n_chars" else r[c]) for c in merkle.COLUMNS])
            proof = h(*[x for step in path for side in step for x in side])
            for before, after in path:
                other = h(*before, other, *after)
            out.append((i, leaf, below[lang][0], root, proof, other, other == root))
    return sorted(out, key=str)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, path string, i string"
ODD = [
    (1, "one", "en", "a", 3), (2, "two", "en", "a", 2 ** 63 - 1), (2, "two", "en", "a", 2 ** 63 - 1), (2, "other", "en", "a", 5),
    (None, "no id", "en", None, 5), (None, "no id", "en", None, 5), (3, None, None, None, None), (4, "", "", "a", 0),
    (5, "long é " * 40000, "fr", "b", 0), (6, "x", "ß", "b", 1), (7, "y", "z", "b", None), (-8, "minus", "en", "1:a", 5),
    (2 ** 53 + 1, "far", "en", "a", 3), (2 ** 53 + 2, "far", "en", "a", 3),
] + [(k, f"text {k}", None, "c", k) for k in range(20, 60)]


@pytest.mark.parametrize("fanout,levels", [(2, 8), (2, 2), (3, 1), (5, 2)])
def test_manifest_agrees_with_brute_force_on_odd_rows(spark, fanout, levels):
    table = spark.createDataFrame([r + ("x", 1, "p", "q") for r in ODD], DOCUMENTS).repartition(4)
    found = merkle.audit(table, fanout, levels).collect()
    assert sorted(map(tuple, found), key=str) == audited(table.collect(), fanout)
    assert not all(r.verified for r in found) and any(r.verified for r in found)


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([ODD[0] + ("x", 1, "p", "q")], DOCUMENTS)
    found = merkle.audit(one).first()
    assert found.leaf == found.subroot == found.root == found.folded_root and found.proof_sha256 == h()
    assert merkle.audit(one.limit(0)).count() == 0
    carried = merkle.manifest(one, carry=("path", "n_chars")).first()
    assert (carried.path, carried.n_chars, carried.proof) == ("p", 3, [])


@needs_tables
def test_manifest_query_agrees_with_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, FOLDER).collect()), key=str) == audited(rows, 2)


# --- language

def presence(text):
    """The n-grams of a text for each length, as Python sets."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    joined = " " + " ".join(words) + " " if words else " "
    return [{joined[k:k + n] for k in range(len(joined) - n + 1)} for n in language.GRAMS]


def kernel(a, b):
    return sum(len(x & y) / math.sqrt(len(x) * len(y)) for x, y in zip(a, b) if x and y) / len(language.GRAMS)


def test_kernel_values_are_those_of_sets():
    texts = ["Der Hund läuft.", "the dog; the cat", "x", "", "12 34", "ÉCOLE école", "日本語 テキスト", "a" * 5000, "İstanbul 😀 b"]
    marks = texts[:3] + texts[5:]
    got = language.Kernel([language.grams(t) for t in marks]).values([language.grams(t) for t in texts])
    want = [[kernel(presence(a), presence(b)) for b in marks] for a in texts]
    assert np.abs(got - np.array(want)).max() < 1e-6


def test_model_is_the_regression_on_nystroem_features(spark):
    draw = np.random.default_rng(4)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["hund", "katze", "maus"], "cc": ["tree", "house", "road"]}
    rows = [(k, " ".join(draw.choice(words[lang], 6)) + f" {lang} {'xyz'[k % 3]}", lang)
            for k, lang in enumerate(list(words) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, landmarks=9, rows=8)
    learned = defaultdict(list)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            learned[lang].append((hashlib.md5(text.encode()).hexdigest(), text))
    chosen = [(lang, t) for lang in sorted(learned) for _, t in sorted(set(learned[lang]))[:8]]
    marks = [t for lang in sorted(learned) for _, t in sorted(set(learned[lang]))[:3]]
    sets = [presence(t) for t in marks]
    own = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, basis = np.linalg.eigh(own)
    kept = values > language.JITTER * values.max()
    white = basis[:, kept] / np.sqrt(values[kept])

    def features(text):
        return np.append(np.array([kernel(presence(text), b) for b in sets]) @ white, 1.0)

    x = np.array([features(t) for _, t in chosen])
    y = np.array([[1.0 if lang == name else -1.0 for name in sorted(learned)] for lang, _ in chosen])
    penalty = language.RIDGE * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    want = np.array([features(t) for _, t, _ in rows]) @ solved
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for (i, _, lang), row in zip(rows, want):
        assert got[i].lang_pred == sorted(learned)[row.argmax()] == lang
        assert got[i].score == pytest.approx(min(max((row.max() + 1) / 2, 0), 1), abs=1e-4)


def test_language_of_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, lang_pred int, score string, rank int, mark string"
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (2, "der Hund und die Katze", "de"),
            (3, None, "en"), (4, "", "en"), (5, "12 ² -- 34", "de"), (6, "the house", None), (None, "die Maus", "de"),
            (7, "der Hund " * 60000, "de"), (8, "the dog " * 3000 + "x", "en"), (9, "Ⅷ", "en"), (10, "日本", "en")]
    docs = spark.createDataFrame([r + (1, "s", 2, "m") for r in rows], schema)
    found = language.identify(docs, language.fit(docs)).collect()
    told = defaultdict(set)
    for r in found:
        told[r.doc_id].add((r.lang_pred, r.score))
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(len(v) == 1 for v in told.values())
    assert [told[k] for k in (3, 4, 5, 9)] == [{("und", 0.0)}] * 4
    pred = {k: next(iter(v))[0] for k, v in told.items()}
    assert (pred[1], pred[2], pred[6], pred[None], pred[7], pred[8]) == ("en", "de", "en", "de", "de", "en")
    none = docs.limit(0)
    assert language.fit(none) is None and language.identify(none, None).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled, language.fit(unlabelled)).collect()} == {"und"}
    # Nothing of a held-out row is learned.
    held = spark.createDataFrame([r + ("xx" if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[2],) for r in rows],
                                 "doc_id long, text string, old string, lang string")
    assert "xx" not in language.fit(held).languages


@needs_tables
def test_language_query_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op13_string_kernel_language"](spark, FOLDER)
    assert found.count() == docs.count()
    rows = found.join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


# --- earlier operators on cases that they once missed

@pytest.mark.parametrize("ids", [
    [2 ** 53 + 1 + k for k in range(60)] + [None],
    list(range(60)) + [None, None, None],
    [-5, 2 ** 62, 2 ** 62 + 1, 7, 7, 7, None] + list(range(100, 150)),
])
def test_edited_texts_follow_any_order_of_ids(spark, ids):
    rows = [(i, f"text {k} " * (k % 5) + "é" * (k % 3), "extra") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(5)
    found = edit_embedding.compare_edits(docs).collect()
    assert len(found) == len(rows)
    texts = defaultdict(set)
    for i, text, _ in rows:
        texts[i].add(text)
    # Rows of one id may follow each other in any order, so each has a set of possible next texts.
    order = sorted({i for i in ids if i is not None}, reverse=True) + ([None] if None in ids else [])
    told = defaultdict(list)
    for r in found:
        told[r.doc_id].append(r.edited_sha256)
    for at, i in enumerate(order):
        after = texts[order[(at + 1) % len(order)]] | (texts[i] if len(texts[i]) > 1 or ids.count(i) > 1 else set())
        possible = {hashlib.sha256(edited(t, n).encode()).hexdigest() for t in texts[i] for n in after}
        assert set(told[i]) <= possible and len(told[i]) == ids.count(i)
        if ids.count(i) == 1 and len(after) == 1:
            assert len(set(told[i])) == 1


def edited(text, following):
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def test_blocks_are_found_where_their_run_stands():
    line = lambda name: " ".join(f"{name}{k}" for k in range(10))
    a = [line(n) for n in ("l1", "x", "l2", "y", "l3", "z", "l1", "l2", "l3")]
    b = [line(n) for n in ("q", "l1", "l2", "l3", "r")]
    assert line_alignment.common_blocks(a, b, [10] * 5, 25) == [1, 2, 3]
    assert line_alignment.common_blocks(a, b, [10] * 5, 31) == []
    # The same run twice in the later text, around an empty line, and in another order than in the earlier one.
    b = [line("l2"), line("l3"), "", line("q"), line("l1"), line("l2"), line("l3"), line("l1"), line("l2"), line("l3")]
    words = [10, 10, 0, 10, 10, 10, 10, 10, 10, 10]
    assert line_alignment.common_blocks(a, b, words, 25) == [4, 5, 6, 7, 8, 9]
    assert line_alignment.common_blocks([], b, words, 25) == [] and line_alignment.common_blocks(a, [], [], 25) == []
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = ([line(f"w{n}") for n in rng.integers(0, 6, rng.integers(1, 14))] for _ in range(2))
        found = line_alignment.common_blocks(a, b, [10] * len(b), 30)
        runs = {tuple(a[i:i + 3]) for i in range(len(a) - 2)}
        # Every line found lies in a shared run; no shared run is left whole.
        covered = {j + k for j in range(len(b) - 2) if tuple(b[j:j + 3]) in runs for k in range(3)}
        assert set(found) <= covered
        assert not any(tuple(b[j:j + 3]) in runs and not set(range(j, j + 3)) & set(found) for j in range(len(b) - 2))


def test_lookup_by_bands_against_brute_force(spark):
    """Texts with a few to many edited characters, copies and strangers: no false pair, at least 0.9 found, any block size."""
    rng, texts = np.random.default_rng(11), []
    for base in range(40):
        text = "".join(rng.choice(list("abcdefgh "), 900))
        texts += [text, text]
        for edits in (1, 3, 8, 20):
            changed = list(text)
            for at in rng.choice(len(changed), edits, replace=False):
                changed[at] = "" if rng.random() < 0.5 else "zé"
            texts.append("".join(changed))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "x"])], "doc_id long, text string")
    prints = edit_embedding.fingerprints(docs)
    rows = prints.collect()
    all_prints = sorted({r.fingerprint for r in rows})
    asked = sorted({r.fingerprint for r in rows if r.doc_id % 50 == 0} | {rows[2].fingerprint})
    queries = prints.where(F.col("fingerprint").isin(asked))
    want = {(a, b): near for a in asked for b in all_prints
            if a != b and (near := edit_embedding.likeness(a, b)) >= 0.5}
    for block in (4096, 3):
        got = edit_embedding.lookup(queries, prints, 0.5, block).collect()
        told = {(r.fingerprint, r.other): r.likeness for r in got}
        assert len(told) == len(got) and set(told) <= set(want)
        assert all(abs(told[k] - want[k]) < 1e-12 for k in told)
        surely = [k for k in want if want[k] >= 0.8]
        assert len(surely) > 5 and len(set(surely) & set(told)) >= 0.9 * len(surely)
        # Exactly the pairs that share a band, of those alike enough.
        assert set(told) == {k for k in want if edit_embedding.shared_bands(*k)}
    assert edit_embedding.lookup(queries.limit(0), prints).count() == 0
    assert edit_embedding.lookup(queries, prints.limit(0)).count() == 0
