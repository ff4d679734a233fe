"""Periodic runs and spelling variants against brute force, and on rows with nulls, long texts, ties and repeats."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import periodic_runs, queries, spelling_variants

# 12 ------------------------------------------------------------------------------------------------------------------


def all_runs(words, min_words=24, min_periods=3):
    """Every period at every place; of one stretch the smallest period."""
    w, out = np.array(words), {}
    for p in range(1, len(w) // min_periods + 1):
        edges = np.diff(np.concatenate([[0], (w[:-p] == w[p:]).astype(int), [0]]))
        for start, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            if end - start + p >= max(min_words, min_periods * p):
                out.setdefault((start, end - start + p), p)
    return sorted((s, length, p) for (s, length), p in out.items())


def without_repeats(words, runs):
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_cover_differences_are_complete():
    assert {(a - b) % periodic_runs.CYCLE for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.CYCLE))


def test_extensions_equal_those_word_by_word():
    rng = np.random.default_rng(3)
    for letters, n in ((1, 200), (2, 300), (2, 31), (3, 7)):
        w = rng.integers(0, letters, n)
        ask = periodic_runs.Extensions(w)
        x, y = rng.integers(-1, n + 1, 400), rng.integers(-1, n + 1, 400)
        x, y = x[x != y], y[x != y]
        wanted = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            k = 0
            while min(a, b) >= 0 and max(a, b) + k < n and w[a + k] == w[b + k]:
                k += 1
            wanted.append(k)
        assert ask(x, y).tolist() == wanted


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        n, letters = rng.randrange(0, 150), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 10:
                a, p = rng.randrange(n), rng.randrange(1, 12)
                for i in range(a + p, min(n, a + p + rng.randrange(90))):
                    w[i] = w[i - p]
        least, periods = rng.choice([(24, 3), (4, 3), (3, 3), (10, 4), (2, 2), (8, 2)])
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(w, np.int64), least, periods).tolist()] == all_runs(w, least, periods)


def test_grid_in_parts(monkeypatch):
    w = np.tile(np.arange(9), 40)
    whole = periodic_runs.runs_of(w).tolist()
    monkeypatch.setattr(periodic_runs, "GRID", 50)
    assert periodic_runs.runs_of(w).tolist() == whole == [[0, 360, 9]]


def test_periodic_query_equals_brute_force(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.queries()["op12_difference_cover_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        names: dict = {}
        runs = all_runs([names.setdefault(w, len(names)) for w in words])
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        text_of = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        wanted = (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text_of.encode()).hexdigest(), hashlib.sha256(without_repeats(words, runs).encode()).hexdigest())
        assert tuple(rows[doc_id][c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == wanted
    assert any(r.n_runs for r in rows.values())


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a b " * 20), (4, "a b " * 20), (4, "a b " * 20), (5, "x " * 50_000), (6, "été ! " * 30), (7, "q w e " * 8 + "r t y " * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1)).withColumn("start", F.lit("kept"))
    out = periodic_runs.periodic_runs(df)
    got = {(r.doc_id, None if r.text is None else len(r.text)): ([tuple(x) for x in r.runs], r.collapsed, r.start) for r in out.collect()}
    assert out.count() == len(rows) and got[(1, None)] == ([], "", "kept") and got[(2, 0)][:2] == ([], "") and got[(3, 4)][:2] == ([], "")
    assert got[(None, 80)][:2] == got[(4, 80)][:2] == ([(0, 40, 2)], "a b") and got[(5, 100_000)][:2] == ([(0, 50_000, 1)], "x")
    assert got[(6, 180)][:2] == ([(0, 30, 1)], "été !") and got[(7, 96)][:2] == ([(0, 24, 3), (24, 24, 3)], "q w e r t y")
    assert periodic_runs.periodic_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, min_periods=1)


# 13 ------------------------------------------------------------------------------------------------------------------


def near_words(words):
    """By the words without one character at each place."""
    at, out = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            at[w[:k], w[k + 1 :]].add(w)
            if (v := w[:k] + w[k + 1 :]) in words:
                out[w].add(v)
                out[v].add(w)
    for group in at.values():
        for w in group:
            out[w] |= group - {w}
    return out


def grouped(words, ratio=5):
    near, form, out = near_words(words), {}, set()
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= ratio * words[w]:
                form[w] = best
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def as_rows(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_variants_query_equals_brute_force(spark, sf_dir):
    counts = collections.Counter()
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    rows = as_rows(queries.queries()["op13_variable_gram_variants"](spark, sf_dir))
    wanted = grouped({w: n for w, n in counts.items() if n >= 5 and len(w) >= 6})
    assert set(rows) == wanted and len(rows) == len(wanted)


@pytest.fixture(scope="module")
def vocabulary():
    """Words of few letters, many of them one edit apart, with chains of forms and ties."""
    rng, out = random.Random(2), {}
    for _ in range(400):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 12)))
        out[w] = rng.choice([5, 5, 25, 26, 125, 625])
        for _ in range(3):
            k, c = rng.randrange(len(w)), rng.choice("abéz")
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            if len(v) >= 6:
                out.setdefault(v, rng.choice([5, 5, 25, 26, 125, 625]))
    return out


@pytest.mark.parametrize("rare, long", [(64, 4096), (2, 4096), (2, 3), (10**9, 10)])
def test_variants_of_any_dictionary_and_list_length(spark, vocabulary, monkeypatch, rare, long):
    monkeypatch.setattr(spelling_variants, "RARE", rare)
    monkeypatch.setattr(spelling_variants, "LIST_WORDS", long)
    assert set(as_rows(spelling_variants.group_variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long")))) == grouped(vocabulary)


def test_bound_of_shared_grams_holds(vocabulary):
    near = near_words(vocabulary)
    for letters in ("", "ab", "aéb"):  # grams that begin with these letters are extended
        counts = collections.Counter(f"^^{w}$$"[k : k + s] for w in vocabulary for k in range(len(w) + 4) for s in range(2, 6) if k + s <= len(w) + 4)
        dictionary = {g: n for g, n in counts.items() if len(g) == 2 or g[0] in letters and all(g[:k] in counts for k in range(2, len(g)))}
        parts = {w: {f"^^{w}$$"[a:b] for a, b in spelling_variants.decompose(f"^^{w}$$", dictionary)} for w in vocabulary}
        for w in vocabulary:
            least = spelling_variants.shared_at_least(f"^^{w}$$", spelling_variants.decompose(f"^^{w}$$", dictionary))
            assert least >= 1 and all(len(parts[w] & parts[v]) >= least for v in near[w])


def test_words_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Ünıcode ÀÉÏabc " * 3), (3, "ÀÉÏabc"), (3, "ÀÉÏabc"), (4, "short letters-letters letters2letters"), (5, "letters " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    assert {tuple(r) for r in spelling_variants.count_words(df, min_count=1).collect()} == {("ÀÉÏabc", 5), ("letters", 20_004)}
    empty = spelling_variants.count_words(df.where("false"))
    assert empty.count() == 0 and spelling_variants.group_variants(empty).count() == 0
    typo = {r.word for r in spelling_variants.count_words(spark.createDataFrame([(k, "abcdefgh") for k in range(3000)], "doc_id long, text string"), 199, 1).collect()}
    assert typo == {"abcdefgh"} | {spelling_variants.with_typo("abcdefgh", h, 199) for k in range(3000) if (h := zlib.crc32(f"{k}:abcdefgh".encode())) % 199 == 0}


def test_odd_word_rows(spark):
    rows = [("abcdef", 3), ("abcdef", 4), (None, 9), ("abcdeg", None), ("abcdex", 35), ("short", 900), ("", 5), ("x" * 5000, 1), ("x" * 4999, 5)]
    df = spark.createDataFrame(rows, "word string, n long").withColumn("gram", F.lit("clash")).withColumn("form", F.lit("clash"))
    long = {("x" * 5000, "x" * 4999, "x" * 4999, 1, 1, 5), ("x" * 4999, None, "x" * 4999, 5, 1, None)}
    assert set(as_rows(spelling_variants.group_variants(df))) == {("abcdef", "abcdex", "abcdex", 7, 1, 35), ("abcdex", None, "abcdex", 35, 1, None)} | long
