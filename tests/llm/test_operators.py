"""Each operator against brute force on the small tables, and on rows with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hushframe.llm import common, decontaminate, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, queries, reshard, suffix_dedup, token_counts
from tests.oracle import check

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This line of more than forty characters stands in many documents."
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "word", "xx", "s", 4), (4, "  \n\n ", "en", None, 5), (5, "the of and " * 3000, "en", "s", 33000), (6, "the of and " * 3000, "en", "s", 33000),
    (None, "a row without id", "en", "s", 16), (7, f"{LINE}\nx", "en", "s", 1), (7, f"{LINE}\nx", "en", "s", 1), *[(k, f"{k}\n  {LINE.upper()}\t\nend", "de", "s", 1) for k in range(8, 13)], (13, "ÉÀ İK über 𝒳 " * 9, "fr", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns named like the operators' own."""
    return spark.createDataFrame(ODD, DOCS).withColumn("shard", F.lit("clash")).withColumn("n_words", F.lit("clash")).withColumn("key", F.lit("clash")).withColumn("gone", F.lit("clash")).withColumn("keys", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


# 1 -------------------------------------------------------------------------------------------------------------------


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(1)
    for _ in range(30):
        supply = [rng.randrange(0, 90) for _ in range(rng.randrange(1, 6))]
        capacity = reshard.even_capacities(sum(supply), rng.randrange(1, 7))
        flow = reshard.min_cost_flow(supply, capacity, [[int(i != j) for j in range(len(capacity))] for i in range(len(supply))])
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == capacity
        stay = sum(min(s, capacity[i]) for i, s in enumerate(supply) if i < len(capacity))
        assert sum(flow[i][i] for i in range(min(len(supply), len(capacity)))) == stay


def test_flow_with_costs_and_too_little_room():
    assert reshard.min_cost_flow([5, 5], [5, 5], [[3, 1], [1, 9]]) == [[0, 5], [5, 0]]
    with pytest.raises(ValueError):
        reshard.min_cost_flow([5], [4], [[0]])


def test_reshard(spark, sf_dir):
    rows = queries.queries()["op1_min_cost_reshard"](spark, sf_dir).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(16))
    sizes = [sum(x["size"] for x in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_reshard_moves_the_fewest_bytes(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = reshard.reshard(docs, F.pmod(F.xxhash64("source"), F.lit(5)), shards=7).collect()
    raw = {d: (t or "").encode() for d, t in texts}
    assert all((r["size"], r.text_crc32) == (len(raw[r.doc_id]) + 1, zlib.crc32(raw[r.doc_id])) for r in rows) and len(rows) == len(raw)
    old, new = collections.Counter(), collections.Counter()
    for r in rows:
        old[r.old_shard] += r["size"]
        new[r.shard] += r["size"]
    capacity = reshard.even_capacities(sum(old.values()), 7)
    least = sum(max(0, old[k] - (capacity[k] if k < 7 else 0)) for k in old)  # what does not fit where it is
    largest = max(r["size"] for r in rows)
    assert sum(r["size"] for r in rows if r.moved) <= least + 7 * largest and all(abs(new[k] - capacity[k]) <= 2 * largest for k in range(7))
    assert all(r.moved == (r.old_shard != r.shard) for r in rows)


def test_many_empty_texts_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(reshard, "BLOCK_ROWS", 50)
    rows = reshard.reshard(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")), F.lit(0), shards=4).collect()
    assert collections.Counter(r.shard for r in rows) == {k: 1250 for k in range(4)}


def test_reshard_odd_rows(odd, none):
    out = reshard.reshard(odd, F.pmod(F.col("doc_id"), F.lit(3)), shards=4).collect()
    assert len(out) == len(ODD) and sorted(r["size"] for r in out) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ODD)
    assert {r.text_crc32 for r in out if r.doc_id == 1} == {0}
    assert reshard.reshard(none, F.lit(0)).count() == 0


def test_rewrite_leaves_other_shards(spark, tmp_path):
    old = spark.range(100).withColumn("old_shard", (F.col("id") % 3).cast("int"))
    old.write.partitionBy("old_shard").parquet(f"{tmp_path}/old")
    plan = old.select("id", "old_shard", F.when((F.col("old_shard") == 0) & (F.col("id") > 50), 1).otherwise(F.col("old_shard")).alias("shard"))
    assert reshard.rewrite(f"{tmp_path}/old", f"{tmp_path}/new", plan, "id") == [0, 1]
    new = spark.read.parquet(f"{tmp_path}/new")
    assert new.select("shard").distinct().count() == 2 and new.count() == plan.where("shard < 2").count()


def test_rewrite_writes_each_row_once(spark, tmp_path):
    rows = [(k % 20 if k % 7 else None, f"text {k % 3}", k % 3 if k % 5 else None) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old_shard int")
    docs.write.partitionBy("old_shard").parquet(f"{tmp_path}/old")
    plan = common.cut(reshard.reshard(docs, F.col("old_shard"), shards=3))
    for _ in range(2):
        assert reshard.rewrite(f"{tmp_path}/old", f"{tmp_path}/new", plan) == [0, 1, 2]
        new = spark.read.parquet(f"{tmp_path}/new").collect()
        assert collections.Counter((r.doc_id, r.text) for r in new) == collections.Counter(r[:2] for r in rows)
        assert collections.Counter((r.doc_id, r.shard) for r in new) == collections.Counter((r.doc_id, r.shard) for r in plan.collect())


def test_a_second_rewrite_leaves_nothing_of_the_first(spark, tmp_path):
    old = spark.createDataFrame([(k, f"t{k}", k % 4) for k in range(8)], "doc_id long, text string, old_shard int")
    old.write.partitionBy("old_shard").parquet(f"{tmp_path}/old")
    for moves, touched in (({0: 1, 2: 3}, [0, 1, 2, 3]), ({0: 1}, [0, 1])):
        place = F.coalesce(F.create_map(*[F.lit(x) for pair in moves.items() for x in pair])[F.col("old_shard")], F.col("old_shard"))
        plan = old.select("doc_id", "old_shard", place.alias("shard"))
        assert reshard.rewrite(f"{tmp_path}/old", f"{tmp_path}/new", plan) == touched
        rows = sorted((r.doc_id, r.shard) for r in spark.read.parquet(f"{tmp_path}/new").collect())
        assert rows == sorted((r.doc_id, r.shard) for r in plan.collect() if r.shard in touched)  # the emptied shards 0 and 2 have no rows


# 2 -------------------------------------------------------------------------------------------------------------------


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places, covered = collections.defaultdict(list), set()
    for k in range(len(words) - 7):
        places[tuple(words[k : k + 8])].append(k)
    for v in places.values():
        if len(v) > 1:
            for k in v:
                covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.queries()["op2_distribution_divergence"](spark, sf_dir).collect()}
    for doc_id, text in texts:
        r, want = rows[doc_id], base_of(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_sound_documents_stay(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    out = queries.queries()["op2_distribution_divergence"](spark, sf_dir).join(good, "doc_id")
    assert out.where("not base_failed and not kept").count() == 0


def test_judge_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (None, 1), (9, None), (9, 0)], "doc_id long, quality int")
    rows = [(r.doc_id, r.kept) for r in quality_rules.judge(odd, labels).collect()]
    assert len(rows) == len(ODD) and not any(k for d, k in rows if d in (1, 2, 3, 4, 5))
    assert quality_rules.judge(none, labels).count() == 0 and quality_rules.keep_sound(odd, labels).columns == odd.columns
    assert quality_rules.judge(odd, labels.limit(0)).where("char_distance is not null").count() == 0


def test_junk_in_the_corpus_is_not_the_reference(spark):
    rng = random.Random(21)
    prose = [" ".join(rng.choice(["the", "of", "and", "river", "stone", "walked", "Evening,", "slowly."]) + rng.choice("abcdefgh") for _ in range(80)) for _ in range(10)]
    junk = [" ".join(f"#{rng.randrange(10**6)}%$" for _ in range(80)) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_rules.judge(docs, spark.createDataFrame([(k, 1) for k in range(5)], "doc_id long, quality int")).where("kept").collect()}
    assert kept == set(range(10))


def test_long_white_space_is_linear(spark):
    import time

    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, "x" * 1_000_000)], "doc_id long, text string")
    began = time.time()
    assert sorted((r.doc_id, r.n_words, r.word_chars) for r in quality_rules.base_counts(docs).select("doc_id", "n_words", "word_chars").collect()) == [(1, 2, 2), (2, 0, 0), (3, 1, 1_000_000)]
    assert time.time() - began < 30


def test_distance_is_jensen_shannon(spark):
    rng = np.random.default_rng(2)
    for _ in range(5):
        a, b = rng.integers(0, 9, 6), rng.integers(1, 9, 6)
        p, q = a / max(a.sum(), 1), b / b.sum()
        m = (p + q) / 2
        want = np.sqrt(sum(sum(x * np.log2(x / y) for x, y in zip(s, m, strict=True) if x) for s in (p, q)) / 2)
        got = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>").select(quality_rules.distance("a", "b")).first()[0]
        assert a.sum() == 0 or abs(got - want) < 1e-9


def test_sound_documents_with_every_working_name_taken(spark, sf_dir, texts):
    """Rows judged in place are those that judge keeps, whatever the columns are called."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = """row language words hashes windows sorted twins lines n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed common own char_counts word_counts
        all_char_counts all_word_counts char_distance word_distance kept text_key verdict_id verdict_key verdict_language row_key""".split()
    named = docs.select("*", *[F.lit(n).alias(n) for n in names], F.lit("dotted").alias("a.b"))
    out = quality_rules.keep_sound(named, labels)
    rows = out.collect()
    assert out.columns == named.columns and all(r[n] == n for r in rows for n in names)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()) and 0 < len(rows) < len(texts)
    assert quality_rules.keep_sound(docs.unionByName(docs), labels).count() == 2 * len(rows)


# 3 -------------------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen, unseen = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    both = quality_classifier.score(docs, seen).join(unseen, "doc_id").select("kept", "quality", "text_score", "metadata_score").collect()
    assert len(both) > 50 and np.mean([r.kept == bool(r.quality) for r in both]) > 0.95


def test_pseudo_labels_come_from_all_documents(spark, monkeypatch):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    monkeypatch.setattr(quality_classifier, "GIVEN", 20)
    seen = []
    real = quality_classifier.exchange
    monkeypatch.setattr(quality_classifier, "exchange", lambda *a: seen.append(real(*a)) or seen[-1])
    known = {r.doc_id for r in labels.collect()}
    assert quality_classifier.fit(docs.unionByName(docs), labels) is not None
    given = [(v, d) for part in seen for v, _, d, _ in part]
    assert len(given) == len(set(given)) > 20 and not known & {d for _, d in given} and len(seen) == quality_classifier.ROUNDS


def test_few_documents_without_labels_still_get_pseudo_labels(spark, monkeypatch):
    """Neither surer documents that have labels nor copies of one document keep others out of the exchange."""
    docs = [(k, f"{'clear words of good prose follow here' if k % 2 else '### junk $$$ 000 ### ||'} {k}", "en", "ab"[k % 2], 40) for k in range(4400)]
    docs += [(4001, docs[4001][1], "en", "b", 40)] * 900
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(k, k % 2, 0) for k in range(4000)], "doc_id long, quality int, toxic int")
    seen, real = [], quality_classifier.exchange
    monkeypatch.setattr(quality_classifier, "exchange", lambda *a: seen.append(real(*a)) or seen[-1])
    assert quality_classifier.fit(docs, labels) is not None
    given = [(v, d) for part in seen for v, _, d, _ in part]
    assert len(seen) == 3 and len(set(given)) == len(given) and {d for _, d in given} <= set(range(4000, 4400))
    assert [sum(v == w for v, *_ in part) for part in seen[:2] for w in range(2)] == [200] * 4  # the third round has what is left: none


def test_exchange_equals_a_ranking_of_all_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*quality_classifier.COLUMNS).toArrow().combine_chunks().to_batches()[0]
    views, rng = quality_classifier._views(rows), np.random.default_rng(2)
    weights = [np.append(rng.normal(size=x.shape[1]) * 3, 0.5) for x in views]
    known, used, wanted = {*range(0, 1000, 3)}, [{1, 4}, {7}], [13, 29]
    ids, expected = rows.column("doc_id").to_pylist(), []
    for v, x in enumerate(views):
        p = quality_classifier.sigmoid(quality_classifier.log_odds(x, weights[v]))
        for label, sure in enumerate((1 - p, p)):
            order = sorted((-s, d) for s, d in zip(sure.tolist(), ids, strict=True) if s >= quality_classifier.SURE and d not in known and d not in used[1 - v])
            expected += [(v, label, d) for _, d in order[: wanted[label]]]
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.createDataFrame([(d,) for d in known], "doc_id long")
    assert quality_classifier.surest(docs, labels, weights, used, wanted) == sorted(expected) and len(expected) > 40


def test_classifier_without_labels(odd, none, spark):
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.score(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r.kept and r.score is None for r in rows)
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(odd, labels).collect())
    assert quality_classifier.score(none, labels).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------


def greedy(word, initial, inner):
    n, have = 0, initial
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in have), 0)
        if not size:
            return token_counts.UNKNOWN_PIECES
        word, n, have = word[size:], n + 1, inner
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(4)
    for _ in range(60):
        initial, inner = ({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(6)} for _ in range(2))
        matcher = token_counts.LongestMatch(initial, inner)
        for _ in range(60):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 12)))
            assert matcher.count(word) == greedy(word, initial, inner)


def test_token_counts(spark, sf_dir, texts):
    import public_tokenizers

    initial, inner = map(set, token_counts.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    first = initial | {p for p in inner if len(p) == 1 and p not in {q[:1] for q in initial}}
    rows = {r.doc_id: r for r in queries.queries()["op4_longest_match_counts"](spark, sf_dir).collect()}
    for doc_id, text in texts[:40]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (rows[doc_id].n_words, rows[doc_id].n_pieces) == (len(words), sum(greedy(w.encode(), first, inner) for w in words))


def test_token_counts_odd_rows(odd, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts.count_tokens(odd, path).collect()
    assert len(rows) == len(ODD) and {(r.n_words, r.n_pieces) for r in rows if r.doc_id in (1, 2, 4)} == {(0, 0)}
    assert token_counts.count_tokens(none, path).count() == 0


def test_long_words_are_not_kept():
    counts = token_counts._Counts(token_counts.LongestMatch([b"a"], [b"a"]))
    assert (counts["a" * 40], counts["a" * 4000]) == (40, 4000) and set(counts) == {"a" * 40}


def test_token_counts_of_rare_scripts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    initial, inner = map(set, token_counts.load_vocabulary(path))
    first = initial | {p for p in inner if len(p) == 1}
    assert len({p for p in inner if len(p) == 1}) == 256
    words = ["สวัสดีชาวโลกทั้งหลาย", "வணக்கம்", "ನಮಸ್ಕಾರ", "\u3231", "\U0001d4b3yz", "über", "नमस्ते", "plain"]
    rows = token_counts.count_tokens(spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_pieces for r in rows} == {k: greedy(w.encode(), first, inner) for k, w in enumerate(words)}
    assert all(r.n_pieces > 1 for r in rows if r.doc_id < 5)


# 5 -------------------------------------------------------------------------------------------------------------------


def shingles(text):
    words = (text or "").lower().split()
    return collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) > 4 else collections.Counter([tuple(words)])


def classes_by_pairs(texts, least):
    bags, root = {d: shingles(t) for d, t in texts}, {d: d for d, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n, m = sum(bags[a].values()), sum(bags[b].values())
            if min(n, m) >= least * max(n, m) and (k := sum((bags[a] & bags[b]).values())) and k / (n + m - k) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_near_classes(spark, sf_dir, texts):
    rows = queries.queries()["op5_order_minhash"](spark, sf_dir).collect()
    assert {r.doc_id: r.class_id for r in rows} == classes_by_pairs(texts, near_dedup.SIMILARITY)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for k in range(200):
        a = rng.integers(0, 400 if k % 2 else 12, rng.integers(1, 60))
        b = a.copy()
        for _ in range(rng.integers(0, 5)):
            i = rng.integers(0, len(b))
            b = np.delete(b, i) if rng.random() < 0.5 and len(b) > 1 else np.insert(b, i, rng.integers(0, 400))
        if k % 5 == 0:
            b = np.concatenate([b[len(b) // 2 :], b[: len(b) // 2]])
        n = longest(a, b)
        want = n / (len(a) + len(b) - n)
        assert abs(near_dedup.ordered_overlap(a, b) - (want if want >= 0.8 - 1e-12 else 0.0)) < 1e-12


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (12, 9), (2, 20)], "a long, b long")
    assert {r.node: r.label for r in near_dedup.components(edges).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 20: 2, 8: 8, 9: 8, 12: 8}


def test_near_odd_rows(odd, none):
    rows = near_dedup.near_classes(odd).collect()
    assert len(rows) == len(ODD) and {r.class_id for r in rows if r.doc_id in (5, 6)} == {5} and {r.class_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert [r.class_id for r in rows if r.doc_id is None] == [None]
    kept = [r.doc_id for r in near_dedup.keep_one(odd).collect()]
    assert kept.count(7) == 1 and 6 not in kept and None in kept and near_dedup.near_classes(none).count() == 0


@pytest.mark.parametrize("piece", [2, 2048])
def test_no_link_of_a_bucket_is_lost(spark, monkeypatch, piece):
    monkeypatch.setattr(near_dedup, "ORDER", 1)
    monkeypatch.setattr(near_dedup, "REPETITIONS", 1)
    monkeypatch.setattr(near_dedup, "PIECE", piece)
    rng, texts = random.Random(51), []
    for family in range(60):
        base = [f"f{family}w{k}" for k in range(120)]
        far, first, second = list(base[:-4]), list(base), list(base)
        for words, places in ((far, (20, 60, 90)), (first, (40,)), (second, (75,))):
            for k in places:
                words[k] = f"x{rng.randrange(10**9)}"
        texts += [(3 * family + k, " ".join(w)) for k, w in enumerate((far, first, second))]
    keys = near_dedup.sketches(*near_dedup.shingles(near_dedup.pa.array([t for _, t in texts])), 1, 1)[:, 0].tolist()
    want = {}
    for key in set(keys):
        want |= classes_by_pairs([t for t, k in zip(texts, keys, strict=True) if k == key], near_dedup.SIMILARITY)
    assert sum(keys[k] == keys[k + 1] == keys[k + 2] and want[k + 1] == want[k + 2] != want[k] for k in range(0, 180, 3)) > 10
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    every = classes_by_pairs(texts, near_dedup.SIMILARITY)  # impure buckets may also find links that no bucket holds
    assert all(got[a] == got[b] for a in want for b in want if want[a] == want[b]) and all(every[a] == every[b] for a in got for b in got if got[a] == got[b])


def test_rare_pairs_are_all_links(spark):
    rng, texts = random.Random(53), []
    words = [f"w{k}" for k in range(300)]
    for k in range(120):  # a frequent passage, families, near misses and repeated words
        base = random.Random(k // 6).choices(words, k=60)
        for _ in range(rng.randrange(0, 5)):
            base[rng.randrange(60)] = rng.choice(words)
        texts.append((k, " ".join(base + ([f"common{j}" for j in range(40)] if k % 3 else ["the", "of"] * rng.randrange(5, 30)))))
    docs = spark.createDataFrame(texts, "node long, text string")
    pa_texts = near_dedup.pa.array([t for _, t in texts])
    grams, begins = near_dedup.shingles(pa_texts)
    signs = near_dedup.signatures(grams, begins).view(np.int64)
    marks = np.column_stack([np.diff(begins), signs, near_dedup.parities(grams, begins)])
    nodes = spark.createDataFrame([(k, k, *map(int, marks[k])) for k in range(len(texts))], f"node long, label long, {', '.join(f'{c} long' for c in near_dedup.MARKS)}")
    pairs = {tuple(sorted((r.a, r.b))) for r in near_dedup._rare_pairs(docs, nodes).collect()}
    want = {(i, j) for j in range(len(texts)) for i in range(j) if near_dedup.ordered_overlap(grams[begins[i] : begins[i + 1]], grams[begins[j] : begins[j + 1]])}
    assert len(want) > 20 and want <= pairs and len(pairs) < 4 * len(want)
    found = {tuple(sorted((r.a, r.b))) for r in near_dedup.links(docs, near_dedup._rare_pairs(docs, nodes)).collect()}
    assert found == want


def test_parity_maps_differ_no_more_than_texts():
    rng = random.Random(55)
    for _ in range(40):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(5, 300))]
        b = [x if rng.random() > 0.1 else rng.choice("abcdefgh") for x in a] + ["z"] * rng.randrange(3)
        grams, begins = near_dedup.shingles(near_dedup.pa.array([" ".join(a), " ".join(b)]))
        one, two = (collections.Counter(grams[x:y].tolist()) for x, y in zip(begins[:-1], begins[1:], strict=True))
        maps = near_dedup.parities(grams, begins).view(np.uint64)
        assert sum(int(x).bit_count() for x in maps[0] ^ maps[1]) <= sum(((one - two) + (two - one)).values())


def test_long_texts_are_aligned():
    rng = np.random.default_rng(54)
    a = rng.integers(0, 1 << 60, 60_000).astype(np.uint64)
    b = np.delete(a, [9, 500, 30_000])
    b[100], b[101] = b[101], b[100]
    assert abs(near_dedup.ordered_overlap(a, b) - 59_996 / (60_000 + 59_997 - 59_996)) < 1e-9


def test_texts_of_one_doc_id_have_classes_of_their_own(spark):
    one, two = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    docs = spark.createDataFrame([(1, one), (1, two), (1, two), (2, two), (3, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.near_classes(docs).collect()) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect()) == [(1, one), (1, two)]


def test_contracted_edges_keep_components(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FOREST_EDGES", 10)
    rng = random.Random(52)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "a long, b long").where("a <> b")
    assert sorted(near_dedup.components(near_dedup.contracted(edges)).collect()) == sorted(near_dedup.components(edges).collect())


# 6 -------------------------------------------------------------------------------------------------------------------


def test_windows_are_optimal():
    rng = np.random.default_rng(6)
    for _ in range(80):
        places = np.unique(np.concatenate(([0], np.cumsum(rng.integers(1, 9, rng.integers(1, 12))))))
        penalty, limit = rng.integers(0, 6, len(places)), int(rng.integers(9, 20))
        cuts = packing.best_windows(places, penalty, limit)
        fine = dict(zip(places.tolist(), penalty.tolist(), strict=True))

        def cost(c, limit=limit, fine=fine):
            return sum(limit - (b - a) + fine[b] for a, b in zip(c, c[1:], strict=False))

        best = [0.0]
        for j in range(1, len(places)):
            best.append(min(best[i] + limit - (places[j] - places[i]) + penalty[j] for i in range(j) if places[j] - places[i] <= limit))
        assert cuts[0] == 0 and cuts[-1] == places[-1] and all(0 < b - a <= limit for a, b in zip(cuts, cuts[1:], strict=False)) and cost(cuts) == best[-1]


def test_cut_places():
    places, penalty = packing.cut_places(600, np.array([100, 500]), np.array([50, 100, 230]))
    assert places.tolist() == [0, 50, 100, 228, 230, 358, 486, 500, 600] and penalty.tolist() == [0, 8, 0, 64, 8, 64, 64, 0, 0]
    assert packing.cut_places(1, np.array([1]), np.array([], int))[0].tolist() == [0, 1]


def pieces_hold(rows, ids):
    whole, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(ids[r.doc_id]) == r.doc_tokens and zlib.crc32(part.astype("<u4").tobytes()) == r.ids_crc32
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert [r.offset for r in w] == np.cumsum([0] + [r.length for r in w])[:-1].tolist() and sum(r.length for r in w) <= 2048
    for d, p in whole.items():
        p.sort(key=lambda r: r.start)
        assert [r.start for r in p] == np.cumsum([0] + [r.length for r in p])[:-1].tolist() and sum(r.length for r in p) == len(ids[d])
    assert set(whole) == set(ids)
    return len(windows)


def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], np.uint32) for d, x in texts}


def test_packing(spark, sf_dir, texts):
    ids = token_ids(texts)
    n = pieces_hold(queries.queries()["op6_dynamic_packing"](spark, sf_dir).collect(), ids)
    assert n * 2048 < 1.1 * sum(map(len, ids.values())) + 5 * 2048


def test_packing_odd_rows(odd, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces_hold(packing.pack(odd.dropDuplicates(["doc_id"]), path).collect(), token_ids({d: t for d, t, *_ in ODD}.items()))
    assert packing.pack(none, path).count() == 0


def test_packing_of_special_tokens_and_long_texts(spark):
    import public_tokenizers

    rows = [(1, "a<|endoftext|>b <|endoftext|>"), (2, " " * 1_000_000), (3, "word " * 70_000), (4, "x" * 3000 + "  " + "\n" * 500), (5, "<|endoftext"), (6, "")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    pieces_hold(out, token_ids(rows))


def test_texts_have_the_tokenizer_s_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole, rng = packing.Encoder(path), Tokenizer.from_file(path), random.Random(61)
    usual = [c for c in map(chr, range(0x11000)) if encoder.plain(c) and not c.isspace()]
    assert len(usual) > 20_000
    texts = ["".join(f"{c}a {c}1 .{c} {c}" for c in usual[k : k + 50]) for k in range(0, len(usual), 50)]
    assert all(map(encoder.plain, texts))
    parts = ["the", "of", "'s", "don't", " ", "  ", "   ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\u180e", "\x1c", "\x85", "\x00", "é", "e\u0301", "中文", "𝒳", "🙂", "12", "3.5", "<|endoftext|>", "<|end", "ĠĊ", "!?", "...", "%%%", "a" * 60, "\ufeff", "\u200b"]
    for every in (parts, [p for p in parts if encoder.plain(p)], [*usual[:600], " ", "\n"]):
        texts += ["".join(rng.choice(every) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(0, 60))) for _ in range(800)]
    assert [x.tolist() for x in encoder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert not encoder.plain("x" * 401) and not encoder.plain(" " * 401) and encoder.plain("x" * 400 + " " * 400)


# 7 -------------------------------------------------------------------------------------------------------------------


def test_repeats_odd_rows(spark, odd, none):
    rows = suffix_dedup.remove_repeats(odd).collect()
    by = {d: (t or "").encode() for d, t, *_ in ODD}
    firsts = {}
    for d in sorted(x for x in by if x is not None):
        for k in range(len(by[d]) - 49):
            firsts.setdefault(by[d][k : k + 50], d)
    assert len(rows) == len(ODD)
    for r in rows:
        raw = by[r.doc_id]
        gone = np.zeros(len(raw), bool)
        if r.doc_id is not None:
            for k in range(len(raw) - 49):
                if firsts[raw[k : k + 50]] < r.doc_id:
                    gone[k : k + 50] = True
        left = bytes(np.frombuffer(raw, np.uint8)[~gone])
        assert (r.kept, r.n_removed, r.kept_sha256) == (left, int(gone.sum()), hashlib.sha256(left).hexdigest())
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_levels_grow_geometrically():
    levels, sizes = suffix_dedup.Levels(), []
    rng = np.random.default_rng(7)
    for d in range(64):
        run = np.zeros(100, suffix_dedup.SUFFIX)
        run["string"] = np.frombuffer(rng.bytes(5000), "S50")
        run["doc"] = d
        list(levels.add(np.sort(run, order="string")))
        sizes.append(len(levels.levels))
    assert max(sizes) <= 7 and sum(map(len, levels.levels)) == 6400
    assert not sum(map(len, levels.close())) and len(levels.levels) == 1


def test_family_reports_what_a_smaller_document_holds():
    rng, levels, seen, gone = np.random.default_rng(70), suffix_dedup.Levels(), [], []
    strings = np.frombuffer(rng.bytes(50 * 40), "S50")
    for batch in range(20):
        run = np.zeros(30, suffix_dedup.SUFFIX)
        run["string"], run["doc"], run["batch"], run["place"] = strings[rng.integers(0, 40, 30)], rng.integers(0, 50, 30), batch, np.arange(30)
        seen.append(run)
        gone += levels.add(np.sort(run, order="string"))
    gone += levels.close()
    rows = np.concatenate(seen)
    low = {s: min(r["doc"] for r in rows if r["string"] == s) for s in set(rows["string"])}
    assert {(r["batch"], r["place"]) for part in gone for r in part} == {(r["batch"], r["place"]) for r in rows if r["doc"] > low[r["string"]]}


def repeats_by_strings(rows):
    firsts = {}
    for d, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49 if d is not None else 0):
            firsts[raw[k : k + 50]] = min(d, firsts.get(raw[k : k + 50], d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49 if d is not None else 0):
            if firsts[raw[k : k + 50]] < d:
                gone[k : k + 50] = True
        out.append((d, bytes(np.frombuffer(raw, np.uint8)[~gone]), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum())))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1, 50_000])
def test_repeats_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(71)
    pool = ["".join(rng.choice("ab é𝒳\0\xff") for _ in range(rng.randrange(20, 120))) for _ in range(25)]
    rows = [(rng.randrange(30), "".join(rng.choice(pool)[rng.randrange(9) : rng.randrange(40, 130)] for _ in range(rng.randrange(6)))) for _ in range(60)]
    common = "a passage of more than fifty bytes that every other one of these texts holds"
    rows += [(100 + k, f"{rng.random()} {common} {rng.random()}") for k in range(40)] + [(7, "one text " * 20), (7, "one text " * 20), (3, "one text " * 20), (7, "x" * 300), (2, "x" * 40 + "y")]
    rows += [(1, "A" * 10 + pool[0] * 3), (2, "A" * 10 + pool[0] * 3), (2, "another text of the same document, which shares nothing with the first one"), (500, "z" * 1_200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == repeats_by_strings(rows)


def test_columns_pack_and_unpack():
    rng = np.random.default_rng(8)
    columns = [rng.integers(0, 100, 500).astype(k) for k in ("<u8", "u1", "<i4")]
    assert all((a == b).all() for a, b in zip(columns, suffix_dedup._unpack(suffix_dedup._pack(*columns), 500, "<u8", "u1", "<i4"), strict=True))


# 8 -------------------------------------------------------------------------------------------------------------------


def base_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.queries()["op8_diagonal_voting"](spark, sf_dir).collect()}
    for doc_id, text in texts:
        r = rows[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_licenses(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


@pytest.mark.parametrize(("text", "labels"), [
    ("Permission is hereby granted, free of charge, to any person obtaining one copy of this software and its associated documentation files (the Software), to deal in the Software without restriction", "mit"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"), ("Released UNDER the MIT\nLicense", "mit"), ("licensed under the laws of physics", ""), ("", ""), (None, ""),
])
def test_notices(spark, text, labels):
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    rows = license_scan.scan_licenses(df).collect()
    assert [r.labels for r in rows] == [labels] * 2 and all((r.score > 0) == bool(labels) for r in rows)


def notices_by_brute_force(text):
    words, spans = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), []
    at = collections.defaultdict(list)
    for k in range(len(words) - 2):
        at[tuple(words[k : k + 3])].append(k)
    for t, (label, template) in enumerate(license_scan.TEMPLATES):
        own, lines = template.split(), collections.defaultdict(set)
        for p in range(len(own) - 2):
            for k in at.get(tuple(own[p : p + 3]), ()):
                lines[k - p].add(p)
        runs = []
        for d in sorted(lines):
            if not runs or d - runs[-1][-1] > license_scan.NEAR:
                runs.append([])
            runs[-1].append(d)
        for run in runs:
            covered = {p + j for d in run for p in lines[d] for j in range(3)}
            first, last = min(d + min(lines[d]) for d in run), max(d + max(lines[d]) + 2 for d in run)
            score = round(len(covered) / len(own), 6)
            if score >= license_scan.COVERED and last - first + 1 <= license_scan.STRETCH * len(own):
                spans.append((first, (score, len(own), -t), label))
    best = [s for s in spans if s[1] == max(o[1] for o in spans if abs(o[0] - s[0]) <= license_scan.TOGETHER)]
    return {label for _, _, label in best}, max((r[0] for _, r, _ in best), default=0.0)


def test_licenses_by_brute_force(spark, sf_dir, texts):
    rng = random.Random(81)
    made = []
    for k in range(60):  # edited notices between other words
        words = rng.choice(license_scan.TEMPLATES)[1].split() + rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = "other"
        made.append((10**6 + k, " ".join(["text"] * rng.randrange(9) + words + ["more"] * 5)))
    docs = spark.createDataFrame(texts + made, "doc_id long, text string")
    for r in license_scan.scan_licenses(docs).collect():
        text = dict(texts + made)[r.doc_id]
        labels, score = notices_by_brute_force(text)
        base = set(filter(None, base_licenses(text)[4].split(",")))
        assert (r.labels, r.score) == (",".join(sorted(base | labels)), 1.0 if base else score)


def test_license_odd_rows(odd, none):
    rows = license_scan.scan_licenses(odd).collect()
    assert sorted((r.n_words, r.n_base) for r in rows) == sorted(base_licenses(t)[:2] for _, t, *_ in ODD) and license_scan.scan_licenses(none).count() == 0


# 9 -------------------------------------------------------------------------------------------------------------------


def test_alignment_score():
    item = np.arange(10, 30, dtype=np.uint64)
    noise = np.arange(100, 140, dtype=np.uint64)
    assert decontaminate.align(np.concatenate([noise, item, noise]), item) == (20.0, 60)
    edited = np.delete(item, [4, 11])
    edited[8] = 999
    assert decontaminate.align(np.concatenate([noise, edited, noise]), item)[0] == 17 - 0.5 * 3


def test_leaks_verbatim_and_edited(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rng = random.Random(9)
    rows, want = [], set()
    for k, (item, text) in enumerate(items):
        words = text.split()
        for j in range(0, len(words), 9):
            words[j] = f"edit{rng.randrange(99)}"
        filler = [f"w{rng.randrange(9999)}" for _ in range(200)]
        rows.append((k, " ".join(filler[:99] + (words if k % 2 else text.split()) + filler[99:])))
        want.add((k, item))
        rows.append((1000 + k, " ".join(f"w{rng.randrange(9999)}" for _ in range(300))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert found == want
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {d for d, _ in rows if d >= 1000}


def test_leaks_by_substring(spark, sf_dir, texts):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    found = {(r.doc_id, r.item_id) for r in queries.queries()["op9_rare_seed_alignment"](spark, sf_dir).collect()}
    assert {(d, i.item_id) for d, t in texts for i in items if i.text in (t or "")} <= found


def test_leaks_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "the of and the of and"), (4, "the of and the of and")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.find_leaks(odd, bench).collect()} == {5, 6}
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.drop_leaks(odd, bench.limit(0)).count() == len(ODD)


def edited(words, rng, every):
    return [f"edit{rng.randrange(9999)}" if k % every == every // 2 else w for k, w in enumerate(words)]


def test_leaks_only_in_edited_or_partial_copies(spark):
    rng = random.Random(91)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(n))) for k, n in enumerate((20, 21, 28, 35, 40, 12, 3))]
    filler = " ".join(f"w{k}" for k in range(60))
    rows, want = [], set()
    for every in (3, 4, 5, 6, 7):
        for item, text in items[:5]:
            rows.append((len(rows), f"{filler} {' '.join(edited(text.split(), rng, every))} {filler}"))
            code = {w: k for k, w in enumerate(text.split())}
            if decontaminate.align(np.array([code.get(w, -1) for w in rows[-1][1].split()]), np.arange(len(code)))[0] >= decontaminate.COPY * len(code):
                want.add((rows[-1][0], item))
    many = " ".join(edited(items[0][1].split(), rng, 6))
    for _ in range(500):  # one edited passage in many documents
        rows.append((len(rows), f"{filler} {many} {filler}"))
        want.add((rows[-1][0], 0))
    for item, text in (items[5], (5, " x ".join(items[5][1].split())), (4, " ".join(items[4][1].split()[:24])), items[6]):  # whole, a word put in everywhere, a part, a short item
        rows.append((len(rows), f"{filler} {text} {filler} {text}"))
        want.add((rows[-1][0], item))
    rows.append((len(rows), f"{filler} i6x0 i6x1 {filler}"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert {r.n_places for r in found if r.doc_id >= 525} == {2} and {r.n_places for r in found if r.doc_id < 525} == {1}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_leaks_are_those_of_full_alignment(spark):
    rng = random.Random(92)
    items = [[f"v{rng.randrange(40)}" for _ in range(n)] for n in (4, 5, 6, 9, 14, 25)]
    docs = []
    for _ in range(150):
        words = [f"v{rng.randrange(60)}" for _ in range(rng.randrange(0, 30))]
        for w in rng.choice(items):
            if (kind := rng.randrange(8)) > 1:
                words.append(w)
            if kind in (1, 2):
                words.append(f"v{rng.randrange(60)}")
        docs.append(words + [f"v{rng.randrange(60)}" for _ in range(rng.randrange(0, 30))])
    code = {f"v{k}": k for k in range(60)}
    number = [[np.array([code[w] for w in x]) for x in y] for y in (docs, items)]
    want = {(d, i): round(s / len(b), 6) for d, a in enumerate(number[0]) for i, b in enumerate(number[1]) if (s := decontaminate.align(a, b)[0]) / len(b) >= decontaminate.COPY}
    frames = [spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(y)], f"{c} long, text string") for y, c in ((docs, "doc_id"), (items, "item_id"))]
    assert len(want) > 50 and {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(*frames).collect()} == want


# 10 ------------------------------------------------------------------------------------------------------------------


def test_perfect_hash():
    keys = np.random.default_rng(10).integers(-(1 << 62), 1 << 62, 5000)
    levels, place = line_dedup.build_hash(keys)
    assert sorted(place) == list(range(5000)) and (line_dedup.probe_hash(levels, keys) == place).all()


def test_lines_odd_rows(odd, none):
    out = line_dedup.dedup_lines(odd)
    rows = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    assert len(rows) == len(ODD) and set(odd.columns) < set(out.columns)
    assert (1, None, 1, 0) in rows and (2, "", 1, 0) in rows and rows.count((7, "x", 2, 1)) == 2
    assert (8, "8\nend", 3, 1) in rows and (12, f"12\n  {LINE.upper()}\t\nend", 3, 0) in rows
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_with_every_working_name_taken(spark):
    names = "gone_id gone_key row_key gone_lines shard part parts lo hi line_no text_key n_docs last_doc _id _key _row_key n_lines n_dropped".split()
    docs = spark.createDataFrame([(k, f"{k}\n{LINE}", *names) for k in range(6)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    rows = line_dedup.dedup_lines(docs).collect()
    assert {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows} == {*((k, str(k), 2, 1) for k in range(5)), (5, f"5\n{LINE}", 2, 0)}
    assert all(r[n] == n for r in rows for n in names[:-2])


def test_lines_of_large_ids_beside_a_row_without_id(spark):
    ids = [2**53 + 1 + 2 * k for k in range(4)] + [7 * 10**18 + 1 + 2 * k for k in range(4)]
    docs = spark.createDataFrame([(k, f"x\n{LINE}") for k in [*ids, None]], "doc_id long, text string")
    rows = line_dedup.dedup_lines(docs).collect()
    assert {(r.doc_id, r.text, r.n_dropped) for r in rows} == {*((k, "x", 1) for k in [*ids[:-1], None]), (ids[-1], f"x\n{LINE}", 0)} and len(rows) == 9


def test_one_frequent_line_is_probed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PART_ROWS", 100)
    docs = spark.createDataFrame([(k, f"{LINE}\n{k}\n{'y' * 50}{k % 400}") for k in range(2000)], "doc_id long, text string")
    references = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(lambda b: line_dedup._references(b, 40), line_dedup.REFERENCES)
    gone = line_dedup.repeated_lines(references, 5)
    assert {r.line_no: r["count"] for r in gone.groupBy("line_no").count().collect()} == {0: 1999, 2: 1600}


# pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    docs, sizes = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == sizes[1]
    left = {r.doc_id: r.text for r in docs.collect()}
    assert len(classes_by_pairs(list(left.items()), near_dedup.SIMILARITY)) == len(set(classes_by_pairs(list(left.items()), near_dedup.SIMILARITY).values()))
    assert not any(i.text in t for i in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for t in left.values())
    pieces_hold(corpus_pipeline.run(spark, sf_dir).collect(), token_ids(left.items()))


def test_repeated_benchmark_rows_count_once(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of the kind is said here at all")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text)] * 20_000 + [(8, text), (9, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score, r.n_places) for r in decontaminate.find_leaks(docs, items).collect()) == [(1, 7, 1.0, 1), (1, 8, 1.0, 1)]
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()] == [2]
