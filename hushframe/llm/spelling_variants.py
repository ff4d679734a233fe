"""Spelling variants: words one edit apart, found through an index of variable-length grams.

Grams grow from MIN_GRAM characters on for as long as they are frequent, so that a frequent short gram gives way to rarer
longer ones. A word is decomposed into the longest grams at its places that no earlier one covers. For each word the grams
that one edit can affect are bounded, which bounds from below what two near words share: only as many of a word's rarest
grams as the bound asks for are indexed, and what two words share is tested by parity maps before the edit is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import cut, read_documents, slices

MIN_CHARS, MIN_COUNT = 6, 5
#: Shortest and longest grams, and what a word is padded by on either side. Two words of MIN_CHARS characters that are one
#: edit apart agree in MAX_GRAM characters from either padded end, so that they share a gram.
MIN_GRAM, MAX_GRAM = 2, 5
HEAD, TAIL = "^^", "$$"
#: A gram is extended if it stands at more than one in SHARE places, and at RARE at least. At most SHARE grams of each
#: length are, which bounds the dictionary by the number of letters times that, whatever the number of words.
SHARE, RARE = 20_000, 64
#: Words of one gram that meet as they are; those of a longer list meet by what they have in common without one character.
LIST_WORDS = 4096
#: Distinct words or grams that a task counts in memory before it passes them on.
COUNTED = 200_000
#: Words of 64 bits of a word's parity map.
PARITY = 2
#: One in so many words of a document loses a character, by crc32.
TYPO_EVERY = 199

_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_CHARS},}}")


def with_typo(word: str, hashed: int, every: int) -> str:
    """The word without one character if every divides hashed."""
    if hashed % every:
        return word
    k = hashed % len(word)
    return word[:k] + word[k + 1 :]


def _flushed(counts: Counter, names: list[str]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=names)
    counts.clear()
    return out


def _count_words(batches: Iterator[pa.RecordBatch], every: int | None) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for part in slices(batch):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                own = Counter(_RUN.findall((text.as_py() or "").encode().lower().decode()))
                if every and doc_id is not None:
                    begin = zlib.crc32(f"{doc_id}:".encode())
                    for word in [w for w in own if not zlib.crc32(w.encode(), begin) % every]:
                        n = own.pop(word)
                        counts[with_typo(word, zlib.crc32(word.encode(), begin), every)] += n
                counts.update(own)
                if len(counts) > COUNTED:
                    yield _flushed(counts, ["word", "n"])
    yield _flushed(counts, ["word", "n"])


def count_words(docs: DataFrame, typo_every: int | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of MIN_CHARS or more characters in all documents (doc_id, text) that stand there min_count times.

    Words are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. With typo_every, a word of a document
    loses a character where typo_every divides the crc32 of "doc_id:word"; rows without doc_id lose none. Shorter runs
    cannot give such a word, so they are not looked at. A null text has no words; repeated rows count each.
    """
    counts = docs.select("doc_id", "text").mapInArrow(lambda b: _count_words(b, typo_every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) & (F.length("word") >= MIN_CHARS))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            padded = f"{HEAD}{word}{TAIL}"
            for size in range(MIN_GRAM, MAX_GRAM + 1):
                counts.update([padded[k : k + size] for k in range(len(padded) - size + 1)])
            if len(counts) > COUNTED:
                yield _flushed(counts, ["gram", "n"])
    yield _flushed(counts, ["gram", "n"])


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Grams and how often they stand in the padded words: all of MIN_GRAM characters, and those whose longest beginning is frequent.

    At most SHARE grams of each length are frequent, so that the dictionary has SHARE * (MAX_GRAM - MIN_GRAM) times the
    number of letters at most, which is what comes to the driver.
    """
    counts = cut(words.select("word").mapInArrow(_count_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    places = counts.where(F.length("gram") == MIN_GRAM).agg(F.sum("n")).first()[0] or 0
    often = counts.where((F.col("n") > max(RARE, places // SHARE)) & (F.length("gram") < MAX_GRAM)).select(F.col("gram").alias("stem"))
    stem = F.expr("substring(gram, 1, length(gram) - 1)")
    longer = counts.withColumn("stem", stem).join(often, "stem", "left_semi").select("gram", "n")
    kept = longer.where(F.length("gram") > MIN_GRAM).union(counts.where(F.length("gram") == MIN_GRAM))
    return dict(map(tuple, kept.collect()))


def decompose(padded: str, dictionary: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of the padded word's grams: at each place the longest one of the dictionary, but none that an earlier one covers."""
    out, reach = [], 0
    for start in range(len(padded) - MIN_GRAM + 1):
        end = start + MIN_GRAM
        while end < len(padded) and end - start < MAX_GRAM and padded[start : end + 1] in dictionary:
            end += 1
        if end > reach:
            out.append((start, end))
            reach = end
    return out


def shared_at_least(padded: str, grams: list[tuple[int, int]]) -> int:
    """How many distinct grams of a word any word has that is one edit away.

    Replacing or deleting the character at place i leaves a gram before it alone if its search ended before i (so one of
    full length may end there), and one behind it if no longer gram from before the edit can come to cover it. An
    inserted character leaves more alone than the replacement of the one before it.
    """
    spans: dict[str, tuple[int, int]] = {}
    for start, end in grams:
        after, before = end if end - start == MAX_GRAM else end + 1, min(start - 1, end - MAX_GRAM - 1)
        old = spans.get(padded[start:end], (after, before))
        spans[padded[start:end]] = min(after, old[0]), max(before, old[1])
    return min(sum(i >= after or i <= before for after, before in spans.values()) for i in range(len(HEAD), len(padded) - len(TAIL)))


def _index(batches: Iterator[pa.RecordBatch], dictionary: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, least, rare, parity = [], [], [], [[] for _ in range(PARITY)]
        for word in batch.column("word").to_pylist():
            padded = f"{HEAD}{word}{TAIL}"
            spans = decompose(padded, dictionary)
            grams = sorted({padded[a:b] for a, b in spans}, key=lambda g: (dictionary[g], g))
            need = shared_at_least(padded, spans)
            sizes.append(len(grams))
            least.append(need)
            rare.append(grams[: len(grams) - need + 1])
            bits = 0
            for g in grams:
                bits ^= 1 << zlib.crc32(g.encode()) % (64 * PARITY)
            for k, column in enumerate(parity):
                column.append((bits >> 64 * k & 0xFFFFFFFFFFFFFFFF) - (1 << 64) * (bits >> 64 * k + 63 & 1))
        columns = [*batch.select(["word", "n"]).columns, pa.array(sizes, pa.int32()), pa.array(least, pa.int32()), pa.array(rare, pa.list_(pa.string())), *(pa.array(c, pa.int64()) for c in parity)]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "size", "least", "rare", *(f"q{k}" for k in range(PARITY))])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of the words (word, n) that differ by exactly one inserted, deleted or replaced character, a < b."""
    shared = words.sparkSession.sparkContext.broadcast(gram_dictionary(words))
    kind = f"word string, n long, size int, least int, rare array<string>, {', '.join(f'q{k} long' for k in range(PARITY))}"
    index = words.select("word", "n").mapInArrow(lambda b: _index(b, shared.value), kind)
    postings = cut(index.withColumn("gram", F.explode("rare")).drop("rare"))
    lists = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("words")).where("words > 1")
    postings = cut(postings.join(lists, "gram"))
    short, long = postings.where(F.col("words") <= LIST_WORDS), postings.where(F.col("words") > LIST_WORDS)
    without = F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.concat(F.substring(F.col("word"), 1, k - 1), F.substring(F.col("word"), k + 1, F.length("word"))))
    long = long.withColumn("part", F.explode(F.array_distinct(F.array_append(without, F.col("word")))))
    met = _meet(short, ["gram"]).unionByName(_meet(long, ["gram", "part"]))
    return met.distinct()


def _meet(postings: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of words with equal keys that share as many grams as both bounds ask for and are one edit apart."""
    rest = ["word", "n", "size", "least", *(f"q{k}" for k in range(PARITY))]
    first = postings.select(*keys, *[F.col(c).alias(f"a_{c}") for c in rest])
    second = postings.select(*keys, *[F.col(c).alias(f"b_{c}") for c in rest])
    differ = sum((F.bit_count(F.col(f"a_q{k}").bitwiseXOR(F.col(f"b_q{k}"))) for k in range(PARITY)), F.lit(0))
    may = differ <= F.col("a_size") + F.col("b_size") - 2 * F.greatest("a_least", "b_least")
    met = first.join(second, keys).where((F.col("a_word") < F.col("b_word")) & may & (F.levenshtein("a_word", "b_word", 1) == 1))
    return met.select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n) of MIN_CHARS characters or more.

    n_near counts a word's near words (one edit away); form is the near word of largest n, of equal ones the smallest, if it
    has at least ratio (over 1) times the word's n; root is the last word that forms lead to. Rows without word or n and shorter words are
    left out; what repeated rows of a word count adds up. An empty table gives no rows; other columns are ignored.
    """
    words = words.where(F.col("n").isNotNull() & (F.length("word") >= MIN_CHARS))
    words = cut(words.groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    pairs = cut(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("form"), F.col("b_n").alias("form_n"))
    both = both.union(pairs.select("b", "b_n", "a", "a_n"))
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    large = -F.col("best.less") >= ratio * F.col("n")
    near = cut(near.select("word", "n_near", F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")))
    roots = near.where("form is not null").select("word", F.col("form").alias("root"))
    out = words.join(near, "word", "left").join(_followed(roots), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def _followed(roots: DataFrame) -> DataFrame:
    """(word, root): where the chains of (word, root) end. Counts grow along a chain, so it ends; each round doubles the steps."""
    roots = cut(roots)
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(roots.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = new.where("moved").limit(1).count()
        roots = new.select("word", "root")
        if not moved:
            return roots


def op13_variable_gram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(read_documents(spark, sf_dir, "doc_id", "text"), TYPO_EVERY))
