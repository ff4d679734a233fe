"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character-class and common-word histograms are compared to those of its language's documents that are labelled
good with the Jensen-Shannon distance. Short documents are too small a sample and are judged by the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import SPACES, clean_text, cut, read_documents

#: Common words by language; fixed values.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "as", "with", "be", "by", "on", "are", "this", "from", "at"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au", "sur", "pas", "plus", "par"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "er"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "lo"],
}
#: Documents in other languages share one reference; their common words are those of all lists' first five.
OTHER = "other"
#: Character classes; each character that is in none counts as a further class.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x20\x09-\x0D", "mark": r".,;:'\"?!()\-", "symbol": r"#*$%&|<>@=+_/\\\^~\[\]{}`"}

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
#: Words from which a document is compared to its language, and the distances (0 to 1) beyond which it is rejected.
COMPARED_WORDS, CHAR_DISTANCE, WORD_DISTANCE = 50, 0.30, 0.50


def _letters(text: Column, chars: str) -> Column:
    """Number of characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with words (array) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = clean_text()
    trimmed = F.btrim(text, F.lit(SPACES))
    df = docs.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+")))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("words")
    windows = F.transform(F.slice("hashes", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("hashes", i + k) for k in range(1, WINDOW)]))
    df = df.withColumn("windows", windows)
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    twin = F.transform("sorted", lambda e, k: F.when((e["h"] == F.get("sorted", k - 1)["h"]) | (e["h"] == F.get("sorted", k + 1)["h"]), e["i"]))
    df = df.withColumn("twins", F.sort_array(F.filter(twin, lambda x: x.isNotNull())))
    covered = F.aggregate(F.transform("twins", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("twins", k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    n_repeat = F.coalesce(covered, F.lit(0).cast("long"))
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"),
        "n_symbols": _letters(text, SYMBOLS[1:-1]).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": n_repeat,
    })
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return df.drop("hashes", "windows", "sorted", "twins", "lines")


def language_key() -> Column:
    return F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(OTHER))


def histograms(df: DataFrame) -> DataFrame:
    """df with language, char_counts and word_counts; the last entry of each is all that is in no class or list."""
    lists = COMMON_WORDS | {OTHER: sorted({w for words in COMMON_WORDS.values() for w in words[:5]})}
    width = max(map(len, lists.values()))
    every = sorted({w for words in lists.values() for w in words})
    df = df.withColumn("language", language_key())
    own = F.lit(None).cast("array<string>")
    for name, words in lists.items():
        own = F.when(F.col("language") == name, F.array(*[F.lit(w) for w in words + [""] * (width - len(words))])).otherwise(own)
    counts = [_letters(clean_text(), c) for c in CLASSES.values()]
    df = df.withColumn("common", F.filter("words", lambda w: F.lower(w).isin(every))).withColumn("common", F.transform("common", lambda w: F.lower(w)))
    df = df.withColumn("own", own).withColumn("char_counts", F.array(*counts, F.length(clean_text())))
    df = df.withColumn("word_counts", F.transform("own", lambda w: F.size("common") - F.size(F.array_remove(F.col("common"), w))))
    df = df.withColumn("char_counts", F.concat(F.slice("char_counts", 1, len(CLASSES)), F.array(F.get("char_counts", F.lit(len(CLASSES))) - sum((F.get("char_counts", F.lit(k)) for k in range(len(CLASSES))), F.lit(0)))))
    known = sum((F.get("word_counts", F.lit(k)) for k in range(width)), F.lit(0))
    return df.withColumn("word_counts", F.concat("word_counts", F.array((F.col("n_words") - known).cast("int")))).drop("common", "own")


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two count arrays of one length; null if either is empty."""
    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def both(p: Column, q: Column) -> Column:
        return part(p, (p + q) / 2) + part(q, (p + q) / 2)

    def shares(c: str) -> Column:
        return F.transform(c, lambda x: x / total(c))

    divergence = F.aggregate(F.zip_with(shares(counts), shares(reference), both), F.lit(0.0), lambda a, x: a + x) / 2
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def references(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(language, all_char_counts, all_word_counts): sums over the documents of rows that labels calls good; a row for each language at most."""
    widths = {"char_counts": len(CLASSES) + 1, "word_counts": max(map(len, COMMON_WORDS.values())) + 1}
    good = labels.where("quality = 1").select("doc_id").distinct()
    sums = rows.join(good, "doc_id", "left_semi").groupBy("language").agg(*[F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, n in widths.items() for k in range(n)])
    return sums.select("language", *[F.array(*[f"{c}{k}" for k in range(n)]).alias(f"all_{c}") for c, n in widths.items()])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, the base counts, base_failed, language, char_distance, word_distance, kept.

    kept is false if base_failed, or if the document has COMPARED_WORDS words and its character distance exceeds
    CHAR_DISTANCE or its word distance WORD_DISTANCE. The references are the sums over a language's documents that labels
    (doc_id, quality) calls good (1), so that junk in the corpus does not become the measure; a language without any
    compares to nothing and rejects nothing. A null text has no words and fails the base rule; a null language counts as
    OTHER. Repeated rows are judged each, alike. An empty table gives no rows. Extra columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", F.xxhash64(clean_text()).alias("text_key"))
    return _judged(cut(histograms(base_counts(rows)).drop("text", "words", "lang")), labels)


def _judged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with histograms, with distances and kept instead."""
    rows = rows.join(F.broadcast(references(rows, labels)), "language", "left")  # a row for each list of COMMON_WORDS and one more
    rows = rows.withColumn("char_distance", F.round(distance("char_counts", "all_char_counts"), 6)).withColumn("word_distance", F.round(distance("word_counts", "all_word_counts"), 6))
    far = (F.col("n_words") >= COMPARED_WORDS) & ((F.coalesce("char_distance", F.lit(0.0)) > CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_DISTANCE))
    return rows.withColumn("kept", ~F.col("base_failed") & ~far).drop("char_counts", "word_counts", "all_char_counts", "all_word_counts")


def keep_sound(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that judge keeps, with all their columns. A row is judged where it stands: no text is shuffled.

    The row travels as one struct, so that its columns may have any names.
    """
    rows = docs.select("doc_id", "text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return _judged(cut(histograms(base_counts(rows)).drop("text", "words", "lang")), labels).where("kept").select("row.*")


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_key")


def _oracle() -> str:
    """The verdicts in DuckDB SQL."""
    lists = COMMON_WORDS | {OTHER: sorted({w for words in COMMON_WORDS.values() for w in words[:5]})}
    own = " ".join(f"WHEN '{name}' THEN {words}" for name, words in lists.items())
    width, kinds = max(map(len, lists.values())), len(CLASSES)
    chars = ", ".join(f"length(regexp_replace(text, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in CLASSES.values())
    js = " + ".join(f"coalesce(CASE WHEN {a} > 0 THEN {a} * log2({a} / ((p + q) / 2)) END, 0)" for a in "pq")

    def far(counts: str, n: int) -> str:
        terms = " + ".join(f"(SELECT {js} FROM (SELECT {counts}[{k}] / list_sum({counts}) AS p, all_{counts}[{k}] / list_sum(all_{counts}) AS q))" for k in range(1, n + 1))
        return f"CASE WHEN list_sum({counts}) > 0 AND list_sum(all_{counts}) > 0 THEN round(sqrt(greatest(({terms}) / 2, 0)), 6) END"

    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(f"'{x}'" for x in COMMON_WORDS)}) THEN lang ELSE '{OTHER}' END AS language FROM documents
), v AS (
  SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines, CASE language {own} END AS own FROM t
), w AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i FROM v),
g AS (SELECT rid, i, string_agg(word, ' ') OVER win AS gram, count(*) OVER win AS n FROM w WINDOW win AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
twins AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g WHERE n = {WINDOW}) WHERE c > 1),
steps AS (SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS s FROM twins),
covered AS (SELECT rid, sum(s) AS n FROM steps GROUP BY rid),
b AS (
  SELECT v.*, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, [{chars}] AS some_chars, list_transform(own, lambda c: len(list_filter(words, lambda x: lower(x) = c))) AS some_words
  FROM v LEFT JOIN covered c ON v.rid = c.rid
), h AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed, list_append(some_chars, length(text) - list_sum(some_chars)) AS char_counts,
    list_append(list_resize(some_words, {width}, 0), n_words - list_sum(some_words)) AS word_counts
  FROM b
), good AS (SELECT * FROM h WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
refs AS (SELECT language, [{", ".join(f"sum(char_counts[{k}])" for k in range(1, kinds + 2))}] AS all_char_counts, [{", ".join(f"sum(word_counts[{k}])" for k in range(1, width + 2))}] AS all_word_counts FROM good GROUP BY language),
d AS (SELECT h.*, {far("char_counts", kinds + 1)} AS char_distance, {far("word_counts", width + 1)} AS word_distance FROM h LEFT JOIN refs r ON h.language = r.language)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, language, char_distance, word_distance,
  NOT base_failed AND NOT (n_words >= {COMPARED_WORDS} AND (coalesce(char_distance, 0) > {CHAR_DISTANCE} OR coalesce(word_distance, 0) > {WORD_DISTANCE})) AS kept
FROM d
"""


ORACLE = _oracle()
