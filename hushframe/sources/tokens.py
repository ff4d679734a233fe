"""Elements and text nodes of plain HTML pages without a parser: a token stream and windows over it.

A page is a sequence of tokens (tags, runs of text, comments). Brackets are matched by running depths: an end tag closes the
element of its name that is open at its depth, an element that nothing closes ends with the one around it. Elements are then
nested intervals of tokens, and whatever asks for ancestors asks for intervals that hold a place: the nearest is the last one
opened a level higher, and a hidden one is known by a running maximum of ends.

All windows are by page, so that one exchange serves them. Meant are pages whose end tags do not cross, without ends that only a next tag
implies, templates, or a > inside an attribute: on those it gives what the parser gives. `crossed` tells pages whose end tags cross.
"""

from __future__ import annotations

from html import unescape
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.functions.text import js_trim
from hushframe.sources.html import UNREAD, VOID

#: A comment, an element whose content is no markup, a declaration, a tag, a run of text, a lone bracket.
TOKEN = r"(?s)<!--.*?(?:-->|\z)|<(?i:script)\b[^>]*>.*?</(?i:script)\s*>|<(?i:style)\b[^>]*>.*?</(?i:style)\s*>|<[!?][^>]*>|</?[a-zA-Z][^>]*>|[^<]+|<"
TAG = r"^</?([a-zA-Z][^\s/>]*)"
#: An opening tag with a mark that hides its element.
HIDING = r"(?i)^<[a-z][^>]*?\s(hidden(?:[\s=/>])|aria-hidden\s*=\s*[\"']?true[\"'\s>]|style\s*=\s*[\"'][^\"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden))"
HIDING_INPUT = r"(?i)^<input\b[^>]*?\stype\s*=\s*[\"']?hidden[\"'\s/>]"
#: Names of characters that text may hold, then those that need no semicolon, longest first; the ampersand comes last of all, in one pass, so that
#: nothing is read twice.
ENTITIES = {f"&{k};": chr(v) for k, v in sorted(name2codepoint.items()) if k != "amp"} | {f"&{k}": html5[k] for k in sorted((n for n in html5 if n[-1] != ";" and n != "amp"), key=lambda n: (-len(n), n))}
#: Decimal and hexadecimal references, with or without a semicolon, and the numbers that stand for something else than their character.
_NUMBERED = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?"
_NUMBERS = {n: "&amp;" if n == 38 else unescape(f"&#{n};") for n in range(0xA0) if n == 38 or unescape(f"&#{n};") != chr(n)}
_UNREADABLE, _NONE = "n > 1114111 OR n BETWEEN 55296 AND 57343", "n % 65536 >= 65534 OR n BETWEEN 64976 AND 65007"


def decoded(text: Column) -> Column:
    """The text with character references read, by name or number, as browsers do: old names and numbers need no semicolon."""
    def char(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "[0-9a-fA-F]+", 0)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")

        def of(n: Column) -> Column:
            odd = F.create_map(*[F.lit(x) for pair in _NUMBERS.items() for x in pair])[n.cast("int")]
            plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
            return F.when((n > 1114111) | n.between(55296, 57343), "\ufffd").when((n % 65536 >= 65534) | n.between(64976, 65007), "").otherwise(F.coalesce(odd, plain))

        return F.get(F.transform(F.array(code), of), F.lit(0))

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(_NUMBERED), F.lit(0)))
    refs = F.array_sort(refs, lambda a, b: F.length(b) - F.length(a))
    out = F.aggregate(refs, text, lambda t, r: F.replace(t, r, char(r)))
    names = F.array(*[F.array(F.lit(name), F.lit(c)) for name, c in ENTITIES.items()])
    out = F.aggregate(names, out, lambda t, e: F.replace(t, e[0], e[1]))
    return F.when(text.contains("&"), F.regexp_replace(out, "&amp;?", "&")).otherwise(text)


def token_rows(pages: DataFrame) -> DataFrame:
    """(page_id, tok, kind, tag, raw) of pages (page_id, html): kind is open, leaf (an element without content), close or text."""
    raw = F.col("raw")
    df = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("tok", "raw"))
    tag = F.lower(F.regexp_extract(raw, TAG, 1))
    leaf = tag.isin(*VOID, "script", "style") | raw.rlike("/>$")
    kind = F.when(raw.rlike("^<[a-zA-Z]"), F.when(leaf, "leaf").otherwise("open")).when(raw.rlike("^</[a-zA-Z]"), "close").when(~raw.rlike("^<[!?]"), "text")
    return df.withColumn("kind", kind).where("kind is not null").withColumn("tag", F.when(F.col("kind") != "text", tag)).select("page_id", "tok", "kind", "tag", "raw")


def nested(pages: DataFrame) -> DataFrame:
    """Token rows with node_idx (of elements, from 0), parent_idx (of the nearest open element, null for none), stop (the token an element ends at,
    null at the page's end), visible (neither it nor an element around it is hidden) and crossed."""
    # a named number of partitions, so that compressed pages are not put together into tasks whose tokens are too many
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.rdd.getNumPartitions())
    df = token_rows(pages.select("page_id", "html").repartition(tasks, "page_id"))

    def upto(*by: str, order: tuple = ("tok",)) -> Window:
        return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    df = df.withColumn("d", F.sum(step).over(upto("page_id", "tag"))).withColumn("low", F.min("d").over(upto("page_id", "tag")))
    stray = (F.col("kind") == "close") & (F.col("d") < 0) & (F.col("d") == F.col("low")) & (F.lag("low", 1, 0).over(Window.partitionBy("page_id", "tag").orderBy("tok")) > F.col("d"))
    depth = F.col("d") - F.least(F.lit(0), F.col("low")) + F.when(F.col("kind") == "close", 1).otherwise(0)
    df = df.withColumn("stray", stray).where("not stray").withColumn("level", depth)
    same = Window.partitionBy("page_id", "tag", "level", F.col("kind").isin("open", "close")).orderBy("tok")
    df = df.withColumn("stop", F.when((F.col("kind") == "open") & (F.lead("kind").over(same) == "close"), F.lead("tok").over(same)))
    df = df.withColumn("start", F.when(F.col("kind") == "close", F.lag("tok").over(same)))
    # closed elements give the levels; one that is not closed ends with the one around it
    step = F.when(F.col("stop").isNotNull(), 1).when(F.col("kind") == "close", -1).otherwise(0)
    df = df.withColumn("level", F.sum(step).over(upto("page_id")) + F.when(F.col("kind") == "close", 1).otherwise(0))
    loose = (F.col("kind") == "open") & F.col("stop").isNull()
    df = df.withColumn("loose", loose)
    ahead = Window.partitionBy("page_id", "level").orderBy("tok").rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("stop", F.when(F.col("loose"), F.first(F.when(F.col("kind") == "close", F.col("tok")), ignorenulls=True).over(ahead)).otherwise(F.col("stop")))
    df = df.withColumn("n_loose", F.sum(F.when(F.col("loose"), 1).otherwise(0)).over(upto("page_id", "level")))
    opened = F.when((F.col("kind") == "open") & ~F.col("loose"), F.struct("tok", "n_loose"))
    df = df.withColumn("opened", F.last(opened, ignorenulls=True).over(upto("page_id", "level")))
    ends = F.when(F.col("kind") == "close", 1 + F.col("n_loose") - F.col("opened.n_loose")).otherwise(0)
    df = df.withColumn("across", (F.col("kind") == "close") & ~F.col("opened.tok").eqNullSafe(F.col("start")))
    # nested intervals: depth, number, and the furthest end of a hidden element so far
    hides = F.col("raw").rlike(HIDING) | F.col("raw").rlike(HIDING_INPUT)
    page = upto("page_id")
    df = df.withColumn("depth", F.sum(F.when(F.col("kind") == "open", 1).otherwise(0) - ends).over(page) - F.when(F.col("kind") == "open", 1).otherwise(0))
    df = df.withColumn("node_idx", F.when(F.col("kind").isin("open", "leaf"), F.count_if(F.col("kind").isin("open", "leaf")).over(page) - 1))
    last = F.when(F.col("kind") == "leaf", F.col("tok")).otherwise(F.coalesce("stop", F.lit(2**31 - 1)))
    df = df.withColumn("hidden_to", F.max(F.when(F.col("kind").isin("open", "leaf") & hides, last)).over(page))
    df = df.withColumn("crossed", F.max("across").over(Window.partitionBy("page_id"))).where("kind <> 'close'")
    # each open element stands once as itself and once for what is a level deeper
    roles = F.array(F.struct(F.lit(1).alias("role"), F.col("depth").alias("key")), F.struct(F.lit(0).alias("role"), (F.col("depth") + 1).alias("key")))
    df = df.withColumn("r", F.explode(F.when(F.col("kind") == "open", roles).otherwise(F.slice(roles, 1, 1))))
    inside = Window.partitionBy("page_id", "r.key").orderBy("tok", "r.role").rowsBetween(Window.unboundedPreceding, -1)
    around = F.last(F.when(F.col("r.role") == 0, F.struct("node_idx", "tag")), ignorenulls=True).over(inside)
    df = df.withColumn("around", around).where("r.role = 1")
    return df.select("page_id", "tok", "kind", "tag", "raw", F.col("node_idx").cast("int").alias("node_idx"), F.col("around.node_idx").cast("int").alias("parent_idx"), F.col("around.tag").alias("parent_tag"), "stop", (F.coalesce("hidden_to", F.lit(-1)) < F.col("tok")).alias("visible"), "crossed")


def native_elements(pages: DataFrame) -> DataFrame:
    """(page_id, node_idx, parent_idx, tag, visible) of pages (page_id, html); null pages have none."""
    return nested(pages).where("kind in ('open', 'leaf')").select("page_id", "node_idx", "parent_idx", "tag", "visible")


def native_text_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, text_idx, parent_idx, visible, text) of pages (page_id, html): non-blank runs of text whose parent shows text."""
    rows = nested(pages).where("kind = 'text' and parent_idx is not null").where(~F.col("parent_tag").isin(*UNREAD)).withColumn("text", js_trim(decoded(F.col("raw")))).where("text <> ''")
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("tok")) - 1
    return rows.select("page_id", number.alias("text_idx"), "parent_idx", "visible", "text")


def sql(table: str = "pages") -> str:
    """The token rows of nested in DuckDB SQL, as a list of common table expressions that ends with nested."""
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    void = ", ".join(text(t) for t in sorted([*VOID, "script", "style"]))
    plain = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
found AS (SELECT page_id, regexp_extract_all(html, {text(TOKEN)}) AS toks FROM {table}),
raws AS (SELECT page_id, unnest(toks) AS raw, unnest(range(len(toks))) AS tok FROM found),
named AS (SELECT *, lower(regexp_extract(raw, {text(TAG)}, 1)) AS name FROM raws),
kinds AS (SELECT page_id, tok, raw, CASE WHEN regexp_matches(raw, '^<[a-zA-Z]') THEN CASE WHEN name IN ({void}) OR raw LIKE '%/>' THEN 'leaf' ELSE 'open' END
  WHEN regexp_matches(raw, '^</[a-zA-Z]') THEN 'close' WHEN NOT regexp_matches(raw, '^<[!?]') THEN 'text' END AS kind, name FROM named),
t0 AS (SELECT page_id, tok, kind, CASE WHEN kind <> 'text' THEN name END AS tag, raw FROM kinds WHERE kind IS NOT NULL),
t1 AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY tok {plain}) AS d FROM t0),
t2 AS (SELECT *, least(0, min(d) OVER (PARTITION BY page_id, tag ORDER BY tok {plain})) AS low FROM t1),
t3 AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY page_id, tag ORDER BY tok), 0) AS low_before FROM t2),
t4 AS (SELECT *, d - low + CASE kind WHEN 'close' THEN 1 ELSE 0 END AS lvl FROM t3 WHERE NOT (kind = 'close' AND low < low_before)),
t5 AS (SELECT *, CASE WHEN kind = 'open' AND lead(kind) OVER same = 'close' THEN lead(tok) OVER same END AS closed FROM t4 WINDOW same AS (PARTITION BY page_id, tag, lvl, kind IN ('open', 'close') ORDER BY tok)),
t6 AS (SELECT *, sum(CASE WHEN closed IS NOT NULL THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY tok {plain}) + CASE kind WHEN 'close' THEN 1 ELSE 0 END AS lev, kind = 'open' AND closed IS NULL AS loose FROM t5),
t7 AS (SELECT *, CASE WHEN loose THEN min(CASE WHEN kind = 'close' THEN tok END) OVER (PARTITION BY page_id, lev ORDER BY tok ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) ELSE closed END AS stop,
  sum(CASE WHEN loose THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, lev ORDER BY tok {plain}) AS n_loose FROM t6),
t8 AS (SELECT *, max(CASE WHEN kind = 'open' AND NOT loose THEN n_loose END) OVER (PARTITION BY page_id, lev ORDER BY tok {plain}) AS n_before FROM t7),
t9 AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN n_before - n_loose - 1 ELSE 0 END) OVER page - CASE kind WHEN 'open' THEN 1 ELSE 0 END AS depth,
  CASE WHEN kind IN ('open', 'leaf') THEN sum(CASE WHEN kind IN ('open', 'leaf') THEN 1 ELSE 0 END) OVER page - 1 END AS node_idx,
  max(CASE WHEN kind IN ('open', 'leaf') AND (regexp_matches(raw, {text(HIDING)}) OR regexp_matches(raw, {text(HIDING_INPUT)})) THEN CASE kind WHEN 'leaf' THEN tok ELSE coalesce(stop, 2147483647) END END) OVER page AS hidden_to
  FROM t8 WINDOW page AS (PARTITION BY page_id ORDER BY tok {plain})),
roles AS (SELECT *, depth AS key, 1 AS role FROM t9 WHERE kind <> 'close' UNION ALL SELECT *, depth + 1, 0 FROM t9 WHERE kind = 'open'),
held AS (SELECT *, max(CASE role WHEN 0 THEN node_idx END) OVER (PARTITION BY page_id, key ORDER BY tok, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_idx FROM roles),
nested AS (SELECT page_id, tok, kind, tag, raw, CAST(node_idx AS INT) AS node_idx, CAST(parent_idx AS INT) AS parent_idx, coalesce(hidden_to, -1) < tok AS visible, stop FROM held WHERE role = 1)"""


def sql_decoded(column: str) -> str:
    code = "CASE WHEN lower(r[3]) = 'x' THEN CAST('0x' || regexp_extract(r, '[0-9a-fA-F]+') AS BIGINT) ELSE CAST(regexp_extract(r, '[0-9]+') AS BIGINT) END"
    odd = " ".join(f"WHEN {n} THEN " + (" || ".join(f"chr({ord(x)})" for x in c) or "''") for n, c in _NUMBERS.items())
    char = f"list_transform([{code}], lambda n: CASE WHEN {_UNREADABLE} THEN chr(65533) WHEN {_NONE} THEN '' ELSE CASE n {odd} ELSE chr(CAST(n AS INT)) END END)[1]"
    refs = f"list_transform(list_reverse_sort(list_transform(list_distinct(regexp_extract_all({column}, '{_NUMBERED}')), lambda r: printf('%03d', length(r)) || r)), lambda r: r[4:])"
    out = f"list_reduce(list_prepend({column}, {refs}), lambda t, r: replace(t, r, {char}))"
    for name, c in ENTITIES.items():
        c = "''" if c == "'" else c
        out = f"replace({out}, '{name}', '{c}')"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"
