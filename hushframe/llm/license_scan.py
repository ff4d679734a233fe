"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of a document are joined to the places of the same k-gram in license templates. Each meeting
votes for a diagonal, document place minus template place. Neighbouring diagonals merge, and a merged run of votes is a
notice if the template words it covers are enough of the template and lie close together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.llm.common import clean_text, cut, read_documents

#: Base phrases and their labels; fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as they stand in files, by label; fixed values.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
#: Words of a k-gram; diagonals this near merge; share of a template's words that a notice covers; its length over the template's.
K, NEAR, COVERED, STRETCH = 3, 3, 0.7, 1.6
#: Notices that begin this near are one, named by the template that it covers best.
TOGETHER = 10

#: All ASCII but digits and small letters, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """Lower case. The two characters beyond ASCII whose small forms hold ASCII letters become another sign first, so that in ASCII only A-Z change."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("·")), F.lit("İ"), F.lit("·")))


def word_array(text: Column) -> Column:
    return F.filter(F.split(lowered(text), SEPARATORS), lambda w: w != "")


def _places(phrase: str) -> Column:
    """Places in words at which the phrase's words stand; only texts that hold all of them are searched."""
    wanted = phrase.split()
    may = None
    for w in dict.fromkeys(wanted):
        may = F.col("low").contains(w) if may is None else may & F.col("low").contains(w)
    def here(i: Column) -> Column:
        out = F.get("words", i) == wanted[0]
        for k, w in enumerate(wanted[1:], 1):
            out = out & (F.get("words", i + k) == w)
        return out

    all_places = F.sequence(F.lit(0), F.size("words") - len(wanted))
    return F.when(may & (F.size("words") >= len(wanted)), F.filter(all_places, here)).otherwise(F.array().cast("array<int>"))


def template_places(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(gram, template, label, place, length) of each k-gram of each template; a fixed small table."""
    rows = [(f"{a} {b} {c}", t, label, k, len(words)) for t, (label, text) in enumerate(templates) for words in [text.split()] for k, (a, b, c) in enumerate(zip(words, words[1:], words[2:], strict=False))]
    schema = T.StructType([T.StructField("grams", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("length", T.IntegerType())])
    table = spark.createDataFrame(rows, schema)
    words = F.split("grams", " ")
    return table.withColumn("gram", _gram(*[F.xxhash64(F.get(words, F.lit(k))) for k in range(K)])).drop("grams")


def _gram(*hashes: Column) -> Column:
    return F.xxhash64(*hashes)


def gram_hits(known: list[int]) -> Column:
    """(gram, at) of the k-grams over word hashes that are among the known hashes; the join's semi-join part, done inside the row."""
    return F.filter(F.transform("hashes", lambda x, i: F.struct(_gram(x, *[F.get("hashes", i + k) for k in range(1, K)]).alias("gram"), i.alias("at"))), lambda s: s["gram"].isin(known))


def find_notices(hits: DataFrame, places: DataFrame) -> DataFrame:
    """(row, label, first, last, score) of the notices, from the k-grams (row, gram, at) of documents and of templates."""
    votes = hits.join(F.broadcast(places), "gram").withColumn("diagonal", F.col("at") - F.col("place"))  # places: the templates' words
    runs = votes.groupBy("row", "template", "label", "length", "diagonal").agg(F.collect_set("place").alias("places"))
    parts = "row, template"
    runs = runs.withColumn("opens", F.expr(f"coalesce(diagonal - lag(diagonal) OVER (PARTITION BY {parts} ORDER BY diagonal) > {NEAR}, true)"))
    runs = runs.withColumn("run", F.expr(f"sum(int(opens)) OVER (PARTITION BY {parts} ORDER BY diagonal)"))
    spans = runs.groupBy("row", "template", "label", "length", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("first"), F.max(F.col("diagonal") + F.array_max("places") + K - 1).alias("last"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + K - 1)))))
    spans = spans.withColumn("score", F.round(covered / F.col("length"), 6))
    near = F.col("last") - F.col("first") + 1 <= STRETCH * F.col("length")
    spans = spans.where((F.col("score") >= COVERED) & near).withColumn("rank", F.struct("score", "length", (-F.col("template")).alias("order")))
    together = Window.partitionBy("row").orderBy("first").rangeBetween(-TOGETHER, TOGETHER)
    return spans.withColumn("best", F.max("rank").over(together)).where("rank = best").select("row", "label", "first", "last", "score")


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base columns count the PHRASES at all places; labels adds those of notices found by diagonal voting. score is 1 where a
    base phrase stands, else the best notice's covered share, else 0. A null text has no words; without a phrase, first_word
    and last_word are null and base_labels is empty. Repeated rows are scanned each, alike. An empty table gives no rows.
    Extra columns are ignored. Each text is split once; what is kept of it are places and the templates' k-grams.
    """
    places = template_places(docs.sparkSession, templates)
    known = [r.gram for r in places.select("gram").distinct().collect()]  # the templates' own grams
    names = [f"p{k}" for k in range(len(PHRASES))]
    rows = docs.select("doc_id", lowered(clean_text()).alias("low")).withColumn("words", F.filter(F.split("low", SEPARATORS), lambda w: w != ""))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumns({n: _places(p) for n, p in zip(names, PHRASES, strict=True)})
    base = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, PHRASES.values(), strict=True)]))
    rows = cut(rows.withColumn("places", F.concat(*names)).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), base.alias("base"), gram_hits(known).alias("hits"),
    ))
    notices = find_notices(rows.select("row", F.explode("hits").alias("hit")).select("row", "hit.gram", "hit.at"), places)
    notices = notices.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    every = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return rows.join(notices, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op8_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_documents(spark, sf_dir, "doc_id", "text"))
