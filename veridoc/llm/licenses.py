"""License scans by diagonal voting, with DataFrame functions alone.

Words are runs of lower-cased letters, digits and non-ASCII characters. All rolling word 3-gram hashes of a text are
joined to the places of the same 3-gram in the templates; a vote lies on the diagonal "place in the text less place
in the template". Short templates are phrases: they stand where a diagonal holds all their grams. For
longer ones each diagonal is merged with its neighbours, at most ``DRIFT`` inserted or missing words away, and the
span is verified: the words of equal grams must make up ``THRESHOLD`` of the template and of the span. Three words, as
the shortest phrase has no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.functions.text import let

WIDTH = 3
DRIFT = 8
THRESHOLD = 0.8
PHRASE_WORDS = 15  # templates up to this length count only where they stand whole
BROADCAST_GRAMS = 100_000  # of about 100 bytes: so many template grams are sent to all tasks, more are shuffled

# The phrases that every scan reports.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Sentences of well-known license notices.
NOTICES = (
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    (
        "apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
    ),
    (
        "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    (
        "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version",
    ),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    (
        "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the rights to use "
        "copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software "
        "is furnished to do so subject to the following conditions",
    ),
    (
        "mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
    ),
    (
        "unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software",
    ),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; A-Z alone is lower-cased. None for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _grams(tokens: Column) -> Column:
    """(place, hash) of all rolling grams; null, which explodes to nothing, for a shorter text."""
    places = F.when(F.size(tokens) >= WIDTH, F.sequence(F.lit(0), F.size(tokens) - WIDTH))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(*[tokens[i + k] for k in range(WIDTH)]).alias("hash")))


def _joined(tokens: Column, place: Column) -> Column:
    """The gram at a place as text; no word holds a blank."""
    return F.concat_ws(" ", *[tokens[place + k] for k in range(WIDTH)], F.lit(""))


def template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """(template, label, base, size, at, hash, gram) for every place of every template."""
    rows = [(number, label, base, text.split()) for number, (label, text, base) in enumerate(templates)]
    short = [text for label, text, _ in templates if len(text.split()) < WIDTH]
    if short:
        raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
    table = spark.createDataFrame(rows, "template int, label string, base boolean, _t array<string>")
    found = table.select("*", F.explode(_grams(F.col("_t"))).alias("_g"))
    at = F.col("_g.place")
    return found.select("template", "label", "base", F.size("_t").alias("size"), at.alias("at"), F.col("_g.hash").alias("hash"), _joined(F.col("_t"), at).alias("gram"))


def text_key(id_column: Column, text: Column) -> Column:
    """Names a row by id and text: rows that agree in both share their spans."""
    return F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def votes(docs: DataFrame, templates: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, template, label, base, size, diagonal, places): the equal grams of texts and templates, by diagonal.

    Hashes find the places, the words themselves confirm them. A diagonal holds at most as many places as the template.
    """
    # grams are a column of their own before they are exploded, so that explode and join share one generated
    # stage, in which the words of a text are not copied for every gram; the outer form keeps the planner from
    # testing the grams in a filter of its own, below the words
    tokens = docs.select(text_key(F.col(id_column), F.col(text)).alias("key"), words(F.col(text)).alias("_w")).withColumn("_gs", _grams(F.col("_w")))
    rolled = tokens.select("key", "_w", F.explode_outer("_gs").alias("_g")).select("key", "_w", F.col("_g.place").alias("place"), F.col("_g.hash").alias("hash"))
    there = _joined(F.col("_w"), F.col("place"))
    if templates.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        hits = rolled.join(F.broadcast(templates), "hash").filter(F.startswith(there, F.col("gram")))
    else:  # rows carry their gram, not their text
        hits = rolled.select("key", "place", "hash", there.alias("_there")).join(templates.hint("merge"), "hash").filter("_there = gram")
    return hits.groupBy("key", "template", "label", "base", "size", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.array_sort(F.collect_set("place")).alias("places"))


def _covered(starts: Column) -> Column:
    """Number of distinct words under the grams that start at the given places."""
    return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(starts), lambda p: F.sequence(p, p + WIDTH - 1)))))


def _extent(hits: Column, size: Column) -> Column:
    """Start, length and similarity of the span that merged (place, at) hits make up."""
    start = F.array_min(hits["place"])
    length = F.array_max(hits["place"]) + WIDTH - start
    return F.struct(start.alias("start"), length.alias("length"), F.least(_covered(hits["at"]) / size, _covered(hits["place"]) / length).alias("similarity"))


def spans(docs: DataFrame, templates: list[tuple[str, str, bool]] | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, label, base, start, length, similarity): verified places of the templates, by row key (``text_key``).

    ``templates`` are (label, words, base) triples; base ones count as phrases whatever their length. A phrase has the
    similarity 1. A notice may be found from several neighbouring diagonals; each gives a row.
    """
    chosen = templates if templates is not None else default_templates()
    found = votes(docs, template_grams(docs.sparkSession, chosen), id_column, text)
    # a diagonal and its neighbours; the order by diagonal stays within one template of one text
    near = Window.partitionBy("key", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    shifted = F.transform("places", lambda p: F.struct(p.alias("place"), (p - F.col("diagonal")).alias("at")))
    merged = found.withColumn("_m", F.flatten(F.collect_list(shifted).over(near)))
    is_phrase = F.col("base") | (F.col("size") <= PHRASE_WORDS)
    stands = F.when(F.size("places") == F.col("size") - WIDTH + 1, F.struct(F.col("diagonal").alias("start"), F.col("size").alias("length"), F.lit(1.0).alias("similarity")))
    judged = merged.withColumn("_s", F.when(is_phrase, stands).otherwise(let(F.col("_m"), lambda m: _extent(m, F.col("size")))))
    return judged.filter(F.col("_s.similarity") >= THRESHOLD).select("key", "label", "base", "_s.start", "_s.length", "_s.similarity")


def default_templates() -> list[tuple[str, str, bool]]:
    return [(label, text, True) for label, text in BASE] + [(label, text, False) for label, text in NOTICES]


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their least and greatest start, or
    null; label lists are distinct, sorted and empty if there is none; ``score`` is the best similarity of a verified place or 0.
    A null text counts as empty. Rows of one id and text have the same result, each in its own row; null ids too. An
    empty table gives no rows; other columns are not looked at. Only hits and slim keys are shuffled.
    """
    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(labels)), ",")

    start = F.when(F.col("base"), F.col("start")).cast("long")
    found = spans(docs, templates, id_column, text).groupBy("key").agg(
        F.count_if("base").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"), F.max("similarity").alias("score"),
    )
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.size(words(F.col(text))).cast("long").alias("n_words"), text_key(F.col(id_column), F.col(text)).alias("key"))
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _template_values() -> str:
    quoted = ", ".join(f"({n}, '{label}', {str(base).lower()}, string_split('{text}', ' '))" for n, (label, text, base) in enumerate(default_templates()))
    return f"(VALUES {quoted}) AS t(template, label, base, w)"


#: DuckDB SQL of ``scan`` with the default templates; ``{docs}`` is the table.
SCAN_SQL = rf"""
WITH t AS (SELECT * FROM {_template_values()}),
tg AS (SELECT template, label, base, len(w) AS size, tp, w[tp + 1:tp + {WIDTH}] AS gram FROM t, LATERAL (SELECT unnest(range(len(w) - {WIDTH - 1})) AS tp)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS w
  FROM {{docs}}),
g AS (SELECT rid, w, unnest(range(greatest(len(w) - {WIDTH - 1}, 0))) AS place FROM d),
hit AS (SELECT rid, template, label, base, size, place - tp AS diagonal, place, tp FROM g JOIN tg ON g.w[g.place + 1:g.place + {WIDTH}] = tg.gram),
v AS (SELECT rid, template, label, base, size, diagonal, count(*) AS n FROM hit GROUP BY ALL),
whole AS (SELECT rid, label, base, diagonal AS start, 1.0::DOUBLE AS similarity FROM v WHERE (base OR size <= {PHRASE_WORDS}) AND n = size - {WIDTH - 1}),
m AS (
  SELECT v.rid, v.template, v.label, v.base, v.size, v.diagonal, h.place, h.tp
  FROM v JOIN hit h ON v.rid = h.rid AND v.template = h.template AND h.diagonal BETWEEN v.diagonal - {DRIFT} AND v.diagonal + {DRIFT}
  WHERE NOT v.base AND v.size > {PHRASE_WORDS}),
c AS (
  SELECT rid, label, base, size, template, diagonal, count(DISTINCT tp + k) AS of_template, count(DISTINCT place + k) AS of_text,
    min(place) AS start, max(place) + {WIDTH} - min(place) AS length
  FROM m, (SELECT unnest(range({WIDTH})) AS k) GROUP BY rid, label, base, size, template, diagonal),
s AS (
  SELECT * FROM whole UNION ALL
  SELECT rid, label, base, start, least(of_template::DOUBLE / size, of_text::DOUBLE / length) AS similarity FROM c
  WHERE least(of_template::DOUBLE / size, of_text::DOUBLE / length) >= {THRESHOLD}),
f AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
    max(similarity) AS score
  FROM s GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (rid)
"""
