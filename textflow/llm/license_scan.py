"""License scans by diagonal voting, with DataFrame operations only.

Every text is cut into rolling grams of ``GRAM`` words. The gram hashes are joined with
the places of the same grams in a table of templates; each match votes for a
diagonal (word number in the text minus word number in the template).
Neighbouring diagonals, as an inserted or missing word makes them, are merged
into spans, and a span is verified: its matches are read in the order of the text, those
whose template position lies behind all earlier ones count, and the template's words
that they cover must be enough, within a stretch of text not much longer than the template.

Two kinds of template: phrases must stand word for word (each place counts),
notices are longer texts of which a span must cover ``COVERAGE``.

Words: A-Z are lower-cased, then runs of digits, a-z and characters beyond
ASCII. Defined cases: a null or empty text has no words and no labels; a text
shorter than a gram has no matches; repeated rows are scanned one by one; a
phrase may overlap itself or others. Matches of a text are grouped by a row
number of the scan, so that neither ids nor texts need be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRAM = 3
#: Diagonals of one template at most this far apart are one span.
NEIGHBOURS = 3
#: Share of a notice's words that makes a label; notices must differ by more than the rest.
COVERAGE = 0.8
#: Templates are broadcast; the table may have no more grams than this.
MAX_GRAMS = 1 << 18

# Phrases of the contract and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Opening sentences of public licenses and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """``array<string>``, empty for a null text."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1)
    return F.filter(parts, lambda w: w != "")


def template_grams(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple]:
    """Rows (template, label, exact, length, at, w0, w1, w2)."""
    rows = []
    for n, (text, label, exact) in enumerate([*((t, v, True) for t, v in phrases.items()),
                                              *((t, v, False) for t, v in notices.items())]):
        parts = text.split()
        if len(parts) < GRAM:
            raise ValueError(f"a template needs {GRAM} words at least: {text}")
        rows += [(n, label, exact, len(parts), i, *parts[i:i + GRAM]) for i in range(len(parts) - GRAM + 1)]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"more than {MAX_GRAMS} template grams")
    return rows


def _votes(docs: DataFrame, doc_id: str, text: str, rows: list[tuple]) -> DataFrame:
    """Matches (row, doc_id, template, label, exact, length, at, pos) and, with a
    null template, the last word of each text (pos -1 for none)."""
    templates = docs.sparkSession.createDataFrame(
        rows, "template int, label string, exact boolean, length int, at int, t0 string, t1 string, t2 string")
    templates = F.broadcast(templates.withColumn("th", F.xxhash64("t0", "t1", "t2")))
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    after = lambda k: F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0)))
    grams = split.select("row", "doc_id", F.posexplode_outer(F.arrays_zip(F.col("w").alias("w0"), after(1).alias("w1"), after(2).alias("w2"))))
    grams = grams.select("row", "doc_id", F.coalesce("pos", F.lit(-1)).alias("pos"), F.col("col.w0").alias("w0"),
                         F.col("col.w1").alias("w1"), F.col("col.w2").alias("w2"))
    same = ((F.xxhash64("w0", "w1", "w2") == F.col("th")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
            & (F.col("w2") == F.col("t2")))
    return (grams.join(templates, same, "left").where("template is not null or w1 is null")
            .select("row", "doc_id", "template", "label", "exact", "length", "at", "pos"))


def spans(votes: DataFrame) -> DataFrame:
    """Merged diagonals: ``(row, doc_id, template, label, exact, length, first,
    covered, extent, n_words)`` with the first diagonal, the number of the template's words that the span's grams
    cover in order, and the words of text from the first of these grams to the last; and for each
    text a row with a null template and ``n_words``."""
    diagonals = (votes.groupBy("row", "doc_id", "template", "label", "exact", "length", (F.col("pos") - F.col("at")).alias("diagonal"))
                 .agg(F.collect_set("at").alias("at"), F.max("pos").alias("pos")))
    by = Window.partitionBy("row", "template", "exact").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(by) <= NEIGHBOURS
    parted = diagonals.withColumn("start", F.when(near & ~F.col("exact"), 0).otherwise(1)).withColumn("span", F.sum("start").over(by))
    merged = parted.groupBy("row", "doc_id", "template", "label", "exact", "length", "span").agg(
        F.min("diagonal").alias("first"), F.array_sort(F.flatten(F.collect_list(F.transform("at", lambda a: F.struct(
            (F.col("diagonal") + a).alias("pos"), a.alias("at")))))).alias("places"),
        (F.max("pos") + 1).alias("n_words"))
    # left to right, the places behind all template positions so far
    none = F.filter("places", lambda _: F.lit(False))
    merged = merged.withColumn("kept", F.aggregate("places", none, lambda kept, p: F.when(
        (F.size(kept) == 0) | (F.coalesce(F.get(kept, F.size(kept) - 1)["at"], F.lit(-1)) < p["at"]), F.concat(kept, F.array(p))).otherwise(kept)))
    reach = F.flatten(F.transform("kept", lambda p: F.sequence(p["at"], p["at"] + GRAM - 1)))
    return merged.select("row", "doc_id", "template", "label", "exact", "length", "first",
                         F.size(F.array_distinct(reach)).alias("covered"),
                         (F.get("kept", F.size("kept") - 1)["pos"] + GRAM - F.get("kept", F.lit(0))["pos"]).alias("extent"),
                         F.when(F.col("template").isNull(), F.col("n_words")).alias("n_words"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases: dict[str, str] | None = None,
         notices: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_words``, ``n_base`` (places of
    phrases), ``first_word`` and ``last_word`` (of the places' starts, else
    null), ``base_labels``, ``labels`` (with those of verified notices) and
    ``score`` (the largest covered share of a template, verified or not)."""
    rows = template_grams(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    found = spans(_votes(docs, doc_id, text, rows))
    share = F.col("covered") / F.col("length")
    place = F.col("exact") & (F.col("covered") == F.col("length"))
    label = F.col("exact") & place | ~F.col("exact") & (share >= COVERAGE) & (F.col("extent") * COVERAGE <= F.col("length"))
    joined = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col("label")))), ",")
    return found.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("first"))).cast("long").alias("last_word"),
        joined(place).alias("base_labels"), joined(label).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score")).drop("row")


def oracle_sql() -> str:
    """The same over ``documents`` in DuckDB."""
    rows = ", ".join("(%d, '%s', %s, %d, %d, '%s')" % (*r[:2], str(r[2]).lower(), *r[3:5], " ".join(r[5:]))
                     for r in template_grams(PHRASES, NOTICES))
    return f"""
WITH t(template, label, exact, length, tpos, gram) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
g AS (SELECT r, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM p
      WINDOW o AS (PARTITION BY r ORDER BY pos)),
v AS (SELECT r, template, label, exact, length, pos - tpos AS diagonal, tpos FROM g JOIN t USING (gram)),
n AS (SELECT *, CASE WHEN NOT exact AND diagonal - lag(diagonal) OVER o <= {NEIGHBOURS} THEN 0 ELSE 1 END AS opens
      FROM (SELECT r, template, label, exact, length, diagonal FROM v GROUP BY ALL) WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM n),
k AS (SELECT s.*, v.tpos, s.diagonal + v.tpos AS at_word, max(v.tpos) OVER (PARTITION BY s.r, s.template, s.span
        ORDER BY s.diagonal + v.tpos, v.tpos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s JOIN v USING (r, template, diagonal)),
c AS (SELECT r, template, label, exact, length, span, min(diagonal) AS first_at, count(DISTINCT reach) AS covered, max(at_word) + {GRAM} - min(at_word) AS extent
      FROM (SELECT *, unnest(range(tpos, tpos + {GRAM})) AS reach FROM k WHERE top IS NULL OR tpos > top) GROUP BY ALL),
f AS (SELECT r, count(*) FILTER (exact AND covered = length) AS n_base,
        min(first_at) FILTER (exact AND covered = length) AS first_word, max(first_at) FILTER (exact AND covered = length) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND covered = length) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN exact THEN covered = length ELSE covered / length >= {COVERAGE} AND extent * {COVERAGE} <= length END) AS labels,
        max(covered / length) AS score
      FROM (SELECT * REPLACE (covered::DOUBLE AS covered, length::DOUBLE AS length) FROM c) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (r)"""
