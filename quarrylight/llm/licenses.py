"""License scans by diagonal voting, on DataFrame functions alone.

Every run of ``K`` words of a text is hashed where it stands and joined with the hashes of the templates' runs. A hit of
document word i with template word j votes for the diagonal i - j: a copy of the template puts its votes on one diagonal,
a copy with words put in or left out on a few neighbouring ones. Votes are counted by diagonal, neighbouring diagonals are
merged, and a merged span is verified: it must cover enough of the template within few enough words. Where the merged span
is too long, as when parts of the notice are repeated behind it, the ranges of up to ``NEAR`` diagonals from each of its
diagonals are verified in its place. The base phrases are short templates whose every run must vote for one diagonal, that is, whose words stand consecutively.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals of one template this near to each other are merged.
NEAR = 6
#: Least share of a template's runs that a span covers, and most words of a span for each of the template's.
COVER = 0.6
STRETCH = 1.5

# Phrases whose places are counted, with their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Openings of public license notices.
TEMPLATES = (
    ("agpl-3", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: Stands for a document itself among the hashes that are joined, so that a text without any hit keeps its row.
WHOLE = 0x5EED


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))


def text_words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, split at what is neither a letter, a digit nor beyond ASCII. ``lower`` also folds letters beyond ASCII, which moves no border between words; the Kelvin sign, the one that would turn into an ASCII letter, is set aside first."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5")))
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def runs(words: Column, k: int = K) -> Column:
    """Hashes of all runs of k words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def template_table(spark, base=BASE, templates=TEMPLATES) -> DataFrame:
    """``tpl``, ``label``, ``exact``, ``t_words``, ``run``, ``tpos`` of every template, made once from the constants."""
    rows = [(n, label, exact, template_words(text)) for n, (label, text, exact) in enumerate([(*b, True) for b in base] + [(*t, False) for t in templates])]
    if any(len(r[3]) < K for r in rows):
        raise ValueError(f"a template has fewer than {K} words")
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({n}, {quoted(label)}, {exact}, array({', '.join(map(quoted, w))}))" for n, label, exact, w in rows)
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t(tpl, label, exact, w)")
    t = t.select("tpl", "label", "exact", F.size("w").alias("t_words"), F.posexplode(runs(F.col("w"))).alias("tpos", "run"))
    whole = spark.sql(f"SELECT -1 AS tpl, '' AS label, false AS exact, 0 AS t_words, 0 AS tpos, {WHOLE}L AS run")
    return t.unionByName(whole)


def _short(span: Column) -> Column:
    return span["last"] - span["first"] + 1 <= STRETCH * F.col("t_words")


def _best_range(near: Column) -> Column:
    """Of the diagonals ``near`` (the row's own first, up to NEAR beyond it), the range from the first that is short enough and covers most, the narrower of two that cover the same; null if none covers enough."""

    def span(width: Column) -> Column:
        held = F.filter(near, lambda x: x.diagonal <= F.col("diagonal") + width)
        at = F.array_distinct(F.flatten(F.transform(held, lambda x: x["at"])))
        first, last = F.array_min(F.transform(held, lambda x: x.diagonal + F.array_min(x["at"]))), F.array_max(F.transform(held, lambda x: x.diagonal + F.array_max(x["at"]) + K - 1))
        return F.struct((F.size(at) / (F.col("t_words") - K + 1)).alias("share"), (-width).alias("width"), first.alias("first"), last.alias("last"))

    fit = F.filter(F.transform(F.sequence(F.lit(0), F.lit(NEAR)), span), lambda x: (x.share >= COVER) & _short(x))
    best = F.array_max(fit)
    return F.when(best.isNotNull(), F.struct(best["share"].alias("share"), best["first"].alias("first"), best["last"].alias("last")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``spans``: a row per row of ``df``.

    A null text counts as empty; repeated rows each have their row. ``spans`` lists what was verified: label, first word,
    last word, score (share of the template's runs that are covered; 1 for a base phrase). ``score`` is the largest, 0
    without spans. Spans from a merged one that was too long may overlap. No other column is read. The template table is the only one broadcast; its size is that of the
    constants.
    """
    spark = df.sparkSession
    table = template_table(spark, base, templates)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), text_words(F.col(text_col)).alias("w"))
    docs = docs.select("id", "th", F.size("w").alias("n_words"), runs(F.col("w")).alias("r"))
    every = docs.select("id", "th", "n_words", F.posexplode(F.concat("r", F.array(F.lit(WHOLE).cast("long")))).alias("pos", "run"))
    hits = every.join(F.broadcast(table), "run")
    key = ["id", "th"]

    # Votes; a row that repeats casts the same votes again, so positions are counted once.
    votes = hits.groupBy(*key, "n_words", "tpl", "label", "exact", "t_words", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("at"), F.count("*").alias("rows"))
    diagonals = Window.partitionBy(*key, "tpl").orderBy("diagonal")
    far = F.col("exact") | (F.col("tpl") < 0) | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(diagonals) > NEAR, F.lit(True))
    free = ~F.col("exact") & (F.col("tpl") >= 0)
    near = F.when(free, F.collect_list(F.struct("diagonal", "at")).over(diagonals.rangeBetween(0, NEAR)))
    grouped = votes.withColumn("group", F.sum(far.cast("int")).over(diagonals.rowsBetween(Window.unboundedPreceding, 0))).withColumn("part", _best_range(near))
    merged = grouped.groupBy(*key, "n_words", "tpl", "label", "exact", "t_words", "group").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min(F.col("diagonal") + F.array_min("at")).alias("first"), F.max(F.col("diagonal") + F.array_max("at") + K - 1).alias("last"), F.max("rows").alias("rows"), F.collect_list("part").alias("parts")
    )
    whole = F.struct((F.size("at") / (F.col("t_words") - K + 1)).alias("share"), "first", "last")
    found = F.when(F.col("tpl") < 0, F.array(whole)).when(F.col("exact"), F.filter(F.array(whole), lambda x: x.share == 1)).when(_short(whole), F.filter(F.array(whole), lambda x: x.share >= COVER)).otherwise(F.col("parts"))
    spans = merged.withColumn("found", F.explode(found)).select(*key, "n_words", "tpl", "label", "exact", "rows", "found.*")

    own, exact = F.col("tpl") < 0, F.col("exact") & (F.col("tpl") >= 0)
    out = spans.groupBy(*key).agg(
        F.max(F.when(own, F.col("rows"))).alias("copies"), F.max("n_words").alias("n_words"), F.count(F.when(exact, 1)).alias("n_base"), F.min(F.when(exact, F.col("first"))).alias("first_word"), F.max(F.when(exact, F.col("first"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(exact, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set(F.when(~own, F.col("label")))).alias("labels"), F.coalesce(F.max(F.when(~own, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(~own, F.struct("label", F.col("first").alias("first_word"), F.col("last").alias("last_word"), F.col("share").alias("score"))))).alias("spans"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.col("n_base").cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", "spans",
    )
