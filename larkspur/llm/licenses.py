"""Licences in texts: fixed phrases, and diagonal voting against the words of known notices. DataFrame functions only.

Every run of K words of a text is hashed and joined with the places of the same run in the notices; the words themselves are compared as well. A hit of
text place p and notice place q lies on diagonal p - q: the hits of one copy share a diagonal, or lie on neighbouring ones where words were added or left out. Hits are
counted by diagonal, diagonals at most NEAR apart are merged, and a merged span is verified: it must cover LEAST_SHARE of the notice's words, and
LEAST_DENSITY of its own words must be covered. Of spans inside one another the outer one stays, of equal ones that which covers more.

The notices' runs are broadcast up to BROADCAST_RUNS of them; a larger set is joined by a shuffle.

A null text counts as empty and has no words. Rows are judged one by one: a row's hits are grouped under a number of its own, so a group of equal documents is no hot spot, and
repeated rows give repeated results. An empty table gives an empty one. A text is split and hashed whole, in one task; about 100 bytes for each of its words are held while
it is. Columns of df that have a result's name are replaced, others stay, but for the text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a word is, and the phrases that are always reported.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Labels and the public notices that stand for them.
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
K = 4
NEAR = 4
LEAST_SHARE, LEAST_DENSITY = 0.7, 0.7
BROADCAST_RUNS = 50_000
RESULT = ("n_words", "base", "found", "score")


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def runs_of(words: Column, k: int = K) -> Column:
    """Array of (place, hash, run) of every k words in a row."""
    def at(i: Column) -> Column:
        each = [F.get(words, i + j) for j in range(k)]
        return F.struct(i.alias("place"), F.xxhash64(*each).alias("hash"), F.concat_ws(" ", *each).alias("run"))

    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), at))


def notice_runs(df: DataFrame, notices: tuple[tuple[str, str], ...], k: int = K) -> DataFrame:
    """notice, label, length, q, hash, run: the places of all runs of the notices, in the session of df."""
    rows = json.dumps([{"notice": i, "label": label, "text": text} for i, (label, text) in enumerate(notices)])
    given = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<notice:int,label:string,text:string>>")))
    words = given.select("notice", "label", words_of(F.col("text")).alias("_w"))
    runs = words.select("notice", "label", F.size("_w").alias("length"), F.inline(runs_of(F.col("_w"), k)))
    return runs.select("notice", "label", "length", F.col("place").alias("q"), "hash", "run")


def phrase_places(words: Column, low: Column, phrase: str, label: str) -> Column:
    """Array of (start, label) of a phrase; a text without it costs one search."""
    parts = phrase.split()

    def stands(i: Column) -> Column:
        out = F.lit(True)
        for j, p in enumerate(parts):
            out = out & (F.get(words, i + j) == p)
        return out

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)
    some = F.rlike(low, F.lit(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(parts))) & (F.size(words) >= len(parts))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(some, F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))).otherwise(none)


def hits(rows: DataFrame, text: str, notices: tuple[tuple[str, str], ...] = NOTICES, k: int = K) -> DataFrame:
    """rows without the text, once for each place p where K words of a text are those at place q of a notice."""
    known = notice_runs(rows, notices, k)
    most = sum(len(t.split()) * 4 for _, t in notices)  # a word of white space has few words in it; only the way of joining hangs on this
    known = F.broadcast(known) if most <= BROADCAST_RUNS else known
    kept = [c for c in rows.columns if c != text]
    runs = rows.select(*kept, words_of(F.col(text)).alias("_w")).select(*kept, F.inline(runs_of(F.col("_w"), k)))
    same = (runs["hash"] == known["hash"]) & (runs["run"] == known["run"])
    return runs.join(known, same).select(*kept, "notice", "label", "length", F.col("place").alias("p"), "q")


def spans(hit: DataFrame, row: list[str], k: int = K, near: int = NEAR, least_share: float = LEAST_SHARE, least_density: float = LEAST_DENSITY) -> DataFrame:
    """row, notice, label, start, end (words, exclusive), share: the verified spans of all notices."""
    copy = [*row, "notice", "label", "length"]
    votes = hit.groupBy(*copy, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.array_sort(F.collect_list("q")).alias("_q"))
    along = Window.partitionBy(*copy).orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > near, F.lit(True)).cast("int")
    merged = votes.withColumn("_opens", opens).withColumn("_span", F.sum("_opens").over(along)).select(*copy, "_span", "diagonal", F.explode("_q").alias("q"))
    inside = [*copy, "_span"]

    def covered(c: str) -> Column:
        """How many words a hit covers that no hit before it by `c` covers."""
        return F.coalesce(F.least(F.lit(k), F.col(c) - F.lag(c).over(Window.partitionBy(*inside).orderBy(c))), F.lit(k))

    placed = merged.withColumn("p", F.col("q") + F.col("diagonal"))
    sums = placed.withColumn("_in_text", covered("p")).withColumn("_in_notice", covered("q")).groupBy(*inside).agg(
        F.min("p").alias("start"), (F.max("p") + k).alias("end"), F.sum("_in_text").alias("_in_text"), F.sum("_in_notice").alias("_in_notice")
    )
    share = F.col("_in_notice") / F.col("length")
    good = sums.withColumn("share", share).where((share >= least_share) & (F.col("_in_text") / (F.col("end") - F.col("start")) >= least_density))
    outer = Window.partitionBy(*row).orderBy("start", F.col("end").desc(), F.col("_in_notice").desc(), F.col("share").desc(), "notice")
    beyond = F.coalesce(F.col("end") > F.max("end").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return good.withColumn("_beyond", beyond).where("_beyond").select(*row, "notice", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "share")


def scan(df: DataFrame, key: str, text: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """df without the text, with n_words, base (start, label of the phrases), found (start, end, label, share of the notices' spans) and score.

    score is 1 where a phrase stands, else the largest share of a notice's words that a span covers, or 0.
    """
    mark = F.xxhash64(key, text)
    rows = df.select(F.col(key).alias("_key"), text, mark.alias("_mark"), F.monotonically_increasing_id().alias("_row"))
    verified = spans(hits(rows, text, notices), ["_row", "_key", "_mark"])
    # Rows that repeat key and text have the same spans: the set of them is that of one row.
    each = F.array_sort(F.collect_set(F.struct("start", "end", "label", "share"))).alias("found")
    found = verified.groupBy(F.col("_key").alias("_found_key"), F.col("_mark").alias("_found_mark")).agg(each, F.max("share").alias("_share"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != text and c not in RESULT]
    words = df.select(*kept, F.col(key).alias("_key"), mark.alias("_mark"), lowered(F.col(text)).alias("_low"), words_of(F.col(text)).alias("_w"))
    based = words.select(*kept, "_key", "_mark", F.size("_w").cast("long").alias("n_words"), F.array_sort(F.concat(*[phrase_places(F.col("_w"), F.col("_low"), *p) for p in PHRASES])).alias("base"))
    both = based.join(found, based["_key"].eqNullSafe(found["_found_key"]) & (based["_mark"] == found["_found_mark"]), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string,share:double>>")
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0)))
    return both.select(*kept, "n_words", "base", F.coalesce("found", none).alias("found"), score.alias("score"))


def labels(*columns: str) -> Column:
    """The different labels of arrays of spans, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda s: s["label"]) for c in columns]))), ",")
