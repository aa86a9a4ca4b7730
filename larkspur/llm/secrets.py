"""Secrets in texts: fixed patterns, and two character Markov models compared by log-likelihood ratio.

DataFrame functions only. The models are first-order: one of random strings, one of ordinary identifiers, both over the
characters that keys are made of, fitted on labelled samples; a transition seldom seen backs off to the second character's own frequency. A candidate is a run of such
characters with a letter in it; it is a secret if its log-likelihood as a random string passes that as an identifier by
`threshold`. Spans count code points, the end is exclusive.

A null text counts as empty. Spans of one kind do not overlap; spans of different kinds may. Rows are judged one by
one, so repeated rows give repeated results, and an empty table an empty one. A very long text is one string in one task, which
takes time in proportion to its length and n log n steps for its n spans. Other columns stay.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.arrays import blocks_of, let, piece, running
from larkspur.llm.sampling import lowest

# The patterns of the base kinds, in the order in which spans with the same start are listed.
ASSIGN = r"""((?i)(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "markov")
MARKOV, FAR = 3, 2**31 - 1
# A run of the characters is as long as it can be, so a least length in the pattern drops just the shorter runs.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

# Candidates of the models, and the code of their first and last character: tables are CODES by CODES.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
LOW, HIGH = ord("+"), ord("z")
CODES = HIGH - LOW + 1

THRESHOLD = 10.0
BACKOFF = 8.0  # transitions that the second character's own frequency counts for
TRAINING_DOCUMENTS = 2_000
RANDOM_STRINGS = 2_000
MASK = "[SECRET]"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of a pattern's leftmost, non-overlapping matches.

    The pieces between the matches and the matches themselves have lengths; their running sum gives the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(v: Column) -> Column:
        n = F.size(v["found"])
        return let(running(F.zip_with(F.slice(v["gaps"], F.lit(1), n), v["found"], lambda gap, hit: gap + F.length(hit)), lambda x, y: x + y, 0), lambda ends: F.zip_with(
            ends, v["found"], lambda end, hit: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("text"))
        ))

    return let(F.struct(found.alias("found"), gaps.alias("gaps")), placed)


def spans_of(text: Column, kind: int, pattern: str, keep=None) -> Column:
    """Array of (start, kind, end) of a kind; texts without a match cost one search."""
    hits = matches(text, pattern)
    if keep is not None:
        hits = F.filter(hits, keep)
    spans = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def with_base(df: DataFrame, text: str) -> DataFrame:
    """df with `_lk_text` (null as empty) and `_lk_assign`, `_lk_access`, `_lk_hex`, the spans of the base kinds."""
    out = df.withColumn("_lk_text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("_lk_text")
    return (
        out.withColumn("_lk_assign", spans_of(t, 0, ASSIGN, lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= LEAST_VALUE))
        .withColumn("_lk_access", spans_of(t, 1, ACCESS)).withColumn("_lk_hex", spans_of(t, 2, HEX))
    )


def pairs(s: Column) -> Column:
    """Places in the model table of a string's neighbouring characters; the string has two at least."""
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c) - LOW)
    return let(codes, lambda v: F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: a * CODES + b))


def train(samples: DataFrame) -> list[float]:
    """Log ratio, random over ordinary, of each transition between two characters. samples: text, random (boolean).

    Counts are summed on the executors; at most 2 * CODES**2 of them come to the driver. Texts of one character say nothing.
    """
    counted = (
        samples.where(F.length("text") >= 2).select("random", F.explode(pairs(F.col("text"))).alias("pair"))
        .groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))
    )
    table = {True: [0.0] * CODES**2, False: [0.0] * CODES**2}
    for r in counted.where(F.col("pair").between(0, CODES**2 - 1)).collect():
        table[bool(r["random"])][r["pair"]] += r["n"]
    logs = {}
    for kind, t in table.items():
        total = sum(t) + CODES
        alone = [(sum(t[second::CODES]) + 1.0) / total for second in range(CODES)]
        logs[kind] = []
        for first in range(CODES):
            row = t[first * CODES : (first + 1) * CODES]
            size = sum(row) + BACKOFF
            logs[kind] += [math.log((n + BACKOFF * p) / size) for n, p in zip(row, alone, strict=True)]
    return [a - b for a, b in zip(logs[True], logs[False], strict=True)]


def labelled(spark: SparkSession, df: DataFrame, key: str, text: str, documents: int = TRAINING_DOCUMENTS, strings: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled samples: text, random.

    Random strings are digests of a counter in base 64 (plain, without marks, for URLs), in lower-case hexadecimal, as a UUID and in upper case. Ordinary
    identifiers are all runs of key characters in at most `documents` different texts, the lowest hashes of id and text, without what a
    base pattern finds there; the bound holds at any size, and an id that many rows share is no hot spot.
    """
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    plain = F.regexp_replace(F.substring(F.base64(F.unhex(digest)), 1, 40), "=", "")
    forms = [
        plain, F.regexp_replace(plain, "[+/]", ""), F.translate(plain, "+/", "-_"), F.substring(digest, 1, 40), F.upper(F.substring(F.base64(F.unhex(digest)), 1, 20)),
        F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
    ]
    source = spark.range(strings).select(F.explode(F.array(*forms)).alias("text"))
    chosen = lowest(df.select(F.col(text).alias("_text"), F.xxhash64(key, text).alias("_hash")), F.col("_hash"), documents)
    bare = F.coalesce(F.col("_text"), F.lit(""))
    for p in (ASSIGN, ACCESS, HEX):
        bare = F.regexp_replace(bare, p, " ")
    ordinary = chosen.select(F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0))).alias("text"))
    return source.withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False)))


def with_fresh(base: Column, extra: Column) -> Column:
    """base and those spans of extra (of a later kind) that overlap none of it, sorted.

    In the order of starts, what overlaps a span began before it and ends behind its start, or is the next to begin and begins before its end.
    """
    def judged(all_spans: Column) -> Column:
        def is_base(s: Column) -> Column:
            return s["kind"] < MARKOV

        ends = running(F.transform(all_spans, lambda s: F.when(is_base(s), s["end"]).otherwise(0)), lambda x, y: F.greatest(x, y), 0)
        starts = F.reverse(running(F.reverse(F.transform(all_spans, lambda s: F.when(is_base(s), s["start"]).otherwise(FAR))), lambda x, y: F.least(x, y), FAR))
        both = F.struct(all_spans.alias("spans"), ends.alias("ends"), starts.alias("starts"))
        return let(both, lambda v: F.filter(v["spans"], lambda s, i: is_base(s) | ((F.get(v["ends"], i) <= s["start"]) & (F.get(v["starts"], i) >= s["end"]))))

    return F.when(F.size(extra) > 0, let(F.array_sort(F.concat(base, extra)), judged)).otherwise(base)


def scan(df: DataFrame, text: str, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """df with `base` and `spans`: arrays of (start, kind, end) by start, then kind. Columns of those names are replaced.

    spans has the base spans and those of the models that overlap none of them.
    """
    ratios = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")

    def score(s: Column) -> Column:
        return F.aggregate(pairs(s), F.lit(0.0), lambda acc, p: acc + F.get(ratios, p))

    found = with_base(df.drop("base", "spans"), text).withColumn("base", F.array_sort(F.concat("_lk_assign", "_lk_access", "_lk_hex")))
    random = spans_of(F.col("_lk_text"), MARKOV, CANDIDATE, lambda m: F.rlike(m["text"], F.lit("[A-Za-z]")) & (score(m["text"]) > threshold))
    return (
        found.withColumn("_lk_markov", random)
        .withColumn("spans", with_fresh(F.col("base"), F.col("_lk_markov")))
        .drop("_lk_assign", "_lk_access", "_lk_hex", "_lk_markov", "_lk_text")
    )


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mask."""
    def masked(v: Column) -> Column:
        ends, many = v["ends"], F.size(v["spans"])
        heads = F.filter(F.sequence(F.lit(0), many - 1), lambda i: (i == 0) | (F.get(v["spans"], i)["start"] >= F.get(ends, i - 1)))
        clear = F.transform(heads, lambda i: piece(v["blocks"], F.coalesce(F.get(ends, i - 1), F.lit(0)), F.get(v["spans"], i)["start"]))
        return F.array_join(F.concat(clear, F.array(piece(v["blocks"], F.get(ends, many - 1), v["length"]))), mask)

    ends = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y), 0)
    parts = F.struct(spans.alias("spans"), ends.alias("ends"), blocks_of(text).alias("blocks"), F.length(text).alias("length"))
    return F.when(F.size(spans) > 0, let(parts, masked)).otherwise(text)
