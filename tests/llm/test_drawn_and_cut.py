"""Resampling, licence spans and fill-in-the-middle against plain versions, on ordinary and on odd tables."""

import hashlib
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import fim, licenses, resample
from larkspur.llm.tournament import merged

DOCS = "doc_id long, text string, lang string"
ODD = [
    (1, "the cat sat on the mat and the dog ran away " * 3, "en"), (1, "the cat sat on the mat and the dog ran away " * 3, "en"), (2, None, None), (3, "", "en"), (4, "  \n ", "de"),
    (5, "word " * 30_000, "en"), (6, "é 你好 🎉 \u0000 x <P>", "fr"), (None, "no id here at all, none " * 9, "en"), (7, "Released under the MIT License.", "en"), (8, "a <S> marker", "en"),
    (1, "another text of the same id " * 5, "en"),
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- resampling


def test_runs_are_merged_in_order_whatever_their_blocks():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 9, 40):
        runs = [sorted((rng.randrange(50), i) for i in range(rng.randrange(1, 60))) for _ in range(n)]
        blocks = [(k, r[a : a + size]) for k, r in enumerate(runs) for size in [rng.randrange(1, 9)] for a in range(0, len(r), size)]
        blocks.sort(key=lambda b: (b[1][0], b[0]))
        # Equal first entries of one run must stay in the run's order.
        assert list(merged(blocks)) == sorted(e for r in runs for e in r)


def plain_draw(docs, target, percent, least, longest, buckets, seed="2024"):
    def features(text):
        words = WORD.findall(low(text))
        return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for _, text, *_ in docs:
        for f in features(text):
            s[bucket(f)] += 1
    for text in target:
        for f in features(text):
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((a + 1) * (sum(s) + buckets) / ((b + 1) * (sum(t) + buckets)))) for a, b in zip(t, s, strict=True)]
    rows = []
    for k, text, *_ in docs:
        fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall(low(text))) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = fit[: len(fit) * percent // 100]
    return sorted([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in [*fit[len(drawn) :], *[r for r in rows if not r[4]]]], key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_draw_matches_a_plain_one(spark, longest):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "你好", "A9"]
    docs = [(rng.randrange(250), " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))), "en") for _ in range(300)] + ODD
    target = [" ".join(rng.choices(vocabulary[:9], k=30)) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame(docs, DOCS).repartition(5).withColumns({c: F.lit("clash") for c in ("score", "rank", "weight", "_range")})
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, "doc_id", "text", bench, "text", percent=30, least_words=20, longest=longest, buckets=97)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_draw(docs, target, 30, 20, longest, 97)


def test_ranges_hold_few_rows_and_the_draw_is_exact():
    counts = {s: (s * 7) % 13 + 1 for s in range(-200, 200)}
    for wanted in (0, 1, 50, 1000, sum(counts.values())):
        plan = resample.Plan(counts, wanted, range_rows=40)
        if wanted == 0:
            assert plan.last is None
            continue
        above = sum(n for s, n in counts.items() if s > plan.last)
        assert above < wanted <= above + counts[plan.last]
        for s in sorted(counts, reverse=True):
            if s >= plan.last:
                assert plan.before[plan.range_of(-s)] <= sum(n for x, n in counts.items() if x > s)
        sizes = [b - a for a, b in zip(plan.before, plan.before[1:], strict=False)]
        assert all(n <= 40 for n in sizes)


def test_a_hot_key_and_an_empty_table_are_drawn(spark):
    text = "one two three four five six seven eight nine ten " * 2
    docs = [(9, text, "en")] * 3000 + [(i, text, "en") for i in range(100)]
    bench = spark.createDataFrame([("one two",)], "text string")
    got = resample.resample(spark.createDataFrame(docs, DOCS).repartition(4), "doc_id", "text", bench, "text", percent=50)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_draw(docs, ["one two"], 50, 20, 1, 10_000)
    none = spark.createDataFrame([], DOCS)
    assert resample.resample(none, "doc_id", "text", bench, "text").count() == 0
    few = resample.resample(spark.createDataFrame(ODD, DOCS), "doc_id", "text", bench.where("false"), "text", percent=10)
    assert sorted(map(tuple, few.collect()), key=repr) == plain_draw(ODD, [], 10, 20, 1, 10_000)


# --- licences


def plain_spans(text):
    """All spans of the notices, from the positions of their runs."""
    words, k = WORD.findall(low(text)), licenses.K
    found = []
    for notice, (label, body) in enumerate(licenses.NOTICES):
        known = WORD.findall(low(body))
        hits = [(p, q) for p in range(len(words) - k + 1) for q in range(len(known) - k + 1) if words[p : p + k] == known[q : q + k]]
        diagonals = sorted({p - q for p, q in hits})
        groups = []
        for d in diagonals:
            if groups and d - groups[-1][-1] <= licenses.NEAR:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            mine = [(p, q) for p, q in hits if p - q in g]
            in_text, in_notice = ({x + j for h in mine for x in [h[side]] for j in range(k)} for side in (0, 1))
            start, end = min(in_text), max(in_text) + 1
            share = len(in_notice) / len(known)
            if share >= licenses.LEAST_SHARE and len(in_text) / (end - start) >= licenses.LEAST_DENSITY:
                found.append((start, -end, -len(in_notice), -share, notice, label))
    out, beyond = set(), -1
    for start, end, _, share, _, label in sorted(found):
        if -end > beyond:
            out.add((start, -end, label, round(-share, 9)))
            beyond = -end
    return out


LICENSED = [
    *[t for _, t in licenses.NOTICES],
    "Some code. " + licenses.NOTICES[1][1].replace("publish, ", "") + " More text, mit  license; MIT-License",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Apache License",
    "word " * 50 + "Licensed under CC BY-NC 4.0. " * 40 + "general public license of nothing",
    "licensed under the apache", "the license of mit", "general public general public license license",
    "this program is free software you can redistribute it", None, "", "MIT license",
]


def test_spans_and_phrases_match_a_plain_version(spark):
    docs = [(i, t) for i, t in enumerate(LICENSED)] + [(0, LICENSED[0]), (0, LICENSED[1]), (None, LICENSED[3]), (None, None)] + [(99, LICENSED[4])] * 50
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("found", "score", "start", "label", "notice", "p", "q", "hash", "run")})
    out = licenses.scan(df, "doc_id", "text").select("doc_id", "n_words", "base", "found", "score", "label")
    got = sorted(((r["doc_id"], r["n_words"], tuple(tuple(s) for s in r["base"]), tuple(sorted((s[0], s[1], s[2], round(s[3], 9)) for s in r["found"])), round(r["score"], 9)) for r in out.collect()), key=repr)

    def want(doc_id, text):
        words = WORD.findall(low(text))
        base = tuple(sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()))
        found = tuple(sorted(plain_spans(text)))
        return doc_id, len(words), base, found, 1.0 if base else max((s[3] for s in found), default=0.0)

    assert got == sorted((want(*d) for d in docs), key=repr)


def test_edited_notices_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(8)
    words = licenses.NOTICES[5][1].split()
    edited = [" ".join(w for i, w in enumerate(words) if i != gone) for gone in range(5, 30, 7)]
    clean = [" ".join(rng.choices(words + ["licence", "free", "of"], k=120)) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(edited + clean)], "doc_id long, text string")
    out = {r["doc_id"]: r["l"] for r in licenses.scan(df, "doc_id", "text").select("doc_id", licenses.labels("found").alias("l")).collect()}
    assert all(out[i] == "gpl" for i in range(len(edited))) and not any(out[len(edited) + i] for i in range(len(clean)))


def test_scan_has_no_python_and_handles_odd_tables(spark, capsys):
    odd = spark.createDataFrame(ODD, DOCS)
    out = licenses.scan(odd, "doc_id", "text")
    out.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan and "BroadcastHashJoin" in plan
    assert out.count() == len(ODD) and out.columns == ["doc_id", "lang", "n_words", "base", "found", "score"]
    assert licenses.scan(spark.createDataFrame([], DOCS), "doc_id", "text").count() == 0


# --- fill in the middle


def plain_middle(text, key):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ z9<>PSMé你🎉\n@[`{"), max_size=40), st.integers(-5, 10**12))
def test_rearranged_texts_match_a_plain_version(text, key):
    assert fim.rearrange(text, str(key)) == plain_middle(text, key)


def test_middles_are_restored_in_odd_tables(spark):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choices("ab cd<>PSM\n9é你🎉", k=rng.randrange(0, 60))), "x") for i in range(400)] + ODD
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("n", "form", "output")})
    made = fim.transform(df, "doc_id", "text").withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    assert made.columns == ["doc_id", "lang", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = sorted((tuple(r) for r in made.drop("lang").collect()), key=repr)
    assert got == sorted(((d[0], *plain_middle(d[1], d[0]), d[1] or "") for d in docs), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(spark.createDataFrame([], DOCS), "doc_id", "text").count() == 0
