"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 3 lower-case characters, in which everything but letters is one separator. A
feature's value is its share of the text's n-grams, times SCALE, times its inverse document frequency in the sample. Weights are
learned by follow-the-regularised-leader (proximal, per coordinate) with L1 and L2 penalties; a part of the sample is
held back to fit one temperature for the scores.

The classifier is fitted on a bounded sample: at most `per_language` different labelled rows of each language, the lowest
hashes of key and text; about a quarter more come to the driver, whatever the table's size. Equal rows count once, so an id that many rows share
is no hot spot. Texts are featurised whole on the executors; only the sample's hashed features come to the driver, and the weights,
BUCKETS by languages, go back. A text that is null or has no letter is `und` with score 0. Without any labelled row
every text is `und`. With one language, every text with a letter is that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.sampling import bar
from larkspur.llm.store import released, small_batches

UND = "und"
BUCKETS = 1 << 16
SCALE = 20.0
PER_LANGUAGE = 1000
MAX_LANGUAGES = 500
CHUNK = 1 << 20

_ALPHA: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which of the code points below 65536 are letters."""
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.array([chr(i).isalpha() for i in range(1 << 16)])
    return _ALPHA


def codes(text: str) -> np.ndarray:
    """Code points of the lower-case text, everything but letters as 0, with a separator before and after."""
    c = np.frombuffer(("\0" + text.lower() + "\0\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    known = letters()[np.minimum(c, 0xFFFF)]
    if c.max() > 0xFFFF:
        high = c > 0xFFFF
        known = known & ~high
        for x in np.unique(c[high]):
            if chr(x).isalpha():
                known |= c == x
    return np.where(known, c, 0).astype(np.uint32)


def grams(c: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams of 1, 2 and 3 characters that begin at each place; runs of separators alone are bucket 0."""
    m = np.uint32(BUCKETS - 1)
    out = []
    h = np.zeros(len(c) - 2, dtype=np.uint32)
    for n in range(3):
        h = (h + c[n : len(c) - 2 + n] * np.uint32((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[n])) * np.uint32(0x27D4EB2F)
        mixed = (h ^ (h >> np.uint32(15))) & m
        plain = c[: len(c) - 2] == 0
        for j in range(1, n + 1):
            plain = plain & (c[j : len(c) - 2 + j] == 0)
        out.append(np.where(plain, 0, mixed))
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares of the text's n-grams, in whole; nothing if the text has no letter."""
    c = codes(text)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for part in grams(c):
        counts += np.bincount(part, minlength=BUCKETS)
    counts[0] = 0
    where = np.flatnonzero(counts)
    return where.astype(np.int32), (counts[where] / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, with idf and SCALE inside
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray | None:
        c = codes(text)
        if not c.any():
            return None
        total, size = np.zeros(len(self.languages)), 0
        # A long text is read in parts that overlap by the length of an n-gram less one.
        step = max(4096, CHUNK // len(self.languages)) if self.languages else CHUNK
        for at in range(0, len(c) - 2, step):
            for part in grams(c[at : at + step + 2]):
                total += self.weights[part].sum(axis=0, dtype=np.float64)
                size += int(np.count_nonzero(part))
        return total / max(1, size) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text else None
        if z is None or not self.languages:
            return UND, 0.0
        p = softmax(z / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, epochs: int = 3, seed: int = 11) -> Model:
    """rows: language, buckets, shares."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    k = len(languages)
    if k < 2:
        return Model(languages, np.zeros((BUCKETS, k), dtype=np.float32), np.zeros(k), 1.0)
    label = {lang: i for i, lang in enumerate(languages)}
    seen = np.zeros(BUCKETS)
    for _, where, _ in rows:
        seen[where] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[: len(rows) // 5]
    taught = order[len(rows) // 5 :]
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(where) -> np.ndarray:
        zz = z[where]
        return np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[where])) / alpha + l2), 0.0)

    def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
        _, where, share = rows[i]
        return np.append(where, BUCKETS), np.append(share * idf[where] * SCALE, 1.0)

    for _ in range(epochs):
        for i in taught:
            where, x = vector(i)
            w = weights(where)
            p = softmax(x @ w)
            p[label[rows[i][0]]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / alpha
            z[where] += g - sigma * w
            n[where] += g * g
    w = weights(slice(None))
    kept = [(x @ w[where], label[rows[i][0]]) for i in held for where, x in [vector(i)]]
    temperature = 1.0
    if kept:
        logits, truth = np.array([a for a, _ in kept]), np.array([b for _, b in kept])
        grid = np.geomspace(0.05, 20.0, 121)
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(languages, (w[:BUCKETS] * (idf * SCALE)[:, None]).astype(np.float32), w[BUCKETS], temperature)


def train(df: DataFrame, key: str, text: str, lang: str, eligible: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the eligible rows with a language, at most per_language of each."""
    rows = small_batches(df).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), eligible.alias("_ok")).where("_ok AND _lang IS NOT NULL AND _text IS NOT NULL")
    hashed = rows.select("_text", "_lang", F.xxhash64("_key", "_text").alias("_order"))
    # Different rows of each language, about; then a range of hashes that holds a quarter more than are wanted.
    counts = {r["_lang"]: r["n"] for r in hashed.groupBy("_lang").agg(F.approx_count_distinct("_order").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return fit([])
    bars = F.create_map(*[F.lit(x) for lang_, n in sorted(counts.items()) for x in (lang_, F.lit(bar(n, per_language)).cast("long"))])
    # Equal rows have one hash and count once, each task's copies before the shuffle.
    chosen = hashed.where(F.col("_order") <= F.element_at(bars, F.col("_lang"))).dropDuplicates(["_lang", "_order"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [features(t) for t in b["_text"]]
            yield pd.DataFrame({"lang": b["_lang"], "order": b["_order"], "buckets": [x.astype("<i4").tobytes() for x, _ in both], "shares": [x.astype("<f4").tobytes() for _, x in both]})

    got = chosen.mapInPandas(released(run), "lang string, order long, buckets binary, shares binary").toPandas().sort_values(["order", "lang"], kind="stable")
    got = got.groupby("lang", sort=False).head(per_language)
    return fit([(lang_, np.frombuffer(a, "<i4"), np.frombuffer(b, "<f4")) for lang_, a, b in zip(got["lang"], got["buckets"], got["shares"], strict=True)])


def predict(df: DataFrame, text: str, model: Model) -> DataFrame:
    """df with lang_pred and score; columns of those names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return released(lambda b: (pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"]) for texts in b))(batches)

    return small_batches(df).select(*names, run(F.col(text)).alias("_lk_found")).select(*names, "_lk_found.lang_pred", "_lk_found.score")


def held_out(key: Column) -> Column:
    """Rows that no classifier may learn from: crc32 of the key as text leaves 1 modulo 3. A null key is held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))
