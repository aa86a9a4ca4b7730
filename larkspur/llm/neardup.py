"""Near-duplicate classes by DartMinHash signatures, banded joins and exact checks.

Two texts are linked if the weighted Jaccard similarity of their shingles (runs of `width` lower-case words, weighted by how
often they occur) is at least `threshold`; a class is a connected component of links, named by its smallest id.

1. Each text becomes a fingerprint of its whole weighted set and a signature. Texts with equal sets are one set from
   here on, so a group of thousands of exact copies costs one row.
2. Sets that agree on all rows of a band meet in a bucket. First every member is compared, by signature, with the
   bucket's member that meets most others in all buckets. Pairs that the signatures leave possible are checked exactly, on
   shingles made anew from the texts, and the links' components become known.
3. A bucket stays open while the members that have not led it are of two or more components. In each round some members
   outside the commonest component lead (few at first, LEADERS at most): each is compared with all that have not led, every
   possible pair of two components is checked exactly, the components grow, and the leaders leave. No bucket or member is
   dropped, and the order of leaders cannot change a class.
4. Rounds end when no bucket is open, or when few of a round's checks were links: then the members are not copies of one text but
   share a passage. Those of the buckets that are still open are joined by their rarest shingles (see prefixes), all at once:
   every pair of them that can be alike is checked exactly unless links already join it. So each pair of a bucket is decided.

A pair is possible if its signatures agree nearly often enough (four standard errors), and if the histograms of its sets
allow it: both sets' weights are summed in BINS hashed bins, and what two sets share cannot be more than the sum of the
bins' smaller values. That bound is exact, so it never costs a link, and it leaves few false pairs among texts of one template.

A null text counts as empty. Texts without a word are alike only if they are equal. A text with fewer words than
`width` is one shingle. Very long texts are hashed whole, about half a megabyte of text at a time and never less than one text. Ties between
leaders go to the smaller key. Extra columns are not read, whatever their names, but a key or text column is named by the caller. Rows without an id are in no class (class_id null). Rows that repeat
an id are judged by their own texts; two classes with the same smallest id have the same name, and differ in `_label` of `members`.
An empty table has no classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import prefixes
from larkspur.llm.components import components
from larkspur.llm.dartminhash import signature, similarity
from larkspur.llm.store import Notes, cut, released, small_batches
from larkspur.llm.wordhash import mix, shingles, word_hashes

WIDTH, THRESHOLD = 5, 0.8
# Coordinates are dealt into bands of ROWS in DEALS different ways: 64 bands of 8. Two texts that share a passage but little
# else seldom agree on 8 coordinates; two at the threshold miss all bands with a chance below one in a thousand.
COORDINATES, ROWS, DEALS = 128, 8, 4
BINS, FULL = 256, 0xFFFF
FIRST_LEADERS, LEADERS, MEMBERS = 16, 256, 256
# A round of fewer links than this share of its checks is the last one.
WORTHWHILE = 0.25
# In the rounds, up to this many texts of candidate pairs are named to all tasks (about 60 bytes each), so that the other texts stay where they are.
BROADCAST_TEXTS = 10_000
# Where there are more, their hashes' slots are named to all tasks, this many at most (about 25 bytes each): only texts in a wanted slot are shuffled.
SLOTS = 1 << 21
# Four standard errors of a signature's estimate at the threshold.
SLACK = 4 * (THRESHOLD * (1 - THRESHOLD) / COORDINATES) ** 0.5


def weighted_sets(texts: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted different shingles of each text, and how often each occurs."""
    words, firsts = word_hashes(texts)
    for i in range(len(texts)):
        elements, counts = np.unique(shingles(words[firsts[i] : firsts[i + 1]], width), return_counts=True)
        yield elements, counts.astype(np.float64)


def deals() -> np.ndarray:
    """The coordinates of each band."""
    random = np.random.default_rng(20)
    return np.concatenate([random.permutation(COORDINATES) for _ in range(DEALS)]).reshape(-1, ROWS)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, bands) keys of (n, COORDINATES) signatures."""
    order = deals()
    key = np.broadcast_to(np.arange(len(order), dtype=np.uint64), (len(signatures), len(order))).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, order[:, r]])
    return key.view(np.int64)


def _text_slices(batch: pd.DataFrame, column: str, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Slices of a batch with about `most` characters each."""
    start = size = 0
    for i, n in enumerate(batch[column].str.len()):
        size += int(n)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(batch):
        yield start, len(batch)


def fingerprints(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """_id, _hash (of the text), _set (fingerprint of the weighted set), _sig and _sketch (null for texts without a word)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _text_slices(batch, "_text"):
                part = batch.iloc[a:b]
                texts = part["_text"].tolist()
                prints, signs, sketches = [], [], []
                for t, (elements, counts) in zip(texts, weighted_sets(texts, width), strict=True):
                    data = elements.tobytes() + counts.tobytes() if len(elements) else b"\0" + t.encode("utf-8", "surrogatepass")
                    prints.append(hashlib.blake2b(data, digest_size=16).digest())
                    own = signature(elements, counts, COORDINATES) if len(elements) else None
                    signs.append(None if own is None else own.tobytes())
                    sketches.append(None if own is None else sketch(elements, counts, own))
                yield pd.DataFrame({"_id": part["_id"].to_numpy(), "_hash": part["_hash"].to_numpy(), "_set": prints, "_sig": signs, "_sketch": sketches})

    return _rows(df, key, text).where("_id IS NOT NULL").mapInPandas(released(run), "_id long, _hash string, _set binary, _sig binary, _sketch binary")


def text_hash(text: str) -> Column:
    """What tells apart the texts of rows that repeat an id."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("_id"), text_hash(text).alias("_hash"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def sketch(elements: np.ndarray, counts: np.ndarray, own: np.ndarray) -> bytes:
    """The low byte of each coordinate of the signature `own`, and the weight in each bin. A bin beyond 16 bits is full: such a set has no bound.

    The bins' high bytes, nearly all 0, stand by themselves, so that they cost little once compressed.
    """
    bins = np.minimum(np.bincount((elements >> np.uint64(32)).astype(np.int64) % BINS, counts, BINS), FULL).astype("<u2")
    return own.astype(np.uint8).tobytes() + bins.view(np.uint8).reshape(BINS, 2).T.tobytes()


def _sketches(column) -> tuple[np.ndarray, np.ndarray]:
    """(n, COORDINATES) bytes of signatures and (n, BINS) histograms."""
    both = np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), COORDINATES + 2 * BINS)
    low, high = both[:, COORDINATES : COORDINATES + BINS], both[:, COORDINATES + BINS :]
    return np.ascontiguousarray(both[:, :COORDINATES]), low + high.astype(np.uint16) * np.uint16(256)


def possible(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Whether each row of a may be alike with the row of b beside it (or with the only one): by estimate, and by the bound of the histograms."""
    out = (a[0] == b[0]).sum(axis=1) >= (threshold - SLACK) * COORDINATES
    at = np.flatnonzero(out)
    x, y = a[1][at], b[1][at] if len(b[1]) == len(out) else b[1]
    shared = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    whole = x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64) - shared
    full = (x.max(axis=1, initial=0) == FULL) | (y.max(axis=1, initial=0) == FULL)
    out[at] = full | (shared >= threshold * whole - 1e-6)
    return out


def bands(sets: DataFrame) -> DataFrame:
    """_id, _bucket: one row for each set and band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"_id": b["_id"].to_numpy(), "_b": list(band_keys(np.frombuffer(b"".join(b["_sig"]), dtype=np.uint32).reshape(len(b), COORDINATES)))})

    return sets.select("_id", "_sig").mapInPandas(released(run), "_id long, _b array<long>").select("_id", F.explode("_b").alias("_bucket"))


def linked(texts: tuple[DataFrame, DataFrame], sets: DataFrame, width: int, threshold: float, note: Notes) -> DataFrame:
    """_id, _label: the smallest set of each linked set's component. sets: _id, _sig, _sketch. texts: see links."""
    spots = bands(sets)
    sizes = spots.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = cut(spots.join(sizes, "_bucket"))
    # The member that meets most others is the likeliest to be near them all: the text that copies were made from.
    degrees = note(shared.groupBy("_id").agg(F.sum("_n").alias("_degree")))
    ranked = cut(shared.drop("_n").join(degrees, "_id"))
    leaders = ranked.groupBy("_bucket").agg(F.max(F.struct(F.col("_degree").alias("d"), (-F.col("_id")).alias("i"))).alias("_m")).select("_bucket", (-F.col("_m.i")).alias("_leader"))
    met = cut(ranked.join(leaders, "_bucket").where("_id <> _leader"))
    sigs = cut(sets.select("_id", "_sketch").join(degrees, "_id"))
    first = (
        met.select("_id", "_leader").distinct()
        .join(sigs.drop("_degree"), "_id").join(sigs.select(F.col("_id").alias("_leader"), F.col("_sketch").alias("_other")), "_leader")
    )

    def sieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[["_id", "_leader"]][possible(_sketches(b["_sketch"]), _sketches(b["_other"]), threshold)]

    checked = note(first.mapInPandas(released(sieve), "_id long, _leader long").select(F.least("_leader", "_id").alias("a"), F.greatest("_leader", "_id").alias("b")).distinct())
    alike = note(links(texts, checked, width, threshold, note).select("a", "b"))
    labels = components(alike, keep=note).toDF("_id", "_label")
    # The members that have not led their bucket.
    state, leaders_now = met.select("_bucket", "_id"), FIRST_LEADERS
    while True:
        state = state.join(labels, "_id", "left").select("_bucket", "_id", F.coalesce("_label", "_id").alias("_label"))
        open_ = state.groupBy("_bucket").agg(F.min("_label").alias("_least"), F.max("_label").alias("_most"), F.count(F.lit(1)).alias("_n")).where("_least <> _most").select("_bucket", "_n")
        state = note(state.join(open_, "_bucket"))
        if state.isEmpty():
            return labels
        common = state.groupBy("_bucket", "_label").agg(F.count(F.lit(1)).alias("_c")).groupBy("_bucket").agg(F.max(F.struct("_c", "_label")).alias("_m")).select("_bucket", F.col("_m._label").alias("_common"))
        order = Window.partitionBy("_bucket").orderBy(F.col("_degree").desc(), "_id")
        leading = state.join(common, "_bucket").where("_label <> _common").join(degrees, "_id").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= leaders_now)
        leading, leaders_now = note(leading.select("_bucket", "_id", "_label")), min(LEADERS, 4 * leaders_now)
        fresh = note(_round(state, leading, sigs.drop("_degree"), threshold).distinct().join(checked, ["a", "b"], "left_anti"))
        state = state.join(leading.select("_bucket", "_id"), ["_bucket", "_id"], "left_anti").select("_bucket", "_id")
        if fresh.isEmpty():
            continue
        checked = checked.unionByName(fresh)
        alike = note(links(texts, fresh, width, threshold, note, few=True).select("a", "b"))
        found = alike.count()
        if found:
            labels = components(labels.toDF("a", "b").unionByName(alike), keep=note).toDF("_id", "_label")
        if found < WORTHWHILE * fresh.count():
            return _by_prefixes(texts, state, labels, sigs.drop("_degree"), checked, width, threshold, note)


def _by_prefixes(texts: tuple[DataFrame, DataFrame], state: DataFrame, labels: DataFrame, sigs: DataFrame, checked: DataFrame, width: int, threshold: float, note: Notes) -> DataFrame:
    """labels with all links between the members of buckets that are still open. state: _bucket, _id of those that have not led."""
    named = state.join(labels, "_id", "left").select("_bucket", "_id", F.coalesce("_label", "_id").alias("_label"))
    open_ = named.groupBy("_bucket").agg(F.min("_label").alias("_least"), F.max("_label").alias("_most")).where("_least <> _most").select("_bucket")
    members = note(named.join(open_, "_bucket", "left_semi").select("_id", "_label").distinct())
    sets = note(shingled(texts, members.select(F.col("_id").alias("_key")), width, note, True).join(members, "_id"))
    met = prefixes.pairs(sets, threshold).join(checked, ["a", "b"], "left_anti")
    both = met.join(sigs.select(F.col("_id").alias("a"), "_sketch"), "a").join(sigs.select(F.col("_id").alias("b"), F.col("_sketch").alias("_other")), "b")

    def sieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[["a", "b"]][possible(_sketches(b["_sketch"]), _sketches(b["_other"]), threshold)]

    fresh = note(both.select("a", "b", "_sketch", "_other").mapInPandas(released(sieve), "a long, b long"))
    alike = note(compared(fresh, sets.select("_id", "_e", "_c"), threshold).select("a", "b"))
    return labels if alike.isEmpty() else components(labels.toDF("a", "b").unionByName(alike), keep=note).toDF("_id", "_label")


def _round(state: DataFrame, leading: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """One round of the open buckets: every pair (a, b) of a leader and a member of another component that may be alike."""
    leaders = leading.join(sigs, "_id").groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct("_id", "_label", "_sketch"))).alias("_lead"))
    members = (
        state.join(sigs, "_id").withColumn("_part", F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / MEMBERS)))
        .groupBy("_bucket", "_part").agg(F.collect_list(F.struct("_id", "_label", "_sketch")).alias("_members"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lead, members in zip(batch["_lead"], batch["_members"], strict=True):
                ids, labels, sketches = np.array([x["_id"] for x in lead]), np.array([x["_label"] for x in lead]), _sketches([x["_sketch"] for x in lead])
                left, right = [], []
                signatures, histograms = _sketches([x["_sketch"] for x in members])
                for i, x in enumerate(members):
                    near = ids[possible(sketches, (signatures[i : i + 1], histograms[i : i + 1]), threshold) & (labels != x["_label"])]
                    left += np.minimum(near, x["_id"]).tolist()
                    right += np.maximum(near, x["_id"]).tolist()
                yield pd.DataFrame({"a": np.array(left, dtype=np.int64), "b": np.array(right, dtype=np.int64)})

    return members.join(leaders, "_bucket").select("_lead", "_members").mapInPandas(released(run), "a long, b long")


def shingled(texts: tuple[DataFrame, DataFrame], keys: DataFrame, width: int, note: Notes, few: bool = False) -> DataFrame:
    """_id, _e, _c: the shingles and counts of the sets whose _key is in keys. With `few`, texts are counted first, and up to BROADCAST_TEXTS of them are found without a shuffle; else only texts in their slots are shuffled.

    texts: rows (_id, _hash, _text), and the row that stands for each set (_key, _id, _hash).
    """
    rows, owners = texts
    wanted = note(owners.join(keys, "_key"))
    if few and wanted.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    else:
        rows = in_slots(rows, wanted)

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _text_slices(batch, "_text"):
                part = batch.iloc[a:b]
                both = list(weighted_sets(part["_text"].tolist(), width))
                yield pd.DataFrame({"_id": part["_key"].to_numpy(), "_e": [e.tobytes() for e, _ in both], "_c": [c.astype(np.float32).tobytes() for _, c in both]})

    # Rows that repeat an id and a text are cut to one before their shingles are made; where both were shuffled, they already stand together.
    once = rows.join(wanted, ["_id", "_hash"]).dropDuplicates(["_id", "_hash"])
    return cut(once.select("_key", "_text").mapInPandas(released(cover), "_id long, _e binary, _c binary"))


def in_slots(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose (_id, _hash) is in a slot with one of wanted's: all those that are wanted and some more, found without a shuffle."""
    slot = F.pmod(F.xxhash64("_id", "_hash"), F.lit(SLOTS)).alias("_slot")
    return rows.select("*", slot).join(F.broadcast(wanted.select(slot).distinct()), "_slot", "left_semi").drop("_slot")


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of sets that are alike, with their similarity."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def view(e: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(e, np.uint64), np.frombuffer(c, np.float32)

        for b in batches:
            s = [similarity(view(*x[:2]), view(*x[2:])) for x in zip(b["_e"], b["_c"], b["_e2"], b["_c2"], strict=True)]
            yield b[["a", "b"]].assign(similarity=np.array(s, dtype=np.float64))

    joined = pairs.join(sets.toDF("a", "_e", "_c"), "a").join(sets.toDF("b", "_e2", "_c2"), "b")
    return joined.mapInPandas(released(check), "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def links(texts: tuple[DataFrame, DataFrame], pairs: DataFrame, width: int, threshold: float, note: Notes, few: bool = False) -> DataFrame:
    """The pairs (a, b) of sets that are alike, with their similarity. Only the texts of those in a pair are shuffled (and those in their slots), and only their shingles go on."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("_key")).distinct()
    return compared(pairs, shingled(texts, keys, width, note, few), threshold)


def members(df: DataFrame, key: str, text: str, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """_id, _hash, _label, class_id for each row of df with an id: its class has one _label, and class_id is the smallest id in it."""
    df = small_batches(df)
    prints = cut(fingerprints(df, key, text, width))
    firsts = prints.groupBy("_set").agg(F.min(F.struct("_id", "_hash")).alias("_m")).select("_set", "_m.*")
    # A key of its own for each set: two sets may have the same smallest id.
    firsts = cut(firsts.withColumn("_key", F.monotonically_increasing_id()))
    sets = cut(prints.where("_sig IS NOT NULL").join(firsts, ["_set", "_id", "_hash"]).dropDuplicates(["_key"]).select(F.col("_key").alias("_id"), "_sig", "_sketch"))
    texts = _rows(df, key, text), firsts.select("_key", "_id", "_hash")
    note = Notes(df.sparkSession)
    named = cut(linked(texts, sets, width, threshold, note).toDF("_key", "_label").join(firsts.select("_key", "_id"), "_key"))
    note.clear()
    least = named.groupBy("_label").agg(F.min("_id").alias("_least"))
    named = named.join(least, "_label").select("_key", "_label", "_least")
    owner = firsts.join(named, "_key", "left").select("_set", F.coalesce("_label", "_key").alias("_label"), F.coalesce("_least", "_id").alias("class_id"))
    return prints.select("_id", "_hash", "_set").join(owner, "_set").drop("_set")


def classes(df: DataFrame, key: str, text: str, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id for each row of df."""
    rows = members(df, key, text, width, threshold).select(F.col("_id").alias(key), "class_id")
    lost = df.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias(key), F.lit(None).cast("long").alias("class_id"))
    return rows.unionByName(lost)
