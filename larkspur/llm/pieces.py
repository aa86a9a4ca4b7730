"""Sampled segmentation over a SentencePiece model's piece lattice, and lossless decoding.

Forward filtering sums, for each place in a text, the weight of all ways to cut what lies before it into pieces; backward
sampling walks from the end and picks each piece in proportion to its weight and that sum. The draws come from a hash
of the row's key and the place in the text, so a row's segmentation does not depend on batches, tasks or retries.

A piece's log weight is -SMOOTHING * ln(rank + RANK_SHIFT) with its rank in the model's own order of scores: the
scores of a merge-based model are ranks, not log-probabilities. A space is the model's space mark; any other character
that is no piece by itself is spelt in byte pieces, and so is the space mark itself where a text has it. So joining
the pieces' bytes gives back exactly the text.

No piece has a space after another character, so a text falls into independent parts before each space that follows one:
each different part of a batch is filtered once, all parts together, place by place. A null text counts as empty and
has no pieces. Rows that repeat key and text get equal pieces; a null key has a seed of its own. An empty table gives an empty one. A text
is filtered whole: batches hold 1 MB of texts or one longer text, and a single run without a space needs about 400 bytes for each of its bytes. Other
columns than key, text and `keep` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.store import released, small_batches, trim
from larkspur.llm.wordhash import SpanHasher, mix, unit

MARK = "▁"
RANK_SHIFT, SMOOTHING = 100.0, 0.4
BATCH_BYTES = 1 << 20
_U = np.uint64


class Lattice:
    """A model's pieces, found by hash, and segmentations sampled from them."""

    def __init__(self, path: str, shift: float = RANK_SHIFT, smoothing: float = SMOOTHING):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        spelt = {i: model.id_to_piece(i).replace(MARK, " ").encode() for i in ids}
        # Pieces with a space after another character would tie a text's parts together; the model must have none.
        if any(b" " in s.lstrip(b" ") for s in spelt.values()):
            raise ValueError("a piece has a space after another character")
        self.bytes = [b""] * model.get_piece_size()
        for i, s in spelt.items():
            self.bytes[i] = s
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        rank = {i: r for r, i in enumerate(sorted(ids, key=lambda i: (-model.get_score(i), i)))}
        self.longest = max(map(len, spelt.values()))
        # Every beginning of a piece has an entry, so that a search ends where no piece goes on.
        whole = {s: i for i, s in spelt.items()}
        heads = list(dict.fromkeys(s[:n] for s in whole for n in range(1, len(s) + 1)))
        data = np.frombuffer(b"".join(heads), dtype=np.uint8)
        ends = np.cumsum([len(s) for s in heads])
        hashes = mix(SpanHasher(data).raw(ends - [len(s) for s in heads], ends))
        # An open table, a quarter full at most: slot to hash, piece (-2: only a beginning; -1: free) and log weight.
        self.bits = int(len(hashes) * 4).bit_length()
        size = 1 << self.bits
        self.slot_hash, self.slot_id = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        self.slot_weight = np.zeros(size)
        self.tries = 1
        for h, s in zip(hashes.tolist(), heads, strict=True):
            at, tries = h >> (64 - self.bits), 1
            while self.slot_id[at] != -1:
                at, tries = (at + 1) % size, tries + 1
            i = whole.get(s, -2)
            self.slot_hash[at], self.slot_id[at], self.slot_weight[at] = h, i, -smoothing * np.log(rank[i] + shift) if i >= 0 else 0.0
            self.tries = max(self.tries, tries)
        self.byte_weight = -smoothing * np.log(len(ids) + shift)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = (hashes >> _U(64 - self.bits)).astype(np.int64)
        taken = self.slot_id[at] != -1
        out = np.where((self.slot_hash[at] == hashes) & taken, at, -1)
        open_ = np.flatnonzero((out < 0) & taken)
        for _ in range(self.tries - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.slot_hash[at[open_]] == hashes[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (self.slot_id[at[open_]] != -1)]
        return out

    def edges(self, parts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For all parts, laid out one after another with one node for each place (a part of n bytes has n + 1): each edge's end node, start node, piece and log weight."""
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        part = np.repeat(np.arange(len(parts)), sizes)
        left = (np.cumsum(sizes)[part] - np.arange(len(data))).astype(np.int64)  # bytes from here to the part's end
        hasher = SpanHasher(data)
        at_all = np.flatnonzero((data & 0xC0) != 0x80)
        alone = np.zeros(len(data), dtype=bool)
        wide = np.select([data >= 0xF0, data >= 0xE0, data >= 0xC0], [4, 3, 2], 1)
        starts, ends, ids, weights = [], [], [], []
        at = at_all
        for n in range(1, self.longest + 1):
            at = at[left[at] >= n]
            if not len(at):
                break
            slot = self.find(mix(hasher.raw(at, at + n)))
            at, slot = at[slot >= 0], slot[slot >= 0]
            hit = self.slot_id[slot] >= 0
            own, slot = at[hit], slot[hit]
            alone[own[wide[own] == n]] = True
            starts.append(own)
            ends.append(own + n)
            ids.append(self.slot_id[slot])
            weights.append(self.slot_weight[slot])
        # Characters that are no piece: each of their bytes is one.
        head = np.zeros(len(data), dtype=np.int64)
        head[at_all] = at_all
        spelt = np.flatnonzero(~alone[np.maximum.accumulate(head)]) if len(data) else np.zeros(0, dtype=np.int64)
        starts.append(spelt)
        ends.append(spelt + 1)
        ids.append(self.byte_ids[data[spelt]])
        weights.append(np.full(len(spelt), self.byte_weight))
        start, end = np.concatenate(starts), np.concatenate(ends)
        shift = part[start]  # each part before adds one node
        return end + shift, start + shift, np.concatenate(ids), np.concatenate(weights)

    def filtered(self, parts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Node offsets of the parts, and edges sorted by end node with the running sum of their probabilities (from the end node's index), for sampling."""
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)))
        end, start, ids, weight = self.edges(parts)
        here = np.arange(first[-1]) - np.repeat(first[:-1], sizes + 1)
        order = np.argsort(end.astype(np.int32) if first[-1] < 1 << 31 else end, kind="stable")
        end, start, ids, weight = end[order], start[order], ids[order], weight[order]
        # By place in the part: the parts go on together. Edges into one node stay side by side.
        place = here[end]
        small = place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place
        order = np.argsort(small, kind="stable")
        sorted_end, sorted_start, sorted_weight, place = end[order], start[order], weight[order], place[order]
        alpha = np.full(first[-1], -np.inf)
        alpha[first[:-1]] = 0.0
        chance = np.zeros(len(end))
        cuts = np.searchsorted(place, np.arange(1, (sizes.max() if len(sizes) else 0) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            value = alpha[sorted_start[a:b]] + sorted_weight[a:b]
            nodes = sorted_end[a:b]
            begin = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
            count = np.diff(np.append(begin, b - a))
            most = np.maximum.reduceat(value, begin)
            share = np.exp(value - np.repeat(np.where(np.isfinite(most), most, 0.0), count))
            total = np.add.reduceat(share, begin)
            with np.errstate(divide="ignore"):
                alpha[nodes[begin]] = most + np.log(total)
            share /= np.repeat(np.where(total > 0, total, 1.0), count)
            chance[order[a:b]] = share
        begin = np.searchsorted(end, np.arange(first[-1] + 1))
        running = np.cumsum(chance)
        base = np.concatenate(([0.0], running))[begin[:-1]]
        return first, start, ids, begin, running, base

    def sample(self, texts: list[bytes], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in order, and where each text's begin."""
        types: dict[bytes, int] = {}
        kind = []
        sizes = []
        for t, s in enumerate(texts):
            pieces = split_parts(s)
            kind += [types.setdefault(p, len(types)) for p in pieces]
            sizes.append(len(pieces))
        parts = list(types)
        if not parts:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        first, start, ids, begin, running, base = self.filtered(parts)
        kind = np.array(kind, dtype=np.int64)
        length = np.array([len(p) for p in parts], dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        ends = np.cumsum(length[kind])
        text_start = np.concatenate(([0], np.cumsum([len(s) for s in texts])))[:-1]
        offset = ends - length[kind] - text_start[text]  # of the part in its text
        seed = seeds[text]
        node, live = first[kind] + length[kind], np.arange(len(kind))
        out_part, out_id, lengths = [], [], []
        low = first[kind]
        while len(live):
            n = node[live]
            place = n - low[live]
            u = unit(mix(seed[live] + (offset[live] + place).astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
            a, b = begin[n], begin[n + 1]
            top = running[b - 1]
            pick = np.searchsorted(running, base[n] + u * (top - base[n]), side="right")
            pick = np.minimum(np.maximum(pick, a), b - 1)
            lengths.append(len(live))
            out_part.append(live)
            out_id.append(ids[pick])
            node[live] = start[pick]
            live = live[start[pick] > low[live]]
        out_part, out_id = np.concatenate(out_part), np.concatenate(out_id)
        # Steps went from each part's end to its front; each part's last step comes first in the text.
        counts = np.bincount(out_part, minlength=len(kind))
        firsts = np.cumsum(counts) - counts
        order_in = np.repeat(np.arange(len(lengths)), lengths)
        final = np.empty(len(out_id), dtype=np.int32)
        final[firsts[out_part] + counts[out_part] - 1 - order_in] = out_id
        per_text = np.bincount(text, weights=counts, minlength=len(texts)).astype(np.int64)
        return final, np.concatenate(([0], np.cumsum(per_text)))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids.tolist()])


def split_parts(text: bytes) -> list[bytes]:
    """The text cut before every space that follows another character."""
    if not text:
        return []
    words = text.split(b" ")
    out, lead = [], b""
    for i, w in enumerate(words):
        if i:
            lead += b" "
        if w:
            out.append(lead + w)
            lead = b""
    if lead:
        out.append(lead)
    return out


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """A model's lattice, kept while the Python worker lives."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
        trim()
    return _LATTICES[path]


def encode(df: DataFrame, key: str, text: str, model_path: str, check: bool = True, keep: str | None = None) -> DataFrame:
    """key, piece_ids (array), n_pieces, ids_crc32 and, with `check`, lossless (whether decoding gives the text back); and the column `keep`, a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        own = lattice(model_path)
        names = ["key", "piece_ids", "n_pieces", "ids_crc32", "lossless", *(["kept"] if keep else [])]
        for batch in batches:
            keys, seeds = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            column = batch.column(2).cast(pa.binary())
            sizes = pc.binary_length(column).to_pylist()
            at = 0
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (end == at or size + sizes[end] <= BATCH_BYTES):
                    size += sizes[end]
                    end += 1
                texts = column.slice(at, end - at).to_pylist()
                ids, firsts = own.sample(texts, seeds[at:end])
                raw = memoryview(ids.astype("<i4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
                same = [own.decode(ids[a:b]) == t for a, b, t in zip(firsts[:-1].tolist(), firsts[1:].tolist(), texts, strict=True)] if check else [None] * (end - at)
                arrays = [keys.slice(at, end - at), pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(firsts), pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), *([batch.column(3).slice(at, end - at)] if keep else [])]
                yield pa.RecordBatch.from_arrays(arrays, names)
                at = end

    rows = small_batches(df).select(F.col(key).cast("long").alias("key"), F.coalesce(F.xxhash64(key), F.lit(0)).alias("seed"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.col(keep).cast("long").alias("kept")] if keep else []))
    out = rows.mapInArrow(released(run), "key long, piece_ids array<int>, n_pieces long, ids_crc32 long, lossless boolean" + (", kept long" if keep else ""))
    return out.withColumnsRenamed({"key": key} | ({"kept": keep} if keep else {}))


def decode(df: DataFrame, ids: str, model_path: str, out: str = "text") -> DataFrame:
    """df with the text of its piece ids in column `out`."""
    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        own = lattice(model_path)
        return pd.Series([None if x is None else own.decode(np.asarray(x)).decode("utf-8") for x in lists])

    return df.withColumn(out, run(F.col(ids)))
