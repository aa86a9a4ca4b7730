"""Patched frame-of-reference coding of 32-bit unsigned integers.

A block is 256 values. Each value's distance to the block's minimum is packed at a width that holds a chosen share of
the block (a percentile of the distances' bit lengths); the rest are outliers: their packed bits are 0 and they stand
in the block's exception list with position and distance. An index has the word at which each block's packed
part begins and the place at which its exceptions begin, so any block can be read alone. A last, short block is
filled with its last value.

File layout, all little-endian:

    magic "LKPF", version u32, documents u64, values u64, blocks u64, packed words u64, exceptions u64
    document keys i64 each, key present u8 each, values in document u64 each
    block minimum u32 each, width u8 each, first word u64 each, first exception u64 each
    exception position u8 each, exception distance u32 each
    packed words u32 each
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 256
LANES = 32
PERCENTILE = 0.9
MAGIC, VERSION = b"LKPF", 1
HEAD = struct.Struct("<4sI5Q")


def pack(groups: np.ndarray, width: int) -> np.ndarray:
    """(n, 32) values below 2**width to (n, width) words."""
    out = np.zeros((len(groups), width), dtype=np.uint32)
    for i in range(LANES if width else 0):
        word, shift = divmod(i * width, 32)
        out[:, word] |= groups[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= groups[:, i] >> np.uint32(32 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """(n, width) words to (n, 32) values."""
    out = np.zeros((len(words), LANES), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(LANES if width else 0):
        word, shift = divmod(i * width, 32)
        value = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | (words[:, word + 1] << np.uint32(32 - shift))
        out[:, i] = value & mask
    return out


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def encode(values: np.ndarray, percentile: float = PERCENTILE) -> dict[str, np.ndarray]:
    """The sections of a file for the values."""
    blocks = -(-len(values) // BLOCK)
    full = np.empty(blocks * BLOCK, dtype=np.uint32)
    full[: len(values)] = values
    if blocks:
        full[len(values) :] = values[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, dtype=np.uint32)
    gap = full - low[:, None]
    # A width holds the share asked for exactly when it holds the value at that rank.
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = bit_length(np.partition(gap, rank, axis=1)[:, rank]) if blocks else np.zeros(0, dtype=np.uint8)
    outlier = gap >> width.astype(np.uint32)[:, None] > 0 if blocks else np.zeros((0, BLOCK), dtype=bool)
    outlier &= width[:, None] < 32
    block, place = np.nonzero(outlier)
    distance = gap[block, place]
    gap[block, place] = 0
    start = np.concatenate(([0], np.cumsum(width.astype(np.int64) * (BLOCK // LANES))))
    words = np.zeros(start[-1], dtype=np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        packed = pack(gap[own].reshape(-1, LANES), int(w)).reshape(len(own), -1)
        words[(start[own][:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    return {
        "low": low, "width": width, "start": start[:-1].astype(np.uint64), "exceptions": np.searchsorted(block, np.arange(blocks)).astype(np.uint64),
        "place": place.astype(np.uint8), "distance": distance.astype(np.uint32), "words": words,
    }


def decode(s: dict[str, np.ndarray], count: int) -> np.ndarray:
    """The values of all blocks, without the filling."""
    blocks = len(s["low"])
    gap = np.zeros((blocks, BLOCK), dtype=np.uint32)
    start = s["start"].astype(np.int64)
    for w in np.unique(s["width"]):
        own = np.flatnonzero(s["width"] == w)
        each = int(w) * (BLOCK // LANES)
        words = s["words"][(start[own][:, None] + np.arange(each)).ravel()]
        gap[own] = unpack(words.reshape(len(own) * (BLOCK // LANES), int(w)), int(w)).reshape(len(own), BLOCK)
    first = np.append(s["exceptions"].astype(np.int64), len(s["place"]))
    gap[np.repeat(np.arange(blocks), np.diff(first)), s["place"]] = s["distance"]
    return (gap + s["low"][:, None]).ravel()[:count]


def block(s: dict[str, np.ndarray], b: int) -> np.ndarray:
    """One block's 256 values, read through the index alone."""
    width, at = int(s["width"][b]), int(s["start"][b])
    gap = unpack(s["words"][at : at + width * (BLOCK // LANES)].reshape(BLOCK // LANES, width), width).ravel()
    first = int(s["exceptions"][b])
    last = int(s["exceptions"][b + 1]) if b + 1 < len(s["low"]) else len(s["place"])
    gap[s["place"][first:last]] = s["distance"][first:last]
    return gap + s["low"][b]


def to_bytes(keys: list[int | None], counts: np.ndarray, values: np.ndarray) -> bytes:
    s = encode(values)
    return b"".join([
        HEAD.pack(MAGIC, VERSION, len(keys), len(values), len(s["low"]), len(s["words"]), len(s["place"])),
        np.array([k or 0 for k in keys], dtype="<i8").tobytes(), np.array([k is not None for k in keys], dtype="u1").tobytes(), counts.astype("<u8").tobytes(),
        s["low"].astype("<u4").tobytes(), s["width"].tobytes(), s["start"].astype("<u8").tobytes(), s["exceptions"].astype("<u8").tobytes(),
        s["place"].tobytes(), s["distance"].astype("<u4").tobytes(), s["words"].astype("<u4").tobytes(),
    ])


def sections(data: bytes) -> tuple[list[int | None], np.ndarray, int, dict[str, np.ndarray]]:
    """Keys, values in each document, number of values, sections."""
    magic, version, docs, count, blocks, words, exceptions = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this format")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    keys, there, counts = take("<i8", docs), take("u1", docs), take("<u8", docs)
    s = {"low": take("<u4", blocks), "width": take("u1", blocks), "start": take("<u8", blocks), "exceptions": take("<u8", blocks)}
    s |= {"place": take("u1", exceptions), "distance": take("<u4", exceptions), "words": take("<u4", words)}
    if at != len(data):
        raise ValueError("the file was cut short or has trailing bytes")
    return [int(k) if t else None for k, t in zip(keys, there, strict=True)], counts.astype(np.int64), count, s


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    keys, counts, count, s = sections(data)
    return keys, counts, decode(s, count)
