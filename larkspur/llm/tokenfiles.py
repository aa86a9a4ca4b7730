"""Whole texts to binary token files and back.

Documents are range-partitioned by key, each partition is encoded and written as files in the format of
`larkspur.llm.pfor`, in ascending key order over all files. A file's name follows from its partition and its place in
it, and it appears under that name only when complete, so a repeated task writes the same file again.

A null text is an empty one: its only id is the end id. A null key comes first. Rows with the same key stand in
the order of a hash of their texts, so that a key with many rows is split like any other range; its equal rows are split by the
partitions they come from. A very long text is encoded whole in one task. An empty table makes no file. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import pfor
from larkspur.llm.store import cut, released

END_ID = 0
IDS_PER_FILE = 8 << 20
CACHE_ENTRIES = 1_600_000

# White space in any sense: Unicode's, and the control characters that some libraries count.
_ODD = "".join(map(chr, [*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACES = frozenset(_ODD + " ")
_ODD_BY_SPACE = re.compile(f"[{re.escape(_ODD)}] | [{re.escape(_ODD)}]")

PUNCTUATION = ".,;:!?"
JOINED = 256


class Encoder:
    """Ids of whole texts through the tokenizers library, each different piece of text encoded once.

    `known` has the ids (as bytes) of a piece under the piece itself if it follows a space, and under a space and
    the piece if it stands as it is; it is emptied when it has `limit` entries, so memory stays bounded.
    """

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each core has its own Python worker
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True
        self.limit = limit
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words that each follow a space and have none inside. Many make one text; a token that begins with a space begins a word."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            joined = ["".join([" " + w for w in part[i : i + JOINED]]) for i in range(0, len(part), JOINED)]
            flat = np.frombuffer(b"".join(self.ids(joined)), dtype="<u4")
            cuts = (np.flatnonzero(self.spaced[flat]) * 4).tolist()
            raw = flat.tobytes()
            found = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
            if len(found) != len(part):
                found = self.ids([" " + w for w in part])
            out += found
        return out

    @staticmethod
    def atoms(piece: str, spaced: bool) -> list[str]:
        """Keys of the parts whose ids, joined, are the piece's: single line ends, final punctuation, and the rest."""
        lines = piece.split("\n")
        if any(x.split() != [x] for x in lines):
            return [piece if spaced else " " + piece]
        out = []
        for i, line in enumerate(lines):
            if i:
                out.append(" \n")
            core = line.rstrip(PUNCTUATION)
            tail = line[len(core) :] if core and core[-1].isalnum() else ""
            body = line[: len(line) - len(tail)]
            out.append(body if spaced and not i else " " + body)
            if tail:
                out.append(" " + tail)
        return out

    def fill(self, keys: set[str]) -> None:
        known = self.known
        new = [k for k in keys if k not in known]
        if len(known) + 2 * len(new) > self.limit:
            known.clear()
            new = list(keys)
        # Most pieces are a word, or a word and one mark; the rest go the general way.
        wanted, ended, made = set(), [], {}
        for k in new:
            if k.isalpha():
                wanted.add(k)
            elif k[-1:] in PUNCTUATION and k[:-1].isalpha():
                wanted.add(k[:-1])
                ended.append(k)
            else:
                made[k] = self.atoms(k[1:], False) if k[:1] == " " else self.atoms(k, True)
        words = list(wanted.difference(known))
        known.update(zip(words, self.words(words), strict=True))
        rest = list({a for parts in made.values() for a in parts}.union(" " + m for m in PUNCTUATION).difference(known))
        known.update(zip(rest, self.ids([a[1:] if a[:1] == " " else " " + a for a in rest]), strict=True))
        for k in ended:
            known[k] = known[k[:-1]] + known[" " + k[-1]]
        for k, parts in made.items():
            if len(parts) > 1:
                known[k] = b"".join([known[a] for a in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit words."""
        split = []
        for t in texts:
            if regular(t):
                pieces = t.split(" ")
                pieces[0] = " " + pieces[0]
            else:
                head, *rest = split_pieces(t)
                pieces = [" " + head, *[w[1:] if " " not in w[1:] else " " + w for w in rest]]
            split.append(pieces)
        # A group of texts at a time is looked up, so that what one fill() adds is there when it is read.
        out, at = [], 0
        while at < len(split):
            wanted: set[str] = set()
            end = at
            while end < len(split) and (end == at or len(wanted) < self.limit // 4):
                wanted.update(split[end])
                end += 1
            self.fill(wanted)
            out += [b"".join(map(self.known.__getitem__, pieces)) for pieces in split[at:end]]
            at = end
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept while the Python worker lives: later tasks use what earlier ones learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def split_pieces(text: str) -> list[str]:
    """Pieces whose ids, joined, are the whole text's.

    A byte-level tokenizer's pre-tokenizer never joins a character with a space after it: its pieces are an optional
    space and a run of one kind of character, or white space alone. So a text may be cut before each single space
    that stands between two characters that are no white space; texts with other spacing keep it inside a piece.
    """
    first, *rest = text.split(" ")
    out, held = [first], False
    for p in rest:
        last = out[-1][-1:]
        if p and p[0] not in _SPACES and last and last not in _SPACES and not held:
            out.append(" " + p)
        else:
            out[-1] += " " + p
        held = not p
    return out


def regular(text: str) -> bool:
    """Whether every space stands between two characters that are no white space, so that split() cuts rightly."""
    return not ("  " in text or text[:1] == " " or text[-1:] == " " or (not text.isprintable() and _ODD_BY_SPACE.search(text)))


def _open(directory: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(directory) if "://" in directory or directory.startswith("file:") else (fs.LocalFileSystem(), directory)


def write(df: DataFrame, key: str, text: str, tokenizer_path: str, directory: str, end_id: int = END_ID, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Encode df's texts and write them to `directory` (a URI all executors reach, or a shared path).

    Returns one row for each file, from a checkpoint: file, documents, ids. The work is done when this returns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = _open(directory)
        store.create_dir(root, recursive=True)
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        keys: list[int | None] = []
        parts: list[bytes] = []
        size = made = 0

        def flush() -> pd.DataFrame:
            nonlocal size, made
            counts = np.array([len(p) // 4 for p in parts], dtype=np.uint64)
            name = f"part-{part:08d}-{made:06d}.pfor"
            data = pfor.to_bytes(keys, counts, np.frombuffer(b"".join(parts), dtype="<u4"))
            hidden = f"{root}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as f:
                f.write(data)
            store.move(hidden, f"{root}/{name}")
            row = pd.DataFrame({"file": [name], "documents": [len(keys)], "ids": [size]})
            keys.clear()
            parts.clear()
            size, made = 0, made + 1
            return row

        for batch in batches:
            ids, texts = batch["_key"].tolist(), batch["_text"].tolist()
            for at in range(0, len(ids), 256):
                for k, b in zip(ids[at : at + 256], encode(texts[at : at + 256]), strict=True):
                    keys.append(None if k is None or k != k else int(k))
                    parts.append(b + end)
                    size += len(b) // 4 + 1
                    if size >= ids_per_file:
                        yield flush()
        if keys:
            yield flush()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        df.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.spark_partition_id().alias("_from"))
        .withColumn("_hash", F.xxhash64("_text"))
        .repartitionByRange(n, F.col("_key").asc_nulls_first(), "_hash", "_from")
        .sortWithinPartitions(F.col("_key").asc_nulls_first(), "_hash", "_text")
        # As text, so that a null key does not turn keys into doubles on the way.
        .select(F.col("_key").cast("string").alias("_key"), "_text")
    )
    return cut(ordered.mapInPandas(released(run), "file string, documents long, ids long"))


def read(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each document in the files: file, key, place (in the file), first (id in the file), ids (binary, little-endian 32-bit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                keys, counts, values = pfor.from_bytes(bytes(data))
                ends = np.cumsum(counts)
                firsts = ends - counts
                for at in range(0, len(keys), 1024):
                    stop = min(at + 1024, len(keys))
                    yield pd.DataFrame({
                        "file": path.rsplit("/", 1)[-1], "key": pd.array(keys[at:stop], dtype="Int64"), "place": np.arange(at, stop), "first": firsts[at:stop],
                        "ids": [values[a:b].tobytes() for a, b in zip(firsts[at:stop], ends[at:stop], strict=True)],
                    })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(directory).select("path", "content")
    return files.mapInPandas(run, "file string, key long, place long, first long, ids binary")


def digest(spark: SparkSession, directory: str, manifest: DataFrame, key: str) -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                keys, counts, values = pfor.from_bytes(bytes(data))
                raw = memoryview(values.astype("<u4").tobytes())
                ends = np.cumsum(counts)
                firsts = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "key": pd.array(keys, dtype="Int64"), "first": firsts, "n_tokens": counts, "ids_crc32": crc})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(directory).select("path", "content")
    # One row a file, not a document: a file has millions of ids, so this one task reads few rows even for millions of files.
    before = manifest.select("file", (F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("_before"))
    rows = files.mapInPandas(run, "file string, key long, first long, n_tokens long, ids_crc32 long")
    return rows.join(before, "file").select(F.col("key").alias(key), (F.col("first") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
