"""Fill-in-the-middle: texts cut at two token borders and put in another order, so that a model learns to fill the gap.

A text is decoded to an array of code points. Tokens are runs of ASCII letters and every other character by itself: a token begins where
the character is no letter, or the one before it is none, so comparing neighbouring classes gives all borders at once. The draws
come from a hash of the row's key and a seed: they do not depend on batches, tasks or retries.

Forms: `psm` is `<P>`prefix`<S>`suffix`<M>`middle, `spm` is `<S>`suffix`<P>`prefix`<M>`middle, `plain` is the text itself. Plain are empty texts, texts in which
a marker stands already (the output could not be undone) and those that the share of rearranged texts leaves out.

A null text counts as empty. Rows that repeat key and text get equal results; a null key is drawn as the empty string. A text is processed whole:
it takes about 15 bytes of a worker's memory for each of its characters, one text at a time. Columns of df that have a result's name are replaced, others stay;
an empty table gives an empty one. There is no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The markers, the shares of forms and the seed.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
RATE, SPM_RATE = 90, 20  # per cent
SEED = "1"
OUT_BYTES = 4 << 20
RESULT = (("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64()), ("output", T.StringType(), pa.string()))


def borders(codes: np.ndarray) -> np.ndarray:
    """Where tokens begin in an array of code points, and its length at the end: n tokens have n + 1 borders."""
    folded = codes | 0x20
    letter = (folded >= ord("a")) & (folded <= ord("z"))
    first = np.ones(len(codes) + 1, dtype=bool)
    first[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first)


def draws(key: str, seed: str = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12))


def rearrange(text: str, key: str, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    raw = text.encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, dtype="<u4")
    at = borders(codes)
    n = len(at) - 1
    h1, h2, h3, h4 = draws(key, seed)
    if n == 0 or h3 % 100 >= rate or any(m in text for m in MARKERS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(at[low]), int(at[high])
    prefix, middle, suffix = (codes[i:j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in ((0, a), (a, b), (b, len(codes))))
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def packed(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of rows that come with their size in bytes; a batch holds OUT_BYTES or one larger row."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def transform(df: DataFrame, key: str, text: str, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """df with n (tokens), form, prefix_chars, middle_chars (code points; NULL if plain) and output. `text` itself is left out: `restore` gives it back."""
    names = [name for name, *_ in RESULT]
    kept = [c for c in df.columns if c != text and c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_lk_key"), F.coalesce(F.col(text), F.lit("")).alias("_lk_text"))
    fields = [f for f in source.schema.fields if f.name in kept]
    out = T.StructType([*fields, *[T.StructField(name, kind) for name, kind, _ in RESULT]])
    schema = pa.schema([(name, kind) for name, _, kind in RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(len(kept)), batch.column(len(kept) + 1)

            def rows(keys=keys, texts=texts) -> Iterator[tuple[tuple, int]]:
                for k, t in zip(keys, texts, strict=True):
                    row = rearrange(t.as_py(), k.as_py(), seed, rate, spm_rate)
                    yield row, 4 * len(row[4])

            first = 0
            for made in packed(rows(), schema):
                columns = [batch.column(i).slice(first, made.num_rows) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *made.columns], names=[*kept, *names])
                first += made.num_rows

    return source.mapInArrow(run, out)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. A marker stands in it once, so the pieces lie between the markers."""
    def pieces(second: str) -> Callable[[int], Column]:
        parts = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{second}|{MIDDLE}", -1)
        return lambda i: F.get(parts, i)

    psm, spm = pieces(SUFFIX), pieces(PREFIX)
    return F.when(form == "psm", F.concat(psm(0), psm(2), psm(1))).when(form == "spm", F.concat(spm(1), spm(2), spm(0))).otherwise(output)
