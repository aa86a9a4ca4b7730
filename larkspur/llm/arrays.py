"""Array expressions in linear or n log n time: bindings, running sums, pieces of long strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a column used in a lambda function would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column], neutral: int) -> Column:
    """op over each value and all before it, for an array of ints: rounds of doubled spans, n log n steps."""
    def round_of(acc: Column, k: Column) -> Column:
        shifted = F.slice(F.concat(F.array_repeat(F.lit(neutral), F.pow(F.lit(2.0), k).cast("int")), acc), F.lit(1), F.size(acc))
        return F.zip_with(acc, shifted, op)

    def whole(v: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v).cast("double"))).cast("int") - 1)
        return F.when(F.size(v) > 1, F.aggregate(rounds, v, round_of)).otherwise(v)

    return let(values.cast("array<int>"), whole)


def blocks_of(text: Column) -> Column:
    """A text in strings of BLOCK code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text in blocks: only the blocks in which they lie are touched."""
    first = F.floor(start / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * BLOCK + 1, end - start)).otherwise("")
