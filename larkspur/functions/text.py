"""Text expressions: cleaning, tickers, tokens, chunks and stable ids."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)[\s\x1c-\x1f]+"


def unescape(text: Column) -> Column:
    """HTML entities decoded in Python, by Arrow batches; a text without an ampersand goes as NULL and comes back as it was."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.coalesce(decode(F.when(text.contains("&"), text)), text)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACES, " "), r"^ +| +$", "")


# The agency marks that are no part of a story.
LEADING_MARK = r"(?iU)^[\s\x1c-\x1f]*reuters[\s\x1c-\x1f]*[-:]?[\s\x1c-\x1f]*"
INLINE_MARK = r"(?iU)\(reuters\)[\s\x1c-\x1f]*[-:]?[\s\x1c-\x1f]*"


def without_marks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, LEADING_MARK, ""), INLINE_MARK, "")


def clean_text(text: Column | str, entities: bool = True) -> Column:
    """Entities decoded, agency marks removed, white space squeezed; NULL counts as empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return squeeze(without_marks(F.replace(unescape(t) if entities else t, F.lit("\u00a0"), F.lit(" "))))


def news_ticker(ticker: Column | str) -> Column:
    """Upper case, no white space, dots as dashes."""
    t = F.col(ticker) if isinstance(ticker, str) else ticker
    return F.replace(F.regexp_replace(F.upper(t), SPACES, ""), F.lit("."), F.lit("-"))


def panel_ticker(ticker: Column | str) -> Column:
    t = F.col(ticker) if isinstance(ticker, str) else ticker
    return F.upper(F.trim(t))


def tokens(cleaned: Column) -> Column:
    """Words of cleaned text; none for an empty one."""
    return F.when(cleaned == "", F.array().cast("array<string>")).otherwise(F.split(cleaned, " "))


def chunks(words: Column, most: int = 256, overlap: int = 0) -> Column:
    """Array of texts of at most `most` words; each starts `most - overlap` words after the last, and the first to reach the end is the last."""
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("chunks need a positive length and a smaller overlap")
    step = most - overlap
    n = F.size(words)
    count = F.when(n == 0, 0).when(n <= most, 1).otherwise(F.ceil((n - most) / step).cast("int") + 1)
    whole = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(most)), " "))
    return F.when(count == 0, F.array().cast("array<string>")).otherwise(whole)


def chunk_id(news_id: Column, ticker: Column, date: Column, index: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of id|ticker|date|index."""
    return F.substring(F.sha1(F.concat_ws("|", news_id.cast("string"), ticker, date.cast("string"), index.cast("string"))), 1, 16)
