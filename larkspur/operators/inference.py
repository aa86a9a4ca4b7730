"""Forward passes of the temporal models in NumPy, over arrays that Spark hands out in batches.

Weights are a table (name, shape, values), small enough for every task: they are trained elsewhere. Names follow the usual export of such a
model: `factor_branch.net.0.weight` and so on; a linear layer's weight is (outputs, inputs), a convolution's (outputs, inputs, kernel).
Training itself is not part of this engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# The dilations of the four blocks, the offset of a layer norm, the least weight in an entropy.
DILATIONS = (1, 2, 4, 8)
EPSILON, LEAST = 1e-5, 1e-8
MAX_WEIGHTS = 50_000_000

Weights = dict[str, np.ndarray]


def weights_table(spark: SparkSession, weights: Weights) -> DataFrame:
    return spark.createDataFrame([(n, list(w.shape), w.astype(float).ravel().tolist()) for n, w in weights.items()], "name string, shape array<int>, values array<double>")


def read_weights(table: DataFrame) -> Weights:
    """The arrays of a weights table; more than MAX_WEIGHTS numbers fail."""
    from pyspark.sql import functions as F

    size = table.agg(F.sum(F.size("values"))).first()[0] or 0
    if size > MAX_WEIGHTS:
        raise ValueError(f"{size} weights are too many to hand to every task")
    return {r["name"]: np.array(r["values"], dtype=np.float64).reshape(r["shape"]) for r in table.collect()}


def seeded_weights(shapes: dict[str, tuple[int, ...]], seed: int = 0) -> Weights:
    """Small random weights, for tests and for seeing that a pipeline runs."""
    random = np.random.default_rng(seed)
    return {n: random.normal(0.0, 1.0 / np.sqrt(max(1, int(np.prod(s[1:])))), s) for n, s in shapes.items()}


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to about 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + erf(x / np.sqrt(2.0)))


def linear(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def norm(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    """Layer norm over the last axis."""
    gap = x - x.mean(axis=-1, keepdims=True)
    return gap / np.sqrt((gap * gap).mean(axis=-1, keepdims=True) + EPSILON) * w[f"{name}.weight"] + w[f"{name}.bias"]


def mlp(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    """Linear layers `<name>.net.<i>` in order of i with a rectifier between them; one output, without its axis."""
    layers = sorted({int(k[len(name) + 5 :].split(".")[0]) for k in w if k.startswith(f"{name}.net.")})
    for i, layer in enumerate(layers):
        x = linear(w, f"{name}.net.{layer}", np.maximum(x, 0.0) if i else x)
    return x[..., 0]


def bottleneck(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    """Norm, linear, GELU, linear, norm."""
    inner = gelu(linear(w, f"{name}.net.1", norm(w, f"{name}.net.0", x)))
    return norm(w, f"{name}.net.5", linear(w, f"{name}.net.4", inner))


def gate(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-mlp(w, name, x)))


def causal(kernel: np.ndarray, bias: np.ndarray, x: np.ndarray, dilation: int) -> np.ndarray:
    """A convolution over time of (rows, time, inputs) that sees no later place; zeros stand before the first."""
    out = np.zeros((*x.shape[:2], kernel.shape[0])) + bias
    for j in range(kernel.shape[2]):
        back = (kernel.shape[2] - 1 - j) * dilation
        if back < x.shape[1]:
            out[:, back:] += x[:, : x.shape[1] - back] @ kernel[:, :, j].T
    return out


def tcn(w: Weights, name: str, x: np.ndarray, mask: np.ndarray | None = None, dilations: tuple[int, ...] = DILATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(states of all places, state of the last valid one) of residual blocks of two causal convolutions each. Places outside the mask are zero throughout."""
    keep = np.ones(x.shape[:2], dtype=bool) if mask is None else mask.astype(bool)
    x = x * keep[..., None]
    for i, d in enumerate(dilations):
        at = f"{name}.layers.{i}"
        side = x if f"{at}.residual.weight" not in w else x @ w[f"{at}.residual.weight"][:, :, 0].T + w[f"{at}.residual.bias"]
        inner = gelu(causal(w[f"{at}.conv1.conv.weight"], w[f"{at}.conv1.conv.bias"], x, d))
        inner = causal(w[f"{at}.conv2.conv.weight"], w[f"{at}.conv2.conv.bias"], inner, d)
        x = norm(w, f"{at}.norm", gelu(inner + side)) * keep[..., None]
    last = np.maximum(keep.sum(axis=1), 1) - 1
    return x, x[np.arange(len(x)), last]


def attention(w: Weights, name: str, chunks: np.ndarray, stock: np.ndarray, mask: np.ndarray, tickers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pooled, weights, entropy) of chunks (rows, chunks, width): what a chunk says to this stock, and what it says by itself, added and normalised over the mask. Without a chunk the weights are 0."""
    keys = linear(w, f"{name}.chunk_proj", chunks)
    query = linear(w, f"{name}.stock_proj", stock)
    table = w.get(f"{name}.ticker_embedding.weight")
    if table is not None and tickers is not None:
        query = query + table[np.maximum(tickers, 0)]
    score = linear(w, f"{name}.score", np.tanh(keys + query[:, None]))[..., 0] + linear(w, f"{name}.content_score", np.tanh(keys))[..., 0]
    score = np.where(mask, score, -np.inf)
    top = score.max(axis=1, keepdims=True)
    raised = np.exp(score - np.where(np.isfinite(top), top, 0.0))
    share = raised / np.maximum(raised.sum(axis=1, keepdims=True), LEAST)
    clipped = np.maximum(share, LEAST)
    return (chunks * share[..., None]).sum(axis=1), share, -(clipped * np.log(clipped)).sum(axis=1)


def single_day(w: Weights, factors: np.ndarray, chunks: np.ndarray, stock: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """The model of one day: attention over its chunks, bottleneck, two branches, gate and their mixture."""
    pooled, share, entropy = attention(w, "pooler", chunks, stock, mask)
    news = bottleneck(w, "news_bottleneck", pooled)
    both = np.concatenate([factors, news], axis=-1)
    base, fused, open_ = mlp(w, "factor_branch", factors), mlp(w, "fusion_branch", both), gate(w, "gate", both)
    return {"factor_only_pred": base, "fusion_pred": fused, "gate_news_prob": open_, "mixed_pred": (1 - open_) * base + open_ * fused, "text_alpha_raw": open_ * (fused - base), "full_text_news_repr": news, "attention_weights": share, "attention_entropy": entropy}


def news_state(w: Weights, factors: np.ndarray, news: np.ndarray, mask: np.ndarray | None, tickers: np.ndarray | None) -> dict[str, np.ndarray]:
    """State of the news stream. news: (rows, time, width) of pooled vectors, or (rows, time, chunks, width) with a mask of chunks, which attention pools day by day."""
    out: dict[str, np.ndarray] = {}
    if news.ndim == 4:
        n, t, c, width = news.shape
        ids = None if tickers is None else np.repeat(tickers, t)
        pooled, share, entropy = attention(w, "news_encoder.attention_pooler", news.reshape(n * t, c, width), factors.reshape(n * t, -1), mask.reshape(n * t, c), ids)
        news = pooled.reshape(n, t, width)
        out = {"attention_entropy": entropy.reshape(n, t)[:, -1], "target_attention_weights": share.reshape(n, t, c)[:, -1]}
    state = tcn(w, "news_encoder.tcn", bottleneck(w, "news_encoder.bottleneck", news))[1]
    return {"full_text_news_repr": np.nan_to_num(state, nan=0.0, posinf=0.0, neginf=0.0), **out}


def temporal(w: Weights, part: str, factors: np.ndarray, news: np.ndarray | None = None, has_news: np.ndarray | None = None, mask: np.ndarray | None = None, tickers: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The models over a history: part is "factor" (factor stream alone), "fusion" (both streams) or "mixture" (both branches and the gate; without news the factor branch stands)."""
    state = np.nan_to_num(tcn(w, "factor_encoder.tcn", factors)[1], nan=0.0, posinf=0.0, neginf=0.0)
    if part == "factor":
        return {"factor_only_pred": mlp(w, "factor_branch", state)}
    out = news_state(w, factors, news, mask, tickers)
    both = np.concatenate([state, out["full_text_news_repr"]], axis=-1)
    fused = mlp(w, "fusion_branch", both)
    if part == "fusion":
        return {"fusion_pred": fused, **out}
    if part != "mixture":
        raise ValueError(f"no model part {part}")
    base, there = mlp(w, "factor_branch", state), np.clip(has_news, 0.0, 1.0)
    fused, open_ = there * fused + (1 - there) * base, there * gate(w, "gate", both)
    return {"factor_only_pred": base, "fusion_pred": fused, "gate_news_prob": open_, "mixed_pred": (1 - open_) * base + open_ * fused, **out}


def shapes(factor_dim: int, embedding_dim: int, hidden: int = 128, daily: int = 64, inner: int = 256, tickers: int = 0, attention_over: bool = False) -> dict[str, tuple[int, ...]]:
    """The arrays of the mixture model over a history."""
    out: dict[str, tuple[int, ...]] = {}

    def dense(name: str, a: int, b: int) -> None:
        out.update({f"{name}.weight": (b, a), f"{name}.bias": (b,)})

    def flat(name: str, n: int) -> None:
        out.update({f"{name}.weight": (n,), f"{name}.bias": (n,)})

    def stream(name: str, a: int) -> None:
        for i in range(len(DILATIONS)):
            for c, m in (("conv1", a if i == 0 else hidden), ("conv2", hidden)):
                out.update({f"{name}.layers.{i}.{c}.conv.weight": (hidden, m, 3), f"{name}.layers.{i}.{c}.conv.bias": (hidden,)})
            if i == 0 and a != hidden:
                out.update({f"{name}.layers.0.residual.weight": (hidden, a, 1), f"{name}.layers.0.residual.bias": (hidden,)})
            flat(f"{name}.layers.{i}.norm", hidden)

    stream("factor_encoder.tcn", factor_dim)
    stream("news_encoder.tcn", daily)
    flat("news_encoder.bottleneck.net.0", embedding_dim)
    dense("news_encoder.bottleneck.net.1", embedding_dim, inner)
    dense("news_encoder.bottleneck.net.4", inner, daily)
    flat("news_encoder.bottleneck.net.5", daily)
    for name, a in (("factor_branch", hidden), ("fusion_branch", 2 * hidden)):
        dense(f"{name}.net.0", a, hidden)
        dense(f"{name}.net.3", hidden, hidden // 2)
        dense(f"{name}.net.5", hidden // 2, 1)
    dense("gate.net.0", 2 * hidden, hidden // 2)
    dense("gate.net.3", hidden // 2, 1)
    if attention_over:
        name = "news_encoder.attention_pooler"
        dense(f"{name}.chunk_proj", embedding_dim, hidden)
        dense(f"{name}.stock_proj", factor_dim, hidden)
        dense(f"{name}.score", hidden, 1)
        dense(f"{name}.content_score", hidden, 1)
        if tickers:
            out[f"{name}.ticker_embedding.weight"] = (tickers + 1, hidden)
    return out


def _nested(column: pd.Series) -> np.ndarray:
    def whole(x) -> np.ndarray:
        return np.stack([whole(y) for y in x]) if len(x) and isinstance(x[0], (list, np.ndarray)) else np.asarray(x, dtype=np.float64)
    return np.stack([whole(x) for x in column])


ROWS = 256


def infer(samples: DataFrame, weights: Weights, part: str, keys: list[str], news: str | None = "news_seq", has_news: str = "has_news", chunk_mask: str | None = None, ticker_id: str | None = None) -> DataFrame:
    """keys and the predictions of a model part for samples with factor_seq and, but for "factor", a news column; attention weights as an array. ROWS samples are worked on at a time."""
    names = {"factor": ["factor_only_pred"], "fusion": ["fusion_pred"], "mixture": ["factor_only_pred", "fusion_pred", "gate_news_prob", "mixed_pred"]}[part]
    arrays = ["target_attention_weights"] if chunk_mask and part != "factor" else []
    extra = ["attention_entropy"] if arrays else []
    spread = samples.sparkSession.sparkContext.broadcast(weights)
    wanted = list(dict.fromkeys([*keys, "factor_seq", *([news] if news and part != "factor" else []), *([has_news] if part == "mixture" else []), *([chunk_mask] if arrays else []), *([ticker_id] if arrays and ticker_id else [])]))
    types = dict(samples.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], *[f"{n} double" for n in names + extra], *[f"{n} array<double>" for n in arrays]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                b = batch.iloc[at : at + ROWS]
                mask = _nested(b[chunk_mask]).astype(bool) if arrays else None
                ids = b[ticker_id].to_numpy() if arrays and ticker_id else None
                out = temporal(spread.value, part, _nested(b["factor_seq"]), _nested(b[news]) if news and part != "factor" else None, b[has_news].to_numpy(dtype=np.float64) if part == "mixture" else None, mask, ids)
                yield pd.DataFrame({**{k: b[k].to_numpy() for k in keys}, **{n: out[n] for n in names + extra}, **{n: list(out[n]) for n in arrays}})

    return samples.select(*wanted).mapInPandas(run, schema)
