"""Whole runs and forward passes against plain versions."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import history as H
from larkspur.operators import inference as I
from larkspur.operators import news as N
from larkspur.operators import pipelines as R
from larkspur.operators import vectors as E
from larkspur.plans import run_queries
from larkspur.sources import manifests, tables

DAY = datetime.date(2024, 1, 2)


def plain_norm(x, w, b):
    m = sum(x) / len(x)
    v = sum((y - m) ** 2 for y in x) / len(x)
    return [(y - m) / math.sqrt(v + 1e-5) * g + c for y, g, c in zip(x, w, b, strict=True)]


def plain_gelu(x):
    return 0.5 * x * (1 + math.erf(x / math.sqrt(2)))


def plain_dense(w, name, x):
    return [sum(a * y for a, y in zip(row, x, strict=True)) + c for row, c in zip(w[f"{name}.weight"], w[f"{name}.bias"], strict=True)]


def plain_mlp(w, name, x, layers):
    for i, k in enumerate(layers):
        x = plain_dense(w, f"{name}.net.{k}", [max(0.0, y) for y in x] if i else x)
    return x[0]


def plain_conv(kernel, bias, x, d):
    out = []
    for t in range(len(x)):
        row = []
        for o in range(len(bias)):
            s = bias[o]
            for j in range(kernel.shape[2]):
                at = t - (kernel.shape[2] - 1 - j) * d
                if at >= 0:
                    s += sum(kernel[o, c, j] * x[at][c] for c in range(kernel.shape[1]))
            row.append(s)
        out.append(row)
    return out


def plain_tcn(w, name, x):
    for i, d in enumerate((1, 2, 4, 8)):
        at = f"{name}.layers.{i}"
        side = x if f"{at}.residual.weight" not in w else plain_conv(w[f"{at}.residual.weight"], w[f"{at}.residual.bias"], x, 1)
        h = [[plain_gelu(v) for v in row] for row in plain_conv(w[f"{at}.conv1.conv.weight"], w[f"{at}.conv1.conv.bias"], x, d)]
        h = plain_conv(w[f"{at}.conv2.conv.weight"], w[f"{at}.conv2.conv.bias"], h, d)
        x = [plain_norm([plain_gelu(a + b) for a, b in zip(p, q, strict=True)], w[f"{at}.norm.weight"], w[f"{at}.norm.bias"]) for p, q in zip(h, side, strict=True)]
    return x[-1]


def plain_attention(w, name, chunks, stock, mask, ticker):
    q = [a + b for a, b in zip(plain_dense(w, f"{name}.stock_proj", stock), w[f"{name}.ticker_embedding.weight"][ticker], strict=True)]
    scores = []
    for c in chunks:
        k = plain_dense(w, f"{name}.chunk_proj", c)
        scores.append(plain_dense(w, f"{name}.score", [math.tanh(a + b) for a, b in zip(k, q, strict=True)])[0] + plain_dense(w, f"{name}.content_score", [math.tanh(a) for a in k])[0])
    e = [math.exp(s) if m else 0.0 for s, m in zip(scores, mask, strict=True)]
    total = sum(e) or 1.0
    share = [x / total for x in e]
    return [sum(s * c[i] for s, c in zip(share, chunks, strict=True)) for i in range(len(chunks[0]))], share


def test_mixture_over_a_history_equals_a_plain_forward_pass(spark):
    r = np.random.default_rng(5)
    n, t, c, width, factors = 3, 6, 4, 5, 2
    w = I.seeded_weights(I.shapes(factors, width, 6, 4, 5, 3, True), 9)
    w = {k: v + (1.0 if k.endswith("norm.weight") or "bottleneck.net.0.weight" in k or "bottleneck.net.5.weight" in k else 0.0) for k, v in w.items()}
    f, chunks = r.normal(size=(n, t, factors)), r.normal(size=(n, t, c, width))
    mask = r.random((n, t, c)) < 0.6
    mask[0, -1] = False
    chunks *= mask[..., None]
    tickers, news = np.array([1, 0, 3]), np.array([0.0, 1.0, 1.0])
    got = I.temporal(w, "mixture", f, chunks, news, mask, tickers)
    for i in range(n):
        state = plain_tcn(w, "factor_encoder.tcn", f[i].tolist())
        days, last = [], None
        for d in range(t):
            pooled, last = plain_attention(w, "news_encoder.attention_pooler", chunks[i, d].tolist(), f[i, d].tolist(), mask[i, d], tickers[i])
            inner = plain_dense(w, "news_encoder.bottleneck.net.1", plain_norm(pooled, w["news_encoder.bottleneck.net.0.weight"], w["news_encoder.bottleneck.net.0.bias"]))
            days.append(plain_norm(plain_dense(w, "news_encoder.bottleneck.net.4", [plain_gelu(x) for x in inner]), w["news_encoder.bottleneck.net.5.weight"], w["news_encoder.bottleneck.net.5.bias"]))
        both = [*state, *plain_tcn(w, "news_encoder.tcn", days)]
        base, fused = plain_mlp(w, "factor_branch", state, (0, 3, 5)), plain_mlp(w, "fusion_branch", both, (0, 3, 5))
        gate = 1 / (1 + math.exp(-plain_mlp(w, "gate", both, (0, 3)))) * news[i]
        fused = fused if news[i] else base
        want = {"factor_only_pred": base, "fusion_pred": fused, "gate_news_prob": gate, "mixed_pred": (1 - gate) * base + gate * fused}
        assert all(abs(got[k][i] - v) < 1e-5 for k, v in want.items())
        assert np.allclose(got["target_attention_weights"][i], last, atol=1e-9)
    df = spark.createDataFrame([(i, f[i].tolist(), chunks[i].tolist(), mask[i].tolist(), float(news[i]), int(tickers[i])) for i in range(n)], "id int, factor_seq array<array<double>>, chunk_seq array<array<array<double>>>, chunk_mask_seq array<array<boolean>>, has_news double, ticker_id int")
    rows = {x["id"]: x for x in I.infer(df, I.read_weights(I.weights_table(spark, w)), "mixture", ["id"], "chunk_seq", chunk_mask="chunk_mask_seq", ticker_id="ticker_id").collect()}
    assert all(abs(rows[i]["mixed_pred"] - got["mixed_pred"][i]) < 1e-9 and np.allclose(rows[i]["target_attention_weights"], got["target_attention_weights"][i]) for i in range(n))


def test_no_state_sees_a_later_day_and_a_mask_ends_the_history():
    w = I.seeded_weights(I.shapes(2, 2, 6, 4, 5), 1)
    x = np.random.default_rng(0).normal(size=(1, 8, 2))
    y = x.copy()
    y[0, 5:] = 99.0
    a, b = I.tcn(w, "factor_encoder.tcn", x)[0], I.tcn(w, "factor_encoder.tcn", y)[0]
    assert np.allclose(a[0, :5], b[0, :5]) and not np.allclose(a[0, 5:], b[0, 5:])
    mask = np.array([[True] * 5 + [False] * 3])
    assert np.allclose(I.tcn(w, "factor_encoder.tcn", y, mask)[1], a[:, 4])
    with pytest.raises(ValueError):
        I.temporal(w, "other", x, x)


def test_single_day_model_shuts_no_branch_and_adds_up():
    shapes = {"pooler.chunk_proj.weight": (6, 4), "pooler.chunk_proj.bias": (6,), "pooler.stock_proj.weight": (6, 2), "pooler.stock_proj.bias": (6,), "pooler.score.weight": (1, 6), "pooler.score.bias": (1,), "pooler.content_score.weight": (1, 6), "pooler.content_score.bias": (1,), "news_bottleneck.net.0.weight": (4,), "news_bottleneck.net.0.bias": (4,), "news_bottleneck.net.1.weight": (5, 4), "news_bottleneck.net.1.bias": (5,), "news_bottleneck.net.4.weight": (3, 5), "news_bottleneck.net.4.bias": (3,), "news_bottleneck.net.5.weight": (3,), "news_bottleneck.net.5.bias": (3,)}
    for name, a in (("factor_branch", 2), ("fusion_branch", 5)):
        shapes |= {f"{name}.net.0.weight": (6, a), f"{name}.net.0.bias": (6,), f"{name}.net.3.weight": (3, 6), f"{name}.net.3.bias": (3,), f"{name}.net.5.weight": (1, 3), f"{name}.net.5.bias": (1,)}
    shapes |= {"gate.net.0.weight": (3, 5), "gate.net.0.bias": (3,), "gate.net.3.weight": (1, 3), "gate.net.3.bias": (1,)}
    r = np.random.default_rng(2)
    mask = np.array([[True, True, False], [False, False, False]])
    out = I.single_day(I.seeded_weights(shapes, 4), r.normal(size=(2, 2)), r.normal(size=(2, 3, 4)), r.normal(size=(2, 2)), mask)
    assert np.allclose(out["attention_weights"].sum(axis=1), [1, 0]) and np.allclose(out["text_alpha_raw"], out["mixed_pred"] - out["factor_only_pred"])
    assert I.erf(np.array([0.5, -1.0])) == pytest.approx([math.erf(0.5), math.erf(-1.0)], abs=2e-7)


def test_representations_are_the_projected_means(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(60, 6)) @ np.diag([4, 3, 2, 1, 0.5, 0.1])
    rows = [(f"c{i}", DAY, f"T{i % 12}", v.tolist(), "a", i) for i, v in enumerate(x)] + [("c0", DAY, "T0", [9.0] * 6, "b", 0), ("none", DAY, "T1", None, "b", 1)]
    stored = spark.createDataFrame(rows, "chunk_id string, date date, ticker string, embedding array<double>, path string, line int")
    panel = spark.createDataFrame([(DAY, f"t{i}", 1, 5) for i in range(14)], "date date, ticker string, news_count int, chunk_count int")
    out = R.representations(stored, panel, 2, 6)
    means = np.array([x[i::12].mean(axis=0) for i in range(12)])
    u = np.linalg.svd(means - means.mean(axis=0), full_matrices=False)[2][:2]
    want = (means - means.mean(axis=0)) @ (u * np.sign(u[np.arange(2), np.argmax(np.abs(u), axis=1)])[:, None]).T
    got = {q["ticker"]: q for q in out["panel"].collect()}
    assert np.allclose([[got[f"T{i}"]["news_repr_0"], got[f"T{i}"]["news_repr_1"]] for i in range(12)], want)
    assert got["T13"]["news_repr_0"] == 0.0 and not got["T13"]["has_vector"] and out["repr"].count() == 12
    assert out["quality"].first()["missing_vectors"] == 1 and out["quality"].first()["repeated_rows"] == 1


def test_chunks_are_encoded_once(spark):
    chunks = spark.createDataFrame([("a", "T", DAY, "one two"), ("b", "T", DAY, None), ("c", "T", DAY, "x")], "chunk_id string, ticker string, date date, chunk_text string")
    store = manifests.VectorStore(spark, spark.conf.get("spark.checkpoint.dir") + "/store")
    out = R.encode_chunks(chunks, store.ids(), lambda: lambda texts: np.array([[len(t)] for t in texts]), "m", 2)
    store.save(out.where("chunk_id <> 'c'"))
    assert {q["chunk_id"]: q["embedding"] for q in store.load().collect()} == {"a": [7.0], "b": [0.0]}
    assert [q["chunk_id"] for q in R.encode_chunks(chunks, store.ids(), lambda: lambda texts: np.ones((len(texts), 1)), "m").collect()] == ["c"]
    assert store.get("a").count() == 1 and store.manifest().first()["embedding_dim"] == 1


def test_batches_hold_whole_dates_in_order_or_in_a_seeded_order(spark):
    df = spark.range(100).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("date"), "id")
    plain = {(q["date"].day, q["batch"], q["date_id"]) for q in R.batches_by_date(df, 4).collect()}
    assert plain == {(d + 1, d // 4, d % 4) for d in range(10)}
    mixed = {q["date"]: q["batch"] for q in R.batches_by_date(df, 4, True, 1).collect()}
    assert mixed == {q["date"]: q["batch"] for q in R.batches_by_date(df.repartition(5), 4, True, 1).collect()}
    assert mixed != {q["date"]: q["batch"] for q in R.batches_by_date(df, 4, True, 2).collect()}


def test_alphas_are_made_only_where_missing(spark):
    df = spark.createDataFrame([(1.0, 9.0)], "s double, have double")
    out = R.with_alphas(df, {"have": ("absent", 1.0), "made": ("s", -1.0)}).first()
    assert out["have"] == 9.0 and out["made"] == -1.0
    with pytest.raises(KeyError):
        R.with_alphas(df, {"x": ("absent", 1.0)})


def test_an_empty_calendar_fails_and_ids_count_over_days(spark):
    news = spark.createDataFrame([("a", "T", "x", "2024-01-02 09:00:00")], "news_id string, ticker string, text string, publish_time string")
    with pytest.raises(Exception, match="calendar"):
        N.signal_dates(news, spark.createDataFrame([], "date date")).collect()
    raw = spark.createDataFrame([("T", f"t{i}", f"2024-01-0{1 + i % 3} 0{i % 9}:00:00") for i in range(27)], "ticker string, text string, publish_time string")
    one = {(q["text"], q["news_id"]) for q in N.normalized(raw, F.struct("publish_time", "text")).collect()}
    assert one == {(q["text"], q["news_id"]) for q in N.normalized(raw, F.struct("publish_time", "text"), bucket=F.to_date("publish_time")).collect()}


def test_lines_of_a_split_manifest_are_numbered_through(spark, tmp_path):
    lines = [f'{{"chunk_id": "c{i}", "embedding_path": "p", "ticker": "t", "date": "2024-01-01"}}' for i in range(500)]
    (tmp_path / "manifest.jsonl").write_text("\n".join([*lines[:3], "", *lines[3:]]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {q["chunk_id"]: q["line"] for q in manifests.read_manifests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"c{i}": i + 1 + (i >= 3) for i in range(500)}


def test_settings_from_files_and_summed_means(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"a": {"b": 1}, "c": 2}')
    assert tables.merged(tables.read_settings(f"{tmp_path}/s.json"), {"a": {"d": 3}}) == {"a": {"b": 1, "d": 3}, "c": 2}
    v = spark.createDataFrame([("A", [1.0, 3.0]), ("A", [3.0, 5.0]), ("B", [2.0, 2.0])], "ticker string, embedding array<double>")
    assert {q["ticker"]: q["vector"] for q in E.numbered_mean(v, ["ticker"], "embedding", width=2).collect()} == {"A": [2.0, 4.0], "B": [2.0, 2.0]}
    with pytest.raises(Exception, match="another length"):
        E.numbered_mean(v, ["ticker"], "embedding", width=3).collect()


def test_samples_of_overlapping_ranges_match_a_plain_history(spark):
    rng = np.random.default_rng(5)
    first = datetime.date(2020, 1, 1)
    panel, matrices = [], {}
    for t, n in (("HOT", 400), ("GAPS", 60), ("SHORT", 3)):
        day = first
        for i in range(n):
            day += datetime.timedelta(int(rng.integers(1, 3)) if t != "GAPS" or i % 7 else 90)
            panel.append((day, t, float(rng.normal()) if rng.random() < 0.9 else None, bool(rng.random() < 0.7), [float(i), 1.0]))
            if rng.random() < 0.6:
                matrices[day, t] = np.float32(rng.normal(size=(int(rng.integers(1, 6)), 2))).tolist()
    matrices[first, "HOT"] = [[1.0, 2.0]]  # a day that is not in the panel
    df = spark.createDataFrame(panel, "date date, ticker string, f double, wanted boolean, v array<double>").repartition(5)
    held = spark.createDataFrame([(d, t, m) for (d, t), m in matrices.items()], "date date, ticker string, matrix array<array<double>>").repartition(3)
    made = H.cut_samples(df, ["f"], 5, F.col("wanted"), "v", held, 2, 4, days=40)
    got = {(r["date"], r["ticker"]): r for r in made.collect()}
    want = 0
    for t in ("HOT", "GAPS", "SHORT"):
        own = sorted(p for p in panel if p[1] == t)
        for i, p in enumerate(own):
            if i < 4 or not p[3]:
                continue
            want += 1
            r, past = got[p[0], t], own[i - 4 : i + 1]
            assert r["date_seq"] == [q[0] for q in past] and r["factor_seq"] == [[q[2] or 0.0] for q in past] and r["news_seq"] == [q[4] for q in past]
            for q, m, k in zip(past, r["chunk_seq"], r["chunk_mask_seq"], strict=True):
                there = matrices.get((q[0], t), [])[:4]
                assert m == there + [[0.0, 0.0]] * (4 - len(there)) and k == [j < len(there) for j in range(4)]
    assert len(got) == want and made.columns == ["date", "ticker", "f", "wanted", "v", "factor_seq", "date_seq", "news_seq", "chunk_seq", "chunk_mask_seq"]
    # What is wide is copied once, and what precedes a range again.
    copies = df.join(H.ranges_needed(df, 30, 200).withColumnRenamed("ticker", "_t"), (F.col("ticker") == F.col("_t")) & (F.floor(F.unix_date("date") / 200) == F.col("_block")) & (F.col("date") >= F.col("_from")))
    assert copies.where("ticker = 'HOT'").count() <= 0.3 * 400


def test_values_between_two_rounded_ones_do_not_depend_on_the_order_of_their_sum(spark):
    rows = [("test", "a", str(i), x, "50", "2.0") for i, x in enumerate(["0.012522499999999995", "0.0125225", "0.012522500000000002", "-8.874999999999983E-4", "0.0125224"])]
    table = spark.createDataFrame(rows, "split string, factor string, decile string, mean_return string, days string, avg_count string")
    got = {r["key"]: r["number"] for r in run_queries.melted(table, "raw_factor_decile_returns").where("field = 'mean_return'").collect()}
    assert got == {"test|a|0": 0.012523, "test|a|1": 0.012523, "test|a|2": 0.012523, "test|a|3": -0.000888, "test|a|4": 0.012522}
