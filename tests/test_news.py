"""Signal dates, chunks, vectors, models, sequences and sources."""

import datetime as dt
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import history as H
from larkspur.operators import models as L
from larkspur.operators import news as N
from larkspur.operators import sequences as S
from larkspur.operators import vectors as E
from larkspur.plans import text_queries
from larkspur.sources import blocks, filings, manifests, tables

DAY = dt.date(2024, 1, 2)


@pytest.mark.parametrize(
    "published,want",
    [
        ("2024-01-02 10:00:00", "2024-01-02"), ("2024-01-02 16:00:00", "2024-01-03"), ("2024-01-05 18:00:00", "2024-01-08"), ("2024-01-06 09:00:00", "2024-01-08"), ("2024-01-02T15:00:00Z", "2024-01-02"),
        ("2024-01-02", "2024-01-03"), ("2024-01-02T00:00:00Z", "2024-01-03"), ("2024-01-03T05:00:00Z", "2024-01-04"), ("2024-07-03T20:00:00Z", None), ("2023-12-20 10:00:00", "2024-01-02"),
    ],
)
def test_signal_date_rules(spark, published, want):
    days = N.business_days(spark, "2024-01-02", "2024-01-10")
    out = N.signal_dates(spark.createDataFrame([(published,)], "publish_time string"), days, past_end="keep").first()
    assert str(out["date"]) == str(want)


def test_news_past_the_calendar_goes_or_fails(spark):
    days = N.business_days(spark, "2024-01-02", "2024-01-03")
    late = spark.createDataFrame([("2024-01-03 17:00:00",)], "publish_time string")
    assert N.signal_dates(late, days).count() == 0
    with pytest.raises(Exception, match="past the end"):
        N.signal_dates(late, days, past_end="fail").collect()
    with pytest.raises(Exception, match="cannot be read"):
        N.signal_dates(spark.createDataFrame([(None,)], "publish_time string"), days).collect()


def test_long_text_makes_three_chunks(spark):
    text = " ".join(f"w{i}" for i in range(600))
    out = spark.createDataFrame([(text,), ("one two",), ("",)], "t string").select(T.chunks(T.tokens(F.col("t"))).alias("c")).collect()
    assert [len(c.split()) for c in out[0]["c"]] == [256, 256, 88] and out[1]["c"] == ["one two"] and out[2]["c"] == []
    overlap = spark.createDataFrame([(text,)], "t string").select(T.chunks(T.tokens(F.col("t")), 256, 16).alias("c")).first()["c"]
    assert len(overlap) == 3 and overlap[1].startswith("w240 ") and overlap[2].endswith("w599")
    with pytest.raises(ValueError):
        T.chunks(F.array(), 10, 10)


def test_chunk_cap_and_ids(spark):
    rows = [(f"n{i:02d}", "abc", "t", " ".join(f"x{j}" for j in range(20)), f"2024-01-02 09:{i:02d}:00") for i in range(10)]
    news = spark.createDataFrame(rows, "news_id string, ticker string, title string, text string, publish_time string")
    days = N.business_days(spark, "2024-01-02", "2024-01-05")
    out = N.chunk_news(news, days, 8, 5).collect()
    assert len(out) == 5 and max(r["token_count"] for r in out) <= 8 and {r["ticker"] for r in out} == {"ABC"}
    assert [r["chunk_id"] for r in sorted(out, key=lambda r: r["chunk_id"])] == [r["chunk_id"] for r in sorted(N.chunk_news(news.repartition(3), days, 8, 5).collect(), key=lambda r: r["chunk_id"])]


def test_vendor_columns_and_missing_ids(spark):
    raw = spark.createDataFrame([("brk.b", "Reuters - text &amp; more", "2024-01-02 09:00:00"), (" a b", None, "2024-01-02 10:00:00")], "Stock_symbol string, Article string, Date string")
    out = N.normalized(raw, "publish_time").orderBy("news_id").collect()
    assert [(r["news_id"], r["ticker"], r["text"], r["title"]) for r in out] == [("news_0", "BRK-B", "text & more", ""), ("news_1", "AB", "", "")]
    with pytest.raises(KeyError):
        N.normalized(raw.drop("Article"), "publish_time")


def test_pooling_and_zero_fill(spark):
    v = spark.createDataFrame([(DAY, "A", [1.0, 3.0]), (DAY, "A", [3.0, 5.0]), (DAY, "B", [2.0, 2.0])], "date date, ticker string, embedding array<double>")
    out = {r["ticker"]: (r["vector"], r["embedded_chunk_count"]) for r in E.numbered_mean(v, ["date", "ticker"], "embedding").collect()}
    assert out == {"A": ([2.0, 4.0], 2), "B": ([2.0, 2.0], 1)}
    panel = spark.createDataFrame([(DAY, "A"), (DAY, "C")], "date date, ticker string")
    filled = {r["ticker"]: (r["vector"], r["has_vector"]) for r in E.into_panel(panel, E.numbered_mean(v, ["date", "ticker"], "embedding"), "vector", 2).collect()}
    assert filled == {"A": ([2.0, 4.0], True), "C": ([0.0, 0.0], False)}
    with pytest.raises(Exception, match="different length"):
        E.numbered_mean(v.unionByName(v.withColumn("embedding", F.array(F.lit(1.0)))), ["ticker"], "embedding").collect()


def test_projection_is_centred_and_padded(spark):
    x = np.random.default_rng(0).normal(size=(50, 4)) @ np.diag([3, 2, 1, 0.1]) + 5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    mean, matrix = E.projection(df, "v", 4, 2)
    assert np.allclose(mean, x.mean(axis=0))
    u = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(u.T @ matrix), np.eye(2), atol=1e-8)
    out = np.array([r["p"] for r in E.project(df, "v", mean, matrix, 3, "p").orderBy("i").collect()])
    assert out.shape == (50, 3) and np.allclose(out[:, 2], 0) and np.allclose(out[:, :2].mean(axis=0), 0)


def test_ridges_equal_their_closed_forms(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(80, 3)) * [1, 5, 0.2] + 1, r.normal(size=80)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    xc, yc = x - x.mean(axis=0), y - y.mean()
    assert np.allclose(L.centred_ridge(df, ["a", "b", "c"], "y", 2.0).weights, np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc), atol=1e-8)
    z = np.column_stack([np.ones(80), x])
    w = np.linalg.pinv(z.T @ z + 1e-3 * np.diag([0, 1, 1, 1])) @ z.T @ y
    model = L.bias_ridge(df, ["a", "b", "c"], "y")
    assert np.allclose([model.intercept, *model.weights], w, atol=1e-8)
    s = xc / x.std(axis=0)
    scaled = L.scaled_ridge(df, ["a", "b", "c"], "y", 1.0)
    assert np.allclose(np.array(scaled.weights) * x.std(axis=0), np.linalg.solve(s.T @ s + np.eye(3), s.T @ yc), atol=1e-8)
    got = [row["p"] for row in L.predict(df, scaled, "p").collect()]
    assert np.allclose(got, s @ (np.array(scaled.weights) * x.std(axis=0)) + y.mean(), atol=1e-8)
    with pytest.raises(ValueError):
        L.centred_ridge(df.where("a > 99"), ["a"], "y")


def test_gate_leans_to_the_better_branch_and_factor_formula(spark):
    rows = [(DAY, "a", 0.0, 1.0, 1.0, 0.5), (DAY, "B", 0.0, 1.0, 0.0, 0.25), (DAY, "C", 0.0, 2.0, 1e200, 0.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, factor_only_pred double, fusion_pred double, target double, gate_news_prob double")
    t = [r[0] for r in df.select(L.gate_target("factor_only_pred", "fusion_pred", "target")).collect()]
    assert abs(t[0] - 1 / (1 + math.exp(-1))) < 1e-12 and abs(t[1] - 1 / (1 + math.exp(1))) < 1e-12
    labels = spark.createDataFrame([(DAY, "A", 0.1)], "date date, ticker string, future_20d_market_adjusted_return double")
    cover = spark.createDataFrame([(DAY, "A", 3, 4)], "date date, ticker string, news_count int, chunk_count int")
    out = {r["ticker"]: r for r in L.text_alpha(df, cover, labels=labels).collect()}
    assert out["A"]["text_alpha_raw"] == 0.5 and out["A"]["news_count"] == 3 and out["B"]["news_count"] == 0 and out["A"]["future_20d_market_adjusted_return"] == 0.1
    with pytest.raises(KeyError):
        L.text_alpha(df, labels=labels, label="nothing")


def test_samples_need_full_history_and_convolutions_are_causal(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(i), "A", float(i), [float(i)] * 2) for i in range(12)], "date date, ticker string, x double, v array<double>")
    out = S.samples(df, ["x"], "v", 3).orderBy("date").collect()
    assert len(out) == 10 and out[0]["factor_seq"] == [[0.0], [1.0], [2.0]] and out[0]["news_seq"][2] == [2.0, 2.0]
    y = df.groupBy("ticker").agg(F.array_sort(F.collect_list("x")).alias("s")).select(S.causal_convolution("s", [1.0, 2.0, 4.0], 2).alias("y")).first()["y"]
    assert y[0] == 0.0 and y[5] == 1 * 1 + 2 * 3 + 4 * 5
    w, p = S.attention_pool(F.col("m"), [1.0, 0.0])
    row = spark.createDataFrame([([[0.0, 1.0], [math.log(3.0), 5.0]],)], "m array<array<double>>").select(w.alias("w"), p.alias("p")).first()
    assert np.allclose(row["w"], [0.25, 0.75]) and np.allclose(row["p"], [0.75 * math.log(3.0), 4.0])
    rows, mask = S.padded(F.col("m"), 3, 2)
    padded = spark.createDataFrame([([[1.0, 1.0]],)], "m array<array<double>>").select(rows.alias("r"), mask.alias("k")).first()
    assert padded["r"] == [[1.0, 1.0], [0.0, 0.0], [0.0, 0.0]] and padded["k"] == [True, False, False]
    batches = S.date_batches(df, 4, 1).groupBy("date").agg(F.count_distinct("batch").alias("n")).collect()
    assert all(r["n"] == 1 for r in batches)


def test_manifests_vectors_and_packing(spark, tmp_path):
    for k, t in enumerate(("a", "b")):
        (tmp_path / t / "x").mkdir(parents=True)
        lines = []
        for i in range(3):
            np.save(tmp_path / t / "x" / f"{i}.npy", np.full((1, 2), k * 10 + i, dtype=np.float32))
            path = str(tmp_path / t / "x" / f"{i}.npy") if i == 0 else f"x/{i}.npy" if i == 1 else f"elsewhere/{i}.npy"
            lines.append(json.dumps({"chunk_id": f"{t}{i}", "ticker": t, "date": "2024-01-02", "embedding_path": path, "publish_time": f"2024-01-02 0{3 - i}:00", "source_news_id": "n", "chunk_index": i}))
        (tmp_path / t / "manifest.jsonl").write_text("\n".join(lines) + "\n\n")
        np.save(tmp_path / t / "2.npy", np.full(2, k * 10 + 2, dtype=np.float32))
    out = manifests.stored_vectors(spark, str(tmp_path)).collect()
    assert {r["chunk_id"]: r["embedding"] for r in out} == {f"{t}{i}": [k * 10.0 + i] * 2 for k, t in enumerate("ab") for i in range(3)}
    packed = {r["ticker"]: r for r in blocks.direct(manifests.stored_vectors(spark, str(tmp_path)), 2).collect()}
    assert packed["A"]["matrix"] == [[2.0, 2.0], [1.0, 1.0]] and packed["B"]["matrix"][0] == [12.0, 12.0]  # earliest publication first
    assert [r["line"] for r in manifests.numbered_lines(spark, str(tmp_path)).orderBy("path", "line").collect()] == [1, 2, 3, 1, 2, 3]
    (tmp_path / "a" / "manifest.jsonl").write_text('{"chunk_id": "x"}\n')
    with pytest.raises(Exception, match="manifest line"):
        manifests.read_manifests(spark, str(tmp_path)).collect()


def test_tables_in_files(spark, tmp_path):
    df = spark.createDataFrame([(DAY, " a", 1.5)], "date date, ticker string, x double")
    tables.write_table(df, f"{tmp_path}/t.parquet")
    tables.write_table(df, f"{tmp_path}/t.csv")
    assert tables.read_panel(spark, f"{tmp_path}/t.parquet").first()["ticker"] == "A"
    assert tables.read_table(spark, f"{tmp_path}/t.csv").first()["x"] == "1.5"
    assert tables.read_optional(spark, f"{tmp_path}/none.parquet") is None and tables.read_optional(spark, None) is None
    with pytest.raises(FileNotFoundError):
        tables.read_required(spark, f"{tmp_path}/none.parquet")
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.txt")
    assert tables.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    tables.write_json(spark, {"a": 1}, f"{tmp_path}/m.json")
    assert json.loads(spark.read.text(f"{tmp_path}/m.json").first()[0]) == {"a": 1}
    assert tables.empty_prices(spark).count() == 0 and tables.raw_files(spark, str(tmp_path), "*.parquet").count() >= 1


def test_company_facts_drop_what_is_not_filed(spark):
    payload = json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2020-12-31", "val": 5, "filed": "2021-02-01"}, {"end": "x", "val": 6, "filed": "2021-02-01"}, {"val": 7}, {"filed": "2021-03-01"}]}}}}})
    out = filings.company_facts(spark.createDataFrame([("t", payload)], "ticker string, payload string"))
    assert sorted((r["value"], str(r["end_date"])) for r in out.collect()) == [(5.0, "2020-12-31"), (6.0, "None")]
    assert filings.wide_facts(out, ["Assets", "None"]).first()["Assets"] == 5.0


def test_stream_counts_news_once(spark, tmp_path):
    from larkspur.streaming.coverage import news_counts

    rows = [("n1", "a", "2024-01-02 10:00:00"), ("n1", "a", "2024-01-02 10:00:00"), ("n2", "a", "2024-01-02 17:00:00"), ("n3", "b.c", "2024-01-02 11:00:00"), ("n9", "a", "2024-01-09 11:00:00")]
    spark.createDataFrame(rows, "news_id string, ticker string, publish_time string").withColumn("event_time", F.to_timestamp("publish_time")).coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    lookup = N.day_map(N.business_days(spark, "2024-01-02", "2024-01-10"))
    stream = news_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lookup)
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    out = {(r["ticker"], str(r["day"])): r["news_count"] for r in spark.table("counts").collect()}
    assert out == {("A", "2024-01-02"): 1, ("A", "2024-01-03"): 1, ("B-C", "2024-01-02"): 1}


def test_packed_matrix_lengths_and_offsets(spark):
    rows = [(t, DAY + dt.timedelta(d), i, [float(i)]) for t, d, n in [("B", 0, 2), ("A", 1, 1), ("A", 0, 5), (None, 0, 2)] for i in range(n)]
    v = spark.createDataFrame(rows, "ticker string, date date, vec_id int, embedding array<double>")
    out = H.packed(v, ["vec_id"], 3).collect()
    want = [("A", DAY, 3, 0), ("A", DAY + dt.timedelta(1), 1, 3), ("B", DAY, 2, 4), (None, DAY, 2, 6)]
    assert sorted(((r["ticker"], r["date"], r["length"], r["offset"]) for r in out), key=lambda r: r[3]) == want
    assert all(len(r["matrix"]) == r["length"] for r in out)
    assert text_queries.packed_matrix(spark, "/root/testdata/sf0.001").columns == ["date", "ticker", "length", "offset"]


def test_no_stock_day_of_the_chunk_queries_is_capped(spark):
    rows = [(f"n{i:02d}", "abc", " ".join(f"x{i}_{j}" for j in range(120)), "2024-01-02 09:00:00") for i in range(40)]
    news = spark.createDataFrame(rows, "news_id string, ticker string, text string, publish_time string")
    days = N.business_days(spark, "2024-01-02", "2024-01-05")
    assert N.chunk_news(news, days, 64, None, 8).count() == 80 and N.chunk_news(news, days, 64, 64, 8).count() == 64
    assert "QUALIFY" not in text_queries.CHUNKS and "<= 64 THEN 1" in text_queries.CHUNKS and "/ 56)" in text_queries.CHUNKS


def long_day(spark, root):
    """Tables with 40 texts of 200 words, each of 4 chunks, on one stock-day; one more day without news."""
    spark.createDataFrame([(i, " ".join(f"x{i}_{j}" for j in range(200)), "abc") for i in range(40)], "doc_id long, text string, source string").write.parquet(f"{root}/documents.parquet")
    events = [(5 * i, dt.datetime(2024, 1, 2, 9)) for i in range(40)] + [(1001, dt.datetime(2024, 1, 3, 9))]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz").write.parquet(f"{root}/events.parquet")
    return str(root)


def test_coverage_counts_all_chunks_of_a_long_day(spark, tmp_path):
    out = text_queries.coverage_counts(spark, long_day(spark, tmp_path)).collect()
    assert [(r["date"], r["ticker"], r["news_count"], r["chunk_count"]) for r in out] == [(DAY, "ABC", 40, 160)]


EARLIER = [(64, 8, 20), (64, 8, 64), (256, 0, 64)]  # words, overlap and cap of the SQL that the chunk queries had in turn


def by_sql(rule, rest, root="/root/testdata/sf0.01"):
    """Rows of DuckDB over the chunks of a rule."""
    c = duckdb.connect()
    for t in ("documents", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return c.execute(f"{text_queries.chunks_sql(*rule)} {rest}").fetchall()


COUNTS = "SELECT date, ticker, count(DISTINCT source_news_id), count(DISTINCT chunk_id) FROM chunks GROUP BY ALL"


def no_count_is_below_an_earlier_sql(rows):
    now = {(r["date"], r["ticker"]): (r["news_count"], r["chunk_count"]) for r in rows}
    for rule in EARLIER:
        old = by_sql(rule, COUNTS)
        assert old and all(now[d, t][0] >= n and now[d, t][1] >= c for d, t, n, c in old)
    assert sum(n for n, _ in now.values()) == 1000


def test_coverage_counts_are_not_below_an_earlier_sql(spark):
    no_count_is_below_an_earlier_sql(text_queries.coverage_counts(spark, "/root/testdata/sf0.01").collect())


def test_stock_day_panel_counts_all_chunks_of_a_long_day(spark, tmp_path):
    out = text_queries.stock_day_panel(spark, long_day(spark, tmp_path)).collect()
    assert sorted((r["date"], r["ticker"], r["news_count"], r["chunk_count"], r["has_news"]) for r in out) == [(DAY, "ABC", 40, 160, 1), (DAY + dt.timedelta(1), "ABC", 0, 0, 0)]


def test_stock_day_panel_is_not_below_an_earlier_sql(spark):
    no_count_is_below_an_earlier_sql(text_queries.stock_day_panel(spark, "/root/testdata/sf0.01").collect())


def test_all_later_chunks_of_a_long_day_are_not_encoded(spark, tmp_path):
    assert text_queries.chunks_not_encoded(spark, long_day(spark, tmp_path)).distinct().count() == 80


def test_chunks_not_encoded_hold_those_of_every_earlier_sql(spark):
    now = {r["chunk_id"] for r in text_queries.chunks_not_encoded(spark, "/root/testdata/sf0.01").collect()}
    for rule in EARLIER:
        old = {r[0] for r in by_sql(rule, "SELECT chunk_id FROM chunks WHERE chunk_index >= 2")}
        assert old and old <= now


def test_lines_of_several_manifests_are_numbered_through(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"part-{k}").write_text("".join(json.dumps({"chunk_id": f"{k}{i}", "ticker": "a", "date": "2024-01-02", "embedding_path": "none.npy"}) + "\n" for i in range(3)))
    out = manifests.with_numbers(manifests.stored_vectors(spark, str(tmp_path), name="part-*"), str(tmp_path), "part-*")
    assert sorted((r["number"], r["chunk_id"]) for r in out.collect()) == [(1, "00"), (2, "01"), (3, "02"), (4, "10"), (5, "11"), (6, "12")]


def test_page_texts_go_to_python_in_small_batches(spark):
    out = text_queries.page_text(spark, "/root/testdata/sf0.001")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    assert int(out.sparkSession.conf.get(key)) == tables.BATCH_BYTES and spark.conf.get(key) != str(tables.BATCH_BYTES) and out.count() > 0
