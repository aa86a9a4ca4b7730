"""Queries on news, chunks, vectors, models, sequences and sources, with their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import history as H
from larkspur.operators import models as L
from larkspur.operators import news as N
from larkspur.operators import panel as P
from larkspur.operators import sequences as S
from larkspur.operators import vectors as E
from larkspur.plans.adapters import load, oracle
from larkspur.plans.factor_queries import W, r, rounded
from larkspur.sources import filings, tables

QUERIES, ORACLES = {}, {}
FIXED: dict = {}  # on literals, not tables: held against their SQL by tests alone


def fixed(sql: str):
    def keep(f):
        FIXED[f.__name__] = (f, sql)
        return f
    return keep



def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return keep


# --- calendars and signal dates

CALENDAR = f"WITH {oracle('calendar')}"


@query(f"{CALENDAR}, span AS (SELECT unnest(generate_series((SELECT min(date) FROM calendar) - 7, (SELECT max(date) FROM calendar), INTERVAL 1 DAY))::DATE AS day) SELECT day, (SELECT min(date) FROM calendar WHERE date >= day) AS on_or_after, (SELECT min(date) FROM calendar WHERE date > day) AS after FROM span")
def trading_day_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.day_map(load(spark, sf_dir, "calendar"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_id FROM events), g AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS date FROM e)
SELECT date FROM g WHERE dayofweek(date) NOT IN (0, 6) AND date NOT IN (SELECT day FROM e WHERE event_id % 500 = 0)""")
def business_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last day with events; the days of some events are holidays."""
    days = load(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_id")
    ends = days.agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b")).first()
    return N.business_days(spark, ends["a"], ends["b"], days.where("event_id % 500 = 0"))


SIGNAL = """(SELECT min(date) FROM calendar c WHERE CASE WHEN CAST(published AS TIME) >= TIME '16:00:00' OR CAST(published AS TIME) = TIME '00:00:00' THEN c.date > CAST(published AS DATE) ELSE c.date >= CAST(published AS DATE) END)"""
DATED = f"{CALENDAR}, {oracle('news')}, dated AS (SELECT *, {SIGNAL} AS date FROM news)"


@query(f"{DATED} SELECT news_id, date FROM dated WHERE date IS NOT NULL")
def signal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.signal_dates(load(spark, sf_dir, "news"), load(spark, sf_dir, "calendar")).select("news_id", "date")


LITERALS = [
    ("2024-01-02 15:59:59", "2024-01-02"), ("2024-01-02 16:00:00", "2024-01-03"), ("2024-01-02", "2024-01-03"), ("2024-01-02 00:00:00", "2024-01-03"), ("2024-01-02T00:00:00Z", "2024-01-03"), ("2024-01-03T05:00:00Z", "2024-01-04"),
    ("2024-01-02T20:59:59Z", "2024-01-02"), ("2024-01-02T21:00:00Z", "2024-01-03"), ("2024-01-06 10:00:00", "2024-01-08"), ("2024-01-05 17:30:00", "2024-01-08"), ("2024-01-02T09:30:00-05:00", "2024-01-02"), ("2024-01-03T02:00:00+01:00", "2024-01-03"),
]


@fixed("SELECT * FROM (VALUES " + ", ".join(f"('{a}', DATE '{b}')" for a, b in LITERALS) + ") AS t(publish_time, date)")
def signal_date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on literal times: the close is too late, midnight says only the day, offsets lead to New York's clock."""
    days = N.business_days(spark, "2024-01-02", "2024-01-12")
    return N.signal_dates(spark.createDataFrame([(a,) for a, _ in LITERALS], "publish_time string"), days).select("publish_time", "date")


# --- texts and chunks

CLEAN = r"trim(regexp_replace(text, '[\s\x1c-\x1f\x{85}\x{a0}]+', ' ', 'g'))"
TEXTS = [("Reuters - Profit  rose", "Profit rose"), ("  REUTERS: up", "up"), ("ReutersX gains", "X gains"), ("London (Reuters) - Shares &amp; bonds", "London Shares & bonds"), ("caf&eacute;&nbsp;&#39;x&#39;", "café 'x'"), ("a\u0085b\u001cc d", "a b c d"), ("", ""), (None, "")]


@fixed("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{b.replace(chr(39), chr(39) * 2)}')" for i, (_, b) in enumerate(TEXTS)) + ") AS t(id, cleaned)")
def cleaned_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, a) for i, (a, _) in enumerate(TEXTS)], "id int, text string").select("id", T.clean_text("text").alias("cleaned"))


@query(f"WITH {oracle('news')} SELECT news_id, sha1({CLEAN}) AS digest, CASE WHEN {CLEAN} = '' THEN 0 ELSE len(string_split({CLEAN}, ' ')) END::INT AS words FROM news")
def cleaned_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = T.clean_text("text")
    return tables.small_batches(load(spark, sf_dir, "news")).select("news_id", F.sha1(cleaned.cast("binary")).alias("digest"), F.size(T.tokens(cleaned)).alias("words"))


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of whole pages decoded, which SQL has no function for."""
    return tables.small_batches(load(spark, sf_dir, "pages")).select("page_id", T.clean_text("html").alias("text"))




def chunks_sql(most: int = 64, overlap: int = 8, per_day: int | None = None) -> str:
    step = most - overlap
    capped = "" if per_day is None else f" QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY publish_time, source_news_id, chunk_index) <= {per_day}"
    return f"""{DATED}, words AS (SELECT news_id, date, upper(regexp_replace(ticker, '\\s+', '', 'g')) AS ticker, publish_time, string_split({CLEAN}, ' ') AS w FROM dated WHERE date IS NOT NULL AND {CLEAN} <> ''),
parts AS (SELECT *, unnest(range(CASE WHEN len(w) <= {most} THEN 1 ELSE ceil((len(w) - {most}) / {step})::BIGINT + 1 END)) AS i FROM words),
texts AS (SELECT date, ticker, news_id AS source_news_id, publish_time, i AS chunk_index, array_to_string(list_slice(w, i * {step} + 1, i * {step} + {most}), ' ') AS chunk_text FROM parts),
chunks AS (SELECT *, substr(sha1(concat_ws('|', source_news_id, ticker, CAST(date AS STRING), CAST(chunk_index AS STRING))), 1, 16) AS chunk_id FROM texts{capped})"""


CHUNKS = chunks_sql()


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all news: no stock-day is capped."""
    return N.chunk_news(tables.small_batches(load(spark, sf_dir, "news")), load(spark, sf_dir, "calendar"), 64, None, 8)


@query(f"{CHUNKS} SELECT chunk_id, date, ticker, source_news_id, chunk_index::INT AS chunk_index, sha1(chunk_text) AS digest, len(string_split(chunk_text, ' '))::INT AS token_count FROM chunks")
def news_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir).select("chunk_id", "date", "ticker", "source_news_id", "chunk_index", F.sha1(F.col("chunk_text").cast("binary")).alias("digest"), "token_count")


@query(f"{chunks_sql(64, 8, 1_000_000)} SELECT chunk_id, date, ticker, chunk_index::INT AS chunk_index, sha1(chunk_text) AS digest FROM chunks")
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shorter chunks that overlap, without a cap on a day."""
    out = N.chunk_news(tables.small_batches(load(spark, sf_dir, "news")), load(spark, sf_dir, "calendar"), 64, 1_000_000, 8)
    return out.select("chunk_id", "date", "ticker", "chunk_index", F.sha1(F.col("chunk_text").cast("binary")).alias("digest"))


@query(f"{CHUNKS} SELECT date, ticker, count(DISTINCT source_news_id) AS news_count, count(DISTINCT chunk_id) AS chunk_count FROM chunks GROUP BY ALL")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coverage_counts(chunked(spark, sf_dir))


@query(f"""{CHUNKS}, cov AS (SELECT date, ticker, count(DISTINCT source_news_id) AS n, count(DISTINCT chunk_id) AS c FROM chunks GROUP BY ALL), g AS (SELECT c.date, t.ticker FROM calendar c CROSS JOIN (SELECT DISTINCT upper(ticker) AS ticker FROM news) t)
SELECT g.date, g.ticker, length(g.ticker) AS factor, CASE WHEN day(g.date) % 2 = 0 THEN day(g.date) END AS label, coalesce(n, 0) AS news_count, coalesce(c, 0) AS chunk_count, (coalesce(n, 0) > 0)::INT AS has_news FROM g LEFT JOIN cov ON g.date = cov.date AND g.ticker = cov.ticker""")
def stock_day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, names = load(spark, sf_dir, "calendar"), load(spark, sf_dir, "news").select(F.upper("ticker").alias("ticker")).distinct()
    # A grid of few days and few tickers: the days are one row, an array.
    calendar = days.agg(F.array_sort(F.collect_list("date")).alias("_days")).withColumn("_k", F.lit(1))
    grid = names.withColumn("_k", F.lit(1)).join(calendar, "_k").select("ticker", F.explode("_days").alias("date"))
    labels = grid.where(F.dayofmonth("date") % 2 == 0).withColumn("label", F.dayofmonth("date").cast("long"))
    return P.stock_day_panel(grid.withColumn("factor", F.length("ticker").cast("long")), labels, chunked(spark, sf_dir))


@query(f"{CHUNKS} SELECT chunk_id FROM chunks WHERE chunk_index >= 2")
def chunks_not_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunked(spark, sf_dir)
    return N.not_yet(chunks, chunks.where("chunk_index < 2")).select("chunk_id")


@query(f"""{CHUNKS}, w AS (SELECT date, ticker, chunk_id, length(chunk_text) % 7 AS attention_weight FROM chunks) SELECT date, ticker, chunk_id, attention_weight, row_number() OVER (PARTITION BY date, ticker ORDER BY attention_weight DESC, chunk_id)::INT AS rank FROM w QUALIFY rank <= 3""")
def top_attention_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunked(spark, sf_dir)
    weights = chunks.select("date", "ticker", "chunk_id", (F.length("chunk_text") % 7).cast("long").alias("attention_weight"))
    return N.top_chunks(chunks, weights, 3).select("date", "ticker", "chunk_id", "attention_weight", "rank")


@fixed("SELECT * FROM (VALUES ('aapl', 'APL'), ('apple inc', 'APL'), ('apl', 'APL'), ('brk.b', 'BRK-B'), ('berkshire', 'BRK-B')) AS t(alias, ticker)")
def ticker_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "AAPL", "Apple Inc"), (2, "Brk.b", "Berkshire"), (3, "APL", "Apple Inc "), (4, "APL", None), (5, "APL", "aapl")], "n int, ticker string, company_name string")
    return N.alias_map(rows, "n")


@query(f"WITH {oracle('news')} SELECT concat('news_', CAST(row_number() OVER (ORDER BY published, news_id) - 1 AS STRING)) AS news_id, upper(ticker) AS ticker, sha1({CLEAN}) AS digest FROM news")
def vendor_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.small_batches(load(spark, sf_dir, "news")).select(F.col("ticker").alias("Stock_symbol"), F.col("text").alias("Article"), F.col("published").alias("Date"), F.col("news_id").alias("key"))
    out = N.normalized(raw, F.struct("publish_time", "key"), bucket=F.to_date("publish_time"))
    return out.select("news_id", "ticker", F.sha1(F.col("text").cast("binary")).alias("digest"))


# --- vectors

VECTORS = f"WITH {oracle('vectors')}"
MEANS = ", ".join(r(f"avg(embedding[{i + 1}]::DOUBLE)", f"mean_emb_{i}") for i in range(64))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "vectors").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))


@query(f"{VECTORS} SELECT DATE '2024-01-01' + day AS date, ticker, count(*) AS embedded_chunk_count, {MEANS} FROM vectors GROUP BY 1, 2")
def mean_pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.numbered_mean(vectors(spark, sf_dir), P.KEYS, "embedding", width=64)
    return rounded(out.select(*P.KEYS, "embedded_chunk_count", *E.to_columns("vector", 64, "mean_emb_")))


@query(f"{VECTORS} SELECT DATE '2024-01-01' + day AS date, ticker, {MEANS} FROM vectors GROUP BY 1, 2")
def wide_pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"emb_{i}" for i in range(64)]
    wide = vectors(spark, sf_dir).select(*P.KEYS, *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])
    return rounded(E.wide_mean(wide, columns))


@query(f"{VECTORS}, m AS (SELECT chunk_id, embedding FROM vectors UNION ALL SELECT chunk_id, embedding FROM vectors WHERE vec_id % 7 = 0) SELECT count(*) AS rows, count(DISTINCT chunk_id) AS distinct_ids, count(*) - count(DISTINCT chunk_id) AS repeated_rows, 0::BIGINT AS missing_vectors, min(len(embedding))::INT AS least_dim, max(len(embedding))::INT AS greatest_dim FROM m")
def manifest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return E.manifest_quality(v.unionByName(v.where("vec_id % 7 = 0")))


@query(f"{VECTORS} SELECT len(embedding)::INT AS dim, count(*) AS rows FROM vectors GROUP BY 1")
def dimension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dimension_histogram(vectors(spark, sf_dir))


@query(f"{VECTORS} SELECT chunk_id, max(day) AS day FROM (SELECT chunk_id, day FROM vectors) AS v GROUP BY chunk_id")
def first_of_each_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("chunk_id", "day").withColumns({"path": F.lit("a"), "line": F.col("day")})
    again = v.withColumns({"path": F.lit("b"), "day": F.lit(99)})
    return E.first_of_each(again.unionByName(v)).select("chunk_id", "day")


@query(f"""{VECTORS}, p AS (SELECT day, ticker, count(*) AS n, avg(embedding[1]::DOUBLE) AS x FROM vectors GROUP BY 1, 2), g AS (SELECT DISTINCT unnest([day, day + 10]) AS day, ticker FROM vectors)
SELECT DATE '2024-01-01' + g.day AS date, g.ticker, {r('coalesce(x, 0)', 'news_repr_0')}, x IS NOT NULL AS has_vector FROM g LEFT JOIN p ON g.day = p.day AND g.ticker = p.ticker""")
def vectors_into_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    pooled = E.numbered_mean(v, P.KEYS, "embedding", width=64)
    # The panel has days without vectors too.
    panel = v.select(F.explode(F.array("date", F.date_add("date", 10))).alias("date"), "ticker").distinct()
    out = E.into_panel(panel, pooled, "vector", 64)
    return rounded(out.select(*P.KEYS, F.get("vector", F.lit(0)).alias("news_repr_0"), "has_vector"))


@query(f"""{VECTORS}, p AS (SELECT day, ticker, count(*) AS n FROM vectors GROUP BY 1, 2) SELECT DATE '2024-01-01' + day AS date, ticker, n AS embedded_chunk_count, CASE WHEN ticker = 'T3' THEN 5 ELSE 0 END::BIGINT AS news_count, CASE WHEN ticker = 'T3' THEN 9 ELSE n END AS chunk_count FROM p""")
def coverage_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = E.numbered_mean(vectors(spark, sf_dir), P.KEYS, "embedding", width=64)
    panel = pooled.where("ticker = 'T3'").select(*P.KEYS, F.lit(5).cast("long").alias("news_count"), F.lit(9).cast("long").alias("chunk_count"))
    return E.with_coverage(pooled, panel).select(*P.KEYS, "embedded_chunk_count", "news_count", "chunk_count")


@query(f"""{VECTORS}, k AS (SELECT day, ticker, least(count(*), 64) AS length FROM vectors GROUP BY 1, 2) SELECT DATE '2024-01-01' + day AS date, ticker, length, (sum(length) OVER (ORDER BY ticker, day) - length)::BIGINT AS "offset" FROM k""")
def packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.packed(vectors(spark, sf_dir), ["vec_id"]).select(*P.KEYS, "length", "offset")


@query(f"{VECTORS} SELECT count(CASE WHEN vec_id % 5 = 0 THEN 1 END) AS only_direct, 0::BIGINT AS only_cached, count(CASE WHEN vec_id % 5 <> 0 THEN 1 END) AS both, 0.5::DOUBLE AS largest_difference FROM vectors")
def cache_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("chunk_id", "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    cached = v.where("vec_id % 5 <> 0").withColumn("embedding", F.transform("embedding", lambda x, i: F.when((i == 0) & (F.col("vec_id") % 2 == 0), x + 0.5).otherwise(x)))
    return rounded(E.compare(v, cached, ["chunk_id"]))


@query(f"""{VECTORS}, w AS (SELECT vec_id, [x::DOUBLE * x::DOUBLE FOR x IN embedding] AS w FROM vectors), c AS (SELECT vec_id, [greatest(least(x, 1), 1e-8) FOR x IN w] AS w FROM w) SELECT vec_id, {r('-list_sum([x * ln(x) FOR x IN w])', 'entropy')} FROM c""")
def attention_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return rounded(vectors(spark, sf_dir).select("vec_id", E.attention_entropy(squares).alias("entropy")))


@query()
def principal_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    mean, matrix = E.projection(v, "embedding", 64, 8)
    return E.project(v, "embedding", mean, matrix, 8, "projected").select("vec_id", *E.to_columns("projected", 8, "news_repr_"))


@query()
def gaussian_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    mean, matrix = E.projection(v, "embedding", 64, 8, "gaussian")
    return E.project(v, "embedding", mean, matrix, 16, "projected").select("vec_id", *E.to_columns("projected", 16, "news_repr_"))


# --- models

PREDS = f"WITH {oracle('preds')}"


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "preds")


# Two columns: the normal equations can be written out.
TWO = """g AS (SELECT count(*)::DOUBLE AS n, avg(momentum) AS m1, avg(surge) AS m2, avg(target) AS my, var_pop(momentum) * count(*) + 1 AS a, var_pop(surge) * count(*) + 1 AS d, covar_pop(momentum, surge) * count(*) AS b, covar_pop(momentum, target) * count(*) AS p, covar_pop(surge, target) * count(*) AS q FROM preds WHERE target IS NOT NULL AND split = 'train'),
c AS (SELECT *, (d * p - b * q) / (a * d - b * b) AS w1, (a * q - b * p) / (a * d - b * b) AS w2 FROM g)"""


@query(f"{PREDS}, {TWO} SELECT date, ticker, {r('my - m1 * w1 - m2 * w2 + w1 * coalesce(momentum, 0) + w2 * coalesce(surge, 0)', 'score', 5)} FROM preds, c")
def ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preds(spark, sf_dir)
    model = L.centred_ridge(p.where("split = 'train'"), ["momentum", "surge"], "target")
    return rounded(L.predict(p, model, "score").select("date", "ticker", "score"), 5)


def _weights(spark: SparkSession, model: L.Linear) -> DataFrame:
    return spark.createDataFrame([("intercept", model.intercept), *zip(model.columns, model.weights, strict=True)], "name string, weight double")


@query(f"{PREDS}, {TWO} SELECT name, {r('weight', 'weight', 5)} FROM (SELECT unnest(['intercept', 'momentum', 'surge']) AS name, unnest([my - m1 * w1 - m2 * w2, w1, w2]) AS weight FROM c) AS t")
def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_weights(spark, L.centred_ridge(preds(spark, sf_dir).where("split = 'train'"), ["momentum", "surge"], "target")), 5)


def solved_sql(name: str, k: int) -> str:
    """The solution of `name`_m's k equations (k lists of k coefficients and a right side) as `name`.w, by elimination."""
    row = f"[CASE WHEN i = step THEN m[i][j] / m[step][step] ELSE m[i][j] - m[i][step] / m[step][step] * m[step][j] END FOR j IN range(1, {k + 2})]"
    return f"""{name}_e(step, m) AS (SELECT 1, m FROM {name}_m UNION ALL SELECT step + 1, [{row} FOR i IN range(1, {k + 1})] FROM {name}_e WHERE step <= {k}),
{name} AS (SELECT [m[i][{k + 1}] FOR i IN range(1, {k + 1})] AS w FROM {name}_e WHERE step = {k + 1})"""


def normal_sql(name: str, source: str, columns: list[str], label: str, penalty: list[float]) -> str:
    """Normal equations of a ridge over a source's columns: `name`_m and `name`."""
    rows = ", ".join("[" + ", ".join(f"sum(({a}) * ({b}))::DOUBLE{f' + {penalty[i]}' if i == j else ''}" for j, b in enumerate([*columns, label])) + "]" for i, a in enumerate(columns))
    return f"{name}_m AS (SELECT [{rows}] AS m FROM {source}), {solved_sql(name, len(columns))}"


def filled_columns(names: list[str]) -> list[str]:
    return ["1", *[f"coalesce({c}, 0)" for c in names]]


PREDS_R = PREDS.replace("WITH ", "WITH RECURSIVE ", 1)
THREE, FOUR = ["momentum", "surge", "distance"], ["momentum", "surge", "distance", "momentum_20"]


@query(f"""{PREDS_R}, l AS (SELECT * FROM preds WHERE split = 'train' AND target IS NOT NULL), st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) * sqrt(count({c}) / count(*)) AS s_{c}' for c in THREE)}, avg(target) AS my FROM l),
x AS (SELECT {', '.join(f'(coalesce({c}, m_{c}) - m_{c}) / s_{c} AS {c}' for c in THREE)}, target - my AS y FROM l, st), {normal_sql('f', 'x', THREE, 'y', [1.0, 1.0, 1.0])}
SELECT unnest(['intercept', {', '.join(f"'{c}'" for c in THREE)}]) AS name, unnest([round(my - {' - '.join(f'w[{i + 1}] / s_{c} * m_{c}' for i, c in enumerate(THREE))}, 5) + 0.0, {', '.join(f'round(w[{i + 1}] / s_{c}, 5) + 0.0' for i, c in enumerate(THREE))}]) AS weight FROM f, st""")
def scaled_ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_weights(spark, L.scaled_ridge(preds(spark, sf_dir).where("split = 'train'"), THREE, "target")), 5)


@query(f"""{PREDS_R}, l AS (SELECT * FROM preds WHERE split = 'train'), {normal_sql('f', 'l', filled_columns(FOUR), 'coalesce(target, 0)', [0.0, *[1e-3] * 4])}
SELECT date, ticker, {r(' + '.join(f'w[{i + 1}] * {c}' for i, c in enumerate(filled_columns(FOUR))), 'fusion_pred', 5)} FROM preds, f""")
def fusion_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preds(spark, sf_dir)
    model = L.bias_ridge(p.where("split = 'train'"), FOUR, "target")
    return rounded(L.predict(p, model, "fusion_pred").select("date", "ticker", "fusion_pred"), 5)


TARGET = "1 / (1 + exp(greatest(least(power(fusion_pred - target, 2) - power(factor_only_pred - target, 2), 700), -700) / 0.5))"


@query(f"{PREDS} SELECT date, ticker, {r(TARGET, 'gate_target')}, {r('(1 - gate_news_prob) * factor_only_pred + gate_news_prob * fusion_pred', 'mixed_pred', 10)}, {r('0.75 * factor_only_pred + 0.25 * fusion_pred', 'fixed_pred', 10)} FROM preds")
def gate_targets_and_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preds(spark, sf_dir).select(
        "date", "ticker", F.round(L.gate_target("factor_only_pred", "fusion_pred", "target", 0.5), 6).alias("gate_target"),
        F.round(L.mixed("factor_only_pred", "fusion_pred", "gate_news_prob"), 10).alias("mixed_pred"), F.round(L.fixed_mixture("factor_only_pred", "fusion_pred", 0.25), 10).alias("fixed_pred"),
    )
    return rounded(out, 10)


@query(f"""{PREDS_R}, l AS (SELECT *, {TARGET.replace('/ 0.5', '/ 1.0')} AS soft FROM preds WHERE split = 'train' AND target IS NOT NULL), {normal_sql('f', 'l', filled_columns(THREE), 'coalesce(soft, 0)', [0.0, *[1e-3] * 3])}
SELECT date, ticker, {r(f"1 / (1 + exp(-({' + '.join(f'w[{i + 1}] * {c}' for i, c in enumerate(filled_columns(THREE)))})))", 'gate_news_prob')} FROM preds, f WHERE target IS NOT NULL""")
def decoupled_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preds(spark, sf_dir).where("target IS NOT NULL")
    return rounded(p.select("date", "ticker", L.gate(p.where("split = 'train'"), THREE).alias("gate_news_prob")))


@query(f"{PREDS}, m AS (SELECT date, ticker, CASE WHEN has_news = 1 THEN fusion_pred ELSE factor_only_pred END AS f, CASE WHEN has_news = 1 THEN gate_news_prob ELSE 0 END AS g, factor_only_pred AS b FROM preds) SELECT date, ticker, {r('f', 'fusion_pred')}, {r('g', 'gate_news_prob')}, {r('(1 - g) * b + g * f', 'mixed_pred', 10)} FROM m")
def news_masked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preds(spark, sf_dir)
    return rounded(out.select("date", "ticker", *[e.alias(n) for n, e in L.masked("has_news", "factor_only_pred", "fusion_pred", "gate_news_prob").items()]), 10)


@query(f"{PREDS} SELECT date, ticker, {r('(1 - gate_news_prob) * factor_only_pred + gate_news_prob * fusion_pred', 'mixed_pred', 10)} FROM preds WHERE has_news = 1")
def assembled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preds(spark, sf_dir)
    out = L.assemble(p.select(*P.KEYS, "factor_only_pred"), p.select(*P.KEYS, "fusion_pred"), p.where("has_news = 1").select(*P.KEYS, "gate_news_prob"))
    return rounded(out.select(*P.KEYS, "mixed_pred"), 10)


@query(f"""{PREDS}, raw AS (SELECT date, ticker, gate_news_prob * (fusion_pred - factor_only_pred) AS x, target FROM preds), q AS (SELECT *, quantile_cont(x, 0.01) OVER d AS a, quantile_cont(x, 0.99) OVER d AS b FROM raw WINDOW d AS (PARTITION BY date)), k AS (SELECT *, greatest(least(x, b), a) AS c FROM q)
SELECT date, ticker, {r('x', 'text_alpha_raw', 10)}, {r('CASE WHEN max(c) OVER d = min(c) OVER d THEN 0 ELSE (c - avg(c) OVER d) / stddev_pop(c) OVER d END', 'text_alpha_zscore')}, 0 AS news_count, {r('target', 'future_20d_market_adjusted_return')} FROM k WINDOW d AS (PARTITION BY date)""")
def text_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preds(spark, sf_dir)
    out = L.text_alpha(p, labels=p.select(*P.KEYS, F.col("target").alias("future_20d_market_adjusted_return")))
    six = rounded(out.select(*P.KEYS, "text_alpha_zscore", "news_count", "future_20d_market_adjusted_return"))
    return rounded(out.select(*P.KEYS, "text_alpha_raw"), 10).join(six, P.KEYS)


QUANTILES = ", ".join(r(f"quantile_cont(gate_news_prob, {q})", f"q{int(q * 100):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95))


@query(f"{PREDS} SELECT {r('avg(gate_news_prob)', 'mean')}, {r('stddev_pop(gate_news_prob)', 'std')}, {QUANTILES} FROM preds")
def gate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.gate_statistics(preds(spark, sf_dir), "gate_news_prob"))


@query(f"{PREDS} SELECT split, count(*) AS rows, sum(has_news)::BIGINT AS news_rows, count(target) AS labelled_rows, count(CASE WHEN has_news = 1 THEN target END) AS labelled_news_rows FROM preds GROUP BY split")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split_sizes(preds(spark, sf_dir), "target")


GAP = "abs(CASE WHEN s > 1e-8 THEN c / (s + 1e-8) ELSE 0 END - z)"


@query(f"""{PREDS}, x AS (SELECT date, factor_only_pred AS p, gate_news_prob AS k, fusion_pred AS z, stddev_pop(factor_only_pred) OVER d AS s, factor_only_pred - avg(factor_only_pred) OVER d AS c FROM preds WHERE factor_only_pred IS NOT NULL WINDOW d AS (PARTITION BY date)),
y AS (SELECT *, {GAP} AS g, CASE WHEN k IS NOT NULL THEN p END AS pk FROM x),
d AS (SELECT date, CASE WHEN count(k) >= 3 AND stddev_pop(pk) > 1e-8 AND stddev_pop(k) > 1e-8 THEN covar_pop(pk, k) / (stddev_pop(pk) * stddev_pop(k) + 1e-8) END AS c, CASE WHEN count(*) >= 2 THEN power(greatest(0.05 - max(s), 0), 2) END AS s, sum(CASE WHEN g <= 1 THEN 0.5 * g * g ELSE g - 0.5 END) AS h, count(g) AS n FROM y GROUP BY date),
l AS (SELECT 1 - avg(c) AS a, sum(h) / sum(n) AS b, avg(s) AS c FROM d) SELECT {r('a', 'ic_loss')}, {r('b', 'huber_loss')}, {r('c', 'variance_penalty')}, {r('0.7 * a + 0.2 * b + 0.1 * c', 'loss')} FROM l""")
def rank_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.rank_loss(preds(spark, sf_dir), "factor_only_pred", "gate_news_prob", "fusion_pred"))


@fixed("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in L.BASELINES) + ") AS t(name, description)")
def baseline_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.baselines(spark)


# --- sequences

SIGNALS = f"WITH {oracle('signals')}"


@query(f"{SIGNALS} SELECT date, ticker, {', '.join(r(f'coalesce(lag(momentum, {i}) OVER {W}, 0)', f'momentum_lag{i}') for i in range(5))} FROM signals")
def lag_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.lag_block(load(spark, sf_dir, "signals"), ["momentum"], 5))


@query(f"""{SIGNALS}, w AS (SELECT *, count(*) OVER h AS n, min(date) OVER h AS first_date, sum(coalesce(momentum, 0)) OVER h AS total, first_value(coalesce(momentum, 0)) OVER h AS oldest FROM signals WINDOW h AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT date, ticker, first_date, {r('total', 'total', 8)}, {r('oldest', 'oldest')} FROM w WHERE n = 30 AND split = 'test'""")
def thirty_day_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.samples(load(spark, sf_dir, "signals"), ["momentum"], keep=F.col("split") == "test")
    total = F.aggregate("factor_seq", F.lit(0.0), lambda a, f: a + F.get(f, F.lit(0)))
    return out.select("date", "ticker", F.get("date_seq", F.lit(0)).alias("first_date"), (F.round(total, 8) + 0.0).alias("total"), F.get(F.get("factor_seq", F.lit(0)), F.lit(0)).alias("oldest"))


@query(f"{SIGNALS} SELECT ticker, row_number() OVER (ORDER BY ticker)::INT AS ticker_id FROM (SELECT DISTINCT ticker FROM signals) AS t")
def ticker_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ticker_ids(load(spark, sf_dir, "signals"))


@query(f"""{SIGNALS}, x AS (SELECT date, ticker, count(*) OVER h AS n, 0.5 * coalesce(momentum, 0) + 0.25 * coalesce(lag(momentum, 2) OVER {W}, 0) - coalesce(lag(momentum, 4) OVER {W}, 0) AS y FROM signals WINDOW h AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT date, ticker, {r('y', 'last_state', 8)} FROM x WHERE n = 10""")
def causal_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.samples(load(spark, sf_dir, "signals"), ["momentum"], lookback=10)
    series = F.transform("factor_seq", lambda f: F.get(f, F.lit(0)))
    return rounded(out.select("date", "ticker", F.element_at(S.causal_convolution(series, [-1.0, 0.25, 0.5], 2), -1).alias("last_state")), 8)


@query(f"""{VECTORS}, m AS (SELECT ticker, day, [x::DOUBLE FOR x IN embedding] AS v, 0.5 * list_sum([x::DOUBLE FOR x IN embedding]) AS s FROM vectors QUALIFY row_number() OVER (PARTITION BY ticker, day ORDER BY vec_id) <= 64),
w AS (SELECT *, exp(s - max(s) OVER d) / sum(exp(s)) OVER d * exp(max(s) OVER d) AS w FROM m WINDOW d AS (PARTITION BY ticker, day))
SELECT ticker, DATE '2024-01-01' + day AS date, 64 AS padded_rows, count(*)::INT AS own_rows, {r('-sum(greatest(w, 1e-8) * ln(greatest(w, 1e-8)))', 'entropy')}, {', '.join(r(f'sum(w * v[{i + 1}])', f'pooled_{i}') for i in range(4))} FROM w GROUP BY 1, 2""")
def attention_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = H.day_matrices(vectors(spark, sf_dir), ["vec_id"])
    matrix = F.transform("matrix", lambda row: row.cast("array<double>"))
    rows, mask = S.padded(matrix, 64, 64)
    weights, pooled = S.attention_pool(matrix, [0.5] * 64)
    out = days.select("ticker", "date", weights.alias("weights"), pooled.alias("pooled"), F.size(rows).alias("padded_rows"), F.size(F.filter(mask, lambda m: m)).alias("own_rows"))
    return rounded(out.select("ticker", "date", "padded_rows", "own_rows", E.attention_entropy("weights").alias("entropy"), *E.to_columns("pooled", 4, "pooled_")))


# --- sources

PAYLOAD = json.dumps({"cik": 1, "entityName": "x", "facts": {"us-gaap": {"Assets": {"label": "a", "units": {"USD": [
    {"end": "2019-12-31", "val": 10.5, "fy": 2019, "fp": "FY", "form": "10-K", "filed": "2020-02-01", "frame": "CY2019"}, {"end": "bad", "val": 11, "fy": 2020, "fp": "Q1", "form": "10-Q", "filed": "2020-05-01"}, {"end": "2020-06-30", "val": None, "filed": "2020-08-01"}, {"end": "2020-06-30", "val": 3},
]}}}, "dei": {"Shares": {"label": "s", "units": {"shares": [{"end": "2020-01-31", "val": 7, "filed": "2020-02-01", "form": "10-K", "fy": 2019, "fp": "FY"}]}}}}})


@fixed("SELECT * FROM (VALUES ('ABC', 'us-gaap', 'Assets', 'USD', 10.5::DOUBLE, 2019, 'FY', '10-K', DATE '2020-02-01', DATE '2019-12-31', 'CY2019'), ('ABC', 'us-gaap', 'Assets', 'USD', 11.0, 2020, 'Q1', '10-Q', DATE '2020-05-01', NULL, NULL), ('ABC', 'dei', 'Shares', 'shares', 7.0, 2019, 'FY', '10-K', DATE '2020-02-01', DATE '2020-01-31', NULL)) AS t(ticker, taxonomy, concept, unit, value, fy, fp, form, filed_date, end_date, frame)")
def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.company_facts(spark.createDataFrame([(" abc", PAYLOAD)], "ticker string, payload string"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IS NOT NULL")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/events.parquet").where("event_type IS NOT NULL").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@fixed("SELECT NULL::DATE AS date, NULL::STRING AS ticker WHERE false")
def empty_price_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.empty_prices(spark).select("date", "ticker")
