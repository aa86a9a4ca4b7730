"""Queries on whole runs, models over a history, sources and sinks, with their DuckDB SQL.

Sinks write under the session's checkpoint folder, which all executors share, and the query reads back what was written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import correlations as C
from larkspur.operators import diagnostics as D
from larkspur.operators import history as H
from larkspur.operators import inference as I
from larkspur.operators import news as N
from larkspur.operators import panel as P
from larkspur.operators import pipelines as R
from larkspur.operators import sequences as S
from larkspur.operators import training as G
from larkspur.operators import vectors as E
from larkspur.plans.adapters import load, oracle
from larkspur.plans.evaluation_queries import AGREE, DIAG, FACTORS, HIGH, IC, KEEP, LONG, MEASURES, RECURSIVE_WIDE, SIGNALS, avg_rank, corr_sql, decile_sql, ic_sql, rolling_sql
from larkspur.plans.factor_queries import r, rounded
from larkspur.plans.text_queries import CALENDAR, PREDS, chunked, fixed, vectors
from larkspur.plans.text_queries import CHUNKS as CHUNK_SQL
from larkspur.sources import blocks, filings, manifests, tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return keep


def scratch(spark: SparkSession) -> str:
    """A new folder that executors share: under spark.checkpoint.dir; a local master without it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.gettempdir()
    return f"{where.rstrip('/')}/run-{uuid.uuid4().hex}"


# --- sources and sinks


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def csv_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/orders.csv"
    tables.write_table(tables.read_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice")), path)
    return tables.read_table(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query(f"WITH {oracle('bars')} SELECT upper(trim(ticker)) AS ticker, date, volume FROM bars")
def panel_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/bars.parquet"
    tables.write_table(load(spark, sf_dir, "bars").withColumn("ticker", F.concat(F.lit(" "), F.lower("ticker"))), path)
    if tables.read_optional(spark, f"{path}-none") is not None:
        raise AssertionError("a table that is not there was read")
    tables.read_required(spark, path)
    return tables.read_panel(spark, path).select("ticker", "date", "volume")


@query(f"{CALENDAR} SELECT date FROM calendar")
def calendar_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/calendar.parquet"
    tables.write_calendar(load(spark, sf_dir, "calendar"), path)
    return spark.read.parquet(path)


@fixed("SELECT NULL::STRING AS ticker, NULL::STRING AS form WHERE false")
def empty_event_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.empty_events(spark).select("ticker", "form")


@query("SELECT concat(CAST(page_id AS STRING), '.html') AS file, octet_length(encode(coalesce(html, ''))) AS length FROM pages")
def files_under_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of files written from a table, one for each page."""
    root = scratch(spark)
    pages = load(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    _write_files(pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").alias("content")), root)
    return tables.raw_files(spark, root, "*.html").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")


def _write_files(df: DataFrame, root: str) -> None:
    """name, content as files under a folder, through an Arrow file system."""
    def run(batches):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(bytes(content))
        yield from ()
    df.mapInPandas(run, "n int").count()


MANIFEST = """WITH v AS (SELECT vec_id, upper(concat('t', CAST(label AS STRING))) AS ticker, DATE '2024-01-01' + CAST(vec_id % 20 AS INT) AS date, embedding FROM embeddings WHERE len(embedding) > 0)"""


def stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A manifest of JSON lines and NumPy files made from the embeddings, and what reading both gives."""
    import io

    import numpy as np

    root = scratch(spark)
    v = load(spark, sf_dir, "embeddings").where(F.size("embedding") > 0)

    @F.pandas_udf("binary")
    def npy(xs):
        out = []
        for x in xs:
            f = io.BytesIO()
            np.save(f, np.asarray(x, dtype=np.float32))
            out.append(f.getvalue())
        import pandas as pd
        return pd.Series(out)

    _write_files(v.select(F.format_string("v%d.npy", "vec_id").alias("name"), npy("embedding").alias("content")), f"{root}/vectors")
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 20).cast("int")).cast("string")
    line = F.struct(
        F.concat(F.lit("chunk"), F.col("vec_id").cast("string")).alias("chunk_id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("ticker"), date.alias("date"), F.lit("m").alias("model_name"),
        F.format_string("v%d.npy", "vec_id").alias("embedding_path"), F.size("embedding").alias("embedding_dim"), F.lit("2024-01-01 09:00:00").alias("publish_time"), F.format_string("n%d", (F.col("vec_id") / 7).cast("int")).alias("source_news_id"), (F.col("vec_id") % 7).cast("int").alias("chunk_index"),
    )
    # In the order of ids: the files' names and the lines in them tell a line's number.
    v.select(F.to_json(line).alias("value"), "vec_id").sort(F.col("vec_id").asc_nulls_last()).select("value").write.text(f"{root}/manifest")
    return root, manifests.stored_vectors(spark, f"{root}/manifest", f"{root}/vectors", "part-*")


@query(f"{MANIFEST} SELECT concat('chunk', CAST(vec_id AS STRING)) AS chunk_id, ticker, date, row_number() OVER (ORDER BY vec_id)::INT AS line, len(embedding)::INT AS width, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM v")
def manifest_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines, numbered through all files, with the NumPy files they name, through a data source that opens those alone."""
    root, named = stored(spark, sf_dir)
    first = named.select("path", "line", "chunk_id", "ticker", "date", F.size("embedding").alias("width"), F.get("embedding", F.lit(0)).cast("double").alias("first"))
    out = manifests.with_numbers(first, f"{root}/manifest", "part-*").withColumn("line", F.col("number").cast("int"))
    return rounded(out.select("chunk_id", "ticker", "date", "line", "width", "first"))


@query(f"{MANIFEST} SELECT concat('chunk', CAST(vec_id AS STRING)) AS chunk_id, ticker, date, round(embedding[64]::DOUBLE, 6) + 0.0 AS last FROM v WHERE ticker IN ('T3', 'T7') AND date >= DATE '2024-01-05' AND date < DATE '2024-01-15'")
def vectors_of_some_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on ticker and date reach the reader of the manifest."""
    _, named = stored(spark, sf_dir)
    some = named.where(F.col("ticker").isin("T3", "T7") & (F.col("date") >= F.lit("2024-01-05").cast("date")) & (F.col("date") < F.lit("2024-01-15").cast("date")))
    return rounded(some.select("chunk_id", "ticker", "date", F.get("embedding", F.lit(63)).cast("double").alias("last")))


@query(f"""{MANIFEST}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY 'n' || CAST(CAST(floor(vec_id / 7) AS INT) AS STRING), vec_id % 7, 'chunk' || CAST(vec_id AS STRING)) AS r FROM v)
SELECT ticker, date, count(*) AS length, round(max(CASE WHEN r = 1 THEN embedding[1] END)::DOUBLE, 6) + 0.0 AS first, round(sum(embedding[64]::DOUBLE), 5) + 0.0 AS last FROM k WHERE r <= 64 GROUP BY ticker, date""")
def chunk_index_of_a_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stock-day's vectors in order, written to block files and read back."""
    root, named = stored(spark, sf_dir)
    index = blocks.write_blocks(named, f"{root}/packed")
    out = blocks.read_blocks(index, f"{root}/packed")
    last = F.aggregate("matrix", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(63)).cast("double"))
    return rounded(out.select("ticker", "date", F.size("matrix").cast("long").alias("length"), F.round(F.get(F.get("matrix", F.lit(0)), F.lit(0)).cast("double"), 6).alias("first"), F.round(last, 5).alias("last")))


@query(f"{MANIFEST}, k AS (SELECT ticker, date, count(*) AS length FROM v GROUP BY ALL) SELECT 0 AS only_direct, 0 AS only_cached, (SELECT count(*) FROM k) AS both, 0.0::DOUBLE AS largest_difference, (SELECT sum(least(length, 64))::BIGINT FROM k) AS chunks")
def packed_against_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block files against the stock-days made anew: the same vectors in the same order."""
    root, named = stored(spark, sf_dir)
    index = blocks.write_blocks(named, f"{root}/packed")
    flat = [blocks.packed_or_direct(spark, d, named).select("ticker", "date", F.flatten("matrix").alias("embedding")) for d in (None, f"{root}/packed")]
    both = E.compare(*flat, P.KEYS).withColumn("_k", F.lit(1))
    return both.join(blocks.summary(index).select("chunks", F.lit(1).alias("_k")), "_k").drop("_k")


VECTOR_ROWS = f"WITH {oracle('vectors')}"


@query(f"{VECTOR_ROWS} SELECT chunk_id, ticker, DATE '2024-01-01' + day AS date, 'm' AS model_name, len(embedding)::INT AS embedding_dim FROM vectors")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the vectors saved, then the rest of them by the ids that the store lacks."""
    store = manifests.VectorStore(spark, scratch(spark))
    v = vectors(spark, sf_dir).withColumn("model_name", F.lit("m"))
    for _ in range(2):  # the repeat changes nothing
        store.save(v.where("day < 10"), "first")
    store.save(v.join(store.ids(), "chunk_id", "left_anti"), "rest")
    return store.manifest()


@query("SELECT 'n' AS name, count(*) AS value FROM orders UNION ALL SELECT 'least', min(o_orderkey) FROM orders")
def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary's single row as a JSON document, with settings laid over each other."""
    row = tables.one_row(load(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least")))
    path = f"{scratch(spark)}/summary"
    tables.write_json(spark, tables.merged({"a": {"n": 0, "least": 0}}, {"a": row}), path)
    return spark.read.text(path).select(F.explode(F.from_json("value", "struct<a:map<string,long>>")["a"]).alias("name", "value"))


@query("SELECT lpad(CAST(s_suppkey AS STRING), 10, '0') AS cik, concat('S', CAST(s_suppkey AS STRING)) AS ticker, s_name AS title FROM supplier")
def published_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published list made of the suppliers, read back."""
    path = f"{scratch(spark)}/tickers"
    entry = F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("title"))
    load(spark, sf_dir, "supplier").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), entry)))).alias("value")).write.text(path)
    return filings.company_tickers(spark, path).select("cik", "ticker", "title")


@query("""SELECT concat('C', CAST(o_custkey AS STRING)) AS ticker, 'us-gaap' AS taxonomy, 'Revenues' AS concept, 'USD' AS unit, o_totalprice AS value, CAST(o_orderdate AS DATE) AS filed_date FROM orders WHERE o_orderkey IS NOT NULL""")
def company_facts_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload a customer with all its orders as reported values."""
    entry = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"), F.lit("10-K").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"))
    by = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(entry).alias("e"))
    units = F.create_map(F.lit("USD"), F.col("e"))
    facts = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), F.struct(F.lit("r").alias("label"), units.alias("units"))))
    payloads = by.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("ticker"), F.to_json(F.struct(F.col("o_custkey").alias("cik"), facts.alias("facts"))).alias("payload"))
    return filings.company_facts(payloads).select("ticker", "taxonomy", "concept", "unit", "value", "filed_date")


# --- panels


@query(f"{SIGNALS} SELECT date, ticker, round(momentum, 6) + 0.0 AS momentum, CASE WHEN date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' THEN 'train' WHEN date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' THEN 'valid' END AS part, round(surge * 2, 6) + 0.0 AS extra FROM signals")
def split_and_new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "signals")
    base = s.select(*P.KEYS, "momentum").withColumn("part", P.split_of("date", {"train": ("1996-01-01", "1997-12-31"), "valid": ("1998-01-01", "1998-12-31")}))
    return rounded(P.only_new(base, s.select(*P.KEYS, "momentum", (F.col("surge") * 2).alias("extra"))))


@query(f"{SIGNALS} SELECT date, ticker, round(fwd5, 6) + 0.0 AS fwd5, round(momentum * 3, 6) + 0.0 AS momentum_zscore, round(surge, 6) + 0.0 AS surge_zscore FROM signals")
def replaced_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "signals")
    old = s.select(*P.KEYS, "fwd5", F.col("momentum").alias("momentum_zscore"), F.col("distance").alias("gone_zscore"))
    new = s.select(*P.KEYS, (F.col("momentum") * 3).alias("momentum_zscore"), F.col("surge").alias("surge_zscore"))
    return rounded(P.replace_factors(old, new))


@query(f"{VECTOR_ROWS}, p AS (SELECT day, ticker, avg(embedding[1]::DOUBLE) AS a, avg(embedding[2]::DOUBLE) AS b FROM vectors GROUP BY 1, 2), g AS (SELECT DISTINCT unnest([day, day + 30]) AS day, ticker FROM vectors) SELECT DATE '2024-01-01' + g.day AS date, g.ticker, {r('coalesce(a, 0)', 'x')}, {r('coalesce(b, 0)', 'y')} FROM g LEFT JOIN p ON g.day = p.day AND g.ticker = p.ticker")
def panel_for_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    panel = v.select(F.explode(F.array("date", F.date_add("date", 30))).alias("date"), F.lower("ticker").alias("ticker"))
    pooled = E.numbered_mean(v, P.KEYS, "embedding", width=64)
    out = P.training_panel(panel, pooled, "vector", 64)
    return rounded(out.select(*P.KEYS, F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y")))


@fixed("SELECT * FROM (VALUES ('factor', 'a_zscore'), ('factor', 'mean_emb_1_zscore'), ('safe', 'a_zscore'), ('embedding', 'mean_emb_0'), ('embedding', 'mean_emb_2'), ('embedding', 'mean_emb_10')) AS t(role, name)")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["date", "a_zscore", "future_b_zscore", "mean_emb_1_zscore", "mean_emb_10", "mean_emb_2", "mean_emb_0", "news_count"]
    found = {"factor": P.factor_columns(columns), "safe": P.safe_factor_columns(columns), "embedding": P.embedding_columns(columns)}
    return spark.createDataFrame([(k, c) for k, names in found.items() for c in names], "role string, name string")


@query(f"{PREDS} SELECT date, ticker, split, {r('target', 'target', 6)} FROM preds WHERE has_news = 1 AND target IS NOT NULL")
def labelled_news_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.news_labelled(load(spark, sf_dir, "preds"), "target").select("date", "ticker", "split", "target"))


@query(f"""{SIGNALS}, y AS (SELECT *, ({avg_rank('fwd5', 'date, (fwd5 IS NULL)')}) / count(*) OVER (PARTITION BY date, (fwd5 IS NULL)) AS k, CASE WHEN max(fwd5) OVER d > min(fwd5) OVER d THEN (fwd5 - avg(fwd5) OVER d) / nullif(stddev_pop(fwd5) OVER d, 0) END AS z FROM signals WINDOW d AS (PARTITION BY date))
SELECT date, ticker, {r('-momentum', 'momentum_alpha')}, {r('surge', 'surge_alpha')}, {r('fwd5', 'label')}, {r('CASE WHEN fwd5 IS NOT NULL THEN k END', 'y_rank')}, {r('z', 'y_z')} FROM y""")
def rank_loss_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.with_alphas(load(spark, sf_dir, "signals").withColumn("surge_alpha", F.col("surge")), {"momentum_alpha": ("momentum", -1.0), "surge_alpha": ("absent", 1.0)})
    out = R.rank_loss_panel(s, "fwd5", ["momentum_alpha", "surge_alpha"])
    return rounded(out.select("date", "ticker", "momentum_alpha", "surge_alpha", "label", "y_rank", "y_z"))


# --- runs


EVERY = f"""rd AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM signals) AS q), kept AS (SELECT s.* FROM signals s JOIN rd USING (date) WHERE (k - 1) % 20 = 0),
marked AS ({decile_sql('kept', 'momentum')}), dr AS (SELECT date, decile, avg(fwd5 / 10) AS ret FROM marked WHERE decile IS NOT NULL AND fwd5 IS NOT NULL GROUP BY date, decile), ls AS (SELECT date, max(CASE WHEN decile = 10 THEN ret END) - max(CASE WHEN decile = 1 THEN ret END) AS x FROM dr GROUP BY date),
grown AS (SELECT date, x, product(1 + x) OVER (ORDER BY date) AS c FROM ls WHERE x IS NOT NULL), fallen AS (SELECT *, c / max(c) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM grown), sd AS (SELECT date, stddev_pop(momentum) AS s FROM signals GROUP BY date)"""
FIFTEEN = {
    "IC": "(SELECT avg(IC) FROM ic)", "ICIR": "(SELECT avg(IC) / stddev_samp(IC) * sqrt(252) FROM ic)", "RankIC": "(SELECT avg(RankIC) FROM ic)", "RankICIR": "(SELECT avg(RankIC) / stddev_samp(RankIC) * sqrt(252) FROM ic)", "coverage": "(SELECT avg(coverage) FROM ic)",
    "positive_rankic_ratio": "(SELECT count(CASE WHEN RankIC > 1e-12 THEN 1 END) / count(RankIC) FROM ic)", "pred_mean": "(SELECT avg(momentum) FROM signals)", "pred_std": "(SELECT stddev_pop(momentum) FROM signals)", "daily_pred_std_mean": "(SELECT avg(s) FROM sd)", "daily_pred_std_min": "(SELECT min(s) FROM sd)",
    "long_short_return_mean": "(SELECT avg(x) FROM ls)", "long_short_sharpe": "(SELECT avg(x) / stddev_samp(x) * sqrt(252.0 / 20) FROM fallen)", "max_drawdown": "(SELECT min(d) FROM fallen)",
}


@query(f"{IC}, {EVERY} SELECT {', '.join(r(x, n, 5) for n, x in FIFTEEN.items())}, (SELECT count(*) FROM ic) AS days, 20 AS rebalance_every")
def prediction_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "signals").withColumns({"pred": F.col("momentum"), "label": F.col("fwd5") / 10})
    return rounded(R.evaluate_predictions(s.select("date", "ticker", "pred", "label")), 5)


SPLITS = {"train": ("1990-01-01", "1998-12-31"), "valid": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2099-12-31")}


def baseline(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = load(spark, sf_dir, "signals").select(*P.KEYS, "fwd5", F.col("momentum").alias("momentum_zscore"), F.col("surge").alias("surge_zscore"), F.col("distance").alias("future_zscore"))
    return R.ridge_by_split(s, "fwd5", split=SPLITS)


# Two columns: filled with their means and scaled by their spread over the rows with a label, the normal equations can be written out.
RIDGE = f"""{SIGNALS}, l AS (SELECT * FROM signals WHERE split = 'train' AND fwd5 IS NOT NULL), m AS (SELECT avg(momentum) AS m1, avg(surge) AS m2, avg(fwd5) AS my FROM l),
f AS (SELECT fwd5 - my AS y, coalesce(momentum, m1) - m1 AS a, coalesce(surge, m2) - m2 AS b FROM l, m), sc AS (SELECT sqrt(avg(a * a)) AS s1, sqrt(avg(b * b)) AS s2 FROM f),
g AS (SELECT sum(a * a) / (s1 * s1) + 1 AS aa, sum(b * b) / (s2 * s2) + 1 AS bb, sum(a * b) / (s1 * s2) AS ab, sum(a * y) / s1 AS ay, sum(b * y) / s2 AS b_y, s1, s2 FROM f, sc GROUP BY s1, s2),
w AS (SELECT (bb * ay - ab * b_y) / (aa * bb - ab * ab) / s1 AS w1, (aa * b_y - ab * ay) / (aa * bb - ab * ab) / s2 AS w2 FROM g),
p AS (SELECT split, date, ticker, my + w1 * (coalesce(momentum, m1) - m1) + w2 * (coalesce(surge, m2) - m2) AS pred, fwd5 FROM signals, m, w)"""


@query(f"{RIDGE} SELECT split, date, ticker, {r('pred', 'factor_only_pred', 5)}, {r('fwd5', 'fwd5')} FROM p")
def ridge_baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = baseline(spark, sf_dir)["predictions"]
    return rounded(out.withColumn("factor_only_pred", F.round("factor_only_pred", 5)))


@query(f"""{RIDGE}, ic AS ({ic_sql('p', 'pred', 'fwd5', 'split, date')}) SELECT split, {r('avg(IC)', 'IC', 4)}, {r('avg(IC) / nullif(stddev_samp(IC), 0) * sqrt(252)', 'ICIR', 4)}, {r('avg(RankIC)', 'RankIC', 4)}, {r('avg(RankIC) / nullif(stddev_samp(RankIC), 0) * sqrt(252)', 'RankICIR', 4)}, {r('avg(coverage)', 'coverage', 4)}, count(IC) AS days FROM ic GROUP BY split""")
def ridge_baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline(spark, sf_dir)["metrics"], 4)


@query(f"""{SIGNALS}, t AS (SELECT date, fwd5 AS y, unnest(['momentum_zscore', 'surge_zscore']) AS factor, unnest([momentum, surge]) AS value FROM signals WHERE split = 'test'), ic AS ({ic_sql('t', 'value', 'y', 'factor, date')}),
u AS (SELECT factor, coverage, unnest(['IC', 'RankIC']) AS metric, unnest([IC, RankIC]) AS x FROM ic) SELECT factor, metric, {r('avg(x)', 'mean', 5)}, {r('avg(x) / nullif(stddev_samp(x), 0) * sqrt(252)', 'ir', 5)}, {r('stddev_samp(x)', 'std', 5)}, {r('count(CASE WHEN x > 1e-12 THEN 1 END) / nullif(count(x), 0)', 'positive_ratio', 5)}, count(x) AS days, {r('avg(coverage)', 'avg_coverage', 5)} FROM u GROUP BY factor, metric""")
def single_factor_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(baseline(spark, sf_dir)["single_factor"], 5)


@query()
def rank_loss_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor network trained on the train split by summed gradients, a few steps, and what it predicts for every row."""
    root = scratch(spark)
    panel = f"{root}/signals.parquet"
    tables.write_table(load(spark, sf_dir, "signals"), panel)
    signals = tables.read_panel(spark, panel)
    model = G.train(signals, root, "fwd5", FACTORS, G.Config(hidden=16, batch_dates=128, epochs=3, rate=0.01))
    return rounded(G.evaluated(signals, "fwd5", model)["predictions"])


# Each table of a diagnostics run by its file's name: key columns, numbers, their digits, texts, and its rows in SQL.
FLAGS = ["direction_consistent", "unstable_flag", "weak_flag"]
SHAPE = ["decile_monotonic_score", "top_decile_return", "bottom_decile_return", "top_bottom_return", "top_bottom_tstat"]
SPLIT_RANKS = ["train_RankIC", "valid_RankIC", "test_RankIC"]
RUN_TABLES = {
    "summary_by_factor_split": (["factor", "split"], [*MEASURES, "days", "min_coverage", "max_coverage", *SHAPE], 5, [], "s JOIN shape USING (factor, split)"),
    "raw_factor_daily_ic": (["split", "factor", "date"], ["IC", "RankIC", "coverage", "total_rows"], 6, [], "ic"),
    "raw_factor_rolling60_rankic": (["split", "factor", "date"], ["rolling_60d_RankIC"], 6, [], f"(SELECT split, factor, date, {rolling_sql(60, 15, 'PARTITION BY factor, split')} FROM ic)"),
    "raw_factor_decile_returns": (["split", "factor", "decile"], ["mean_return", "days", "avg_count"], 6, [], "agg"),
    "highly_correlated_pairs": (["method", "split", "factor_a", "factor_b"], ["corr", "abs_corr"], 6, [], "(SELECT *, abs(corr) AS abs_corr FROM high WHERE abs(corr) >= 0.2)"),
    "factor_stability_flags": (["factor"], [*SPLIT_RANKS, "selected_direction"], 6, FLAGS, f"(SELECT factor, a AS train_RankIC, b AS valid_RankIC, c AS test_RankIC, {AGREE} AS direction_consistent, coalesce(a * c < 0, false) OR coalesce(b * c < 0, false) AS unstable_flag, coalesce(abs(c) < 0.005, true) AS weak_flag, coalesce(sign(list_median([x FOR x IN [a, b, c] IF x IS NOT NULL])), 0) AS selected_direction FROM w)"),
    "recommended_factor_keep_drop": (["factor"], ["test_RankIC", "stability_score"], 5, ["keep_or_drop", "reason", "correlated_with", "direction_consistent"], "choice"),
} | {
    f"factor_corr_{split}_{m}": (["factor"], FACTORS, 6, [], f"""(SELECT factor_a AS factor, {', '.join(f"max(CASE WHEN factor_b = '{f}' THEN corr END) AS {f}" for f in FACTORS)} FROM (SELECT factor_a, factor_b, corr FROM high WHERE split = '{split}' AND method = '{m}'
      UNION ALL SELECT factor_b, factor_a, corr FROM high WHERE split = '{split}' AND method = '{m}' UNION ALL SELECT factor, factor, 1.0 FROM names) GROUP BY 1)""")
    for split in ("train", "valid", "test") for m in ("pearson", "spearman")
}


def melted_sql(name: str) -> str:
    keys, numbers, digits, texts, source = RUN_TABLES[name]
    fields = ", ".join(f"'{c}'" for c in [*numbers, *texts])
    values = ", ".join([*[f"round({c}::DOUBLE, {digits}) + 0.0" for c in numbers], *["NULL" for _ in texts]])
    words = ", ".join([*["NULL::VARCHAR" for _ in numbers], *[f"{c}::VARCHAR" for c in texts]])
    return f"SELECT '{name}' AS name, concat_ws('|', {', '.join(f'{k}::VARCHAR' for k in keys)}) AS key, unnest([{fields}]) AS field, unnest([{values}]::DOUBLE[]) AS number, unnest([{words}]) AS text FROM {source}"


def melted(df: DataFrame, name: str) -> DataFrame:
    """name, key, field, number, text: one row a value of one of the run's files, which are all text."""
    keys, numbers, digits, texts, _ = RUN_TABLES[name]
    none = F.lit(None).cast("string")
    # A value just between two rounded ones goes up (away from zero), whatever the order of its sum left in its last bits.
    fields = [F.struct(F.lit(c).alias("field"), (F.round(F.round(F.col(c).cast("double"), 12), digits) + 0.0).alias("number"), none.alias("text")) for c in numbers]
    fields += [F.struct(F.lit(c).alias("field"), F.lit(None).cast("double").alias("number"), F.coalesce(c, F.lit("")).alias("text")) for c in texts]
    return df.select(F.lit(name).alias("name"), F.concat_ws("|", *keys).alias("key"), F.inline(F.array(*fields)))


SHAPES = f"""ends AS (SELECT split, factor, date, max(CASE WHEN decile = 10 THEN m END) - max(CASE WHEN decile = 1 THEN m END) AS x FROM day GROUP BY ALL), spread AS (SELECT split, factor, avg(x) AS top_bottom_return, avg(x) / stddev_samp(x) * sqrt(count(x)) AS top_bottom_tstat FROM ends GROUP BY ALL),
ranked AS (SELECT *, {avg_rank('mean_return', 'split, factor')} AS k FROM agg), shape AS (SELECT * FROM (SELECT split, factor, corr(decile, k) AS decile_monotonic_score, max(CASE WHEN decile = 10 THEN mean_return END) AS top_decile_return, max(CASE WHEN decile = 1 THEN mean_return END) AS bottom_decile_return FROM ranked GROUP BY ALL) JOIN spread USING (split, factor))"""


@query(f"{RECURSIVE_WIDE}{DIAG[len(LONG):]}, {SHAPES}, high AS ({HIGH}), {KEEP} {' UNION ALL '.join(map(melted_sql, RUN_TABLES))}")
def diagnostics_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the thirteen tables of a run, as they are in its files."""
    root = scratch(spark)
    panel = f"{root}/signals.parquet"
    tables.write_table(load(spark, sf_dir, "signals"), panel)
    done = R.run_diagnostics(tables.read_panel(spark, panel), root, FACTORS, "fwd5", None, threshold=0.2)
    parts = [melted(spark.read.option("header", True).csv(f"{root}/{n}.csv"), n) for n in done["files"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""SELECT factor_a AS factor, max(CASE WHEN factor_b = 'momentum' THEN corr END) AS momentum, max(CASE WHEN factor_b = 'momentum_20' THEN corr END) AS momentum_20, max(CASE WHEN factor_b = 'surge' THEN corr END) AS surge, max(CASE WHEN factor_b = 'distance' THEN corr END) AS distance
FROM (WITH c AS ({corr_sql('pearson')}) SELECT factor_a, factor_b, corr FROM c WHERE split = 'test' UNION ALL SELECT factor_b, factor_a, corr FROM c WHERE split = 'test' UNION ALL SELECT DISTINCT factor_a, factor_a, 1.0 FROM c UNION ALL SELECT DISTINCT factor_b, factor_b, 1.0 FROM c) AS t GROUP BY 1""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.matrix(D.factor_correlations(load(spark, sf_dir, "signals"), FACTORS, "pearson").where("split = 'test'"), FACTORS))


@query(f"""{VECTOR_ROWS}, p AS (SELECT day, ticker, count(*) AS n, {', '.join(f'avg(embedding[{i + 1}]::DOUBLE) AS e{i}' for i in range(4))} FROM vectors GROUP BY 1, 2) SELECT DATE '2024-01-01' + day AS date, ticker, 1 AS has_news, n AS embedded_chunk_count, {', '.join(r(f'e{i}', f'mean_emb_{i}') for i in range(4))} FROM p""")
def raw_representation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumns({"path": F.lit("a"), "line": F.col("vec_id")})
    again = v.withColumn("path", F.lit("b")).withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    return rounded(R.raw_representations(v.unionByName(again), 64)["repr"].select(*P.KEYS, "has_news", "embedded_chunk_count", *[f"mean_emb_{i}" for i in range(4)]))


@query()
def projected_representation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of the pooled vectors in a panel that has days without news; a test holds them against NumPy."""
    v = vectors(spark, sf_dir).withColumns({"path": F.lit("a"), "line": F.col("vec_id")})
    panel = v.select(F.explode(F.array("date", F.date_add("date", 30))).alias("date"), "ticker").distinct().withColumns({"news_count": F.lit(1), "chunk_count": F.lit(2)})
    return R.representations(v, panel, 8, 64)["panel"]


@query(f"{CHUNK_SQL} SELECT chunk_id, date, ticker, 'lengths' AS model_name, length(chunk_text)::DOUBLE AS characters, len(string_split(chunk_text, ' '))::DOUBLE AS words FROM chunks WHERE chunk_index % 2 = 1")
def encoded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for an encoder behind the hook: lengths in place of meaning. Half of the chunks are there already."""
    def make():
        import numpy as np
        return lambda texts: np.array([[len(t), len(t.split(" "))] for t in texts], dtype=np.float32)

    chunks = chunked(spark, sf_dir)
    out = R.encode_chunks(chunks, chunks.where("chunk_index % 2 = 0"), make, "lengths")
    return out.select("chunk_id", "date", "ticker", "model_name", F.get("embedding", F.lit(0)).cast("double").alias("characters"), F.get("embedding", F.lit(1)).cast("double").alias("words"))


@query(f"""WITH {oracle('news')} SELECT lower(ticker) AS alias, upper(ticker) AS ticker FROM news GROUP BY ALL UNION SELECT lower(concat('company ', ticker)), upper(ticker) FROM news""")
def aliases_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = load(spark, sf_dir, "news").select("news_id", "ticker", F.concat(F.lit(" Company "), F.col("ticker")).alias("company_name"))
    return N.alias_map(news, "news_id")


# --- histories and models


@query(f"""{SIGNALS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM signals) AS q) SELECT s.date, s.ticker, floor(n / 16)::INT AS batch, (n % 16)::INT AS date_id FROM signals s JOIN d USING (date)""")
def batches_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batches_by_date(load(spark, sf_dir, "signals")).select("date", "ticker", "batch", "date_id")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense panel of the vectors' days: two factors, and the days' chunks as far as there are some."""
    v = vectors(spark, sf_dir)
    grid = v.select("ticker").distinct().withColumn("date", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-20").cast("date"))))
    return grid.withColumns({"f": F.dayofmonth("date") / 20.0, "g": F.length("ticker") + F.dayofmonth("date") % 3})


@query(f"""{VECTOR_ROWS}, k AS (SELECT day, ticker, least(count(*), 64) AS n FROM vectors GROUP BY 1, 2), g AS (SELECT t.ticker, d::INT AS day FROM (SELECT DISTINCT ticker FROM vectors) AS t, range(20) AS r(d)), c AS (SELECT g.ticker, g.day, coalesce(n, 0) AS n FROM g LEFT JOIN k USING (ticker, day)),
w AS (SELECT ticker, day, sum(n) OVER h AS own, count(*) OVER h AS days FROM c WINDOW h AS (PARTITION BY ticker ORDER BY day ROWS 4 PRECEDING)) SELECT DATE '2024-01-01' + day AS date, ticker, own::BIGINT AS own_chunks, 320::BIGINT AS places, dense_rank() OVER (ORDER BY ticker)::INT AS ticker_id FROM w WHERE days = 5""")
def padded_chunk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.chunk_samples(history(spark, sf_dir), H.day_matrices(vectors(spark, sf_dir), ["vec_id"]), ["f", "g"], 64, 64, 5)
    own = F.size(F.filter(F.flatten("chunk_mask_seq"), lambda m: m)).cast("long")
    return out.select(*P.KEYS, own.alias("own_chunks"), F.size(F.flatten("chunk_seq")).cast("long").alias("places"), "ticker_id")


def attended(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = R.chunk_samples(history(spark, sf_dir), H.day_matrices(vectors(spark, sf_dir), ["vec_id"]), ["f", "g"], 64, 64, 5).withColumn("has_news", F.exists(F.element_at("chunk_mask_seq", -1), lambda m: m).cast("double"))
    weights = I.read_weights(I.weights_table(spark, I.seeded_weights(I.shapes(2, 64, 16, 8, 16, 10, True), 3)))
    return I.infer(samples, weights, "mixture", P.KEYS, "chunk_seq", chunk_mask="chunk_mask_seq", ticker_id="ticker_id")


@query()
def attention_mixture_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture model over histories of chunks, with seeded weights; a test holds the forward pass against a plain version."""
    return attended(spark, sf_dir).drop("target_attention_weights")


@query()
def attention_weights_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide sink of attention weights, read back in the long form; the weights of a day with news add up to 1."""
    root = scratch(spark)
    path = R.write_attention(attended(spark, sf_dir), "target_attention_weights", 64, root, "test")
    wide = spark.read.parquet(path)
    long = R.attention_long(wide.select(*P.KEYS, F.array(*[f"attention_weight_{i}" for i in range(64)]).alias("w")), "w")
    return rounded(long.withColumn("attention_weight", F.col("attention_weight").cast("double")), 4)


@query()
def pooled_mixture_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three models over histories of pooled vectors, with seeded weights."""
    s = load(spark, sf_dir, "signals").withColumn("news", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in FACTORS])).withColumn("has_news", (F.col("distance") > 0.25).cast("double"))
    samples = S.samples(s, FACTORS, "news", 30, F.col("has_news").isNotNull())
    weights = I.seeded_weights(I.shapes(4, 4, 16, 8, 16), 5)
    both = I.infer(samples, weights, "mixture", P.KEYS)
    fused = I.infer(samples, weights, "fusion", P.KEYS).withColumnRenamed("fusion_pred", "fused_alone")
    base = I.infer(samples, weights, "factor", P.KEYS).withColumnRenamed("factor_only_pred", "factor_alone")
    return both.join(fused, P.KEYS).join(base, P.KEYS)
