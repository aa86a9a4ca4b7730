"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import ann, fim, language, licenses, mixing, neardup, pieces, resample, secrets, sharding, store, tokenfiles, topk, warc

SHARDS = [1.0] * 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_dartminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its class of near duplicates, named by the smallest doc_id in it."""
    return neardup.classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS, [*SHARDS, 1.0])


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("_id") % 100 == 0, k=10)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = store.fresh_dir(spark, "tokens")
    files = tokenfiles.write(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer("byte_bpe_50k.json"), where)
    return tokenfiles.digest(spark, where, files, "doc_id")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata and a conversion record for every page."""
    rows = warc.derive(warc.responses(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    text = F.when(F.col("record_type") == "conversion", F.decode("block", "UTF-8"))
    return rows.withColumn("content_length", F.octet_length("block").cast("long")).withColumn("text", text)


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether decoding gave its text back."""
    return pieces.encode(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer("piece_bpe_32k.model"))


def op7_block_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("_id") % 50 == 0, k=5)


def op8_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal target weights for all sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text_hash"))
    return mixing.mix(docs, "source", "doc_id", "text_hash").select("doc_id", "source", "block", "phase", "slot", "position")


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.labelled(spark, docs, "doc_id", "text"))
    found = secrets.scan(docs, "text", model)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, "doc_id", "text", "lang", ~language.held_out(F.col("doc_id")))
    return language.predict(docs, "text", model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")


def op12_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    starts = F.transform("base", lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.labels("base").alias("base_labels"), licenses.labels("base", "found").alias("labels"), "score",
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")

    def digest(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)

    output = F.col("output")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(output).alias("output_sha256"), digest(fim.restore(output, F.col("form"))).alias("restored_sha256"))


_ALL = (
    op1_dartminhash_classes, op2_rendezvous_sharding, op3_projection_forest, op4_token_files, op5_warc_derivatives,
    op6_sampled_pieces, op7_block_pruned_topk, op8_pfair_mixture, op9_markov_secrets, op10_language,
    op11_importance_resampling, op12_license_spans, op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in _ALL}

# Classes from all shared shingles: words are runs of ASCII letters, digits, underscores and characters beyond ASCII.
_CLASSES = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '(?:[0-9a-z_]|[^\x00-\x7F])+') AS w FROM d),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS x FROM w),
c AS (SELECT doc_id, x, count(*) AS n FROM s GROUP BY ALL), total AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN total u ON u.doc_id = a JOIN total v ON v.doc_id = b WHERE m / (u.n + v.n - m) >= 0.8 UNION SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON a.t = b.t AND a.doc_id < b.doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT doc_id AS n, doc_id AS label FROM d UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.n)
SELECT n AS doc_id, min(label) AS class_id FROM r GROUP BY n"""

_TOPK = """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 5"""

# The checksum's table has 256 entries, from its polynomial; only different words are summed, byte by byte.
_RESAMPLE = r"""WITH RECURSIVE k(i, v, n) AS (SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, n + 1 FROM k WHERE n < 8),
tab AS (SELECT i, v FROM k WHERE n = 8), d AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS t FROM documents),
low AS (SELECT doc_id, id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
f AS (SELECT id, unnest(w) AS w FROM low), b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM f UNION SELECT w FROM b)),
c(w, h, pos, v) AS (SELECT w, h, 1, 4294967295::UBIGINT FROM u UNION ALL SELECT w, h, pos + 2, xor(tab.v, c.v >> 8) FROM c JOIN tab ON tab.i = xor(c.v & 255, ('0x' || substr(h, pos, 2))::UBIGINT) WHERE pos < length(h)),
x AS (SELECT w, (xor(v, 4294967295::UBIGINT) % 10000)::BIGINT AS bucket FROM c WHERE pos > length(h)),
s AS (SELECT bucket, count(*) AS n FROM f JOIN x USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM b JOIN x USING (w) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN x USING (w) JOIN g USING (bucket) GROUP BY id),
r AS (SELECT low.doc_id, coalesce(m.n, 0)::BIGINT AS n_features, coalesce(m.weight, 0)::BIGINT AS weight, len(low.w) >= 20 AS enough, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT AS h FROM low LEFT JOIN m USING (id)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY enough) AS many FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= many * 10 // 100 THEN place END AS rank FROM o"""

_NOTICES = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(licenses.NOTICES))
_LICENSES = (
    r"""WITH d AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT notice, label, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (VALUES """
    + _NOTICES
    + r""") v(notice, label, text)),
f AS (SELECT * FROM (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) v(ph, label)),
b AS (SELECT id, label, unnest([i - 1 FOR i IN range(1, len(w) - len(ph) + 2) IF w[i:i + len(ph) - 1] = ph]) AS p FROM d, f),
bb AS (SELECT id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS l FROM b GROUP BY id),
dg AS (SELECT id, unnest(range(len(w) - 3)) AS p, unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) AS g FROM d WHERE len(w) > 3),
tg AS (SELECT notice, label, len(w) AS n, unnest(range(len(w) - 3)) AS q, unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) AS g FROM t),
h AS (SELECT id, notice, label, n, p, q, p - q AS diagonal FROM dg JOIN tg USING (g)),
v AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY id, notice ORDER BY diagonal) > 4, true)::INT AS o FROM (SELECT DISTINCT id, notice, diagonal FROM h)),
s AS (SELECT id, notice, diagonal, sum(o) OVER (PARTITION BY id, notice ORDER BY diagonal) AS span FROM v),
c AS (SELECT h.*, span, coalesce(least(4, p - lag(p) OVER (PARTITION BY id, notice, span ORDER BY p)), 4) AS x, coalesce(least(4, q - lag(q) OVER (PARTITION BY id, notice, span ORDER BY q)), 4) AS y FROM h JOIN s USING (id, notice, diagonal)),
a AS (SELECT id, notice, label, min(p) AS b, max(p) + 4 AS e, sum(x) / (max(p) + 4 - min(p)) AS density, sum(y) AS y, sum(y) / max(n) AS share FROM c GROUP BY id, notice, label, span),
g AS (SELECT * FROM a WHERE share >= 0.7 AND density >= 0.7),
k AS (SELECT *, coalesce(e > max(e) OVER (PARTITION BY id ORDER BY b, e DESC, y DESC, share DESC, notice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS beyond FROM g),
m AS (SELECT id, max(share) AS share, list(DISTINCT label) AS l FROM k WHERE beyond GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(bb.l), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.l, []), coalesce(m.l, [])))), ','), '') AS labels,
CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score FROM d LEFT JOIN bb USING (id) LEFT JOIN m USING (id)"""
)

_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w FROM d),
m AS (SELECT *, len(w)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::UBIGINT FOR i IN range(4)] AS r FROM k),
c AS (SELECT *, (r[1] % (n + 1))::BIGINT AS x, (r[2] % (n + 1))::BIGINT AS y,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM m),
p AS (SELECT *, array_to_string(w[:least(x, y)], '') AS a, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(w[greatest(x, y) + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLES: dict[str, str] = {"op1_dartminhash_classes": _CLASSES, "op7_block_pruned_topk": _TOPK, "op11_importance_resampling": _RESAMPLE, "op12_license_spans": _LICENSES, "op13_fill_in_middle": _MIDDLE}
