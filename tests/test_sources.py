"""Committed tables, block files, the data source of vectors, and encoding from a stream."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull

from larkspur.operators import vectors as E
from larkspur.sources import blocks, commits, manifests, vector_files
from larkspur.streaming import encoding

DAY = dt.date(2024, 1, 2)
ROWS = "chunk_id string, ticker string, date date, model_name string, embedding array<double>"


def rows(spark, *ids):
    return spark.createDataFrame([(i, "T", DAY, "m", [1.0, 2.0]) for i in ids], ROWS)


def test_a_repeated_save_changes_nothing(spark, tmp_path):
    store = manifests.VectorStore(spark, str(tmp_path / "store"))
    assert store.load().count() == 0 and store.ids().columns == ["chunk_id"]
    assert store.save(rows(spark, "a", "b"), "one") and not store.save(rows(spark, "a", "b"), "one") and not store.save(rows(spark, "c"), "one")
    assert store.save(rows(spark, "d")) and store.save(rows(spark), "empty")
    assert sorted(r["chunk_id"] for r in store.load().collect()) == ["a", "b", "d"]
    assert {e["batch"]: e["rows"] for e in store.table.entries()}["one"] == 2
    with pytest.raises(ValueError):
        store.save(rows(spark, "x"), "../x")


def test_a_save_that_dies_half_way_is_not_there(spark, tmp_path, monkeypatch):
    store = manifests.VectorStore(spark, str(tmp_path / "store"))
    store.save(rows(spark, "a"), "one")
    broken = rows(spark, *[f"x{i}" for i in range(50)]).repartition(4).withColumn("model_name", F.when(F.col("chunk_id") == "x7", F.raise_error(F.lit("dead"))).otherwise("m"))
    with pytest.raises(Exception, match="dead"):
        store.save(broken, "two")
    # All files written, but not committed.
    monkeypatch.setattr(commits, "create_once", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.save(rows(spark, "b"), "two")
    monkeypatch.undo()
    assert [r["chunk_id"] for r in store.load().collect()] == ["a"]
    assert store.save(rows(spark, "b"), "two")
    assert sorted(r["chunk_id"] for r in store.load().collect()) == ["a", "b"]


def test_one_of_two_savers_of_a_batch_wins(spark, tmp_path):
    path = str(tmp_path / "log" / "one.json")
    (tmp_path / "log").mkdir()
    assert commits.create_once(spark, path, "first") and not commits.create_once(spark, path, "second")
    assert (tmp_path / "log" / "one.json").read_text() == "first"
    assert [f.name for f in (tmp_path / "log").iterdir() if f.suffix != ".crc"] == ["one.json"]


def chunked(spark, n=60, width=3):
    rng = np.random.default_rng(3)
    made = [(f"c{i}", f"T{i % 4}", DAY + dt.timedelta(int(i % 3)), f"2024-01-02 0{i % 5}:00", f"n{i % 7}", i, "p", i, [float(x) for x in np.float32(rng.normal(size=width))]) for i in range(n)]
    made.append(("c0", "T0", DAY, "x", "x", 0, "q", 0, [9.0] * width))
    return spark.createDataFrame(made, "chunk_id string, ticker string, date date, publish_time string, source_news_id string, chunk_index int, path string, line long, embedding array<double>")


def test_blocks_equal_what_they_are_made_of(spark, tmp_path):
    v, where = chunked(spark), str(tmp_path / "packed")
    index = blocks.write_blocks(v.repartition(5), where, most=4, file_bytes=100)
    assert index.count() == 12 and tuple(blocks.summary(index).first()) == (12, 48, 3)
    flat = [d.select("ticker", "date", F.flatten("matrix").alias("embedding")) for d in (blocks.direct(v, 4), blocks.packed_or_direct(spark, where, v))]
    assert tuple(E.compare(*flat, ["ticker", "date"]).first()) == (0, 0, 12, 0.0)
    assert blocks.packed_or_direct(spark, str(tmp_path / "none"), v, 4).count() == 12
    held = {(r["file"], r["ticker"], r["date"], r["start"]) for r in index.collect()}
    assert len({f for f, *_ in held}) > 3
    assert held == {(r["file"], r["ticker"], r["date"], r["start"]) for f in {f for f, *_ in held} for r in blocks.footer(f"{where}/blocks", f).to_pylist()}
    none = blocks.write_blocks(v.where("false"), str(tmp_path / "empty"))
    assert none.count() == 0 and blocks.read_blocks(none, str(tmp_path / "empty")).count() == 0


def test_reading_a_stock_day_touches_its_bytes_alone(spark, tmp_path):
    v, where = chunked(spark), str(tmp_path / "packed")
    index = blocks.write_blocks(v.coalesce(1), where)
    one = index.where((F.col("ticker") == "T2") & (F.col("date") == DAY))
    want, at = blocks.read_blocks(one, where).first()["matrix"], one.first()
    file = tmp_path / "packed" / "blocks" / at["file"]
    data = bytearray(file.read_bytes())
    keep = range(at["start"], at["start"] + 4 * at["rows"] * at["width"])
    file.write_bytes(bytes(b if i in keep else 255 for i, b in enumerate(data)))
    for f in (tmp_path / "packed" / "blocks").iterdir():
        if f.name != at["file"]:
            f.unlink()
    assert blocks.read_blocks(one, where).first()["matrix"] == want
    with pytest.raises(ValueError):
        blocks.footer(f"{where}/blocks", at["file"])


@pytest.fixture
def folder(tmp_path):
    for t in ("a", "b", "c"):
        (tmp_path / "m" / t).mkdir(parents=True)
        lines = []
        for i in range(40):
            np.save(tmp_path / f"{t}{i}.npy", np.array([[i, i + 1]], dtype=np.float64))
            lines.append(json.dumps({"chunk_id": f"{t}{i}", "ticker": f" {t}", "date": f"2024-01-{1 + i // 2:02d}", "embedding_path": f"{t}{i}.npy" if i else "none.npy", "chunk_index": i}, ensure_ascii=False))
        (tmp_path / "m" / t / "manifest.jsonl").write_text("\n".join(lines) + ("\n\n" if t == "a" else ""))
        (tmp_path / f"unnamed{t}.npy").write_bytes(b"no array")
    return tmp_path


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_every_line_is_in_one_range(folder, size):
    reader = vector_files.ManifestReader({"manifests": f"{folder}/m", "root": str(folder), "rangeBytes": str(size)})
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["chunk_id"] for r in found) == sorted(f"{t}{i}" for t in "abc" for i in range(40))
    assert all(r["embedding"] == ([r["chunk_index"], r["chunk_index"] + 1] if r["chunk_index"] else None) for r in found)
    assert reader.files_opened == 3 * 39


def test_pushed_conditions_leave_files_closed(folder):
    reader = vector_files.ManifestReader({"manifests": f"{folder}/m", "root": str(folder)})
    left = list(reader.pushFilters([EqualTo(("ticker",), "B"), GreaterThanOrEqual(("date",), dt.date(2024, 1, 18)), In(("chunk_id",), ("b36", "b38", "b2", "a39")), IsNotNull(("ticker",))]))
    assert left == [IsNotNull(("ticker",))]
    assert [r["chunk_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == ["b36", "b38"]
    assert reader.files_opened == 2


def test_spark_reads_only_what_it_asks_for(spark, folder):
    for i in range(40):  # files of a ticker that is not asked for cannot be read
        (folder / f"c{i}.npy").write_bytes(b"broken")
    v = manifests.stored_vectors(spark, f"{folder}/m", str(folder))
    assert v.where("ticker IN ('A', 'B') AND date < '2024-01-03' AND chunk_index > 0").select("chunk_id").orderBy("chunk_id").collect() == [("a1",), ("a2",), ("a3",), ("b1",), ("b2",), ("b3",)]
    with pytest.raises(Exception):
        v.where("ticker = 'C'").collect()
    (folder / "m" / "a" / "manifest.jsonl").write_text('{"chunk_id": "x"}\n')
    with pytest.raises(Exception, match="manifest line"):
        v.where("ticker = 'A'").collect()


def test_a_replayed_batch_is_encoded_once(spark, tmp_path):
    store = manifests.VectorStore(spark, str(tmp_path / "store"))
    source = tmp_path / "news"
    chunk = "chunk_id string, ticker string, date date, chunk_text string"
    lengths = lambda: lambda texts: np.array([[len(t)] for t in texts])

    def arrive(*ids):
        spark.createDataFrame([(i, "T", DAY, f"text {i}") for i in ids], chunk).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(chunk).parquet(str(source))
        encoding.encode_arrivals(stream, store, lengths, "m", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    arrive("a", "b", "a")
    run()
    arrive("b", "c")
    run()
    # As after a failure between the store's commit and the stream's: the last batch comes again.
    for f in sorted((tmp_path / "checkpoint" / "commits").iterdir()):
        if f.name.lstrip(".").startswith("1"):
            f.unlink()
    run()
    assert sorted(r["chunk_id"] for r in store.load().collect()) == ["a", "b", "c"] and len(store.table.entries()) == 2
    assert not encoding.encode_batch(spark.createDataFrame([("z", "T", DAY, "z")], chunk), "encode-000000000001", store, lengths, "m")
