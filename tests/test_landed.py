"""The landed source: a partition a provider, pushed windows, failures as rows, a stream that reads each file once."""

import json

from pyspark.sql import functions as F

from newsgauge.sources import landed


def land(root, company, provider, name, payload):
    folder = root / f"company={company}" / f"provider={provider}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(payload if isinstance(payload, str) else json.dumps(payload))


def items(*days):
    return {"items": [{"url": f"https://a.example/{d}", "title": f"t{d}", "published_at": f"2026-07-{d:02}T00:00:00Z"} for d in days]}


def fill(root):
    land(root, 1, "feed", "001.json", items(1, 10, 20))
    land(root, 1, "wire", "001.json", {"error": "timeout"})
    land(root, 2, "feed", "001.json", "{broken")
    land(root, 2, "feed", "002.json", {"items": [{"url": "u", "title": None, "published_at": "soon"}, "x"]})
    land(root, 3, "feed", "001.json", {"items": []})


def test_failures_are_rows(spark, tmp_path):
    fill(tmp_path)
    landed.register(spark)
    rows = spark.read.format("landed").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4
    got = sorted((r["company_id"], r["provider"], r["file"], r["position"] if r["position"] is not None else -1, r["url"], (r["error"] or "")[:10]) for r in rows.collect())
    assert got == [
        ("1", "feed", "001.json", 0, "https://a.example/1", ""), ("1", "feed", "001.json", 1, "https://a.example/10", ""),
        ("1", "feed", "001.json", 2, "https://a.example/20", ""), ("1", "wire", "001.json", -1, None, "timeout"), ("2", "feed", "001.json", -1, None, "unreadable"),
        ("2", "feed", "002.json", 0, "u", ""), ("2", "feed", "002.json", 1, None, "no item"),
    ]
    said = {(r["company_id"], r["provider"]): (r["items"], r["failures"], r["ok"]) for r in landed.health(rows).collect()}
    assert said == {("1", "feed"): (3, 0, True), ("1", "wire"): (0, 1, False), ("2", "feed"): (1, 2, False)}


def test_windows_and_names_are_pushed(spark, tmp_path):
    fill(tmp_path)
    landed.register(spark)
    rows = spark.read.format("landed").load(str(tmp_path)).where("company_id = '1' AND published_at >= timestamp'2026-07-05' AND published_at < timestamp'2026-07-20'")
    assert [r["url"] for r in rows.collect()] == ["https://a.example/10"] and rows.rdd.getNumPartitions() == 2
    plan = rows._jdf.queryExecution().toString()
    assert "published_at" in plan.split("BatchScan")[-1]
    window = landed.Window()
    assert window.take(landed.EqualTo(("company_id",), "1")) and not window.take(landed.EqualTo(("title",), "x"))


def test_an_absent_folder_is_empty(spark, tmp_path):
    landed.register(spark)
    assert spark.read.format("landed").load(str(tmp_path / "none")).count() == 0


def test_a_stream_reads_each_file_once(spark, tmp_path):
    root = tmp_path / "in"
    fill(root)
    landed.register(spark)

    def go():
        rows = spark.readStream.format("landed").load(str(root)).select("company_id", "file", "url", "error")
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        query.start(str(tmp_path / "out")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).groupBy("company_id").agg(F.count("*").alias("n"))

    assert {r["company_id"]: r["n"] for r in go().collect()} == {"1": 4, "2": 3}
    land(root, 2, "feed", "003.json", items(3))
    land(root, 9, "wire", "001.json", items(4, 5))
    assert {r["company_id"]: r["n"] for r in go().collect()} == {"1": 4, "2": 4, "9": 2}
