"""The requirement source: shards as partitions, bounds, another connector, a stream over several arrivals."""

import json

from skein.sources import requirements as Q
from skein.streaming.traces import appended


class Counting:
    """A connector of two shards that makes its items up; used by name."""

    def __init__(self, options):
        self.n = int(options["n"])

    def shards(self):
        return ["even", "odd"]

    def latest(self):
        return self.n

    def pull(self, shard, after, upto):
        return ({"seq": i, "item_id": f"r{i}", "title": "t" * 3} for i in range(1, self.n + 1) if after < i <= upto and (i % 2 == 0) == (shard == "even"))


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows) + "\n")


def items(lo, hi):
    return [{"seq": i, "item_id": f"r{i}", "project_id": "p", "title": "Títle", "body": "b" * 3000, "status": None, "other": 1} for i in range(lo, hi)]


def test_folder(spark, tmp_path):
    Q.register(spark)
    put(tmp_path / "in", "a.json", items(1, 900))
    put(tmp_path / "in", "b.json", items(900, 1001) + [{"item_id": "without number"}])
    put(tmp_path / "in", "c.json", [])
    read = spark.read.format("requirements").option("path", f"file://{tmp_path}/in")
    got = read.load()
    assert got.rdd.getNumPartitions() == 3
    assert sorted((r.seq, r.item_id, r.title, len(r.body), r.status) for r in got.collect()) == [(i, f"r{i}", "Títle", 3000, None) for i in range(1, 1001)]
    assert sorted(r.seq for r in read.option("after", "890").option("upto", "910").load().collect()) == list(range(891, 911))
    assert spark.read.format("requirements").option("path", f"file://{tmp_path}/none").load().collect() == []


def test_other_connector(spark):
    Q.register(spark)
    got = spark.read.format("requirements").option("connector", "tests.test_requirements:Counting").option("n", "7").load()
    assert sorted((r.seq, r.item_id, r.body) for r in got.collect()) == [(i, f"r{i}", None) for i in range(1, 8)]


def test_stream_pulls_what_changed(spark, tmp_path):
    """A second run from the same checkpoint takes up where the first ended."""
    Q.register(spark)
    put(tmp_path / "in", "a.json", items(1, 40))
    stream = spark.readStream.format("requirements").option("path", f"file://{tmp_path}/in").load().select("seq", "item_id")
    assert sorted(r.seq for r in appended(stream, "pull").rows.collect()) == list(range(1, 40))
    out = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/at")
    out.trigger(availableNow=True).start().awaitTermination()
    put(tmp_path / "in", "b.json", items(40, 60))
    out.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == list(range(1, 60))
