"""The data source of receipt lines: round trips in batches and streams, nothing from what failed."""

import json
import os

import pytest
from pyspark.sql import functions as F

from veritrail.sources import lines


@pytest.fixture()
def source(spark):
    lines.register(spark)
    return spark


def receipts(spark, n, start=0):
    at = F.timestamp_seconds(F.lit(1_900_000_000) + F.col("id") * 20_000)
    return spark.range(start, start + n, 1, 3).select(F.format_string('{"receipt_id":"r%d"}', "id").alias("receipt"), at.alias("issued_at"))


def save(df, path, **options):
    df.write.format("receipts").mode("append").options(path=str(path), **options).save()


def read(spark, path):
    return [(r.path, r.at, r.receipt) for r in spark.read.format("receipts").load(str(path)).orderBy("path", "at").collect()]


def ids(rows):
    return sorted(int(json.loads(t)["receipt_id"][1:]) for *_, t in rows)


def test_round_trip_by_day(source, tmp_path):
    save(receipts(source, 40), tmp_path / "out")
    save(receipts(source, 5, 40), f"file://{tmp_path}/out", prefix="late")
    rows = read(source, tmp_path / "out")
    assert ids(rows) == list(range(45))
    for path, at, text in rows:
        i = int(json.loads(text)["receipt_id"][1:])
        day = source.sql(f"SELECT date_format(timestamp_seconds({1_900_000_000 + i * 20_000}), 'yyyy-MM-dd')").first()[0]
        assert os.path.basename(os.path.dirname(path)) == f"{'late' if i >= 40 else 'receipts'}-{day}"
        with open(path, "rb") as f:
            f.seek(at)
            assert f.readline().decode().rstrip("\n") == text
        assert os.stat(path).st_mode & 0o777 == 0o600


def test_a_failed_task_leaves_no_line(source, tmp_path):
    save(receipts(source, 6), tmp_path / "out")
    broken = receipts(source, 30, 6).withColumn("receipt", F.when(F.get_json_object("receipt", "$.receipt_id") == "r33", F.lit("two\nlines")).otherwise(F.col("receipt")))
    with pytest.raises(Exception, match="one line"):
        save(broken, tmp_path / "out")
    assert ids(read(source, tmp_path / "out")) == list(range(6)) and lines.orphans(str(tmp_path / "out")) == []


def test_streams_write_once(source, tmp_path):
    save(receipts(source, 10), tmp_path / "in")

    def run(checkpoint):
        stream = source.readStream.format("receipts").load(str(tmp_path / "in")).withColumn("issued_at", F.timestamp_seconds(F.lit(1_900_000_000)))
        query = stream.writeStream.format("receipts").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()

    run("a")
    assert ids(read(source, tmp_path / "out")) == list(range(10))
    save(receipts(source, 7, 10), tmp_path / "in")
    run("a")
    assert ids(read(source, tmp_path / "out")) == list(range(17))
    run("b")  # the same batches once more, as after a crash between commit and checkpoint
    assert len([r for r in read(source, tmp_path / "out") if "r3\"" in r[2]]) == 1 and lines.orphans(str(tmp_path / "out")) == []


def test_paths(source, tmp_path, monkeypatch):
    (tmp_path / "d" / "b").mkdir(parents=True)
    (tmp_path / "d" / "_hidden").mkdir()
    for name, text in {"d/2.jsonl": '{"a":2}\n\n{"a":3}', "d/1.json": '{"a":1}\r\n', "d/b/0.jsonl": '{"a":4}\n', "d/x.txt": "no", "d/_hidden/9.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    assert [t for *_, t in read(source, tmp_path / "d")] == ['{"a":1}', '{"a":2}', '{"a":3}', '{"a":4}']
    assert [(a, t) for _, a, t in read(source, tmp_path / "d" / "2.jsonl")] == [(0, '{"a":2}'), (9, '{"a":3}')]
    assert [t for *_, t in read(source, f"{tmp_path}/d/*.jsonl")] == ['{"a":2}', '{"a":3}']
    for bad in ("none", "none*.json"):
        with pytest.raises(Exception, match="nothing to read"):
            read(source, tmp_path / bad)


def test_parts_share_no_line(tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "PART_BYTES", 7)
    for text in ("a\nbb\nccccccccccccccccccc\n\nd\neeeeee\nf", "\n\n", "x" * 30, "1234567\n1234567\n", "123456\n1\n"):
        (tmp_path / "f.jsonl").write_text(text)
        parts = lines.Reader(str(tmp_path / "f.jsonl")).partitions()
        got = [x for p in parts for b in lines._lines(lines.pafs.LocalFileSystem(), p) for x in b.column("receipt").to_pylist()]
        assert got == [x for x in text.split("\n") if x]


def test_refusals(source, tmp_path):
    os.symlink(tmp_path / "elsewhere", tmp_path / "link")
    (tmp_path / "elsewhere").mkdir()
    with pytest.raises(Exception, match="symbolic link"):
        save(receipts(source, 3), tmp_path / "link")
    assert os.listdir(tmp_path / "elsewhere") == []
    with pytest.raises(Exception, match="plain name"):
        save(receipts(source, 3), tmp_path / "out", prefix="../x")
    with pytest.raises(Exception, match="columns are missing"):
        save(receipts(source, 3).drop("issued_at"), tmp_path / "out")
