"""Catalogue ingest with keyed state: restart, late rows, replay, and reads that do not grow with batches."""

import json
import os

from pyspark.sql import functions as F

from seriesmith.streaming import stream as st

SCHEMA = "path string, length long, modified long"


def rows(df):
    return {(r.path, r.length, r.modified) for r in df.collect()}


def run(spark, src, root):
    st.incremental_ingest(spark, spark.readStream.schema(SCHEMA).json(src), root).awaitTermination()


def put(src, name, *values):
    os.makedirs(src, exist_ok=True)
    with open(os.path.join(src, name), "w") as f:
        f.writelines(json.dumps(dict(zip(("path", "length", "modified"), v, strict=True))) + "\n" for v in values)


def test_restart_late_rows_and_ties(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    put(src, "1.json", ("a", 1, 10), ("a", 2, 11), ("b", 1, 5), (None, 7, 1))
    run(spark, src, root)
    assert rows(st.read_catalog(spark, root)) == {("a", 2, 11), ("b", 1, 5), (None, 7, 1)}
    put(src, "2.json", ("a", 9, 3), ("b", 2, 5), ("c", None, None))  # late row, equal time, no time
    run(spark, src, root)
    assert rows(st.read_catalog(spark, root)) == {("a", 2, 11), ("b", 2, 5), (None, 7, 1), ("c", None, None)}
    assert rows(st.read_changes(spark, root, 1)) == {("a", 2, 11), ("b", 2, 5), ("c", None, None)}
    run(spark, src, root)  # nothing new
    assert st.read_catalog(spark, root).count() == 4


def test_replay_of_a_batch(spark, tmp_path):
    """A batch whose commit is lost runs again on the state before it: same catalogue, same changes."""
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    put(src, "1.json", ("a", 1, 1))
    run(spark, src, root)
    put(src, "2.json", ("a", 2, 2), ("b", 1, 1))
    run(spark, src, root)
    want, changes = rows(st.read_catalog(spark, root)), rows(st.read_changes(spark, root, 1))
    for name in ("1", ".1.crc"):
        os.remove(os.path.join(root, "checkpoint", "commits", name))
    run(spark, src, root)
    assert rows(st.read_catalog(spark, root)) == want and rows(st.read_changes(spark, root, 1)) == changes


def test_reading_does_not_grow_with_batches(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    tasks = []
    for k in range(4):
        put(src, f"{k}.json", ("a", k, k), ("b", k, k))
        run(spark, src, root)
        got = st.read_catalog(spark, root)
        tasks.append(got.rdd.getNumPartitions())
        assert rows(got) == {("a", k, k), ("b", k, k)}
    assert len(set(tasks)) == 1 and tasks[0] == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.conf.get(st.PROVIDER) != st.ROCKSDB
    assert st.read_catalog(spark, root).where(F.col("path") == "a").count() == 1
