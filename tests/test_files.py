"""Headers of many files in one job, and the keyed merge that rewrites touched buckets only."""

import os

from salestide.sources import files


def test_headers_of_all_files_in_one_job(spark, tmp_path):
    for i in range(12):
        lines = ["a,\"b, c\",d", f"{i},x,y"] if i % 2 else ["d,a", f"{i},z"]
        (tmp_path / f"part {i}.csv").write_text("\n".join(lines) + "\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "")
    layouts = files._layouts(spark, str(tmp_path), "*.csv")
    spark.sparkContext.setJobGroup("", "")
    assert {k: len(v) for k, v in layouts.items()} == {("a", "b, c", "d"): 6, ("d", "a"): 6}
    # one query, whose shuffles are jobs of their own; not one per file
    assert len(tracker.getJobIdsForGroup("headers")) <= 4
    got = sorted((r["a"], r["b, c"], r["d"]) for r in files.read_yearly(spark, str(tmp_path)).collect())
    assert len(got) == 12 and ("1", "x", "y") in got and ("z", None, "0") in got


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "table")
    old = [(f"p{i}", i, "old") for i in range(200)]
    files.write_keyed(spark.createDataFrame(old, "product_id string, n int, v string"), path, buckets=16)
    before = _files(path)
    new = [("p3", 3, "new"), ("p3", 2, "older"), ("q1", 1, "new"), (None, 0, "nobody's")]
    incoming = spark.createDataFrame(new, "product_id string, n int, v string")
    counts = {r["action"]: r["rows"] for r in files.merge_keyed(spark, path, incoming, buckets=16).collect()}
    assert counts == {"kept": 199, "updated": 1, "created": 1, "rejected": 1}
    after = _files(path)
    changed = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert 1 <= len(changed) <= 2 and len(set(before) & set(after)) >= len(before) - 2
    table = sorted(tuple(r) for r in files.read_keyed(spark, path).select("product_id", "n", "v").collect())
    assert table == sorted([r for r in old if r[0] != "p3"] + [("p3", 3, "new"), ("q1", 1, "new")])
    # a rerun gives the same table
    again = {r["action"]: r["rows"] for r in files.merge_keyed(spark, path, incoming, buckets=16).collect()}
    assert again == {"kept": 199, "updated": 2, "rejected": 1}
    assert sorted(tuple(r) for r in files.read_keyed(spark, path).select("product_id", "n", "v").collect()) == table
    assert {r["action"]: r["rows"] for r in files.merge_keyed(spark, path, incoming.where("n > 9"), buckets=16).collect()} == {"kept": 201, "rejected": 0}
