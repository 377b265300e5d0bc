"""Requests that are delivered again, retried and replayed; versions that are replaced under their readers."""

import hashlib
import json
import threading

import pytest
from pyspark.sql import functions as F

from quillspark.sources import snapshots, versions
from quillspark.streaming import requests


def send(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def by_url(df):
    """``flaky`` works from the second attempt on, ``down`` never, ``bad`` fails for good."""
    failure = F.when((F.col("url") == "down") | ((F.col("url") == "flaky") & (F.col("attempt") < 2)), "TRANSIENT_DOWNLOAD").when(F.col("url") == "bad", "NO_TEXT_FOUND")
    return df.withColumns({"body": F.concat(F.lit("read "), F.col("url")), "failure": failure})


def answers(results):
    rows = [tuple(r) for r in results.select("id", "status", "code", "retryable", "attempts", "body").collect()]
    assert len(rows) == len({r[0] for r in rows}), rows
    return {r[0]: r[1:] for r in rows}


ALL = {
    "a": ("ok", None, False, 1, "read x"),
    "b": ("ok", None, False, 2, "read flaky"),
    "c": ("error", "TRANSIENT_DOWNLOAD", True, 3, None),
    "d": ("error", "NO_TEXT_FOUND", False, 1, None),
}


def test_ids_delivered_again_are_answered_once(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    send(source, "1.json", {"id": "a", "url": "x"}, {"id": "b", "url": "flaky"}, {"id": "a", "url": "x"}, "{bad", {"id": "", "url": "x"})
    send(source, "2.json", {"id": "c", "url": "down"}, {"id": "a", "url": "y"}, {"id": "d", "url": "bad", "attempt": 9}, {"id": "e"})
    results, dead = requests.run_requests(spark, str(source), out, checkpoint, by_url)
    assert answers(results) == ALL
    assert sorted(r["error"] for r in dead.collect()) == ["INVALID_JSON", "MISSING_ID", "MISSING_URL"]
    # Another run, with ids of the first: they are still known, what is new is answered.
    send(source, "3.json", {"id": "b", "url": "x"}, {"id": "f", "url": "x"}, {"id": "c", "url": "x"})
    results, dead = requests.run_requests(spark, str(source), out, checkpoint, by_url)
    assert answers(results) == ALL | {"f": ("ok", None, False, 1, "read x")} and dead.count() == 3


@pytest.mark.parametrize("kind", ["results", "dead", "retry"])
def test_a_batch_that_dies_before_its_commit_is_replayed(spark, tmp_path, kind):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    send(source, "1.json", {"id": "a", "url": "x"}, {"id": "b", "url": "flaky"}, "{bad")
    send(source, "2.json", {"id": "c", "url": "down"}, {"id": "d", "url": "bad"}, {"id": "b", "url": "flaky"})
    fail = [True]

    def write(df, out, what, number):
        requests.write_batch(df, out, what, number)
        if what == kind and fail and number == 1:
            fail.clear()
            raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        requests.run_requests(spark, str(source), out, checkpoint, by_url, write=write)
    results, dead = requests.run_requests(spark, str(source), out, checkpoint, by_url, write=write)
    assert answers(results) == ALL and [r["error"] for r in dead.collect()] == ["INVALID_JSON"]


def test_no_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    results, dead = requests.run_requests(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), by_url)
    assert results.count() == 0 and dead.count() == 0


# -- versions -------------------------------------------------------------------------------------


def rows(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in values], "k int, v string")


def test_readers_see_one_version_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.current(spark, root) is None
    versions.publish(rows(spark, (1, "a"), (2, "b")), root, None)
    old = versions.read(spark, root)
    said = versions.update(spark, root, lambda now: snapshots.upsert(now, rows(spark, (2, "c"), (3, "d")), ["k"]))
    assert said["number"] == 1 and said["rows"] == 3
    assert sorted(map(tuple, old.collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, versions.read(spark, root).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, versions.read(spark, root, 0).collect())) == [(1, "a"), (2, "b")]


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.publish(rows(spark, (1, "a")), root, None)
    versions.publish(rows(spark, (1, "b")), root, 0)
    with pytest.raises(versions.Conflict):
        versions.publish(rows(spark, (1, "c")), root, 0)
    assert versions.current(spark, root)["number"] == 1 and versions.read(spark, root).first()["v"] == "b"
    assert len(list((tmp_path / "t" / "versions").iterdir())) == 2  # the loser's folder is gone
    # Several at once: every change is there in the end, none is lost.
    threads = [threading.Thread(target=versions.update, args=(spark, root, lambda now, k=k: now.unionByName(rows(spark, (k, "x"))), 20)) for k in (10, 11, 12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r["k"] for r in versions.read(spark, root).collect()} == {1, 10, 11, 12} and versions.current(spark, root)["number"] == 4


def test_a_writer_that_fails_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.publish(rows(spark, (1, "a")), root, None)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        versions.update(spark, root, lambda now: now.withColumn("k", F.col("k") / F.lit(0)))
    assert versions.current(spark, root)["number"] == 0 and versions.read(spark, root).count() == 1
    versions.update(spark, root, lambda now: now)
    versions.update(spark, root, lambda now: now)
    assert versions.prune(spark, root, keep=1) >= 2 and versions.read(spark, root).count() == 1
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))


def tree(lines, leaf):
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in sorted(lines)]
    while True:
        hashes = [hashlib.sha256("".join(hashes[i : i + leaf]).encode()).hexdigest() for i in range(0, len(hashes), leaf)]
        if len(hashes) <= 1:
            return hashes[0]


@pytest.mark.parametrize("leaf", [3, 1024])
def test_digests_follow_the_content_alone(spark, monkeypatch, leaf):
    monkeypatch.setattr(versions, "LEAF", leaf)
    df = spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("v"))
    df = df.unionByName(df.where("k < 5"))
    got = {tuple(versions.tree_digest(d).first()) for d in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("k")).repartition(3, "k"))}
    lines = [json.dumps({"k": k, "v": str(k) if k % 7 else None}, separators=(",", ":")) for k in [*range(50), *range(5)]]
    assert got == {(55, tree(lines, leaf))}
    assert tuple(versions.tree_digest(df.limit(0)).first()) == (0, hashlib.sha256(b"").hexdigest())
    assert versions.tree_digest(df.where("k <> 9")).first()["digest"] != tree(lines, leaf)


def test_of_updates_with_one_key_the_last_counts(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    updates = spark.createDataFrame([(2, "c", 2), (2, "z", 1), (3, "d", 1), (3, "d", 1)], "k int, v string, at int")
    assert sorted(tuple(r) for r in snapshots.upsert(base, updates, ["k"], ["at"]).collect()) == [(1, "a", 0), (2, "c", 2), (3, "d", 1)]
    assert sorted(tuple(r) for r in snapshots.upsert(base, updates, ["k"]).collect()) == [(1, "a", 0), (2, "z", 1), (3, "d", 1)]
