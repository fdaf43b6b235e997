import datetime
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.streaming import ledger as l
from quarry.streaming import timers as t
from quarry.streaming.watch import files_stream


class Stopped(Exception):
    pass


def run(spark, inbox, checkpoint, each):
    """Runs a watch over all that is there; each file of the inbox is a batch of its own."""
    s = files_stream(spark, inbox, max_files=1).withColumn("mtime", F.unix_micros("mtime"))
    q = s.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()


@pytest.mark.parametrize("stop_at", ["before work", "after half of the work", "after work", "after commit", None])
def test_each_file_once_whenever_it_stops(spark, tmp_path, stop_at):
    """Outputs land in the watched folder itself; the run stops in the second batch, and starts again."""
    inbox, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    os.makedirs(inbox)
    for k, name in enumerate("abc"):
        path = f"{inbox}/{name}.txt"
        with open(path, "w") as f:
            f.write(name * 10)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    ledger, stops, worked = l.Ledger(spark, str(tmp_path / "ledger"), merge_every=2), {"left": 1 if stop_at else 0}, []

    def stop(number, where):
        if stops["left"] and number == 1 and where == stop_at:
            stops["left"] = 0
            raise Stopped(where)

    def each(batch, number):
        def work(rows, folder):
            stop(number, "before work")
            found = rows.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
            if stops["left"] and number == 1 and stop_at == "after half of the work":
                found.limit(1).write.mode("overwrite").json(folder)
                stop(number, stop_at)
            worked.extend((number, r["name"]) for r in found.collect())
            found.write.mode("overwrite").json(folder)
            stop(number, "after work")

        l.exactly_once(ledger, work, f"{inbox}/out")(batch, number)
        stop(number, "after commit")

    for _ in range(4):
        try:
            run(spark, inbox, checkpoint, each)
        except Exception as e:
            assert "Stopped" in str(e)
    assert stops["left"] == 0
    results = sorted(json.loads(x)["name"] for d, _, names in os.walk(f"{inbox}/out") for n in names if n.startswith("part-") for x in open(f"{d}/{n}"))
    assert results == ["a.txt", "b.txt", "c.txt"]
    assert {name for _, name in worked} == {"a.txt", "b.txt", "c.txt"}
    assert len(worked) == (4 if stop_at == "after work" else 3)
    own = {os.path.basename(r["path"]) for r in ledger.outputs().collect()}
    assert own == {n for d, _, names in os.walk(f"{inbox}/out") for n in names if n.startswith("part-")}
    assert any(n.startswith("upto-") for n in os.listdir(tmp_path / "ledger"))


def test_a_replaced_output_is_new(spark, tmp_path):
    ledger = l.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.outputs().count() == 0 and not ledger.has(0)
    ledger.commit(0, spark.createDataFrame([("x", 1, 5), ("y", 1, 5)], l.VERSION))
    ledger.commit(1, spark.createDataFrame([("x", 2, 9)], l.VERSION))
    seen = spark.createDataFrame([("x", 1, 5, "a"), ("x", 2, 9, "b"), ("y", 1, 5, "c"), ("y", 1, 6, "d"), (None, 1, 5, "e")], l.VERSION + ", more string")
    assert sorted(r["more"] for r in ledger.fresh(seen).collect()) == ["a", "d", "e"]
    assert ledger.has(1) and not ledger.has(2)
    os.remove(tmp_path / "ledger" / "batch-1" / "_SUCCESS")  # a table that was not finished is not there
    assert not ledger.has(1) and {(r["path"], r["length"]) for r in ledger.outputs().collect()} == {("x", 1), ("y", 1)}


W = t.Waits(settle=2_000, zero_wait=30_000, retry=10_000)


def log(rows):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    return [(p, start + datetime.timedelta(seconds=s), n, m, z, f) for p, s, n, m, z, f in rows]


def times(df):
    base = 1_704_067_200_000
    return sorted((r["path"], r["length"], r["attempt"], (r["ready_ms"] - base) / 1000) for r in df.collect())


def test_rules(spark):
    rows = [
        ("settles", 0, 1, 1, False, False), ("settles", 1.5, 1, 1, False, False),
        ("grows", 0, 1, 1, False, False), ("grows", 1, 2, 2, False, False), ("grows", 2.5, 3, 3, False, False),
        ("zeros", 0, 9, 1, True, False), ("data comes", 0, 9, 1, True, False), ("data comes", 12, 9, 1, False, False), ("data comes soon", 0, 9, 1, True, False), ("data comes soon", 1, 9, 1, False, False),
        ("fails", 0, 1, 1, False, False), ("fails", 3, 1, 1, None, True), ("fails", 14, 1, 1, None, True), ("fails", 30, 1, 1, False, False),
        ("changes after failing", 0, 1, 1, False, False), ("changes after failing", 3, 1, 1, None, True), ("changes after failing", 5, 2, 2, False, False),
        ("comes back", 0, 1, 1, False, False), ("comes back", 5, 2, 2, False, False), ("comes back", 9, 1, 1, False, False),
        ("failed unseen", 0, 1, 1, None, True), (None, 0, 1, 1, False, False),
    ]
    assert times(t.ready(spark.createDataFrame(log(rows), t.OBSERVED), W)) == sorted([
        ("settles", 1, 1, 2), ("grows", 3, 1, 4.5), ("zeros", 9, 1, 30), ("data comes", 9, 1, 12), ("data comes soon", 9, 1, 2), ("fails", 1, 1, 2), ("fails", 1, 2, 13),
        ("changes after failing", 1, 1, 2), ("changes after failing", 2, 1, 7), ("comes back", 1, 1, 2), ("comes back", 2, 1, 7),
    ])


def test_long_logs_over_many_batches(spark):
    rng = random.Random(1)
    rows = [(f"p{rng.randrange(40)}", s / 3, rng.randrange(3), rng.randrange(2), rng.random() < 0.2, rng.random() < 0.1) for s in range(3000)]
    df = spark.createDataFrame(log(rows), t.OBSERVED)
    whole = times(t.ready(df, W))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert times(t.ready(df.repartition(9), W)) == whole and len(whole) > 40
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert t.ready(spark.createDataFrame([], t.OBSERVED), W).count() == 0


def test_timers_in_a_stream(spark, tmp_path):
    """Several timers a path fire without new input, and the rows are those of the log form."""
    inbox, waits = tmp_path / "seen", t.Waits(settle=500, zero_wait=6_000, retry=2_000)
    inbox.mkdir()
    base = datetime.datetime.now(datetime.timezone.utc)

    def see(name, rows):
        at = datetime.datetime.now(datetime.timezone.utc)
        text = "".join(json.dumps({"path": p, "at": at.isoformat(), "length": n, "mtime": 1, "zeros": z, "failed": f}) + "\n" for p, n, z, f in rows)
        (tmp_path / name).write_text(text)
        os.rename(tmp_path / name, inbox / name)
        return [(p, at, n, 1, z, f) for p, n, z, f in rows]

    out = t.ready_stream(spark.readStream.schema(t.OBSERVED).json(str(inbox)), waits)
    q = out.writeStream.format("memory").queryName("ready_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        seen = see("1.json", [("plain", 5, False, False), ("zeros", 6, True, False), ("fails", 7, False, False)])

        def wait_for(n, seconds=60):
            end = time.time() + seconds
            while time.time() < end and spark.table("ready_rows").count() < n:
                assert q.isActive, q.exception()
                time.sleep(0.3)

        wait_for(2)
        seen += see("2.json", [("fails", 7, None, True), ("plain", 5, False, False)])
        wait_for(4)
    finally:
        q.stop()
    got = sorted((r["path"], r["length"], r["attempt"]) for r in spark.table("ready_rows").collect())
    assert got == sorted((r["path"], r["length"], r["attempt"]) for r in t.ready(spark.createDataFrame(seen, t.OBSERVED), waits).collect()) == [("fails", 7, 1), ("fails", 7, 2), ("plain", 5, 1), ("zeros", 6, 1)]
    assert base


def ticked(rows, waits, step=250):
    """The rules once more, by looking at every path every ``step`` milliseconds."""
    out = []
    for path in {r[0] for r in rows}:
        seen = {}
        for _, ms, n, m, z, f in rows:
            if _ == path:
                seen.setdefault(ms, []).append((m, n, z, f))
        now, last, version, changed, zeros, tries, again, done = min(seen), max(seen) + 10**6, None, 0, False, 0, None, set()
        while now <= last:
            for m, n, z, f in sorted(seen.get(now, []), key=lambda x: x[:2]):
                if f:
                    if version == (n, m) and tries == 1 and again is None:
                        again = now + waits.retry
                    continue
                if version != (n, m):
                    version, changed, again = (n, m), now, None
                    tries = 2 if version in done else 0
                zeros = bool(z)
            if again is not None and now >= again:
                out.append((path, *version, 2, now))
                again, tries = None, 2
            if version and tries == 0 and now >= changed + (waits.zero_wait if zeros else waits.settle):
                out.append((path, *version, 1, now))
                tries = 1
                done.add(version)
            now += step
    return sorted(out)


def test_equals_a_look_at_every_tick(spark):
    rng = random.Random(9)
    waits, base = t.Waits(settle=1_000, zero_wait=5_000, retry=2_500), 1_704_067_200_000
    rows = [(f"p{rng.randrange(12)}", ms := 250 * rng.randrange(400), ms // 15_000 % 4, int(rng.random() < 0.04), rng.random() < 0.3, rng.random() < 0.25) for _ in range(900)]
    rows = [r for i, r in enumerate(rows) if (r[0], r[1]) not in {(q[0], q[1]) for q in rows[:i]}]
    df = spark.createDataFrame(log([(p, ms / 1000, n, m, z, f) for p, ms, n, m, z, f in rows]), t.OBSERVED)
    got = sorted((r["path"], r["length"], r["mtime"], r["attempt"], r["ready_ms"] - base) for r in t.ready(df, waits).collect())
    assert got == ticked(rows, waits) and len(got) > 30 and any(r[3] == 2 for r in got)
