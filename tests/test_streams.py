"""Deliveries, shipping, keyed state and flushed counters as streams, batch by batch."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lipiflow.functions.scores import HALF_LIFE_DAYS
from lipiflow.operators.personal import decayed_counts
from lipiflow.sources import shipping
from lipiflow.streaming import keyed, receipt

DELIVERY = "install string, stream string, seq string, body string"
A, B = "a" * 8, "0123456789abcdef"


def deliver(spark, tmp_path, rows):
    spark.createDataFrame(rows, DELIVERY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    receipt.receive(spark.readStream.schema(DELIVERY).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "offsets"))


def test_deliveries_are_stored_once_and_bad_ones_refused(spark, tmp_path):
    good, two = '{"h": 1}\n\n{"h": 2}\n', '{"x": 1}'
    deliver(spark, tmp_path, [(A, "events", "1", good), (A, "events", "1", good), (B, "metrics", "7", two)])
    deliver(spark, tmp_path, [(A, "events", "1", "{}"), (A, "events", "2", two), (A, "metrics", "1", two)])  # the first came before
    bad = [("short", "events", "1", two), (A, "other", "1", two), (A, "events", "-1", two), (A, "events", "3", "[1]"), (A, "events", "3", ""), (A, "events", "3", "{"), (None, "events", "1", two), (A, "events", "4", None), (A, "events", "5", "{}" + " " * (1 << 20))]
    deliver(spark, tmp_path, bad)
    rows = sorted((r.install, r.stream, r.seq) for r in receipt.chunks(spark, str(tmp_path / "store")).collect())
    assert rows == [(B, "metrics", 7), (A, "events", 1), (A, "events", 1), (A, "events", 2), (A, "metrics", 1)]
    counts = [tuple(r) for r in spark.read.parquet(str(tmp_path / "store" / "receipts")).select("refused", "duplicate", "stored").orderBy("batch").collect()]
    assert counts == [(0, 1, 2), (0, 1, 2), (9, 0, 0)]
    receipt.forget_install(spark, str(tmp_path / "store"), A)
    assert {r.install for r in receipt.chunks(spark, str(tmp_path / "store")).collect()} == {B}
    deliver(spark, tmp_path, [(A, "events", "1", good)])  # a late copy of what was forgotten
    assert receipt.chunks(spark, str(tmp_path / "store")).count() == 1


def test_a_batch_that_runs_again_stores_the_same(spark, tmp_path):
    batch = spark.createDataFrame([(A, "events", str(i), "{}") for i in range(5)], DELIVERY)
    for _ in range(2):
        assert tuple(receipt.take(batch, 3, str(tmp_path)).first()) == (3, 0, 0, 5)
    assert receipt.chunks(spark, str(tmp_path)).count() == 5


def test_only_the_parts_of_a_batch_are_read(spark, tmp_path):
    installs = [f"{i:08x}" for i in range(64)]
    receipt.take(spark.createDataFrame([(i, "events", "1", "{}") for i in installs], DELIVERY), 0, str(tmp_path))
    part = spark.range(1).select(receipt.part_of(F.lit(installs[0]))).first()[0]
    known = receipt.stored_keys(spark, str(tmp_path), [part], 1)
    plan = known._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") : plan.index("], PushedFilters")]
    mine = sum(spark.range(1).select(receipt.part_of(F.lit(i))).first()[0] == part for i in installs)
    assert known.count() == mine < len(installs) and f"= {part})" in filters and "batch#" in filters


class Boom(Exception):
    pass


def ship(spark, tmp_path, got, most=64, fail=False):
    stream = shipping.shipments(spark, (tmp_path / "logs").as_uri(), most)

    def put(batch, _):
        rows = [(os.path.basename(r.path), r.seq, r.body) for r in batch.collect()]
        if fail:
            raise Boom
        got.extend(sorted(rows))

    stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()


def test_growing_files_are_shipped_in_whole_lines(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    log, other = tmp_path / "logs/events.jsonl", tmp_path / "logs/metrics.jsonl"
    lines = [json.dumps({"n": i}) + "\n" for i in range(30)]
    log.write_text("".join(lines) + '{"torn')
    other.write_text("{}\n")
    got = []
    ship(spark, tmp_path, got)
    events = [r for r in got if r[0] == "events.jsonl"]
    assert "".join(b for *_, b in events) == "".join(lines) and all(b.endswith("\n") and len(b) <= 64 for *_, b in events)
    assert [s for _, s, _ in events] == list(range(1, len(events) + 1)) and ("metrics.jsonl", 1, "{}\n") in got
    log.write_text("".join(lines) + '{"torn": 1}\nx\n')
    with pytest.raises(Exception):  # noqa: B017
        ship(spark, tmp_path, got, fail=True)
    before = list(got)
    ship(spark, tmp_path, got)
    assert got[len(before) :] == [("events.jsonl", len(events) + 1, '{"torn": 1}\nx\n')]
    log.write_text("new\n")  # another file by that name: from its beginning, numbers rise
    ship(spark, tmp_path, got)
    assert got[-1] == ("events.jsonl", len(events) + 2, "new\n")


def test_cut_points_read_little():
    import io

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    text = b"".join(b"x" * random.Random(i).randint(0, 300) + b"\n" for i in range(20_000))
    f = Counted(text)
    cuts = shipping.cut_points(f, 0, len(text))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and all(b - a <= shipping.MAX_CHUNK_BYTES and text[b - 1] == 10 for a, b in cuts)
    assert f.taken <= 4096 * len(cuts)
    assert shipping.cut_points(io.BytesIO(b"y" * 100), 0, 100, 50) == [] and shipping.cut_points(io.BytesIO(b"a\n" + b"y" * 100), 0, 102, 50) == [(0, 2)]


def test_learning_and_forgetting_as_a_stream(spark, tmp_path):
    schema, rng = "install long, roman string, word string, t double, forget boolean", random.Random(3)
    day, log = 86400.0, []
    commit = lambda t: (rng.randint(1, 3), rng.choice("ab"), rng.choice("xy"), t, rng.choice([False, None]))
    batches = [[commit(rng.uniform(0, 40) * day) for _ in range(30)], [commit(rng.uniform(0, 60) * day) for _ in range(30)]]  # the second has late ones
    batches.append([(2, None, None, 70 * day, True), (2, "a", "x", 65 * day, False), (2, "a", "x", 71 * day, False), (1, "a", "x", 65 * day, False)])
    batches.append([(2, "b", "y", 69 * day, False), (2, "b", "y", 80 * day, False)])  # the first is hidden by the forgetting
    for rows in batches:
        log += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        keyed.learn(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"))
    got = {(r.install, r.roman, r.word): (r["count"], r["last"]) for r in keyed.learned(spark, str(tmp_path / "state")).collect()}
    kept = [r for r in log if not r[4] and not (r[0] == 2 and r[3] <= 70 * day)]
    now = 90 * day
    want = decayed_counts(spark.createDataFrame(kept, schema), ["install", "roman", "word"], now)
    rate = math.log(2) / (HALF_LIFE_DAYS * day)
    assert {k: pytest.approx(c * math.exp(-rate * (now - last))) for k, (c, last) in got.items()} == {(r.install, r.roman, r.word): r["count"] for r in want.collect()}
    assert {k[0] for k in got} == {1, 2, 3}


def test_counters_leave_after_twenty_words(spark, tmp_path):
    schema, rng = "install long, h string, ts double, top1_taken boolean, retyped boolean, flush boolean", random.Random(5)
    out, log = str(tmp_path / "out"), []
    for n in (7, 50, 90, 3):
        rows = [(rng.randint(1, 2), f"h{t // 100:02}", float(t), rng.random() < 0.5, rng.random() < 0.2, None) for t in (rng.randint(len(log), len(log) + 250) for _ in range(n))]
        log += rows
        ends = [(i, None, None, None, None, True) for i in (1, 2)] if n == 3 else []
        spark.createDataFrame(rows + ends, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with keyed.on_disk(spark):
            q = keyed.flushed(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "offsets"))
            q.trigger(availableNow=True).start(out).awaitTermination()
    parts = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert all(0 < r[2] <= keyed.FLUSH_EVERY for r in parts) and max(r[2] for r in parts) == keyed.FLUSH_EVERY
    sums, want = {}, {}
    for i, h, *c in parts:
        sums[i, h] = [a + b for a, b in zip(sums.get((i, h), [0, 0, 0]), c)]
    for i, h, _, top, again, _ in log:
        want[i, h] = [a + b for a, b in zip(want.get((i, h), [0, 0, 0]), [1, top, again])]
    assert sums == want


def test_words_without_an_hour_are_counted(spark, tmp_path):
    schema = "install long, h string, ts double, top1_taken boolean, retyped boolean, flush boolean"
    rows = [(i, h, float(t), True, False, None) for i in range(300) for t, h in enumerate(["h1", None, None])] + [(i, None, None, None, None, True) for i in range(300)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    with keyed.on_disk(spark):
        q = keyed.flushed(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "offsets"))
        q.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.h is None) == [(i, None, 2, 2, 0) for i in range(300)]


def test_words_without_letters_are_learned(spark, tmp_path):
    commits = "install long, roman string, word string, t double, forget boolean"
    spark.createDataFrame([(1, None, "x", 5.0, False), (1, "a", None, 5.0, False), (1, "a", None, 5.0, False)], commits).coalesce(1).write.parquet(str(tmp_path / "commits"))
    keyed.learn(spark.readStream.schema(commits).parquet(str(tmp_path / "commits")), str(tmp_path / "state"))
    assert {(r.roman, r.word, r["count"]) for r in keyed.learned(spark, str(tmp_path / "state")).collect()} == {(None, "x", 1.0), ("a", None, 2.0)}
