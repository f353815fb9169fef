"""The inbox loses nothing: half-written and rewritten files, bad files among good ones, waiting files without new ones."""

import os
import time

import pytest
from pyspark.sql import functions as F

from accordant.streaming import inbox


class Inbox:
    def __init__(self, spark, tmp_path, **tables):
        self.spark, self.folder, self.events, self.tables, self.got, self.busy = spark, tmp_path / "in", str(tmp_path / "events"), tables, [], set()
        (self.folder / "p").mkdir(parents=True)

    def put(self, name, text, pile="p", at=None):
        (self.folder / pile).mkdir(exist_ok=True)
        path = self.folder / pile / name
        path.write_text(text)
        if at:
            os.utime(path, (at, at))

    def dispatch(self, df):
        texts = sorted(bytes(r.content).decode() for r in df.collect())
        self.got.append(texts)
        if any("bad" in t for t in texts):
            raise ValueError("cannot be read")

    def tick(self, **more):
        busy = lambda: self.spark.createDataFrame([(b,) for b in self.busy], "pile_id string")
        return inbox.tick(self.spark, str(self.folder), self.events, self.dispatch, busy=busy, **self.tables, **more)

    def outcomes(self):
        return sorted((r.filename, r.outcome) for r in inbox.read_events(self.spark, self.events).collect())


@pytest.fixture
def box(spark, tmp_path):
    return Inbox(spark, tmp_path)


def test_a_half_written_file_is_taken_once_and_whole(box):
    box.put("a.txt", "first ha", at=1000)
    box.tick()
    box.put("a.txt", "first half and second", at=1001)  # still being written
    box.tick()
    assert box.got == []
    for _ in range(3):
        box.tick()
    assert box.got == [["first half and second"]] and box.outcomes() == [("a.txt", "dispatched")]


def test_a_rewritten_file_is_new_and_an_unchanged_one_is_not_read_again(box, monkeypatch):
    box.put("a.txt", "one", at=1000)
    box.put("b [1]{x}?.txt", "same", at=1000)
    box.tick(), box.tick()
    box.put("a.txt", "two", at=2000)  # same size
    box.put("c.txt", "same", at=2000)  # a content that was dispatched under another name
    read = []
    monkeypatch.setattr(inbox, "_contents", lambda spark, paths, real=inbox._contents: (read.append(len(paths)), real(spark, paths))[1])
    for _ in range(3):
        box.tick()
    assert box.got == [["one", "same"], ["two"]] and read == [0, 2, 0]


def test_a_bad_file_fails_alone(box):
    for name, text in (("g1", "good 1"), ("x", "bad"), ("g2", "good 2"), ("g3", "good 3")):
        box.put(name, text)
    for _ in range(5):
        box.tick(tries=2)
    assert box.outcomes() == [("g1", "dispatched"), ("g2", "dispatched"), ("g3", "dispatched"), ("x", "failed")]
    assert [t for texts in box.got for t in texts].count("bad") <= 2 * 3 and box.got[-1] == ["bad"]


def test_an_outage_fails_nothing_for_good(box):
    """A dispatch that raises whatever it gets, for one tick."""
    calm, real = [False], box.dispatch

    def dispatch(df):
        if not calm[0]:
            raise RuntimeError("executor lost")
        real(df)

    box.dispatch = dispatch
    box.put("a", "one"), box.put("b", "two")
    box.tick(), box.tick()
    assert box.outcomes() == []
    calm[0] = True
    box.tick()
    assert box.got == [["one", "two"]] and box.outcomes() == [("a", "dispatched"), ("b", "dispatched")]


def test_waiting_files_come_again_with_the_clock_alone(box):
    box.busy = {"p"}
    box.put("a", "one"), box.put("b", "two", pile="q")
    for _ in range(3):
        box.tick()
    assert box.got == [["two"]]
    box.busy = set()
    assert box.tick() == 1 and box.got == [["two"], ["one"]] and box.tick() == 0


def test_what_a_failing_dispatch_stored_is_not_dispatched_again(spark, tmp_path):
    stored = []
    box = Inbox(spark, tmp_path, documents=lambda: spark.createDataFrame(stored, "pile_id string, content_sha256 string"))

    def dispatch(df):
        rows = sorted(df.collect(), key=lambda r: r.filename)
        box.got.append([r.filename for r in rows])
        stored.append((rows[0].pile_id, rows[0].content_sha256))
        if len(rows) > 1:
            raise OSError("lost on the way")

    box.dispatch = dispatch
    for n in "abc":
        box.put(n, n)
    box.tick(), box.tick()
    names = [n for part in box.got for n in part]
    assert box.got[0] == ["a", "b", "c"] and names.count("a") == 1 and {x for x in box.outcomes()} == {("a", "dispatched"), ("b", "dispatched"), ("c", "dispatched")}


def test_outcomes_that_a_dispatch_gives_back(box):
    box.dispatch = lambda df: df.select("content_sha256", F.lit("failed").alias("outcome"), F.lit("no pages").alias("detail")).where("filename = 'b'")
    box.put("a", "one"), box.put("b", "two")
    for _ in range(3):
        box.tick(tries=1)
    assert box.outcomes() == [("a", "dispatched"), ("b", "failed")]


def test_few_files_a_tick_and_state_that_expires(box, spark):
    for i in range(5):
        box.put(f"f{i}", str(i), at=1000 + i)
    taken = [box.tick(per_tick=2) for _ in range(5)]
    assert taken == [0, 2, 2, 1, 0] and box.got == [["0", "1"], ["2", "3"], ["4"]]
    for i in range(5):
        (box.folder / "p" / f"f{i}").unlink()
    box.tick()
    assert inbox._last_listing(spark, f"{box.events}_listing").where("path is not null").count() == 0


def test_on_the_clock(spark, tmp_path):
    """The running stream takes a file that waits, with no new file."""
    box = Inbox(spark, tmp_path)
    box.busy = {"p"}
    busy = lambda: spark.createDataFrame([(b,) for b in box.busy], "pile_id string")
    box.put("a", "one")
    stream = inbox.watch(spark, str(box.folder), box.events, str(tmp_path / "check"), box.dispatch, once=False, busy=busy, seconds=0.5)
    try:
        time.sleep(6)
        assert box.got == []
        box.busy = set()
        until = time.time() + 60
        while not box.got and time.time() < until:
            time.sleep(0.5)
    finally:
        stream.stop()
    assert box.got == [["one"]]


def test_settled_stream_forgets_and_ignores_late_scans(spark, tmp_path):
    def scans(n, rows):
        spark.createDataFrame(rows, inbox.SCANS).coalesce(1).write.mode("append").parquet(str(tmp_path / "scans"))
        query = inbox.settled_stream(spark.readStream.schema(inbox.SCANS).parquet(str(tmp_path / "scans"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        query.trigger(availableNow=True).start().awaitTermination(120)

    scans(1, [("x", 5, 1, 1), ("y", 1, 1, 1), ("y", 2, 1, 1)])
    scans(2, [("x", 4, 9, 9), ("x", 6, 1, 1), ("y", 3, 2, 1)])
    assert sorted((r.filename, r.scan) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("x", 6), ("y", 2)]
