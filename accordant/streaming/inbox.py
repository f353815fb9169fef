"""A watched inbox: settled arrivals, each content handled once, one outcome per file.

A stream is the clock.  Each tick lists the folder (names, sizes and times, no
content) and holds it against the listing of the tick before: a file that is still
being written differs and waits, a rewritten one is new again.  Files that are
settled, not handled and of a known pile that is not in work are read and handed to
``dispatch``; those of busy and unknown piles stay where they are and come again with
the clock, without any new file.  If a dispatch fails, its files are tried in halves,
so that one bad file fails alone.

Tables are Parquet folders in shared storage: the event log, which grows only when
something happened, and the last two listings, written in turns, in which a file that
left the folder is forgotten.  A tick that is run again finds what was recorded, or
stored, and does it no second time.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that are not finished files.
PARTIAL = (".part", ".crdownload", ".tmp", ".swp", "~")
EVENTS = "batch_id long, pile_id string, filename string, content_sha256 string, outcome string, detail string"
ARRIVAL = ("pile_id", "filename", "content", "content_sha256")
#: A file of the folder at one tick; done: nothing more is to be done with this size and time; tries: dispatches of it alone that failed.
LISTED = "path string, pile_id string, filename string, size long, mtime timestamp, scan long, done boolean, tries int"
Table = Callable[[], DataFrame] | None
#: Gets arrivals; may give back (content_sha256, outcome, detail), those not named are dispatched.
Dispatch = Callable[[DataFrame], DataFrame | None]
SCANS = "filename string, scan int, size long, mtime long"


def ignored(name: Column) -> Column:
    out = name.startswith(".")
    for suffix in PARTIAL:
        out = out | name.endswith(suffix)
    return out


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of <folder>/<pile>/<name> as path, pile_id, filename, size, mtime; no content is read. A folder that is not there has none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LISTED).select("path", "pile_id", "filename", "size", "mtime")
    parts = F.split("path", "/")
    named = files.select("path", F.element_at(parts, -2).alias("pile_id"), F.element_at(parts, -1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return named.where(~ignored(F.col("filename")))


def compared(now: DataFrame, last: DataFrame) -> DataFrame:
    """now (path, pile_id, filename, size, mtime) with settled, done and tries: what the listing before says of the same size and time."""
    was = last.select(F.col("path").alias("of"), F.col("size").alias("was_size"), F.col("mtime").alias("was_mtime"), F.col("done").alias("was_done"), F.col("tries").alias("was_tries"))
    same = F.col("size").eqNullSafe(F.col("was_size")) & F.col("mtime").eqNullSafe(F.col("was_mtime")) & F.col("of").isNotNull()
    both = now.join(was, F.col("path") == F.col("of"), "left").withColumn("settled", same)
    both = both.withColumn("done", same & F.coalesce("was_done", F.lit(False))).withColumn("tries", F.when(same, F.coalesce("was_tries", F.lit(0))).otherwise(0))
    return both.select(*now.columns, "settled", "done", "tries")


def standing(files: DataFrame, piles: DataFrame | None = None, busy: DataFrame | None = None) -> DataFrame:
    """files, as ``compared`` gives them, with what a tick does with each: handled, settling, no_pile, busy or due."""
    out = files
    for table, name in ((piles, "known"), (busy, "locked")):
        if table is None:
            out = out.withColumn(name, F.lit(name == "known"))
        else:
            held = table.select(F.col("pile_id").alias(f"{name}_pile")).distinct()
            out = out.join(held, F.col("pile_id") == F.col(f"{name}_pile"), "left").withColumn(name, F.col(f"{name}_pile").isNotNull()).drop(f"{name}_pile")
    said = F.when(F.col("done"), "handled").when(~F.col("settled"), "settling").when(~F.col("known"), "no_pile").when(F.col("locked"), "busy").otherwise("due")
    return out.withColumn("standing", said).drop("known", "locked")


def unhandled(batch: DataFrame, events: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Arrivals whose content the pile has neither dispatched, failed nor stored; each content once."""
    done = events.where("outcome in ('dispatched', 'failed', 'duplicate')").select("pile_id", "content_sha256")
    if documents is not None:
        done = done.unionByName(documents.select("pile_id", "content_sha256"))
    new = batch.join(done, ["pile_id", "content_sha256"], "left_anti")
    names = new.groupBy("pile_id", "content_sha256").agg(F.min("filename").alias("filename"))
    return new.join(names, ["pile_id", "content_sha256", "filename"], "left_semi").dropDuplicates(["pile_id", "content_sha256"])


def outcomes(new: DataFrame, piles: DataFrame, busy: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """outcome and whether it is recorded: busy piles and unknown ones are not, and come again."""
    out = new.join(piles.select("pile_id").distinct().withColumn("known", F.lit(True)), "pile_id", "left").join(busy.select("pile_id").distinct().withColumn("locked", F.lit(True)), "pile_id", "left")
    if failed is not None:
        out = out.join(failed.select("content_sha256").distinct().withColumn("broke", F.lit(True)), "content_sha256", "left")
    else:
        out = out.withColumn("broke", F.lit(None).cast("boolean"))
    outcome = F.when(F.col("known").isNull(), "no_pile").when(F.col("locked").isNotNull(), "busy").when(F.col("broke").isNotNull(), "failed").otherwise("dispatched")
    out = out.withColumn("outcome", outcome).drop("known", "locked", "broke")
    return out.withColumn("recorded", F.col("outcome").isin("failed", "dispatched"))


def attempted(due: DataFrame, dispatch: Dispatch, documents: Table = None) -> dict[tuple[str, str], tuple[str, str]]:
    """(pile_id, content_sha256) to outcome and detail, of the few arrivals of one tick.

    When a dispatch raises, what it has stored meanwhile counts as dispatched, and
    the others are tried in two halves, down to single files; one that raises alone
    is failed.
    """
    found: dict[tuple[str, str], tuple[str, str]] = {}
    # the keys of one tick, at most its number of files
    work = [sorted((r.pile_id, r.content_sha256) for r in due.select("pile_id", "content_sha256").collect())]
    while work:
        keys = work.pop()
        if not keys:
            continue
        part = due.where(F.struct("pile_id", "content_sha256").isin([F.struct(F.lit(p), F.lit(h)) for p, h in keys]))
        try:
            said = dispatch(part)
            told = {} if said is None else {r.content_sha256: (r.outcome, r.detail) for r in said.select("content_sha256", "outcome", "detail").collect()}
            found |= {k: told.get(k[1], ("dispatched", "")) for k in keys}
        except Exception as error:  # of the arrivals; the watcher goes on
            stored = {(r.pile_id, r.content_sha256) for r in part.select("pile_id", "content_sha256").join(documents(), ["pile_id", "content_sha256"], "left_semi").collect()} if documents else set()
            found |= {k: ("dispatched", "stored before an error") for k in keys if k in stored}
            keys = [k for k in keys if k not in stored]
            if len(keys) == 1:
                found[keys[0]] = ("failed", f"{type(error).__name__}: {error}"[:500])
            else:
                work += [keys[len(keys) // 2 :], keys[: len(keys) // 2]]
    return found


def handled(spark: SparkSession, batch: DataFrame, batch_id: int, events_path: str, dispatch: Dispatch, piles: Table = None, busy: Table = None, documents: Table = None, last_try: Callable[[str, str], bool] = lambda pile, content: True) -> dict[tuple[str, str], str]:
    """Arrivals by their outcome, recorded in the event log; (pile_id, content_sha256) to what is final of them.

    Contents of busy and unknown piles are not final.  Contents that ``documents``
    holds are duplicates and not dispatched.  A failure is final, and recorded, if
    last_try says so.
    """
    events = read_events(spark, events_path)
    held = documents() if documents else None
    known = piles() if piles else batch.select("pile_id").distinct()
    locked = busy() if busy else known.where("false")
    taken = outcomes(batch, known, locked).where("outcome = 'dispatched'").select(*ARRIVAL).persist()
    try:
        new = unhandled(taken, events, held).persist()
        names = {(r.pile_id, r.content_sha256): r.filename for r in new.select("pile_id", "content_sha256", "filename").collect()}
        seen = {(r.pile_id, r.content_sha256): r.filename for r in taken.select("pile_id", "content_sha256", "filename").collect()}
        logged = {(r.pile_id, r.content_sha256) for r in taken.select("pile_id", "content_sha256").join(events, ["pile_id", "content_sha256"], "left_semi").collect()}
        said = attempted(new, dispatch, documents) if names else {}
        final = {k: v for k, v in said.items() if v[0] != "failed" or last_try(*k)}
        rows = [(batch_id, p, names[p, h], h, *v) for (p, h), v in final.items()]
        rows += [(batch_id, *k[:1], name, k[1], "duplicate", "already stored") for k, name in seen.items() if k not in names and k not in logged]
        if rows:
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(events_path)
        return {k: final[k][0] if k in final else "retry" if k in names else "duplicate" for k in seen}
    finally:
        new.unpersist()
        taken.unpersist()


def _last_listing(spark: SparkSession, path: str) -> DataFrame:
    """The newer of the two listings that are written in turns, with its mark."""
    both = _read(spark, f"{path}/0", LISTED).unionByName(_read(spark, f"{path}/1", LISTED))
    newest = both.agg(F.max("scan")).first()[0]
    return both.where(F.col("scan") == (0 if newest is None else newest))


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The few files of one tick; none if one of them has just gone, which the next listing shows."""
    named = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]
    try:
        return spark.read.format("binaryFile").load(named) if named else None
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def tick(spark: SparkSession, folder: str, events_path: str, dispatch: Dispatch, piles: Table = None, busy: Table = None, documents: Table = None, per_tick: int = 100, tries: int = 3) -> int:
    """One pass over the folder; how many files it took. Files over per_tick come with the next ticks, oldest first."""
    state = f"{events_path}_listing"
    last = _last_listing(spark, state)
    scan = (last.agg(F.max("scan")).first()[0] or 0) + 1
    files = standing(compared(listing(spark, folder), last), piles() if piles else None, busy() if busy else None).persist()
    try:
        due = {r.path: r for r in files.where("standing = 'due'").orderBy("mtime", "path").limit(per_tick).collect()}
        read, final = _contents(spark, list(due)), {}
        if read is not None:
            sizes = spark.createDataFrame([(p, r.size, r.mtime, r.pile_id, r.filename) for p, r in due.items()], "of string, size long, mtime timestamp, pile_id string, filename string")
            # a file that was written to since the listing is not taken
            whole = read.join(F.broadcast(sizes), (F.col("path") == F.col("of")) & (F.col("length") == F.col("size")) & (F.col("modificationTime") == F.col("mtime")))
            batch = whole.select("path", "pile_id", "filename", "content", F.sha2("content", 256).alias("content_sha256")).persist()
            try:
                paths: dict[tuple[str, str], list[str]] = {}
                for r in batch.select("path", "pile_id", "content_sha256").collect():
                    paths.setdefault((r.pile_id, r.content_sha256), []).append(r.path)
                last_try = lambda pile, content: all(due[p].tries + 1 >= tries for p in paths[pile, content])
                became = handled(spark, batch.select(*ARRIVAL), scan, events_path, dispatch, None, busy, documents, last_try)
                final = {p: (became[k] != "retry", due[p].tries + (became[k] == "retry")) for k, held in paths.items() if k in became for p in held}
            finally:
                batch.unpersist()
        changed = spark.createDataFrame([(p, *v) for p, v in final.items()], "of string, now_done boolean, now_tries int")
        kept = files.join(F.broadcast(changed), F.col("path") == F.col("of"), "left").select(
            "path", "pile_id", "filename", "size", "mtime", F.lit(scan).cast("long").alias("scan"), F.coalesce("now_done", "done").alias("done"), F.coalesce("now_tries", "tries").alias("tries")
        )
        # a row without a path numbers the listing of an empty folder, too
        mark = spark.createDataFrame([(None, None, None, None, None, scan, True, 0)], LISTED)
        kept.unionByName(mark).write.mode("overwrite").parquet(f"{state}/{scan % 2}")
        return len(final)
    finally:
        files.unpersist()


def watch(spark: SparkSession, folder: str, events_path: str, checkpoint: str, dispatch: Dispatch, per_trigger: int = 100, once: bool = True, piles: Table = None, busy: Table = None, documents: Table = None, seconds: float = 3.0, tries: int = 3):
    """Start the stream: each tick hands settled, unhandled arrivals to ``dispatch`` and records what became of them.

    piles, busy, documents: functions that give the known piles, those in work, and
    the stored documents when a tick begins; without them no arrival waits.  once: two
    listings so many seconds apart, and ticks until nothing is due; else a tick each
    time so many seconds have gone.  A file that fails alone is tried in so many ticks.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        step = lambda: tick(spark, folder, events_path, dispatch, piles, busy, documents, per_trigger, tries)
        step()
        if once:
            time.sleep(seconds)
            while step():
                pass

    if once:
        clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
        return clock.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return clock.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log."""
    return _read(spark, path, EVENTS)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # the first tick finds no folder yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def settled_stream(scans: DataFrame, forget: str | None = None) -> DataFrame:
    """Stream of scan rows to files that two consecutive scans saw alike; the state is one row per file.

    forget: a file of which no scan has come for so long leaves the state; for streams
    that run on, since timeouts keep an availableNow trigger from ending.  A scan that
    comes after a later one of its file changes nothing.
    """
    import pandas as pd

    milliseconds = int(pd.Timedelta(forget).total_seconds() * 1000) if forget else None

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen = pd.concat(list(frames))[["scan", "size", "mtime"]].drop_duplicates("scan").sort_values("scan")
        if state.exists:
            before = pd.DataFrame([state.get], columns=seen.columns)
            seen = pd.concat([before, seen[seen["scan"] > state.get[0]]])
        like = (seen["scan"].diff() == 1) & (seen["size"].diff() == 0) & (seen["mtime"].diff() == 0)
        state.update(tuple(int(x) for x in seen.iloc[-1]))
        if milliseconds:
            state.setTimeoutDuration(milliseconds)
        if like.any():
            found = seen[like].astype("int64")
            found.insert(0, "filename", key[0])
            yield found

    return scans.groupBy("filename").applyInPandasWithState(step, SCANS, "scan int, size long, mtime long", "append", "ProcessingTimeTimeout" if forget else "NoTimeout")


def deduplicated_stream(rows: DataFrame, at: str = "at", delay: str = "1 hour") -> DataFrame:
    """Each (pile_id, content_sha256) once within the delay; the watermark bounds the state."""
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["pile_id", "content_sha256"])


def updated(held: DataFrame, arrived: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` makes of all facts of the piles that the arrivals touch.

    held, arrived: facts (pile_id, document, ...), the second of documents just
    read.  Those documents' older facts give way; other piles are not read beyond
    the semi join.  Made for ``watch``'s dispatch, where the batch is small and is
    the side that Spark may broadcast by its measured size.
    """
    older = held.join(arrived.select("pile_id", "document").distinct(), ["pile_id", "document"], "left_anti")
    return work(older.join(arrived.select("pile_id").distinct(), "pile_id", "left_semi").unionByName(arrived))


def running_registry(facts: DataFrame) -> DataFrame:
    """Stream of facts (pile_id, entity_key, name, seq) to one row per engagement: its first name and how many facts so far.

    A streaming aggregate: the state is one row per engagement, not per pile, and
    partial results combine before the shuffle, so a hot pile spreads.
    """
    return facts.where("entity_key is not null").groupBy("pile_id", "entity_key").agg(F.min_by(F.left("name", F.lit(500)), "seq").alias("name"), F.count("*").alias("facts"))


def watch_report(files: DataFrame, events: DataFrame) -> DataFrame:
    """All files of the inbox that no event accounts for."""
    return files.where(~ignored(F.col("filename"))).join(events.select("pile_id", "filename"), ["pile_id", "filename"], "left_anti").orderBy("pile_id", "filename")


def recent(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest events of the log, a report of so many rows."""
    return events.where("filename is not null").orderBy(F.desc("batch_id"), "pile_id", "filename").limit(limit)
