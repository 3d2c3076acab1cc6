"""Incremental ingest of session logs into an index of immutable Parquet buckets.

The index is a folder with ``manifest.json`` and, for each bucket of sessions, folders of turns and postings. A
run finds the files that changed (size, time, and hashes of the head and of the bytes before the last turn) and takes
them, the largest first, in batches of BATCH_BYTES. For each batch it parses only what is new where a file merely grew,
rewrites the touched buckets into new folders in one job, and then replaces the manifest in one step: readers see the
index before or after a batch, and a run that dies leaves nothing but unused folders and goes on where it stopped. State
is written last, so a repeated batch does the same again.

Postings are range partitioned and sorted by term within their bucket, so a query's terms cut them down to a few row
groups; each turn carries its number of tokens, and the manifest the totals, so that ranking reads no other posting.
A file that cannot be read or turned into rows, for whatever reason, counts as failed and does not stop the others.
"""

from __future__ import annotations

import contextlib
import fcntl
import heapq
import json
import os
import re
import shutil
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.functions.names import project_of
from turnscope.functions.text import fnv1a64
from turnscope.operators import extract, fulltext, lookup, turns
from turnscope.sources import session_log

SCHEMA_VERSION = "2"
#: Buckets of a new index; an index keeps the number that it began with.
BUCKETS = 32
#: Bytes of logs that are committed together.
BATCH_BYTES = 64 << 30
# The windows hashed to tell growth from rewriting.
HEAD_BYTES, TAIL_BYTES = 4096, 256
KEY = ["session", "entry_id"]
COLUMNS = ["prompt", "files_text", "reply", "commands"]
#: Characters of session names and folders that are sent to every task; beyond, they are joined.
BROADCAST_CHARS = 4 << 20
TURNS = (
    "session string, entry_id long, project_key string, project_name string, cwd string, date long, prompt string, reply string, "
    "gist string, commands string, files array<string>, commits array<string>, failed boolean, has_reply boolean, tokens long"
)
POSTINGS = "session string, entry_id long, col string, term string, pos int"


@dataclass(frozen=True)
class SessionState:
    session: str
    path: str
    cwd: str
    project_key: str
    size: int
    mtime_ns: int
    head_hash: int
    tail_offset: int
    tail_hash: int
    tail_entry: int | None
    skipped: int


@dataclass(frozen=True)
class Job:
    """A file to bring up to date; from its start, or from the last indexed turn."""

    session: str
    path: str
    size: int
    mtime_ns: int
    head_hash: int
    old: SessionState | None


@dataclass
class Report:
    busy: bool = False
    changed: int = 0
    removed: int = 0
    failed: int = 0


def _read(path: str, start: int, end: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(start)
        return f.read(max(0, end - start))


def detect(state: SessionState | None, session: str, path: str, size: int, mtime_ns: int) -> Job | None:
    """What to do about a file; nothing if its size and time are those of the last run."""
    if state and (state.size, state.mtime_ns) == (size, mtime_ns):
        return None
    head = _read(path, 0, min(size, HEAD_BYTES))
    grown = (
        state is not None
        and state.tail_entry is not None
        and size > state.size
        and fnv1a64(head[: min(state.size, HEAD_BYTES)]) == state.head_hash
        and fnv1a64(_read(path, max(0, state.tail_offset - TAIL_BYTES), state.tail_offset)) == state.tail_hash
    )
    return Job(session, path, size, mtime_ns, fnv1a64(head), state if grown else None)


def parse_job(job: Job) -> tuple[bool, SessionState, list[dict]]:
    """(whether all turns are replaced, the new state but for its tail, rows of the log)."""
    start = job.old.tail_offset if job.old else 0
    before = max(0, start - TAIL_BYTES)
    data = _read(job.path, before, job.size)
    log = session_log.parse(data[start - before :], start)
    if job.old:
        # Growth is only what it seems if the bytes start with the turn that was last before.
        prompts = _first_prompt(log)
        if log.root != job.old.tail_entry or prompts != job.old.tail_entry:
            return parse_job(replace(job, old=None))
    cwd = job.old.cwd if job.old else log.cwd or ""
    skipped = job.old.skipped + sum(o >= job.old.size for o in log.skipped) if job.old else len(log.skipped)
    state = SessionState(job.session, job.path, cwd, project_of(cwd)[0], job.size, job.mtime_ns, job.head_hash, 0, 0, None, skipped)
    rows = [r | {"window": None} for r in session_log.rows_of(job.session, log)]
    for r in rows:
        if r["role"] == "user":  # what may open the last turn; the bytes hashed are those that were parsed
            at = r["offset"] - before
            r["window"] = str(fnv1a64(data[max(0, at - TAIL_BYTES) : at]))
    return job.old is None, state, rows


def batches(jobs: list[Job], most: int) -> Iterator[list[Job]]:
    """The jobs, largest first, in runs of at most ``most`` bytes; a larger job is a run of its own."""
    run, size = [], 0
    for job in sorted(jobs, key=lambda j: (-j.size, j.session)):
        if run and size + job.size > most:
            yield run
            run, size = [], 0
        run, size = [*run, job], size + job.size
    if run:
        yield run


def dealt(jobs: list[Job], hands: int) -> list[tuple[int, Job]]:
    """(hand, job): each job, largest first, goes to the hand that holds the least."""
    held = [(0, hand) for hand in range(hands)]
    out = []
    for job in sorted(jobs, key=lambda j: (-j.size, j.session)):
        load, hand = heapq.heappop(held)
        out.append((hand, job))
        heapq.heappush(held, (load + job.size + 1, hand))
    return out


def _first_prompt(log: session_log.Log) -> int | None:
    """The id of the branch's first entry if it can open a turn."""
    for i in log.branch:
        e = log.entries[i]
        kinds = [b["type"] for b in e["blocks"]]
        text = "\n".join(b["text"] for b in e["blocks"] if b["type"] == "text" and b["text"] is not None).strip()
        opens = e["role"] == "user" and "tool_result" not in kinds and text and not re.match(turns.INJECTED, text)
        return e["entry_id"] if opens and not e["boundary"] else None
    return None


class Index:
    """The index below ``home``."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.folder = spark, os.path.join(home, "turnscope")
        self.sessions_folder = os.path.join(home, "sessions")
        os.makedirs(self.folder, mode=0o700, exist_ok=True)

    # --- manifest -----------------------------------------------------------------------------------------

    @property
    def manifest_path(self) -> str:
        return os.path.join(self.folder, "manifest.json")

    def manifest(self) -> dict:
        """The stored manifest; an empty one if there is none of this schema."""
        with contextlib.suppress(OSError, ValueError):
            with open(self.manifest_path, encoding="utf-8") as f:
                stored = json.load(f)
            if stored.get("schema") == SCHEMA_VERSION:
                return stored
        return self._new()

    @staticmethod
    def _new() -> dict:
        return {"schema": SCHEMA_VERSION, "last_catch_up": None, "bucket_count": BUCKETS, "buckets": {}, "sessions": {}, "projects": [], "tokens": 0}

    def _commit(self, manifest: dict) -> None:
        fresh = f"{self.manifest_path}.{uuid.uuid4().hex}"
        with os.fdopen(os.open(fresh, os.O_WRONLY | os.O_CREAT, 0o600), "w", encoding="utf-8") as f:
            json.dump(manifest, f)
        os.replace(fresh, self.manifest_path)
        used = {n.partition("/")[0] for n in manifest["buckets"].values()}
        for name in os.listdir(self.folder):
            if name.startswith("data-") and name not in used:
                shutil.rmtree(os.path.join(self.folder, name), ignore_errors=True)

    @contextlib.contextmanager
    def lock(self) -> Iterator[bool]:
        """Whether this process holds the writer's lock meanwhile."""
        with open(os.path.join(self.folder, "index.lock"), "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                yield False
                return
            yield True

    def reset(self) -> None:
        self._commit(self._new())

    # --- reading ------------------------------------------------------------------------------------------

    def _table(self, kind: str, schema: str, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        names = [n.split("/") for b, n in sorted(manifest["buckets"].items()) if buckets is None or b in buckets]
        paths = [p for run, bucket in names if os.path.isdir(p := os.path.join(self.folder, run, kind, bucket))]
        if not paths:  # an empty bucket has no folder
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def turns(self) -> DataFrame:
        return self._table("turns", TURNS, self.manifest())

    def postings(self) -> DataFrame:
        return self._table("postings", POSTINGS, self.manifest())

    def sessions(self) -> DataFrame:
        rows = [(s,) for s in sorted(self.manifest()["sessions"])]
        return self.spark.createDataFrame(rows, "session string")

    def projects(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(p) for p in self.manifest()["projects"]], "key string, name string, name_lower string, turns long")

    def totals(self) -> tuple[int, int]:
        """(turns, tokens) of the whole index."""
        m = self.manifest()
        return sum(p[3] for p in m["projects"]), m["tokens"]

    def stats(self) -> dict:
        m = self.manifest()
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(self.folder) for f in names)
        return {
            "turns": sum(p[3] for p in m["projects"]),
            "sessions": len(m["sessions"]),
            "projects": len(m["projects"]),
            "skipped": sum(s["skipped"] for s in m["sessions"].values()),
            "bytes": size,
            "last_catch_up": m["last_catch_up"],
        }

    # --- writing ------------------------------------------------------------------------------------------

    def catch_up(self) -> Report:
        with self.lock() as held:
            return self.catch_up_locked() if held else Report(busy=True)

    def catch_up_locked(self) -> Report:
        manifest, report, jobs = self.manifest(), Report(), []
        states = {k: SessionState(**v) for k, v in manifest["sessions"].items()}
        files = session_log.list_sessions(self.sessions_folder)
        for session, path in files:
            try:
                stat = os.stat(path)
                job = detect(states.get(session), session, path, stat.st_size, stat.st_mtime_ns)
            except OSError:
                report.failed += 1
                continue
            if job:
                jobs.append(job)
        gone = set(states) - {s for s, _ in files}
        report.removed = len(gone)
        for batch in batches(jobs, BATCH_BYTES) if jobs else [[]] if gone else []:
            self._apply(manifest, states, batch, gone, report)
            self._commit(manifest)
            gone = set()
        manifest["last_catch_up"] = int(time.time() * 1000)
        self._commit(manifest)
        return report

    def _apply(self, manifest: dict, states: dict[str, SessionState], jobs: list[Job], gone: set[str], report: Report) -> None:
        parsed = self._parse(jobs).persist()
        fresh = None
        try:
            # The states of the batch's sessions; the listing of the folder that led here is as long.
            done = {r["session"]: r for r in parsed.filter("kind = 'file'").select("session", "state", "full").collect()}
            report.failed += len(jobs) - len(done)
            report.changed += len(done)
            bucket = lambda s: str(zlib.crc32(s.encode()) % manifest["bucket_count"])
            touched = {bucket(s) for s in [*done, *gone]}
            fresh = self._rows(parsed, {s: SessionState(**json.loads(r["state"])) for s, r in done.items()}).persist()
            last = fresh.groupBy("session").agg(F.max(F.struct("offset", "entry_id")).alias("tail")).select("session", "tail.*")
            windows = parsed.filter("kind = 'entry'").select("session", "offset", "window")
            tails = {r["session"]: r for r in last.join(windows, ["session", "offset"]).collect()}
            stale = sorted(gone | {s for s, r in done.items() if r["full"]})
            old = self._table("turns", TURNS, manifest, touched)
            if stale:
                names = self.spark.createDataFrame([(s,) for s in stale], "session string")
                old = old.join(names, "session", "left_anti")
            merged = lookup.upsert(old, fresh.drop("offset"), KEY)
            self._write(merged, touched, manifest)
        finally:
            parsed.unpersist()
            if fresh is not None:
                fresh.unpersist()
        for s in gone:
            manifest["sessions"].pop(s)
        for s, r in done.items():
            tail = tails.get(s)
            new = {"tail_offset": tail["offset"], "tail_hash": int(tail["window"]), "tail_entry": tail["entry_id"]} if tail else {"tail_offset": 0, "tail_hash": fnv1a64(b""), "tail_entry": None}
            manifest["sessions"][s] = asdict(replace(SessionState(**json.loads(r["state"])), **new))
        turns_now = self._table("turns", TURNS, manifest)
        manifest["projects"] = [list(r) for r in lookup.project_rollup(turns_now).collect()]
        manifest["tokens"] = turns_now.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def _parse(self, jobs: list[Job]) -> DataFrame:
        """Rows of the logs, with ``state`` and ``full`` on file rows; a file that cannot be read has none."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        schema = session_log.SCHEMA + ", window string, state string, full boolean"
        arrow = to_arrow_schema(_parse_datatype_string(schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    d = json.loads(raw)
                    job = Job(**{**d, "old": SessionState(**d["old"]) if d["old"] else None})
                    try:
                        full, state, rows = parse_job(job)
                        rows = [r | {"state": None, "full": None} for r in rows]
                        rows[0] |= {"state": json.dumps(asdict(state)), "full": full}
                        parts = [pa.RecordBatch.from_pylist(part, arrow) for part in turns.chunked(rows, 1000)]
                    except (OSError, ValueError, ArithmeticError, LookupError, TypeError):
                        continue  # one file must not stop the others: it is missing below, and counts as failed
                    yield from parts

        slices = max(1, min(len(jobs), 4 * self.spark.sparkContext.defaultParallelism))
        listed = self.spark.createDataFrame([(json.dumps(asdict(j)), hand) for hand, j in dealt(jobs, slices)], "job string, hand int")
        return listed.repartitionByRange(slices, "hand").select("job").mapInArrow(run, schema)

    def _rows(self, parsed: DataFrame, states: dict[str, SessionState]) -> DataFrame:
        """Extracted turns of the parsed logs, with their prompts' offsets and numbers of tokens."""
        names = [(s, st.cwd, *project_of(st.cwd)) for s, st in states.items()]
        places = self.spark.createDataFrame(names, "session string, cwd string, project_key string, project_name string")
        assembled = turns.turns_of(parsed).join(F.broadcast(places) if sum(len(s) + len(c) for s, c, *_ in names) < BROADCAST_CHARS else places, "session")
        rows = extract.extract(assembled).join(assembled.select("session", "entry_id", "offset"), KEY)
        sizes = [F.size(fulltext.stems_col(F.array_join("files", "\n") if c == "files_text" else F.col(c))) for c in COLUMNS]
        return rows.withColumn("tokens", sum(sizes[1:], sizes[0]).cast("long"))

    def _write(self, merged: DataFrame, touched: set[str], manifest: dict) -> None:
        """A new folder with the touched buckets, turns and postings alike, written by one job each."""
        name = f"data-{uuid.uuid4().hex}"
        path = os.path.join(self.folder, name)
        bucket = F.pmod(F.crc32(F.col("session").cast("binary")), F.lit(manifest["bucket_count"]))
        staged = merged.select([c.split()[0] for c in TURNS.split(", ")]).withColumn("bucket", bucket).persist()
        try:
            by_session = staged.repartitionByRange("bucket", "session").sortWithinPartitions("bucket", "session", "entry_id")
            by_session.write.partitionBy("bucket").parquet(f"{path}/turns")
            rows = staged.withColumn("files_text", F.array_join("files", "\n"))
            posted = fulltext.postings(rows, ["bucket", *KEY], COLUMNS).withColumn("col", F.when(F.col("col") == "files_text", "files").otherwise(F.col("col")))
            by_term = posted.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term")
            by_term.write.partitionBy("bucket").parquet(f"{path}/postings")
        finally:
            staged.unpersist()
        for b in touched:
            manifest["buckets"][b] = f"{name}/bucket={b}"


def follow(spark: SparkSession, home: str, trigger: str = "5 seconds", once: bool = False):
    """Catch up at every trigger, as a streaming query. A clock wakes it, because Spark's file source sees new files but no growth;
    a catch-up without changes is a listing of the folder. ``once`` catches up with what is there and ends."""
    index = Index(spark, home)
    os.makedirs(index.sessions_folder, exist_ok=True)
    if once:
        stream = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl").load(index.sessions_folder)
    else:
        stream = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    checkpoint = os.path.join(index.folder, "follow-once" if once else "follow")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: index.catch_up() and None)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)
    return writer.start()
