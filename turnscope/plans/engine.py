"""A search request from its text to its hits: scope, filters, fallback to other projects, and paging."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.functions.names import parse_date, project_of
from turnscope.operators import fulltext, lookup
from turnscope.operators.errors import BadRequest, Unknown
from turnscope.streaming.ingest import KEY, Index

# The limits of a request.
DEFAULT_LIMIT, MOST_LIMIT = 5, 20
SEARCH_CHARS, SHOW_CHARS, LEAST_CHARS, MOST_CHARS = 2500, 8000, 500, 50_000
MOST_AROUND = 10


@dataclass
class Request:
    query: str = ""
    project: str | None = None
    all: bool = False
    file: str | None = None
    since: str | None = None
    until: str | None = None
    failed: bool = False
    limit: int | None = None
    offset: int = 0
    id: str | None = None
    around: int = 0
    json: bool = False
    max_chars: int | None = None

    @property
    def page(self) -> int:
        return min(max(DEFAULT_LIMIT if self.limit is None else self.limit, 1), MOST_LIMIT)

    @property
    def budget(self) -> int:
        default = SHOW_CHARS if self.id is not None else SEARCH_CHARS
        return min(max(default if self.max_chars is None else self.max_chars, LEAST_CHARS), MOST_CHARS)

    @property
    def named_project(self) -> str | None:
        return self.project if self.project and self.project.strip() else None


@dataclass
class Context:
    """Who asks, and when: the clock is handed in."""

    cwd: str = ""
    session: str | None = None
    now_ms: int = field(default_factory=lambda: int(time.time() * 1000))
    zone: str = "UTC"


@dataclass
class Found:
    scope: str
    scope_turns: int
    all: bool
    hits: list[dict]
    total: int
    fell_back: bool = False


@dataclass
class Shown:
    session: str
    target: int
    turns: list[dict]


def filtered(turns: DataFrame, project: tuple[str, bool] | None = None, session: str | None = None, since: int | None = None, until: int | None = None, file: str | None = None, failed: bool = False) -> DataFrame:
    """Turns that pass every given filter; ``project`` is (key, inside)."""
    if project:
        key, inside = project
        turns = turns.filter(F.col("project_key") == key if inside else F.col("project_key") != key)
    if session:
        turns = turns.filter(F.col("session") != session)
    if since is not None:
        turns = turns.filter(F.col("date") >= since)
    if until is not None:
        turns = turns.filter(F.col("date") <= until)
    if file:
        turns = turns.filter(F.contains(F.array_join("files", "\n"), F.lit(file)))
    return turns.filter("failed") if failed else turns


class Engine:
    """Searches one index."""

    def __init__(self, index: Index):
        self.index = index

    def search(self, request: Request, context: Context) -> Found:
        query = fulltext.parse_query(request.query)
        filters = {
            "since": parse_date(request.since, context.now_ms, False, context.zone) if request.since is not None else None,
            "until": parse_date(request.until, context.now_ms, True, context.zone) if request.until is not None else None,
            "file": request.file,
            "failed": request.failed,
            "session": context.session,
        }
        projects = self.index.projects()
        if request.all:
            scope, key = "all projects", None
            scope_turns = projects.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]
        else:
            if request.named_project:
                project = lookup.resolve_project(projects, request.named_project)
                key, name, scope_turns = project["key"], project["name"], project["turns"]
            else:
                key, name = project_of(context.cwd)
                known = projects.filter(F.col("key") == key).first()
                scope_turns = known["turns"] if known else 0
            scope = f"project {name}"
        hits, total = self._run(query, filters, (key, True) if key is not None else None, request, context)
        if total == 0 and key is not None and not request.named_project:
            hits, total = self._run(query, filters, (key, False), request, context)
            return Found(scope, scope_turns, False, [h | {"other_project": True} for h in hits], total, True)
        return Found(scope, scope_turns, request.all, hits, total)

    def _run(self, query: fulltext.Parsed, filters: dict, project: tuple[str, bool] | None, request: Request, context: Context) -> tuple[list[dict], int]:
        turns = self.index.turns()
        allowed = filtered(turns, project, **filters)
        if query.empty:
            total = allowed.count()
            page = allowed.orderBy(F.desc("date"), *KEY).offset(request.offset).limit(request.page).withColumn("score", F.lit(0.0))
            rows = [r.asDict() for r in page.collect()]
            return [r | {"did": r["gist"], "other_project": False} for r in rows], total
        # Lengths are stored with the turns and totals in the manifest, so only postings of the query's terms are read.
        lengths = turns.select(*KEY, F.col("tokens").alias("dl"))
        n, tokens = self.index.totals()
        stats = self.index.spark.createDataFrame([(n, tokens / max(n, 1))], "n long, avgdl double")
        matched = fulltext.matches(self.index.postings(), lengths, stats, query, KEY, weights=fulltext.TURN_WEIGHTS)
        # Wide columns are fetched for the page alone.
        met = matched.join(allowed.select(*KEY, "date", "has_reply"), KEY).persist()
        try:
            total = met.count()
            page = fulltext.ranked(met, KEY, context.now_ms, request.page, request.offset)
            best = page.select(*KEY, "bm25", "score").collect()  # at most 20 rows
        finally:
            met.unpersist()
        if not best:
            return [], total
        order = self.index.spark.createDataFrame([(i, *r) for i, r in enumerate(best)], "n int, session string, entry_id long, bm25 double, score double")
        rows = [r.asDict() for r in turns.join(F.broadcast(order), KEY).orderBy("n").collect()]
        return [r | {"did": fulltext.snippet(r["reply"], query.words + query.phrases) or r["gist"], "other_project": False} for r in rows], total

    def show(self, wanted: str, around: int) -> Shown:
        wanted = wanted.strip()
        prefix, colon, entry = wanted.rpartition(":")
        try:
            target = int(entry)
        except ValueError:
            colon = ""
        if not colon or not prefix or not entry.lstrip("+-").isdigit():
            raise BadRequest(f"bad id '{wanted}': expected <session>:<entry> as printed on a card")
        session = lookup.resolve_session(self.index.sessions(), prefix)
        rows = [r.asDict() for r in lookup.neighbours(self.index.turns(), session, target, min(around, MOST_AROUND)).collect()]
        if not any(r["entry_id"] == target for r in rows):
            raise Unknown(f"no turn {target} in session {session}")
        return Shown(session, target, rows)
