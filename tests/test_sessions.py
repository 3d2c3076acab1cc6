"""Logs to turns to fields, then the whole index: catch-up, search, show, views and the three front ends."""

import io
import json
import os
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnscope.operators import extract, fulltext, lookup, turns
from turnscope.operators.errors import BadRequest, Unknown
from turnscope.plans import cli, render
from turnscope.plans.engine import Context, Found, Request, Shown
from turnscope.sources import session_log
from turnscope.streaming import ingest

T0 = 1_790_000_000_000


class Log:
    """Builds a session file; entries are a second apart."""

    def __init__(self, name, cwd="/work/p"):
        self.lines, self.last, self.n = [json.dumps({"version": 1, "id": name, "cwd": cwd})], None, 0

    def raw(self, line):
        self.lines.append(line)
        return self

    def add(self, role, content, parent=0, ts=None, boundary=False):
        self.n += 1
        entry = {"entry_id": self.n, "parent_id": self.last if parent == 0 else parent, "timestamp": T0 + 1000 * self.n if ts is None else ts, "message": {"role": role, "content": content}}
        if boundary:
            entry["compaction_boundary"] = True
        self.lines.append(json.dumps(entry))
        self.last = self.n
        return self

    def user(self, text, **k):
        return self.add("user", [{"type": "text", "text": text}], **k)

    def reply(self, text, **k):
        return self.add("assistant", [{"type": "text", "text": text}], **k)

    def tool(self, name, **args):
        return self.add("assistant", [{"type": "tool_use", "name": name, "args": args}])

    def result(self, content, is_error=False):
        return self.add("user", [{"type": "tool_result", "content": content, "is_error": is_error}])

    def bytes(self):
        return ("\n".join(self.lines) + "\n").encode()

    def write(self, home, name):
        os.makedirs(home / "sessions", exist_ok=True)
        (home / "sessions" / f"{name}.jsonl").write_bytes(self.bytes())


def turns_of(spark, *logs):
    rows = [r for i, log in enumerate(logs) for r in session_log.rows_of(str(i), session_log.parse(log))]
    df = spark.createDataFrame([tuple(r[k.split()[0]] for k in ("session", "kind", "offset", "entry_id", "parent_id", "ts", "boundary", "role", "blocks", "on_branch", "cwd", "root", "skipped")) for r in rows], session_log.SCHEMA)
    return [r.asDict(recursive=True) for r in turns.turns_of(df).orderBy("session", "entry_id").collect()]


def test_parse_offsets_and_bad_lines():
    log = Log("s").user("a").raw("not json").raw("[1, 2]").raw('{"no": "entry"}').raw("   ").raw('{"id": "again"}')
    data = log.bytes() + b'{"entry_id": 9'
    parsed = session_log.parse(data)
    assert parsed.cwd == "/work/p" and [e["entry_id"] for e in parsed.entries] == [1] and parsed.root == 1
    assert [data[o:].split(b"\n")[0] for o in parsed.skipped] == [b"not json", b"[1, 2]", b'{"no": "entry"}', b'{"id": "again"}']
    assert session_log.parse(b"\n" + log.bytes()).cwd is None
    assert session_log.parse(b"").root is None


def test_branch_guards():
    assert session_log.branch_of([1, 2, 3, 4], [None, 1, 1, 3]) == [0, 2, 3]
    assert session_log.branch_of([1, 2], [2, 1]) == [0, 1]
    assert session_log.branch_of([1, 1, 2], [None, None, 1]) == [1, 2]
    assert session_log.branch_of([], []) == []


def test_turns(spark):
    log = Log("s").reply("before any prompt").user("one").reply(" ").reply("did one").user("rewound").user("two", parent=2)
    log.add("assistant", [{"type": "tool_use", "name": "bash", "args": {"command": "ls"}}, {"type": "text", "text": "ran"}])
    log.result([{"k": 1}]).result("exit 2").add("system", "ignored").add("user", "as string").add("user", [{"type": "image", "data": "x"}])
    log.user("[agent loop guard: x").user('<skill name="fmt" x>body').add("user", [{"type": "text", "text": "lost"}, {"type": "tool_result", "content": "z"}])
    got = turns_of(spark, log.bytes())
    assert [(t["entry_id"], t["prompt"]) for t in got] == [(2, "one"), (6, "two"), (11, "as string"), (14, "[skill fmt]")]
    assert got[0]["texts"] == [] and got[1]["texts"] == ["ran"]
    assert got[1]["tools"] == [{"name": "bash", "args": '{"command":"ls"}'}]
    assert [r["content"] for r in got[1]["results"]] == ['[{"k":1}]', "exit 2"] and got[3]["results"][0]["content"] == "z"


BAD_LINES = [
    b'{"entry_id": 12345678901234567890123, "message": {}}',
    b'{"entry_id": 4, "message": {"role": "user", "content": "half \\ud800 pair"}}',
    b'{"entry_id": NaN}',
    b'{"entry_id": 1e999}',
    b"\xff\xfe{}",
    b"\xef\xbb\xbf{}",
    b'{"entry_id": true}',
    b"[" * 100_000,
    b'"' + b"9" * 5000,
    b"9" * 5000,
]


def test_odd_lines_are_skipped_and_counted(spark):
    whole = b'{"entry_id": 1, "timestamp": 123456789012345678901234, "parent_id": 99999999999999999999, "message": {"role": "user", "content": "kept \\ud83d\\ude00"}}\n'
    log = session_log.parse(whole + b"\n".join(BAD_LINES) + b"\n")
    assert len(log.skipped) == len(BAD_LINES) and [(e["entry_id"], e["ts"], e["parent_id"]) for e in log.entries] == [(1, 0, None)]
    assert turns_of(spark, whole + b"\n".join(BAD_LINES) + b"\n")[0]["prompt"] == "kept 😀"


_JSON_LIKE = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["entry_id", "id", "message", "content", "role", "type", "text", "args", "timestamp", "parent_id", "is_error", "name"]), x, max_size=5), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=60) | _JSON_LIKE.map(lambda v: json.dumps(v).encode()), max_size=6))
def test_no_bytes_stop_the_parser(lines):
    """Every line is an entry, the header, blank or skipped, and what is read can be stored."""
    data = b"".join(line.replace(b"\n", b" ") + b"\n" for line in lines)
    log = session_log.parse(data)
    blank = sum(not line.replace(b"\n", b" ").strip(b" \t\r\x0c") for line in lines)
    assert len(log.entries) + len(log.skipped) + blank in (len(lines), len(lines) - 1)
    assert all(-(1 << 63) <= e["entry_id"] < 1 << 63 for e in log.entries)
    json.dumps(session_log.rows_of("s", log), ensure_ascii=False).encode()


def test_jobs_are_dealt_evenly_and_in_batches():
    jobs = [ingest.Job(f"s{i}", "", size, 0, 0, None) for i, size in enumerate([5, 90, 40, 40, 10, 1, 1])]
    assert [[j.size for j in b] for b in ingest.batches(jobs, 100)] == [[90], [40, 40, 10, 5, 1, 1]]
    loads = {}
    for hand, job in ingest.dealt(jobs, 3):
        loads[hand] = loads.get(hand, 0) + job.size
    assert sorted(loads.values()) == [47, 50, 90] or max(loads.values()) == 90


def test_a_run_goes_on_after_a_bad_file(spark, home, monkeypatch):
    """One file that cannot be read fails alone, is tried again, and batches are committed one by one."""
    (home / "sessions" / "bad.jsonl").mkdir()
    os.symlink("/nonexistent", home / "sessions" / "link.jsonl")
    unreadable = Log("u").user("x").write(home, "unreadable")
    monkeypatch.setattr(ingest, "BATCH_BYTES", 1)
    index = ingest.Index(spark, str(home))
    os.chmod(home / "sessions" / "unreadable.jsonl", 0o000)
    failed = index.catch_up()
    assert failed.changed + failed.failed == 3 and index.stats()["sessions"] == failed.changed
    os.chmod(home / "sessions" / "unreadable.jsonl", 0o600)
    assert index.catch_up().failed == 0 and index.stats()["sessions"] == 3
    del unreadable


def test_a_query_reads_its_terms_only(spark, home):
    """Postings are cut to the query's terms in the scan, and nothing else reads them."""
    index = ingest.Index(spark, str(home))
    index.catch_up()
    postings = index.postings()
    hits = fulltext.phrase_hits(postings, ["session", "entry_id"], ["deploy"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    stored = {(r["session"], r["entry_id"]): r["tokens"] for r in index.turns().collect()}
    counted = {(r["session"], r["entry_id"]): r["dl"] for r in fulltext.document_lengths(postings, ["session", "entry_id"]).collect()}
    assert counted == {k: n for k, n in stored.items() if n} and index.totals() == (len(stored), sum(stored.values()))


def test_compaction_and_prompt_cap(spark):
    log = Log("s").user("kept", ts=0).user("summary", ts=1000, boundary=True).user("copy", ts=1400).user("new", ts=1501).user("é" * 2000, ts=1502)
    got = turns_of(spark, log.bytes())
    assert [t["prompt"] for t in got] == ["kept", "new", "é" * 1024]


def test_branch_operators_on_entry_rows(spark):
    rows = spark.createDataFrame([("a", 0, 1, None), ("a", 9, 2, 1), ("a", 20, 3, 1)], "session string, offset long, entry_id long, parent_id long")
    branch = turns.active_branch(rows)
    assert [r[0] for r in branch.orderBy("offset").select("entry_id").collect()] == [1, 3]
    assert branch.transform(turns.branch_roots).collect()[0]["root"] == 1


def test_extract_fields(spark):
    log = Log("s").user("go").tool("bash", command="cat a.rs\n  && cd /x").tool("read", path="b.rs", file_path="/work/p/c.rs").tool("grep", pattern="x y").tool("", path="n").tool("bash").tool("web")
    log.result("[main 0123abc] msg\n[main 0123abc] msg\n[b (root-commit) fedcba98] x").result("  \n exit 3").reply("first").reply("\n\n last  line \nmore").user("second").reply("ok").result("exit 0")
    rows = turns_of(spark, log.bytes())
    df = spark.createDataFrame([(t["session"], t["entry_id"], t["date"], t["prompt"], t["texts"], [tuple(x.values()) for x in t["tools"]], [tuple(x.values()) for x in t["results"]]) for t in rows], "session string, entry_id long, date long, prompt string, texts array<string>, tools array<struct<name:string,args:string>>, results array<struct<content:string,is_error:boolean>>")
    places = {"cwd": F.lit("/work/p"), "project_key": F.lit("/work/p"), "project_name": F.lit("p")}
    a, b = extract.extract(df.withColumns(places)).orderBy("entry_id").collect()
    assert a["commands"] == "cat a.rs && cd /x\nread b.rs\ngrep x y\nweb"
    assert a["files"] == ["a.rs", "b.rs", "c.rs"] and a["commits"] == ["0123abc", "fedcba98"]
    assert a["failed"] and not b["failed"] and a["gist"] == "last line" and a["reply"] == "first\n\n\n\n last  line \nmore"
    assert b["files"] == [] and b["commands"] == "" and b["has_reply"]


def test_commands_cap_lets_later_lines_in():
    long = ("web", {"url": "u" * 290})
    listed = extract.command_list([long] * 14 + [("x", {})])
    assert len(listed.encode()) < extract.COMMANDS_BYTES and listed.endswith("\nx") and listed.count("\n") == 14 - 1 + 1 - (14 - listed.count("uuu" * 90))


@pytest.mark.parametrize(
    ("query", "words", "phrases", "excluded"),
    [("a b", ["a", "b"], [], []), ('x "p q" -n', ["x"], ["p q"], ["n"]), ('"open end', [], ["open end"], []), ("- ! -", [], [], []), ('a-"b c"', ['a-"b', 'c"'], [], []), ('"" a', ["a"], [], [])],
)
def test_query_language(query, words, phrases, excluded):
    p = fulltext.parse_query(query)
    assert (p.words, p.phrases, p.excluded) == (words, phrases, excluded)


def test_exclusions_alone_are_an_error():
    with pytest.raises(BadRequest):
        fulltext.parse_query("-a")


def test_bm25_is_that_of_the_index_engine(spark):
    rows = [("s", 1, "prefix cache cache", "lib.rs", "the prefix cache is cold", ""), ("s", 2, "deploy prefix", "", "deployed the cache", "make deploy"), ("s", 3, "cache", "a/cache.rs", "", "cache prefix"), ("t", 1, "nothing", "", "", ""), ("t", 2, "", "", "", ""), ("t", 3, "lib rs", "", "rs lib", "")]
    df = spark.createDataFrame(rows, "session string, entry_id long, prompt string, files string, reply string, commands string")
    columns = list(fulltext.TURN_WEIGHTS)
    index = fulltext.postings(df, ["session", "entry_id"], columns)
    lengths = fulltext.document_lengths(index, ["session", "entry_id"])
    stats = fulltext.corpus_stats(df, lengths)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(prompt, files, reply, commands, tokenize='porter unicode61')")
    db.executemany("INSERT INTO f(rowid, prompt, files, reply, commands) VALUES (?,?,?,?,?)", [(i, *r[2:]) for i, r in enumerate(rows)])
    for query, expr in [("cache", '"cache"'), ("deploys prefix", '"deploys" OR "prefix"'), ('"prefix cache"', '"prefix cache"'), ('"prefix cache" cold deploy', '"prefix cache" AND ("prefix cache" OR "cold" OR "deploy")'), ("cache -prefix", '("cache") NOT "prefix"'), ("lib.rs", '"lib.rs"'), ("cache cache", '"cache" OR "cache"')]:
        want = {rows[i][:2]: round(s, 9) for i, s in db.execute("SELECT rowid, bm25(f, 3.0, 2.0, 1.0, 0.5) FROM f WHERE f MATCH ?", (expr,))}
        got = fulltext.matches(index, lengths, stats, fulltext.parse_query(query), ["session", "entry_id"], weights=fulltext.TURN_WEIGHTS)
        assert {(r["session"], r["entry_id"]): round(r["bm25"], 9) for r in got.collect()} == want, query


def test_scores_and_snippets():
    assert fulltext.score(-2.0, 0, 0, True) == 2.6 and fulltext.score(-2.0, 5, 0, False) == 1.3
    assert fulltext.snippet("one two three", ["twos"]) == "one two three"
    assert fulltext.snippet("x " * 50 + "needle" + " y" * 50, ["needle"]).count("needle") == 1
    assert fulltext.snippet("one", ["two"]) is None


def test_resolve_project(spark):
    df = spark.createDataFrame([("/w/web", "web", "web", 9), ("/w/Web", "Web", "web", 3), ("/w/deploy-kit", "deploy-kit", "deploy-kit", 1)], "key string, name string, name_lower string, turns long")
    assert lookup.resolve_project(df, "/w/Web")["name"] == "Web" and lookup.resolve_project(df, "web")["turns"] == 9
    assert lookup.resolve_project(df, "ploy")["name"] == "deploy-kit" and lookup.resolve_project(df, "deploi-kit")["name"] == "deploy-kit"
    for bad in ("WEB", "zzz"):
        with pytest.raises(Unknown):
            lookup.resolve_project(df, bad)
    with pytest.raises(BadRequest):
        lookup.resolve_project(df, " ")


@pytest.fixture
def home(tmp_path):
    Log("a", "/work/p").user("deploy the site").reply("Deployed to pages.").user("token sk-secret123 leak").result("exit 1").write(tmp_path, "1900bae3-0000-4000-8000-000000000000")
    Log("b", "/work/q").user("compaction of logs").tool("edit", path="src/x.rs").reply("Compacted everything.").write(tmp_path, "other")
    (tmp_path / "sessions" / "archive").mkdir()
    (tmp_path / "sessions" / "notes.txt").write_text("x")
    return tmp_path


def test_catch_up_life_cycle(spark, home):
    index = ingest.Index(spark, str(home))
    assert index.catch_up() == ingest.Report(changed=2)
    assert index.catch_up() == ingest.Report()
    assert index.stats()["turns"] == 3 and sorted(r["name"] for r in index.projects().collect()) == ["p", "q"]
    path = home / "sessions" / "other.jsonl"
    with path.open("ab") as f:  # growth, with a half-written line
        f.write(json.dumps({"entry_id": 4, "parent_id": 3, "timestamp": T0, "message": {"role": "user", "content": "grown"}}).encode() + b"\nbad\n" + b'{"entry_id": 5')
    assert index.catch_up().changed == 1
    assert index.turns().filter("session = 'other'").count() == 2 and index.stats()["skipped"] == 1
    with path.open("ab") as f:
        f.write(b', "parent_id": 4, "message": {"role": "assistant", "content": "late reply"}}\n')
    index.catch_up()
    assert [r["reply"] for r in index.turns().filter("prompt = 'grown'").collect()] == ["late reply"] and index.stats()["skipped"] == 1
    Log("b", "/work/r").user("rewritten").write(home, "other")
    index.catch_up()
    assert [(r["prompt"], r["project_name"]) for r in index.turns().filter("session = 'other'").collect()] == [("rewritten", "r")]
    assert index.postings().filter("term = 'grown'").count() == 0
    os.remove(path)
    assert index.catch_up().removed == 1 and index.stats()["sessions"] == 1
    with index.lock() as held:
        assert held and index.catch_up().busy
    stored = b"".join(p.read_bytes() for p in (home / "turnscope").rglob("*") if p.is_file())
    assert b"sk-secret123" not in stored


def test_search_show_and_front_ends(spark, home):
    app = cli.App(spark, str(home))
    ctx = Context(cwd="/work/p", now_ms=T0 + 10_000)
    out = app.run(["deploying"], ctx)
    assert out.code == 0 and " | 1 of 1" in out.text and "1. 1900bae3:1" in out.text and "done: Deployed to pages." in out.text
    found = app.engine.search(Request(query="compacting"), ctx)
    assert found.fell_back and found.hits[0]["other_project"] and found.total == 1
    assert app.engine.search(Request(query="compacting", project="p"), ctx).total == 0
    assert app.engine.search(Request(all=True, failed=True), ctx).hits[0]["prompt"] == "token <redacted> leak"
    assert app.engine.search(Request(all=True, file="src/x"), ctx).total == 1
    assert app.engine.search(Request(all=True), Context(session="other", now_ms=T0)).total == 2
    assert [h["entry_id"] for h in app.engine.search(Request(limit=1, offset=1), ctx).hits] == [1]
    assert app.run(["-x"], ctx).code == 2 and app.run(["--since", "nope", "a"], ctx).code == 2 and app.run(["-p", "zzz", "a"], ctx).code == 3
    shown = app.engine.show("1900:1", 5)
    assert [t["entry_id"] for t in shown.turns] == [1, 3]
    for bad, code in (("x", 2), (":1", 2), ("19:99", 3), ("nosuch:1", 3)):
        assert app.run(["show", bad], ctx).code == code
    assert ">> 1900bae3:1" in app.run(["show", "1900:1", "--around", "1"], ctx).text
    assert json.loads(app.run(["show", "1900:1", "--json"], ctx).text)["turns"][0]["reply"] == "Deployed to pages."
    assert json.loads(app.run(["search", "--json", "deploy"], ctx).text)["total"] == 1
    assert [p["name"] for p in json.loads(app.run(["projects", "--json"], ctx).text)] == ["p", "q"]
    assert "2 sessions" in app.run(["status"], ctx).text and "2 sessions, 3 turns" in app.run(["reindex"], ctx).text
    assert not app.tool_call({"query": "nothinghere", "all": "true"}, ctx)["is_error"] and app.tool_call({"limit": 1.5}, ctx)["is_error"]
    sent = [{"id": 1, "method": "plugin/manifest"}, {"method": "tool/call"}, {"id": 2, "method": "nope"}, {"id": 3, "method": "tool/call", "params": {"name": "x"}}, {"id": 4, "method": "command/run", "params": {"argv": ["projects"]}}, {"id": 5, "method": "plugin/shutdown"}, {"id": 6, "method": "plugin/manifest"}]
    wrote = io.StringIO()
    cli.serve(app, io.StringIO("junk\n" + "\n".join(map(json.dumps, sent))), wrote)
    replies = [json.loads(line) for line in wrote.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 3, 4, 5] and replies[1]["result"]["is_error"] and "2 projects" in replies[2]["result"]["text"]


def test_follow_catches_up(spark, home):
    query = ingest.follow(spark, str(home), once=True)
    query.awaitTermination()
    assert ingest.Index(spark, str(home)).stats()["turns"] == 3


def test_arguments():
    assert cli.normalize(["a"]) == ["search", "a"] and cli.normalize(["show", "x"]) == ["show", "x"] and cli.normalize([]) == ["search"]
    assert cli.query_from(["a b", "c", 'd "e f"', "g -h"]) == '"a b" c d "e f" g -h'
    got = cli.request_from_json({"query": 7, "limit": "3", "all": "true", "since": "", "unknown": 1, "offset": 2.0})
    assert (got.query, got.limit, got.all, got.since, got.offset) == ("7", 3, True, None, 2)
    assert cli.request_from_json(None) == cli.request_from_json({"query": None, "limit": " ", "offset": 0.0}) == Request()
    assert cli.request_from_json({"query": True and "x", "all": "false", "id": 3, "max_chars": " 7 "}) == Request(query="x", all=False, id="3", max_chars=7)
    for bad in ({"limit": -1}, {"all": 1}, {"query": []}, [1], {"limit": True}, {"query": False}, {"all": ""}, {"offset": 1.5}, {"limit": float("nan")}, {"limit": "+3"}):
        with pytest.raises(BadRequest):
            cli.request_from_json(bad)
    assert Request(limit=0).page == 1 and Request(limit=99).page == 20 and Request(id="x").budget == 8000 and Request(max_chars=1).budget == 500
    assert cli.wire_context({"session": {"cwd": "/s", "id": "i"}, "cwd": "/c"}).cwd == "/s" and len(cli.tool_definition()["parameters"]["properties"]) == 13


def _turn(n, **k):
    return {"session": "s", "entry_id": n, "project_key": "/w/p", "project_name": "p", "cwd": "/w/p", "date": T0, "prompt": f"prompt {n} " + "x " * 400, "reply": "r " * 3000, "gist": "gist " * 80, "commands": "c " * 500, "files": ["a.rs"] * 30, "commits": ["0123456789"] * 5, "failed": n % 2 == 0, "has_reply": True, "did": "did " * 200, "score": 1.0, "other_project": False} | k


@pytest.mark.parametrize("budget", [500, 900, 2500, 8000])
def test_views_stay_in_budget(budget):
    found = Found("project p", 4140, False, [_turn(i) for i in range(1, 21)], 33)
    text = render.search_text(found, Request(query="q", max_chars=budget))
    assert len(text) <= budget and "of 33" in text and "read on: " in text
    assert len(render.show_text(Shown("s", 5, [_turn(i) for i in range(1, 11)]), budget)) <= budget
    assert len(render.projects_text([{"name": f"n{i}", "key": f"/k/{i}", "turns": i} for i in range(300)], budget)) <= budget


def test_blocks_take_what_room_there_is():
    block = lambda n, rank: render.Block(("a" * 3 * n, "b" * n), rank)
    assert render.each_richest([block(4, 1), block(4, 2), block(4, 3)], 21) == ["a" * 12, "b" * 4, "b" * 4]
    assert render.each_richest([block(4, 1), block(4, 2)], 7) == ["b" * 4] and render.each_richest([], 7) == []
    near, far = block(4, 1), block(5, 2)
    assert render.all_alike([far, near], 27) == {far: "a" * 15, near: "a" * 12}
    assert render.all_alike([far, near], 20) == {far: "b" * 5, near: "b" * 4} and render.all_alike([far, near], 8) == {near: "b" * 4}


def test_manifest_fields():
    told = cli.manifest()
    tool = told["tools"][0]
    assert told["commands"] == list(told["command_descriptions"]) and told["description"] and told["protocol"] == "1.1" and told["hooks"] == []
    assert [c["arg"] for c in told["completion"]] == list(cli.VERBS) and all(c["description"] for c in told["completion"])
    assert tool["label"] and tool["snippet"] and tool["preview"] == "query" and len(tool["description"]) > 80


def test_empty_views():
    nothing = Found("project p", 0, False, [], 0)
    assert "--all looks everywhere" in render.search_text(nothing, Request())
    assert "smaller offset" in render.search_text(Found("project p", 9, False, [], 9), Request(offset=200))
    assert "any project" in render.search_text(Found("project p", 0, False, [], 0, True), Request(), busy=True)
    assert "no project" in render.projects_text([], 500)
    assert "never" in render.status_text({"turns": 1, "sessions": 1, "projects": 1, "bytes": 9, "skipped": 0, "last_catch_up": None}, "/i", T0)
    assert render.divide(100, [10, 10, 1000], [4, 3, 1]) == [10, 10, 80] and render.divide(90, [1000, 1000, 1000], [4, 3, 1]) == [22, 22, 46]
