import hashlib
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewarden.functions import jsons
from tracewarden.plans import pipelines
from tracewarden.sources import browser, canonical, committed, dialogue, files, terminal, trials


def run(i, ok=True, split="train", **more):
    return {"trajectory_id": f"t{i}", "task_id": "toy", "final_success": ok, "split": split, "steps": [{"context": "c", "action_text": f"a{k}", "tool_name": "", "tool_args": {"b": 1, "a": "é"}} for k in range(3)]} | more


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_canonical_round_trip(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [run(0), "", run(1, ok=False, failure_bucket="SEARCH_MISS", metadata={"x": [1]}), "  "])
    runs = canonical.read_runs(spark, path)
    s = canonical.steps_of(runs)
    assert runs.count() == 2 and s.count() == 6
    first = s.where("trajectory_id = 't0' and step_index = 1").first()
    assert (first["tool_name"], first["result_text"], first["failure_bucket"], json.loads(first["tool_args"])) == (None, "", "NONE", {"a": "é", "b": 1})
    assert s.select(jsons.canonical_json("tool_args")).first()[0] == '{"a": "\\u00e9", "b": 1}'
    canonical.write_runs(runs, str(tmp_path / "out"))
    again = canonical.read_runs(spark, str(tmp_path / "out"))
    cols = ["trajectory_id", "final_success", "failure_bucket", "metadata", "steps"]
    assert sorted(map(str, again.select(cols).collect())) == sorted(map(str, runs.select(cols).collect()))
    info = pipelines.inspect(spark, path)
    assert info["splits"] == [{"split": "train", "trajectory_count": 2, "prefix_count": 6, "positive_count": 3, "signature_count": 6}]


@pytest.mark.parametrize("rows,problem", [([run(0), '{"trajectory_id": '], "not a JSON"), ([{k: v for k, v in run(0).items() if k != "task_id"}], "task_id is missing"), ([run(0, steps=[])], "no steps"), (["", " "], "no record"), ([run(0, steps=[{"context": "c"}])], "a step lacks")])
def test_bad_lines_raise(spark, tmp_path, rows, problem):
    path = write(tmp_path / "a.jsonl", rows)
    with pytest.raises(ValueError, match=problem):
        canonical.read_runs(spark, path)


def test_rejects(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [run(0), "{"])
    assert canonical.read_runs(spark, path, strict=False).count() == 1
    assert canonical.rejected_lines(spark, path).first()["problem"] == "not a JSON object"


def test_manifests(spark, tmp_path):
    rows = [{"trajectory_id": f"terminalbench::a::{i}", "split": s} for i, s in ((2, "fit"), (1, "cal"))]
    m = canonical.read_manifest(spark, write(tmp_path / "m.jsonl", rows))
    runs = spark.createDataFrame([("terminalbench::a::1", "x"), ("terminalbench::a::2", "y"), ("terminalbench::a::3", "z")], "trajectory_id string, v string")
    assert [(r["trajectory_id"][-1], r["split"], r["v"]) for r in canonical.join_manifest(m, runs).collect()] == [("2", "fit", "y"), ("1", "cal", "x")]
    with pytest.raises(ValueError, match="not in the source"):
        canonical.join_manifest(m, runs.limit(0))
    with pytest.raises(ValueError, match="more than once"):
        canonical.read_manifest(spark, write(tmp_path / "n.jsonl", [rows[0], rows[0]]))
    with pytest.raises(ValueError, match="another shape"):
        canonical.read_manifest(spark, write(tmp_path / "o.jsonl", [rows[0], run(1)]))
    with pytest.raises(ValueError, match="split manifest"):
        canonical.read_runs(spark, str(tmp_path / "m.jsonl"))


def test_artifacts(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    text = b'{"a":1}\n\n{"a":2}\n'
    (tmp_path / "d" / "x.jsonl").write_bytes(text)
    expected = spark.createDataFrame([("x.jsonl", 2, hashlib.sha256(text).hexdigest()), ("y.jsonl", 1, None)], "path string, rows long, sha256 string")
    got = {r["path"]: r for r in canonical.verify_artifacts(spark, expected, str(tmp_path / "d")).collect()}
    assert got["x.jsonl"]["ok"] and not got["y.jsonl"]["ok"] and not got["y.jsonl"]["found"]


@pytest.mark.parametrize("piece", [1, 3, 5, 1000])
def test_artifacts_pass_piece_by_piece(spark, tmp_path, piece):
    (tmp_path / "d").mkdir()
    texts = {"a": b"one\n \n\ntwo\n  x", "b": "é é\n\n".encode() * 3, "c": b"\n \n", "e": b"no end"}
    for name, text in texts.items():
        (tmp_path / "d" / name).write_bytes(text)
    rows = [(n, sum(x.strip(b" ") != b"" for x in t.split(b"\n")), hashlib.sha256(t).hexdigest()) for n, t in texts.items()]
    expected = spark.createDataFrame([*rows, ("f", None, None)], "path string, rows long, sha256 string")
    got = {r["path"]: r for r in canonical.verify_artifacts(spark, expected, str(tmp_path / "d"), piece).collect()}
    assert all(got[n]["ok"] and (got[n]["row_count"], got[n]["digest"]) == (k, h) for n, k, h in rows) and not got["f"]["found"]
    assert canonical._passed(str(tmp_path / "d" / "a"), piece) == (rows[0][2], rows[0][1])


def test_result_files_stay_small(spark, tmp_path, monkeypatch):
    from tracewarden.plans import catalogue, scratch, source_queries  # noqa: F401

    monkeypatch.setattr(scratch, "folder", lambda spark, name: str(tmp_path / name))
    talk = spark.range(5000).selectExpr("id AS conv_id", "explode(array(0L, 1L)) AS turn").selectExpr("conv_id", "turn", "if(turn = 0, 'user', 'assistant') AS role", "concat('t', conv_id) AS text")
    talk.write.parquet(str(tmp_path / "sf" / "conversations.parquet"))
    assert catalogue.QUERIES["dialogue_result_steps"](spark, str(tmp_path / "sf")).count() == sum(i % 11 < 10 for i in range(5000))
    files_ = list((tmp_path / "results").glob("bundle=*/*.json"))
    assert len(files_) == 20 and all(len(json.loads(f.read_text())["simulations"]) <= 256 for f in files_)


def test_dialogue(spark, tmp_path):
    call = lambda i, n: {"id": i, "name": n, "arguments": {"k": 1}}
    messages = [
        {"role": "user", "content": "hi"},
        {"role": "assistant", "content": "let me see", "tool_calls": [call("c1", "get_a"), call("c2", "get_b")]},
        {"role": "tool", "id": "c2", "content": "two", "error": True},
        {"role": "tool", "id": "zz", "content": "spare"},
        {"role": "assistant", "content": "done"},
        {"role": "user", "content": "thanks"},
    ]
    doc = {"info": {"environment_info": {"domain_name": "shop"}, "agent_info": {"llm": "m"}}, "tasks": [{"id": "1", "description": "d"}], "simulations": [{"id": "s", "task_id": "1", "trial": 0, "reward_info": {"reward": 0.0, "reward_basis": "['DB', 'COMMUNICATE']"}, "messages": messages}, {"id": "u", "task_id": "9", "messages": messages}]}
    (tmp_path / "agent_shop_base_user_x.json").write_text(json.dumps(doc))
    r = dialogue.read_results(spark, str(tmp_path))
    assert dialogue.missing_tasks(r).first()["task_id"] == "9"
    s = dialogue.steps(r).orderBy("step_index").collect()
    assert [(x["tool_name"], x["result_text"], x["status"]) for x in s] == [("get_a", "spare", "ok"), ("get_b", "two", "tool_error"), ("respond", "user: thanks", "failure")]
    assert s[0]["trajectory_id"] == "tau2-shop-agent_shop_base_user_x-task1-trial0" and s[0]["failure_bucket"] == "TAU2_DB_COMMUNICATE"
    assert s[0]["action_text"] == "let me see\nTOOL_CALL get_a" and s[0]["context"].endswith("observation=\nuser: hi")
    assert dialogue.summary(r, dialogue.steps(r)).first().asDict() == {"num_imported": 1, "num_steps": 3, "num_successes": 0, "num_failures": 1, "num_without_task": 1}


def test_terminal(spark, tmp_path):
    messages = [{"src": "user", "msg": "do it"}, {"src": "agent", "msg": "run", "tools": [{"fn": "bash", "cmd": "ls"}], "obs": "Traceback x"}, {"src": "Agent", "msg": "", "tools": [{"fn": "a", "cmd": "1"}, {"fn": "b"}], "obs": "ok"}]
    rows = pd.DataFrame({"task_name": ["t", "t"], "trial_name": ["n", ""], "trial_id": ["i", None], "agent": ["g"] * 2, "model": ["m"] * 2, "reward": [1, 0], "steps": [json.dumps(messages), "null"]})
    (tmp_path / "data").mkdir()
    rows.to_parquet(tmp_path / "data" / "p.parquet")
    table = terminal.read_table(spark, str(tmp_path))
    s = terminal.steps(table).orderBy("step_index").collect()
    assert [(x["trajectory_id"], x["tool_name"], x["status"]) for x in s] == [("terminalbench::n::i", "bash", "tool_error"), ("terminalbench::n::i", "multi_tool_call", "success")]
    assert json.loads(s[0]["tool_args"]) == {"cmd": "ls"} and json.loads(s[1]["tool_args"]) == {"cmd_preview": ["1"], "tool_count": 2, "tool_fns": ["a", "b"], "truncated_tool_count": 1}
    assert s[1]["action_text"] == "tool_call::multi_tool_call" and "user: do it\nagent: run" in s[1]["context"]
    assert {r["skip"]: r["count"] for r in terminal.skip_counts(table).collect()} == {"no_steps": 1}
    assert terminal.light_scan(table).first().asDict() == {"task_id": "terminalbench::t", "runs": 1, "skipped": 1, "successes": 1, "agent_steps": 2}


PAGE = """<html><div class="state_obv"><pre>obs 1</pre></div><h3 class="url">URL: http://a</h3><div class="action_object">{'answer': '', 'raw_prediction': 'I will ```click [12]```'}</div>
<div class="state_obv">obs 2</div><h3 class="url">http://b</h3><div class="action_object">{'answer': 'x', 'raw_prediction': 'no idea'}</div></html>"""


def test_browser(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "release_v1.0_ab.c.zip", "w") as z:
        z.writestr("r/merged_log.txt", "[Config file]: config_files/3.json\n[Result] (FAIL) config_files/3.json\n[Result] (PASS) config_files/3.json\n[Config file]: config_files/4.json\n")
        z.writestr("r/render_3.html", PAGE)
    members = browser.read_members(spark, str(tmp_path))
    assert browser.missing_results(browser.log_labels(members)).first()["task_id"] == 4
    tasks = spark.createDataFrame([(3, "find it", 8)], "task_id int, intent string, intent_template_id long")
    s = browser.steps(members, tasks).orderBy("step_index").collect()
    assert [(x["trajectory_id"], x["tool_name"], x["action_text"], x["status"]) for x in s] == [("abc-3", "click", "click [12]", "ok"), ("abc-3", "stop", "stop [EARLY_STOP]", "early_stop")]
    assert s[0]["result_text"] == "next_url=http://b\nnext_observation=\nobs 2" and s[1]["result_text"] == "" and s[0]["final_success"]
    assert s[0]["context"] == "task_intent=find it\ncurrent_url=http://a\nobservation=\nobs 1"


def test_an_archive_is_read_by_several_tasks(spark, tmp_path):
    texts = {f"r/render_{i}.html": f"<p>{'é' * (50 * i)}</p>" for i in range(30)}
    for name in ("one.zip", "release_v1.0_two.zip"):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("r/merged_log.txt", "x")
            z.writestr("r/other.bin", b"\xff" * 9)
            z.writestr("r/deeper/render_1.html", "no")
            for m, t in texts.items():
                z.writestr(m, t)
    members = browser.read_members(spark, str(tmp_path), part_bytes=4000)
    found = files.archive_members(spark, str(tmp_path), part_bytes=4000)
    assert found.rdd.getNumPartitions() >= 2 * sum(len(t.encode()) for t in texts.values()) // 4000
    got = {(r["source"], r["member"]): r["text"] for r in members.collect()}
    want = {m.removeprefix("r/"): t for m, t in texts.items()} | {"merged_log.txt": "x"}
    assert got == {(s, m): t for s in ("one", "two") for m, t in want.items()}
    assert files.archive_members(spark, str(tmp_path / "one.zip"), r"other").count() == 1
    (tmp_path / "none").mkdir()
    assert files.archive_members(spark, str(tmp_path / "none")).count() == 0
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("render_1.html", "")
    with pytest.raises(Exception, match="0 files named merged_log.txt"):
        browser.read_members(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("text,expected", [("```goto [x]``` then ```click [1]```", "click [1]"), ("do `type [2] [a]` now", "type [2] [a]"), ("1. scroll [down]\nbecause", "scroll [down]"), ("nothing", "nothing")])
def test_actions(text, expected):
    assert browser.action_text(text) == expected


TRACES = {
    "agent/sessions/projects/p/s.jsonl": ("claude_session_jsonl", [{"type": "user", "message": {"content": "go"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "look"}, {"type": "tool_use", "id": "1", "name": "Bash", "input": {"command": "ls"}}]}}, {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": "f", "is_error": False}]}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "bye"}]}}], ["bash", "respond"]),
    "trajectory/acp_trajectory.jsonl": ("acp_trajectory_jsonl", [{"type": "tool_call", "kind": "execute", "title": "Terminal", "status": "completed", "content": [{"type": "content", "content": {"type": "text", "text": "ls"}}]}, {"type": "agent_message", "text": "done"}], ["bash", "respond"]),
    "agent/codex.txt": ("codex_txt", [{"type": "item.completed", "item": {"type": "reasoning", "text": "think"}}, {"type": "item.completed", "item": {"type": "command_execution", "command": "ls", "exit_code": 1, "aggregated_output": "no"}}, {"type": "item.completed", "item": {"type": "command_execution", "command": "pwd", "exit_code": 0}}], ["bash", "bash"]),
    "agent/gemini-cli.trajectory.json": ("gemini_cli_trajectory_json", {"messages": [{"type": "user", "content": "q"}, {"type": "gemini", "content": "", "toolCalls": [{"name": "read_file", "status": "error", "args": {}, "result": [{"functionResponse": {"response": {"error": "x"}}}]}]}, {"type": "gemini", "content": "end"}]}, ["read_file", "respond"]),
    "agent/trajectory.json": ("trajectory_json", [{"prompt": "p0", "response": '{"analysis": "an", "commands": [{"keystrokes": "ls"}, {"keystrokes": "cd"}]}'}, {"prompt": "p1", "response": '{"load_skill": "s"}'}, {"prompt": "p2", "response": "text"}], ["bash", "bash", "load_skill", "respond"]),
    "agent/gemini-cli.txt": ("gemini_cli_txt", "YOLO mode is enabled. x\none\n\ntwo", ["respond", "respond"]),
}


def trial(root, below, body, reward=1.0):
    (root / below).parent.mkdir(parents=True, exist_ok=True)
    text = body if isinstance(body, str) else "\n".join(map(json.dumps, body)) if below.endswith(("l", "t")) else json.dumps(body)
    (root / below).write_text(text)
    (root / "result.json").write_text(json.dumps({"task_name": "task", "trial_name": root.name, "verifier_result": {"rewards": {"reward": reward}}}))
    (root / "config.json").write_text(json.dumps({"agent": {"name": "ag", "model_name": "mo"}}))


def test_trials(spark, tmp_path):
    for k, (below, (_, body, _)) in enumerate(TRACES.items()):
        trial(tmp_path / "jobs" / "cond" / f"t{k}", below, body, reward=float(k % 2))
    both = tmp_path / "jobs" / "cond" / "t0"
    (both / "agent" / "codex.txt").write_text("")  # a lower priority
    found = trials.find_trials(spark, str(tmp_path))
    runs = {r["trajectory_id"].rsplit("::", 1)[1]: r for r in trials.parse_trials(found, strict=True).collect()}
    for k, (_, (fmt, _, tools)) in enumerate(TRACES.items()):
        r = runs[f"t{k}"]
        assert json.loads(r["metadata"])["trace_format"] == fmt and [s["tool_name"] for s in r["steps"]] == tools
        assert r["trajectory_id"] == f"skillsbench::cond::t{k}" and r["final_success"] == bool(k % 2)
        assert r["steps"][-1]["status"] == ("success" if k % 2 else "failure") and all(s["source_raw_text"] for s in r["steps"])
    assert runs["t0"]["steps"][0]["result_text"] == "result=f" and "dialogue_history=\nuser: go" in runs["t0"]["steps"][0]["context"]
    assert "recent_reasoning=think" in runs["t2"]["steps"][0]["context"] and "recent_reasoning" not in runs["t2"]["steps"][1]["context"]
    assert runs["t3"]["steps"][0]["result_text"] == 'error=x\n{"error": "x"}' and runs["t4"]["steps"][0]["action_text"] == "analysis=an ls"
    assert runs["t4"]["steps"][1]["result_text"] == "p1"
    manifest = spark.createDataFrame([(0, "skillsbench::cond::t3", "val")], "position long, trajectory_id string, split string")
    assert trials.read_manifest_runs(spark, manifest, str(tmp_path)).first()["split"] == "val"


def test_only_the_manifests_traces_are_opened(spark, tmp_path):
    """Traces of other runs are dangling links: to open one is to fail."""
    for k in range(4):
        home = tmp_path / "jobs" / "cond" / f"t{k}"
        trial(home, "agent/codex.txt", TRACES["agent/codex.txt"][1])
        if k > 1:
            (home / "agent" / "codex.txt").unlink()
            (home / "agent" / "codex.txt").symlink_to(tmp_path / "gone")
            (tmp_path / "gone").write_text("x")
    doc = json.loads((tmp_path / "jobs/cond/t1/result.json").read_text())
    (tmp_path / "jobs/cond/t1/result.json").write_text(json.dumps(doc | {"trial_name": "renamed"}))
    manifest = spark.createDataFrame([(0, "skillsbench::cond::t0", "val"), (1, "skillsbench::cond::renamed", "fit")], "position long, trajectory_id string, split string")
    listed = trials.list_trials(spark, str(tmp_path)).cache()
    assert listed.count() == 4
    (tmp_path / "gone").unlink()
    monkey = pytest.MonkeyPatch()
    monkey.setattr(trials, "list_trials", lambda *_: listed)
    got = [(r["trajectory_id"], r["split"]) for r in trials.read_manifest_runs(spark, manifest, str(tmp_path)).collect()]
    assert got == [("skillsbench::cond::t0", "val"), ("skillsbench::cond::renamed", "fit")]
    with pytest.raises(Exception, match="t[23]"):
        trials.read_trials(listed).collect()
    monkey.undo()


def test_lines_are_committed_as_a_whole(spark, tmp_path):
    path = tmp_path / "out"
    df = spark.range(1000).selectExpr("if(id = 5, null, concat('line é ', id)) AS value").repartition(4)
    committed.write_lines(df, str(path))
    m = committed.manifest(spark, str(path)).collect()
    assert sum(r["rows"] for r in m) == 999 and len(m) == 4 and not list((path / committed.STAGING).iterdir())
    for r in m:
        data = (path / r["path"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and data.count(b"\n") == r["rows"]
    assert sorted(r["value"] for r in committed.read_lines(spark, str(path)).collect()) == sorted(f"line é {i}" for i in range(1000) if i != 5)
    assert all(r["ok"] for r in canonical.verify_artifacts(spark, committed.manifest(spark, str(path)), str(path)).collect())
    with pytest.raises(Exception, match="has been written"):
        committed.write_lines(df, str(path))
    # a write that fails half way leaves what was there
    bad = spark.range(1000).selectExpr("if(id = 777, raise_error('broken'), 'x') AS value").repartition(4)
    before = sorted(f.name for f in path.iterdir())
    for target, overwrite in ((path, True), (tmp_path / "new", False)):
        with pytest.raises(Exception, match="broken"):
            committed.write_lines(bad, str(target), overwrite)
    assert sorted(f.name for f in path.iterdir()) == before and not list((tmp_path / "new").rglob("*.json*"))
    committed.write_lines(df.limit(3), str(path), overwrite=True)
    assert sum(r["rows"] for r in committed.manifest(spark, str(path)).collect()) == committed.read_lines(spark, str(path)).count() <= 3
    committed.write_lines(df.limit(0), str(tmp_path / "empty"))
    assert committed.read_lines(spark, str(tmp_path / "empty")).count() == 0


def test_document_trace():
    payload = {"schema_version": "ATIF-v1.5", "steps": [{"source": "user", "message": "q"}, {"source": "agent", "message": "m", "tool_calls": [{"function_name": "edit", "arguments": {}}, {"function_name": "x"}], "observation": {"results": [{"content": "r0"}]}}]}
    _, s = trials.trial_steps("/a/jobs/c/t", "trajectory_json", json.dumps(payload), {}, {})
    assert [(x["tool_name"], x["result_text"]) for x in s] == [("replace", "r0"), ("x", "NONE")]


def test_bad_trials_are_reported(spark, tmp_path):
    trial(tmp_path / "jobs" / "c" / "t", "agent/codex.txt", "{")
    r = trials.parse_trials(trials.find_trials(spark, str(tmp_path))).first()
    assert r["problem"] and r["steps"] == []


def test_runs_are_handed_on_as_they_come(spark):
    line = json.dumps({"type": "item.completed", "item": {"type": "command_execution", "command": "c", "exit_code": 0}})
    cells = [F.concat(F.lit("/jobs/c/t"), "id").alias("trial"), *(F.lit(x).alias(n) for n, x in (("result", "{}"), ("config", "{}"), ("exception", ""), ("format", "codex_txt"))), F.when(F.col("id") % 7 < 6, line).otherwise("{").alias("trace")]
    t = spark.range(50, numPartitions=2).select(*cells)
    for held in (1, 10**9):
        r = trials.parse_trials(t, held_bytes=held).collect()
        assert len(r) == 50 and sum(x["problem"] is not None for x in r) == 7 and all(len(x["steps"]) == (x["problem"] is None) for x in r)
        assert {x["trajectory_id"] for x in r if x["steps"]} == {f"skillsbench::c::t{i}" for i in range(50) if i % 7 < 6}


def test_manifest_runs_are_read_once(spark, tmp_path):
    line = json.dumps({"type": "item.completed", "item": {"type": "command_execution", "command": "c", "exit_code": 0}})
    for i in range(3):
        trial(tmp_path / "jobs" / "c" / f"t{i}", "agent/codex.txt", line)
    listed = trials.list_trials(spark, str(tmp_path))
    ids = {r["trial"].rsplit("/", 1)[1]: r["trajectory_id"] for r in trials.parse_trials(trials.read_trials(listed), strict=True).collect()}
    manifest = spark.createDataFrame([(i, ids[f"t{i}"], "fit") for i in range(2)], "position long, trajectory_id string, split string")
    try:
        got = trials.read_manifest_runs(spark, manifest, str(tmp_path))
    finally:
        for f in tmp_path.rglob("codex.txt"):
            f.unlink()
    assert [(r["trajectory_id"], len(r["steps"])) for r in got.collect()] == [(ids["t0"], 1), (ids["t1"], 1)]


def test_trials_are_listed_by_few_tasks(spark, tmp_path):
    """What Spark's own listing finds, but without a task for every few files."""
    for i in range(200):
        trial(tmp_path / "jobs" / f"c{i % 2}" / f"t {i}é%20#", "agent/codex.txt", "x")
    home = tmp_path / "jobs" / "c0" / "t 0é%20#"
    deep = home / "agent" / "sessions" / "projects" / "trajectory"
    trial(deep.parent, "trajectory/acp_trajectory.jsonl", "x")  # a trial's only trace, and the other's best one
    for name in (".git/x", "_work/x", "_k=1/x", "k=1/_x", "x._COPYING_", "empty", "exception.txt", "a/exception.txt"):
        (home / name).parent.mkdir(exist_ok=True)
        (home / name).write_text("" if name == "empty" else "x")
    (home / "gone").symlink_to(tmp_path / "nothing")
    root, tracker = f"file://{tmp_path}/", spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    spark.sparkContext.setJobGroup("listing", "")
    try:
        found = {r["trial"]: r for r in trials.list_trials(spark, root).collect()}
        tasks = sum(tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks < 400 and len(found) == 201
    first, inner = found[f"file:{home}"], found[f"file:{deep.parent}"]
    assert (first["format"], first["trace_path"], first["exception_path"]) == ("claude_session_jsonl", f"file:{deep}/acp_trajectory.jsonl", f"file:{home}/exception.txt")
    assert (inner["format"], inner["trace_path"], inner["exception_path"]) == ("acp_trajectory_jsonl", f"file:{deep}/acp_trajectory.jsonl", None)
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    assert sorted(files.listed(spark, root).collect()) == sorted(theirs.collect())
    with pytest.raises(FileNotFoundError):
        files.listed(spark, str(tmp_path / "nothing"))


def test_files_are_read_by_many_tasks(spark, tmp_path):
    """Rows that one task holds are dealt out before their files are opened."""
    for i in range(20):
        (tmp_path / f"{i}").write_text(f"é{i}")
    rows = spark.range(20, numPartitions=1).select("id", F.when(F.col("id") > 0, F.concat(F.lit(f"{tmp_path}/"), "id")).alias("path"))
    got = files.fetched(rows, {"path": "text"}).withColumn("task", F.spark_partition_id()).collect()
    assert {r["id"]: r["text"] for r in got} == {i: f"é{i}" if i else None for i in range(20)} and len({r["task"] for r in got}) == 4


def test_bounded_json():
    counts = {}
    out = jsons.bounded({"a": "x" * 3000, "b": list(range(20))}, counts)
    assert counts == {"string_values": 1, "list_values": 1} and len(out["a"]) == 2048 and out["b"][8] == {"source_raw_truncated_items": 4} and out["b"][-1] == 19


def test_basis(spark):
    got = spark.createDataFrame([("['DB', 'a b']",), ("x-y",), (None,), ("[]",)], "b string").select(dialogue.failure_basis(F.col("b"))).collect()
    assert [r[0] for r in got] == ["DB_A_B", "X_Y", "", ""]
