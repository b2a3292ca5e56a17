import json

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import adapter, render
from tracewarden.functions import reduce as R
from tracewarden.functions import text as T

COLUMNS = "context string, action_text string, tool_name string, tool_args string, result_text string, status string, source_raw_text string"


def view(spark, context, action="a", tool=None, args="{}", result="", status=None, **options):
    df = spark.createDataFrame([(context, action, tool, args, result, status, None)], COLUMNS)
    return render.step_views(df, **options).first()


def test_text_functions(spark):
    r = spark.range(1).select(T.normalize(F.lit("  a\t b\x1c ")).alias("n"), T.lines(F.lit("a\r\nb\x0bc d\n")).alias("l"), T.token_count(F.lit(" ")).alias("z"), T.compact(F.lit("x" * 30), 20).alias("c")).first()
    assert (r["n"], r["l"], r["z"], r["c"]) == ("a b", ["a", "b", "c", "d"], 0, "xxxx...<truncated>")


def test_dialogue_view(spark):
    context = "dataset=TAU2Bench\nobservation=\nuser: hi\nassistant: hello\ntool[a]: found 3\nuser: please"
    r = view(spark, context, "Could you confirm your order number?", "respond", dialogue_profile="collecting-subtypes-v3")
    assert "speaker_pattern=user->assistant->tool->user" in r["metadata_lines"] and "query_collecting_mode=confirm" in r["metadata_lines"]
    assert r["observation_lines"] == ["user: hi", "assistant: hello", "user: please", "tool_summary: lookup_success"]
    assert (r["tool_name"], r["status"]) == ("respond", "NONE")


def test_process_view(spark):
    context = "dataset=SkillsBench\ntrace_format=codex_txt\ninitial_prompt=do\nmore words\nobservation=\nx"
    r = view(spark, context, "run pytest", "bash", '{"command": "pytest -q", "exit_code": 1}', "output=ok", "failed")
    assert "initial_prompt=do more words" in r["metadata_lines"] and "skillsbench_phase=test" in r["metadata_lines"]
    assert "skillsbench_exit_code_fine=error_generic" in r["metadata_lines"] and r["observation_lines"] == []


def test_block_and_line_views(spark):
    r = view(spark, "dataset=TerminalBench\ntask_name=q\nhistory=\nstdout: 1\nline\nerror: bad 22", max_lines=1)
    assert r["observation_lines"] == ["error: bad 22"]
    r = view(spark, "a\nb\nc 1\nd error 22\ne click", "click", max_lines=2)
    assert (r["metadata_lines"], r["observation_lines"]) == (["a", "b"], ["d error 22", "e click"])
    assert view(spark, "")["metadata_lines"] == ["NO_METADATA"]


def test_ties_take_the_first_lines(spark):
    df = spark.createDataFrame([(["b", "a", "c"], ["z"])], "lines array<string>, hints array<string>")
    assert R.add_best(df, "lines", "hints", "top", 2).first()["top"] == ["b", "a"]
    assert R.add_best(df, "lines", "hints", "top", 0).first()["top"] == []


def test_text_modes(spark):
    df = spark.createDataFrame([("m1\nm2\nobservation=o", "go", "t", "{}", "r", "ok", "raw  text")], COLUMNS)
    v = render.step_views(df)
    text = lambda mode, **k: v.select(render.view_text(mode, **k)).first()[0]
    assert text("full") == "tool=t status=ok action=go args={} result=r meta=m1 | m2"
    assert text("transfer-full").endswith(" observation=o") and text("drop-args-result") == "tool=t status=ok action=go args={} result=NONE meta=m1 | m2"
    assert text("observation-only") == "o" and text("full", exclude=("m",)).endswith("meta=NONE")
    with pytest.raises(ValueError):
        render.view_text("other")
    assert render.payloads(df, "source-raw").first()["payload"] == "raw text"
    assert render.payloads(df).first()["payload"].startswith("CONTEXT=[m1 m2 observation=o] ACTION=[action=go; tool=t; args={}]")


SPEC = {
    "dataset_name": "d", "version": "v1", "trace_family": "browser", "notes": [],
    "field_mapping": {"metadata_sources": ["context:line:task_id=", "field:tool_name"], "observation_source": "context:observation_block", "action_source": "field:action_text", "tool_source": "field:tool_name", "args_source": "field:tool_args", "result_source": "field:result_text", "status_source": "field:status"},
    "policies": {"observation_unit": "line", "reducer_kind": "lexical_lines", "max_observation_units": 2, "tool_normalization": {"lowercase": True, "aliases": {"go": "navigate"}}, "status_policy": {"mode": "native_or_derive", "derive_from_result_patterns": [{"pattern": "BAD", "status": "failed"}]}},
    "confidence": dict.fromkeys(adapter.PARTS, 0.5),
}


def test_adapter(spark, tmp_path):
    df = spark.createDataFrame([("task_id=7\nx=1\nobservation=\nl1\nl2 3\nl4 55", "act", "Go", '{"a": "q"}', "so bad", None, None)], COLUMNS)
    r = adapter.step_views(df, SPEC).first()
    assert (r["metadata_lines"], r["tool_name"], r["status"], r["observation_lines"]) == (["task_id=7", "Go"], "navigate", "failed", ["l2 3", "l4 55"])
    adapter.save(SPEC, tmp_path / "s.json")
    assert adapter.load(tmp_path / "s.json") == SPEC


def test_projection_of_repeated_lines_is_its_sql(spark, tmp_path):
    import duckdb

    from tracewarden.plans import catalogue, step_queries  # noqa: F401

    texts = ["a\nb\na\n\na", "respond\nrespond", "", "x y\nx  y\nobservation=z\nx y", "task_name=second\nbash\nBash"]
    talk = spark.createDataFrame([(c, t, "user", texts[(c + t) % 5]) for c in range(24) for t in range(5)], "conv_id long, turn long, role string, text string")
    talk.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in catalogue.QUERIES["adapter_projection"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.sql(catalogue.SQL["adapter_projection"]).fetchall())
    assert adapter.step_views(step_queries.calls(spark, str(tmp_path)), step_queries.SPEC).where("size(array_distinct(metadata_lines)) < size(metadata_lines)").isEmpty()


@pytest.mark.parametrize("change", [{"extra": 1}, {"version": "v2"}, {"trace_family": "x"}, {"confidence": SPEC["confidence"] | {"tool": 1.5}}, {"field_mapping": SPEC["field_mapping"] | {"metadata_sources": []}}, {"policies": SPEC["policies"] | {"max_observation_units": 0}}])
def test_bad_specs(change):
    with pytest.raises(adapter.SpecError):
        adapter.check(json.loads(json.dumps(SPEC | change)))
