import dataclasses
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden import __main__ as cli
from tracewarden.operators import descent
from tracewarden.operators import networks as N
from tracewarden.operators import tape as T
from tracewarden.plans import reproduce, training
from tracewarden.plans.checkpoints import Log

KINDS = ("soft-fsm", "symbol-flat", "symbol-gru", "symbol-transformer", "predictor")


def group(rng, lengths=(4, 1, 6), inputs=6):
    n = sum(lengths)
    return N.Group(np.arange(len(lengths)) + 7, np.array(lengths), np.repeat(np.arange(n), 3), rng.integers(0, inputs, 3 * n), rng.random(3 * n), rng.integers(0, 2, n).astype(float), rng.random(n) < 0.8, rng.integers(0, 3, n))


def params_of(kind, rng, inputs=6, hidden=5, symbols=3, size=4):
    p = N.symbolizer_params(inputs, hidden, symbols, rng) | (N.predictor_params(symbols, size, hidden, rng) if kind == "predictor" else N.head_params(kind, symbols, size, rng))
    return {k: np.asarray(v + 0.05 * rng.normal(size=np.shape(v))) for k, v in p.items()}


@pytest.mark.parametrize("kind,prefix_weight", [*((k, 1.0) for k in KINDS), ("predictor", 0.0)])
def test_gradients_match_differences(kind, prefix_weight):
    """Through Gumbel samples, attention, recurrence, the contrastive loss and the entropy of the mean."""
    rng = np.random.default_rng(4)
    g, p, s = group(rng), params_of(kind, rng), N.Settings(kind, 3, prefix_weight=prefix_weight)
    noise = N.gumbel(g.keys, g.lengths, 3, 1, 1)

    def sizes(p):
        return N.Round(g.n, int(g.counted.sum()), 1, int((g.lengths > 1).sum()), N.symbol_probs(T.Tape().leaves(p), g, 0.7, noise).value.mean(axis=0))

    def loss(p):
        return N.total_loss(N.gradient(p, g, sizes(p), s, (0.7, 0.6), noise)[0], sizes(p), s)

    _, grad = N.gradient(p, g, sizes(p), s, (0.7, 0.6), noise)
    for name, value in p.items():
        if kind == "predictor" and prefix_weight and name.startswith(("in_", "out_")):
            continue  # the next step's probabilities are targets there, which have no gradient
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            moved = []
            for d in (1e-5, -1e-5):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += d
                moved.append(loss(q))
            assert grad[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=2e-6), name


@pytest.mark.parametrize("kind", KINDS[:4])
def test_trained_heads_score_as_they_were_trained(kind):
    rng = np.random.default_rng(5)
    g, p = group(rng), params_of(kind, rng)
    leaves = T.Tape().leaves(p)
    probs = N.symbol_probs(leaves, g, 0.7, None)
    z = N.risk_logits(kind, leaves, N._padded(probs, g.padded()[0]), 0.6).value
    at = 0
    for i, n in enumerate(g.lengths):
        assert np.allclose(N.scorer(kind, p, 0.6)(probs.value[at : at + n]), 1 / (1 + np.exp(-z[i, :n])), atol=1e-9)
        at += n


def test_contrastive_in_blocks_and_alone():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(30, 4)), rng.integers(0, 8, 30)
    values, grads = [], []
    for block in (10_000, 60, 1):
        node = T.Tape().leaves({"x": x})["x"]
        loss = T.contrastive(node, y, block=block)
        node.tape.backward(loss)
        values.append(float(loss.value))
        grads.append(node.grad)
    assert np.allclose(values, values[0]) and all(np.allclose(g, grads[0]) for g in grads)
    from tracewarden.operators.models import contrastive_loss

    anchors = np.bincount(y)
    assert values[0] / anchors[anchors > 1].sum() == pytest.approx(contrastive_loss(x, y.tolist()))
    assert float(T.contrastive(T.Tape().leaves({"x": x[:3]})["x"], np.array([1, 2, 3])).value) == 0


def step_rows(n_runs=60, seed=0, inputs=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_runs):
        length = int(rng.integers(1, 12)) if i else 40  # a run longer than a group
        bad = i % 2
        for t in range(length):
            places = sorted(rng.choice(inputs, 2, replace=False).tolist()) if not bad or t < 2 else [inputs - 2, inputs - 1]
            rows.append((f"run{i}", t + 1, places, [0.6, 0.8], int(bad and t >= length - 3), bool(t % 5), f"s{bad}{t % 3}"))
    return rows


STEPS = "trajectory_id string, step_index int, places array<int>, features array<double>, label int, counted boolean, signature string"


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame(step_rows(), STEPS).repartition(5)


def whole(table):
    """All groups of a table on one machine, as one group."""
    batch = table.select("runs").toArrow().combine_chunks().to_batches()
    return [g for b in batch for g in descent.unpacked(b)]


@pytest.mark.parametrize("kind", KINDS)
def test_a_round_on_executors_equals_all_rows_at_once(spark, steps, kind):
    table = descent.groups(steps, group_steps=20).cache()
    assert table.count() > 5
    rng = np.random.default_rng(1)
    p, s = params_of(kind, rng), N.Settings(kind, 3, seed=3)
    r = descent.round_sizes(table, p, s, 0.8, epoch=2)
    loss, grad = descent.round_gradient(table, p, r, s, (0.8, 0.9), epoch=2)
    parts = whole(table)
    noise = [N.gumbel(g.keys, g.lengths, 3, 3, 2) for g in parts]
    probs = np.concatenate([N.symbol_probs(T.Tape().leaves(p), g, 0.8, x).value for g, x in zip(parts, noise, strict=True)])
    assert (r.steps, r.counted, r.groups, r.runs) == (len(probs), sum(int(g.counted.sum()) for g in parts), len(parts), sum(int((g.lengths > 1).sum()) for g in parts))
    assert np.allclose(r.mean, probs.mean(axis=0), atol=1e-7)
    if kind == "predictor":  # contrasts are made inside groups, so the plain loop goes over them
        own = [N.gradient(p, g, r, s, (0.8, 0.9), x) for g, x in zip(parts, noise, strict=True)]
        want_loss, want = N.total_loss(sum(a for a, _ in own), r, s), {k: sum(g[k] for _, g in own) for k in p}
    else:  # one batch of all runs
        lengths = np.concatenate([g.lengths for g in parts])
        first = np.cumsum([0, *(g.n for g in parts)])
        one = N.Group(np.concatenate([g.keys for g in parts]), lengths, np.concatenate([g.rows + f for g, f in zip(parts, first, strict=False)]), *(np.concatenate([getattr(g, f) for g in parts]) for f in ("columns", "values", "labels", "counted", "signatures")))
        total, want = N.gradient(p, one, r, s, (0.8, 0.9), np.concatenate(noise))
        want_loss = N.total_loss(total, r, s)
    assert loss == pytest.approx(want_loss, abs=1e-7)
    for k in p:
        assert np.allclose(grad[k], want[k], atol=1e-8), k


def test_sums_do_not_depend_on_partitions(spark, steps):
    p, s = params_of("soft-fsm", np.random.default_rng(2)), N.Settings("soft-fsm", 3)
    seen = []
    for n in (1, 3, 7):
        table = descent.groups(steps.repartition(n), group_steps=20).repartition(n)
        r = descent.round_sizes(table, p, s, 1.0, 1)
        loss, grad = descent.round_gradient(table, p, r, s, (1.0, 1.0), 1)
        seen.append((loss, r.mean.tolist(), {k: v.tolist() for k, v in grad.items()}))
    assert seen[0] == seen[1] == seen[2]


def test_groups_hold_every_step_once(spark, steps):
    table = descent.groups(steps, batches=3, group_steps=20).cache()
    flat = table.select("batch", F.explode("runs").alias("r")).select("batch", "r.id", F.explode("r.steps").alias("s")).select("id", "s.step_index").collect()
    assert sorted((r["id"], r["step_index"]) for r in flat) == sorted((r[0], r[1]) for r in step_rows())
    sizes = table.select(F.expr("aggregate(runs, 0, (a, r) -> a + size(r.steps))").alias("n"), F.size("runs").alias("k")).collect()
    assert all(r["n"] < 20 + 40 for r in sizes) and {r["batch"] for r in table.select("batch").collect()} <= {0, 1, 2}


@pytest.mark.parametrize("kind", KINDS[:4])
def test_heads_learn(spark, steps, kind):
    table = descent.groups(steps, batches=2, group_steps=64).cache()
    rng = np.random.default_rng(7)
    p, adam, s = params_of(kind, rng, hidden=8, symbols=4), descent.Adam(0.05), N.Settings(kind, 4)
    losses = []
    for epoch in range(1, 9):
        p, loss = descent.run_epoch(table, 2, p, adam, s, (1.0, 1.0), epoch)
        losses.append(loss)
    assert losses[-1] < losses[0] - 0.03


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    from tracewarden.sources import canonical

    path = str(tmp_path_factory.mktemp("runs"))
    word = lambda i, k: "error retry failed" if i % 2 and k > 2 else f"open page {k} ok"
    rows = [(f"run{i}", f"task{i % 4}", i % 2 == 0, "NONE" if i % 2 == 0 else "LOST", ("fit", "cal", "test")[i // 2 % 3], "{}", [("start", word(i, k), None, "{}", "", "ok", word(i, k)) for k in range(6)]) for i in range(24)]
    step = "context: string, action_text: string, tool_name: string, tool_args: string, result_text: string, status: string, source_raw_text: string"
    canonical.write_runs(spark.createDataFrame(rows, f"trajectory_id string, task_id string, final_success boolean, failure_bucket string, split string, metadata string, steps array<struct<{step}>>"), path, mode="overwrite")
    return path


def test_a_stopped_run_goes_on_with_the_same_numbers(spark, runs, tmp_path):
    options = {"symbols": 3, "states": 4, "hidden": 6, "batches": 2, "seed": 5}
    one = training.train(spark, runs, str(tmp_path / "one"), epochs=3, **options)
    training.train(spark, runs, str(tmp_path / "two"), epochs=3, stop_after=1, **options)
    log = Log(spark, str(tmp_path / "two/epochs"))
    assert log.versions() == [1]
    # data of an epoch that was never committed does not count
    spark.range(3).write.parquet(str(tmp_path / "two/epochs/data/00000002-dead"))
    two = training.train(spark, runs, str(tmp_path / "two"), epochs=3, resume=True, **options)
    assert [e["loss"] for e in one["epochs"]] == [e["loss"] for e in two["epochs"]] and one["best_epoch"] == two["best_epoch"]
    a, b = (Log(spark, str(tmp_path / f"{n}/epochs")).read() for n in ("one", "two"))
    assert a.version == b.version == 3 and all((a.arrays[k] == b.arrays[k]).all() for k in a.arrays)
    best = max(one["epochs"], key=lambda e: (tuple(e["key"]), -e["epoch"]))
    assert one["best_epoch"] == best["epoch"]
    kept = {f.name[:8] for f in (tmp_path / "two/epochs/data").iterdir() if f.is_dir()}
    assert kept == {"00000003", f"{two['best_epoch']:08}"}
    with pytest.raises(ValueError, match="other settings: rate"):
        training.train(spark, runs, str(tmp_path / "two"), epochs=5, resume=True, rate=0.5, **options)
    with pytest.raises(ValueError, match="ended epoch 3"):
        training.train(spark, runs, str(tmp_path / "two"), epochs=3, resume=True, **options)
    with pytest.raises(ValueError, match="holds a run"):
        training.train(spark, runs, str(tmp_path / "two"), epochs=3, **options)


def test_selection_by_the_discrete_automaton(spark, runs, tmp_path):
    out = training.train(spark, runs, str(tmp_path / "c"), symbols=6, states=4, hidden=16, batches=1, epochs=3, model="predictor", rate=0.05, seed=2)
    keys = [(tuple(e["key"]), -e["epoch"]) for e in out["epochs"] if e["key"] is not None]
    assert keys and out["best_epoch"] == -max(keys)[1]
    found = training.evaluate(spark, str(tmp_path / "c"), runs)
    assert found["soft"] is None and set(found) >= {"config", "split", "discrete"}


def test_a_manifest_runs_once_and_goes_on(spark, runs, tmp_path):
    (tmp_path / "data").mkdir()
    shutil.copytree(runs, tmp_path / "data" / "tau2")
    run = {"id": "A", "family": "tau2", "seeds": [1, 2], "output_template": "o/{seed}", "num_symbols": 3, "q_max": 4, "epochs": 1, "horizon": 3, "train_args": ["--warning-model-type", "symbol-flat", "--device", "cpu", "--derive-train-fit-cal"], "eval_args": ["--dfa-backend", "legacy"]}
    todo = reproduce.jobs({"runs": [run, run | {"id": "B", "family": "other"}]}, str(tmp_path / "out"), str(tmp_path / "data"), ["tau2"])
    assert [j.id for j in todo] == ["A/seed1/train", "A/seed1/evaluate", "A/seed2/train", "A/seed2/evaluate"] and todo[0].settings["model"] == "symbol-flat"
    states = lambda x: [r["state"] for r in x]
    assert states(reproduce.run(spark, todo[:2], stop_after=1)) == ["ran"]
    assert states(reproduce.run(spark, todo[:2])) == ["done", "ran"]
    assert states(reproduce.run(spark, todo[:2])) == ["done", "done"]
    found = json.loads((tmp_path / "out/experiments/A/seed1/evaluation.json").read_text())
    assert found["run"] == "A" and found["seed"] == 1 and 0 <= found["soft"]["auroc"] <= 1
    # another setting of a job repeats it and what comes after it
    changed = [dataclasses.replace(todo[0], settings=todo[0].settings | {"symbols": 4}), todo[1]]
    assert states(reproduce.run(spark, changed)) == ["ran", "ran"]


def test_log_commits_whole_versions(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.read() is None
    arrays = {"a": np.arange(6.0).reshape(2, 3), "b": np.float64(0.1), "c": np.zeros((0, 3))}
    log.commit(1, arrays, {"x": 1})
    log.commit(2, {"a": np.ones(2)}, {"x": 2}, keep=(1,))
    state = log.read(1)
    assert state.note == {"x": 1} and state.arrays["a"].tolist() == arrays["a"].tolist() and state.arrays["b"].shape == () and state.arrays["c"].shape == (0, 3)
    with pytest.raises(ValueError, match="not after 2"):
        log.commit(2, arrays, {})
    (tmp_path / "log/log/.half").write_text("{")
    assert log.versions() == [1, 2]
    record = tmp_path / "log/log/00000002.json"
    text = json.loads(record.read_text())
    (tmp_path / "log/log/.00000002.json.crc").unlink(missing_ok=True)
    record.write_text(json.dumps(text | {"sha256": "0"}))
    with pytest.raises(ValueError, match="not what was committed"):
        log.read()
    assert cli.FAMILIES
