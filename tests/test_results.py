"""A folder of result files: which count, why others don't, and what a run counts."""

import json

from skysift.operators.metrics import Run
from skysift.sources import results as RF

NAME = "d_s_m_cc_clip_{}_0.1_0.5_mean.jsonl"


def line(category, output, truth="A", task="Perception"):
    return json.dumps({"Task": task, "Subtask": "Remote Sensing", "Category": category, "Answer choices": ["(A) x", "(B) y"], "Ground truth": truth, "output": output, "Question_id": "q"})


def test_a_file_counts_whole_or_not_at_all(spark, tmp_path):
    good = [line("Position", "A"), line("color", "B"), line("count", "B", ["A", "B"]), line("color", "A", task="Reasoning")]
    files = {
        NAME.format(0.3): good, NAME.format(0.4): [*good, '{"Task": "Perc'], NAME.format(0.5): good[:2] + good[3:], NAME.format(0.6): [*good, line("count", "A")], "notes.jsonl": good, NAME.format("x"): good,
        NAME.format(0.7): [], NAME.format(0.8): [*good, json.dumps({"Task": "Perception"})],
    }
    (tmp_path / "in" / "below").mkdir(parents=True)
    for k, (name, lines) in enumerate(files.items()):
        (tmp_path / "in" / ("below" if k % 2 else "") / name).write_text("\n".join(lines))
    (tmp_path / "in" / "readme.txt").write_text("no result")
    run = Run("sweep")
    rows = {r.file: r for r in RF.sweep(RF.read_results(spark, str(tmp_path / "in")), 3, run=run).collect()}
    reasons = {n: rows[n].reason for n in files}
    assert reasons == {
        NAME.format(0.3): None, NAME.format(0.4): "1 unreadable lines", NAME.format(0.5): "no items of count", NAME.format(0.6): "4 items, not 3", "notes.jsonl": "no parameters in its name", NAME.format("x"): "no parameters in its name",
        NAME.format(0.7): "empty", NAME.format(0.8): "1 unreadable lines",
    }
    kept = rows[NAME.format(0.3)]
    assert (kept.position, kept.color, kept["count"], kept.n, kept.path_T, kept.reduce_fn) == (1.0, 0.0, 1.0, 3, 0.3, "mean") and abs(kept.accuracy - 2 / 3) < 1e-9
    counts = {(r.stage, r.metric): r.value for r in run.table(spark).collect()}
    assert counts == {("lines", "rows"): sum(map(len, files.values())) + 1, ("lines", "unreadable"): 2, ("files", "rows"): 8, ("files", "dropped"): 7}
    run.write(spark, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 4
