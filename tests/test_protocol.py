"""Protocol datasets: nothing is lost, tasks stay together, names are renamed together."""

import re

import pytest
from pyspark.sql import functions as F

from rolloom.operators import distillation, protocol
from rolloom.sources.stable import stable

CODE = "[A-Z]{2}[0-9]{4}"


@pytest.fixture(scope="module")
def episodes(spark):
    rows = []
    for i in range(40):
        talk = [("system", "be kind", []), ("assistant", f"<think>t{i}</think>hello AB{i:04d}" if i % 4 else "hello", ["look"] if i % 5 == 0 else []), ("user", f"AB{i:04d} and CD{i:04d}", []), ("assistant", f"CD{i:04d}, AB{i:04d} is gone", [])]
        rows.append((f"f{i % 3}", i, f"task{i % 6}" if i % 13 else None, i, talk if i % 9 else talk[:1], i % 2 == 0, float(i % 8 > 0)))
    kind = "source_path string, source_index long, task_id string, sample_id long, messages array<struct<role:string,content:string,tools:array<string>>>, enable_thinking boolean, reward double"
    return spark.createDataFrame(rows, kind)


def rules():
    return [("short", F.size("messages") < 2), ("low", F.col("reward") < 1)]


def counts(made):
    return {(r.name, r.key): r.rows for r in made.manifest.collect()}


def test_counts_add_up(spark, episodes):
    made = protocol.build(episodes, rules(), transform="randomize", count=3, include_original=True, seed=2, fraction=0.3)
    told = counts(made)
    rejected = made.rejected.collect()
    short = {i for i in range(40) if i % 9 == 0}
    assert {r.source_index: r.reason for r in rejected} == {i: "short" if i in short else "low" for i in range(40) if i in short or i % 8 == 0}
    assert told["accepted_rows", None] == 4 * (40 - len(rejected)) == told["train_rows", None] + told["test_rows", None] and told["rejected_rows", None] == len(rejected)
    assert sum(n for (name, _), n in told.items() if name == "accepted_per_task") == told["accepted_rows", None]
    train, test = ({r.task_id for r in x.select("task_id").distinct().collect()} for x in (made.train, made.test))
    assert train and test and not train & test and made.split_mode == "hashed_task_id"
    again = protocol.build(episodes, rules(), transform="randomize", count=3, include_original=True, seed=2, fraction=0.3)
    key = lambda m: sorted((r.row_id, str(r.messages)) for r in m.train.collect())
    assert key(made) == key(again)


@pytest.mark.parametrize("form", ["trajectory", "turn"])
def test_names_are_drawn_once_and_in_small_batches(spark, episodes, form):
    made = protocol.build(episodes, rules(), form=form, transform="randomize", seed=1)
    for part in (made.train, made.test, made.rejected, made.manifest):
        assert "ArrowEvalPython" not in part._jdf.queryExecution().toString()
    together = F.pandas_udf(lambda s: s * 0 + len(s), "long")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    assert stable(spark.range(0, 3000, 1, 1).select(together("id").alias("n"))).agg(F.max("n")).first()[0] <= 256
    assert spark.conf.get(name) == before


def test_one_mapping_a_trajectory(episodes):
    made = protocol.build(episodes, rules(), transform="randomize", count=2, include_original=True, seed=1)
    seen = {}
    for r in made.train.unionByName(made.test).collect():
        texts = [m.content for m in r.messages]
        codes = {c for t in texts for c in re.findall(CODE, t)}
        own = {f"AB{r.source_index:04d}", f"CD{r.source_index:04d}"}
        assert (codes == own) if r.id_variant == "original" else len(codes) == 2 and not codes & own
        if r.id_variant != "original":
            assert texts[-1].endswith("is gone") and texts[-1].split(", ")[1].split()[0] in texts[2].split()[0]
            seen.setdefault(r.source_index, set()).add(frozenset(codes))
    assert all(len(x) == 2 for x in seen.values())  # variants differ


def test_turns_and_traces(episodes):
    made = protocol.build(episodes, rules(), form="turn", need_traces=True, transform="canonicalize", most_per_task=2)
    told = counts(made)
    assert told["rejected_reasons", "missing_thinking_traces"] == sum(i % 4 == 0 and i % 9 != 0 and i % 8 != 0 for i in range(40))
    rows = made.train.unionByName(made.test).collect()
    assert rows and all(r.target.role == "assistant" and r.thinking_supervision_mode == "source_thinking_traces" for r in rows)
    per_task = {}
    for r in rows:
        per_task[r.task_id] = per_task.get(r.task_id, 0) + 1
    assert max(per_task.values()) == 2


def test_lists_of_tasks(spark, episodes):
    tasks = lambda *names: spark.createDataFrame([(n,) for n in names], "task_id string")
    with pytest.raises(ValueError):
        protocol.build(episodes, rules(), train_tasks=tasks("task1"), test_tasks=tasks("task2"))
    with pytest.raises(ValueError):
        protocol.build(episodes, rules(), train_tasks=tasks("task1"), test_tasks=tasks("task1"), allow_test_tasks=True)
    with pytest.raises(ValueError):
        protocol.build(episodes, rules(), train_tasks=tasks("task1"))
    made = protocol.build(episodes, rules(), train_tasks=tasks("task1"), test_tasks=tasks("task2"), allow_test_tasks=True)
    told = counts(made)
    assert made.split_mode == "manifest" and set(k for (n, k) in told if n == "train_per_task") == {"task1"}
    assert told["rejected_reasons", "not_in_split"] == told["accepted_rows", None] - told["train_rows", None] - told["test_rows", None]
    held = protocol.build(episodes, rules(), train_tasks=tasks("task1", "task3"), test_tasks=tasks("none"), local_hold_out=True, fraction=0.5)
    assert held.split_mode == "manifest_local_hold_out" and held.test.count() > 0
    with pytest.raises(ValueError):
        protocol.build(episodes, [("all", F.lit(True))])


def test_rules_of_variants_and_thinking(spark):
    assert [v.name for v in protocol.variants("randomize", 2, True)] == ["original", "randomize_0", "randomize_1"] and [v.transform for v in protocol.variants()] == ["none"]
    for bad in (("none", 2, False), ("canonicalize", 1, True), ("randomize", 0, False), ("shuffle", 1, False)):
        with pytest.raises(ValueError):
            protocol.variants(*bad)
    rows = [("true", None, None, True), ("yes", None, None, True), ("false", '{"enable_thinking": true}', None, False), (None, '{"enable_thinking": false}', "on", False), (None, '{"other": 1}', "ON", True), ("", None, None, False)]
    df = spark.createDataFrame(rows, "flag string, kw string, mode string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", protocol.thinking_enabled(F.col("flag"), F.col("kw"), F.col("mode"))).collect())
    says = spark.createDataFrame([("plain_text", "My name is Bo"), ("plain_text", "i am Ann Lee, my user id"), ("tool", "my name is Bo"), ("plain_text", None), ("plain_text", "fine")], "a string, t string")
    assert [r.x for r in says.select(protocol.user_echo(F.col("a"), F.col("t")).alias("x")).collect()] == [["my_name_is"], ["my_user_id", "i_am_named_user"], None, None, None]


def test_written_and_read(spark, episodes, tmp_path):
    made = protocol.build(episodes, rules())
    protocol.write(made, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/train").count() == counts(made)["train_rows", None]
    assert spark.read.json(f"{tmp_path}/out/manifest").count() == made.manifest.count()


def test_divergences(spark):
    with pytest.raises(ValueError):
        distillation.divergence("k1")(lambda *a: None)
    with pytest.raises(ValueError):
        distillation.get_divergence("k9")
    # two tokens listed by the teacher, one of them unknown to the student
    rows = [(0, 0, 1, -1.0, -1.0, 0.5, [7, 9], [-0.5, -1.5], [9, 3], [2.0, 1.0], 0.0), (0, 1, 0, -1.0, -1.0, 0.5, [7, 9], [-0.5, float("-inf")], [7], [1.0], 5.0)]
    t = spark.createDataFrame(rows, "row_id long, t long, mask int, logp double, old_logp double, advantage double, teacher_ids array<int>, teacher_logprobs array<double>, student_ids array<int>, student_logits array<double>, student_rest double")
    from math import exp, log

    norm = log(exp(2) + exp(1) + exp(0))
    want = exp(-0.5) * (-0.5 - (0 - log(5) - norm)) + exp(-1.5) * (-1.5 - (2 - norm))
    got = distillation.distil(t, "forward_kl_topk", unlisted=5).first()
    assert got.loss == pytest.approx(want) and got.student_mass == pytest.approx((exp(2) + 1 / 5) / exp(norm)) and got.teacher_mass_min == pytest.approx(exp(-0.5) + exp(-1.5))
    assert distillation.distil(t.drop("student_rest"), "forward_kl_topk").first().loss == float("inf")
    assert distillation.distil(t.drop("student_rest"), "forward_kl_topk", least=-3.0).first().loss < 3
    k1 = distillation.distil(t.withColumn("teacher", F.lit(-3.0)), "k1", most=1.5).first()
    assert (k1.loss, k1.loss_max, k1.abs_loss) == (1.5, 2.0, 2.0)
