"""Helpers that no query reaches: golden values."""

import pytest
from pyspark.sql import functions as F

from rolloom.functions import parsing, scores
from rolloom.functions import tokens as tk
from rolloom.operators import advantage, balance, batch, correction, curation, datasets, episodes, losses, messages, metrics
from rolloom.sources import files
from rolloom.streaming import replay


def values(df, *columns):
    return [r[0] if len(r) == 1 else tuple(r) for r in df.select(*columns).collect()]


def test_batches_compared_and_inverted(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (1, "y")], "row_id long, v string")
    assert batch.same(a, a.select("v", "row_id")) and not batch.same(a, a.distinct()) and not batch.same(a, a.withColumn("w", F.lit(1)))
    index = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "row_id long, idx long")
    assert sorted(values(balance.inverse(index, "idx"), "row_id", "idx")) == [(0, 1), (1, 2), (2, 0)]
    told = balance.unbalance([1, 9, 2, 8], [[0, 1], [2, 3]], "s")
    assert told == {"s/min": 10, "s/max": 10, "s/minmax_diff": 0, "s/balanced_min": 10, "s/balanced_max": 10, "s/mean": 10.0}


def test_replay_rows(spark):
    tags = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "a", 3)], "partition string, key string, v int")
    keys = spark.createDataFrame([("p", "a")], "partition string, key string")
    assert sorted(values(replay.remove(tags, keys), "v")) == [2, 3]
    assert values(replay.fetch(tags, keys, ["v"]), "partition", "key", "v") == [("p", "a", 1)]


def test_answers_by_line_and_box(spark):
    cases = ["x = \\text{an 5 cm}", "\\frac12", "1,234", "$3\\pi$ units", "\\boxed{7}", "12 dollars."]
    assert [scores.answer_normal(c) for c in cases] == ["5", "\\frac{1}{2}", "1234", "3\\pi", "7", "12."]
    rows = spark.createDataFrame([("Step.\nAnswer: 7", "7"), ("Answer: 8", "7"), (None, "7"), ("so \\boxed{7}", "7"), ("\\boxed{7} " + "x" * 100, "7")], "t string, g string")
    assert [r.s.score for r in rows.select(scores.answer_line_score("t", "g").alias("s")).collect()] == [1, -1, -1, -1, -1]
    assert [(r.s.score, r.s.pred) for r in rows.select(scores.strict_box_score("t", "g").alias("s")).collect()] == [(-1, None), (-1, None), (-1, None), (1, "7"), (-1, None)]
    thoughts = spark.createDataFrame([("<think>a</think> \\boxed{1}",), ("<think>a \\boxed{1}",), ("\\boxed{1}",)], "t string")
    assert values(thoughts, scores.thought_and_boxed(F.col("t"))) == [1.0, 0.0, 0.0]


def test_calls_and_identifiers(spark):
    text = '<tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call> and <tool_call>{"name": "g"}</tool_call> <tool_call>junk</tool_call>'
    rows = spark.createDataFrame([(text,)], "t string")
    assert [(c.name, c.arguments) for c in values(rows, parsing.tagged_json_calls(F.col("t")))[0]] == [("f", '{"a":1}')]
    assert values(rows, F.trim(parsing.without_calls(F.col("t")))) == ["and"]
    names = spark.createDataFrame([("ABC123 for mia_li_0001, not AB12",)], "t string").select(parsing.identifiers_of("t", F.lit("s")).alias("m")).first().m
    assert set(names) == {"ABC123", "mia_li_0001"} and all(k != v and len(k) == len(v) for k, v in names.items())


def test_losses_without_a_query(spark):
    rows = [(0, 0, 1, -1.0, -1.2, 0.5, 0.7), (0, 1, 1, -0.5, -0.4, 0.5, 0.1), (1, 0, 0, -9.0, -0.1, 9.0, 9.0)]
    t = spark.createDataFrame(rows, "row_id long, t long, mask int, logp double, old_logp double, advantage double, entropy double")
    assert losses.entropy_loss(t).first().loss == pytest.approx(0.4)
    assert losses.bypass(t).first().loss == pytest.approx(losses.ppo_clip(t).first().loss)
    assert losses.bypass(t, "reinforce").first().loss == pytest.approx(losses.reinforce(t, "token-mean").first().loss)
    with pytest.raises(ValueError):
        losses.bypass(t, "other")
    fixed = advantage.FixedCoefficient(0.3)
    fixed.update(99.0, 10)
    assert fixed.value == 0.3
    wide = spark.createDataFrame([([-1.0], [-2.0])], "old_log_probs array<double>, rollout_log_probs array<double>")
    assert correction.bypass_columns(wide).first().old_log_probs == [-2.0]


def test_differences_of_tokens(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 5, 6], [1, 1, 0])], "a array<int>, b array<int>, m array<int>")
    assert values(df, tk.count_differences(F.col("a"), F.col("b"), F.col("m"))) == [1]


def test_episode_texts(spark):
    df = spark.createDataFrame([(" kind ", None, "lost bag", "", "x")], "p string, k string, r string, t string, u string")
    assert values(df, episodes.instruction_text(*[F.col(c) for c in "pkrtu"])) == ["Persona:\nkind\n\nReason for call:\nlost bag\n\nUnknown info:\nx"]
    runs = spark.createDataFrame([(True, "official_gym", "terminated", "", "0"), (False, "", "terminated", "", "1.0"), (True, "other", "terminated", "", "1"), (True, "", "open", "running", "1"), (False, "", "", "done", "x")], "success boolean, runtime string, status string, terminal_reason string, reward string")
    assert values(runs, messages.verified_success(["reward"])) == [True, True, False, False, False]


def test_choices_and_profiles(spark):
    df = spark.createDataFrame([("A man [step] runs", ["x [title] y", "z  w"], "1"), ("no label", ["a"], "")], "c string, e array<string>, l string")
    got = values(datasets.choices(df, F.col("c"), F.col("e"), F.col("l")), "query", "choices", "gold")
    assert got == [("A man runs", ["x. y", "z w"], 1)]
    turns = spark.createDataFrame([("hi", ["f"], "t", 0), ("", ["g", "h"], None, 3), ("bye", [], "", 9), (None, None, None, None)], "content string, tools array<string>, thinking string, assistant_turn_index int")
    assert values(curation.target_profile(turns), "stratum", "has_thinking") == [("tool_call_with_text|f|early", True), ("tool_call|g|middle", False), ("final_or_clarify_text|no_tool|late", False), ("empty_text|no_tool|unknown", False)]


def test_held_out_by_task_or_row(spark):
    many = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 8).cast("string").alias("task_id"))
    held = curation.hold_out(many, 0.25, 3)
    sides = {}
    for r in held.collect():
        sides.setdefault(r.task_id, set()).add(r.is_test)
    assert all(len(s) == 1 for s in sides.values()) and sum(s == {True} for s in sides.values()) == 2
    one = curation.hold_out(many.withColumn("task_id", F.lit("t")), 0.25, 3)
    assert one.where("is_test").count() == 10


def test_files_of_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "req-1", "ab", 0.5), (1, "req-2", "cd", 0.9), (2, "r-eq3", "ab 12", 0.1)], "step int, request_id string, text string, score double")
    files.write_by_step(rows, f"{tmp_path}/dump")
    back = files.read_dump(spark, f"{tmp_path}/dump", mask="[0-9]+")
    assert back.where("step = 2").first().text == "ab *" and [r.score for r in files.sorted_by_score(back).collect()] == [0.9, 0.5, 0.1]
    assert files.by_request(rows, "req3").first().step == 2 and files.search(rows, "text", "ab").count() == 2
    files.log_metrics(spark.createDataFrame([(1, "loss", 0.5), (1, "acc", 1.0)], "step int, name string, value double"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").first().data.asDict() == {"acc": 1.0, "loss": 0.5}
    for name in ("a", "b"):
        spark.range(3).coalesce(1).write.json(f"{tmp_path}/{name}/x")
    found = files.discover(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/a"])
    assert len(found) == 1 and found[0].endswith(".json")
    (tmp_path / "c" / "x").mkdir(parents=True)
    (tmp_path / "d" / "x").mkdir(parents=True)
    for name, text in (("c", "same"), ("d", "same")):
        (tmp_path / name / "x" / "f.txt").write_text(text)
    assert files.same_tree(spark, f"{tmp_path}/c", f"{tmp_path}/d")
    (tmp_path / "d" / "x" / "f.txt").write_text("longer")
    assert not files.same_tree(spark, f"{tmp_path}/c", f"{tmp_path}/d")
    filled = files.with_defaults(spark.createDataFrame([((None,),)], "extra_info struct<index:int>")).first()
    assert (filled["index"], filled.tools_kwargs) == (0, "{}")


def test_slowest_sample(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 5.0), (2, 4.0, 3.0)], "row_id long, gen double, tool double")
    told = metrics.slowest(df, ["gen", "tool"]).first()
    assert (told.gen_min, told.gen_max, told.tool_mean) == (1.0, 4.0, pytest.approx(10 / 3)) and told.slowest.row_id == 1


def test_a_batch_goes_to_any_estimator(spark):
    rows = [(i, f"u{i % 3}", [0.1 * i, 1.0 - 0.2 * i, 0.3], [1, 1, i % 2], [0.2, 0.1, 0.0], 0.4, [-0.5, -0.4, -0.3], [0.2, 0.3, 0.4]) for i in range(9)]
    b = spark.createDataFrame(rows, "row_id long, uid string, token_level_rewards array<double>, response_mask array<int>, values array<double>, reward_baselines double, old_log_probs array<double>, sum_pi_squared array<double>")
    made = {n: {r.row_id: r for r in advantage.advantages_of(b, n, epsilon=1e-6, gamma=0.9).collect()} for n in ("grpo", "gae", "remax", "rloo", "opo", "reinforce_plus_plus", "optimal_token_baseline")}
    assert all(len(x) == 9 and all(len(r.advantages) == len(r.returns) == 3 for r in x.values()) for x in made.values())
    direct = {r.row_id: r.advantage for r in advantage.leave_one_out(b.withColumn("score", tk.total(F.col("token_level_rewards")))).collect()}
    assert all(made["rloo"][i].advantages == pytest.approx([a, a, a * (i % 2)]) and made["rloo"][i].returns == made["rloo"][i].advantages for i, a in direct.items())
    plain = {r.row_id: r.advantages for r in advantage.gae(b, "token_level_rewards", gamma=0.9).collect()}
    assert all(made["gae"][i].advantages == pytest.approx(x) for i, x in plain.items())
    z = F.arrays_zip(F.col("token_level_rewards").alias("reward"), F.col("response_mask").alias("mask"), F.col("old_log_probs").alias("logp"), F.col("sum_pi_squared").alias("sum_pi2"))
    tokens = b.select("row_id", "uid", F.posexplode(z).alias("t", "z")).select("row_id", "uid", "t", "z.*")
    long = {(r.row_id, r.t): r.advantage for r in advantage.token_baseline(tokens).collect()}
    assert all(made["optimal_token_baseline"][i].advantages[t] == pytest.approx(a, abs=1e-4) for (i, t), a in long.items())
    with pytest.raises(ValueError, match="values"):
        advantage.advantages_of(b.drop("values"), "gae")
    with pytest.raises(ValueError):
        advantage.advantages_of(b, "nothing")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_bucket_delays_in_blocks(spark, block):
    rows = [(("a", "b", None)[i % 100 // 40], i, float(i * i % 23 + i), None if i % 31 == 5 else float(i * 37 % 150)) for i in range(300)]
    want = {}
    for key in ("a", "b", None):
        have, now, out = 50.0, 0.0, want.setdefault(key, [])
        for _, _, at, n in (r for r in rows if r[0] == key):
            later = max(now, at)
            have = min(50.0, have + (later - now) * 2.0)
            wait = max(0.0, ((50.0 if n is None else min(n, 50.0)) - have) / 2.0)
            have, now = 50.0 if n is None else have + wait * 2.0 - n, later + wait
            out.append(now - at)
    got = {r.key: r.delays for r in replay.bucket_delays(spark.createDataFrame(rows, "key string, seq long, at double, tokens double"), 2.0, 50.0, block=block).collect()}
    assert got.keys() == want.keys()
    for key, delays in want.items():
        assert got[key] == pytest.approx(delays, abs=1e-9)
