import itertools
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolloom.functions import parsing, scores
from rolloom.functions import tokens as tk
from rolloom.operators import balance, correction, curation, datasets, diagnostics, episodes, losses, messages, metrics
from rolloom.sources import files
from rolloom.streaming.queue import SampleQueue, capacity, must_pause, run_queue, run_queue_batch


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=8, max_size=40), st.integers(2, 8))
def test_bins_cover_rows_once(lengths, k):
    bins = balance.balanced(lengths, k, equal_size=False)
    assert sorted(itertools.chain(*bins)) == list(range(len(lengths)))
    n = len(lengths) // k * k
    assert {len(b) for b in balance.balanced(lengths[:n], k, equal_size=True)} == {n // k}
    assert sorted(itertools.chain(*balance.greedy(lengths, k, False))) == list(range(len(lengths)))


def test_differencing_beats_greedy_on_a_known_case():
    sums = lambda bins, x: sorted(sum(x[i] for i in b) for b in bins)
    x = [8, 7, 6, 5, 4]
    assert sums(balance.differencing(x, 2, False), x) == [14, 16]


def padded_differencing(x, k):
    """The same with every bin of every candidate, empty ones too, in place."""
    heap = [sorted([(n, 1, [(i, n)])] + [(0, 0, [])] * (k - 1), reverse=True) for i, n in enumerate(x)]
    while len(heap) > 1:
        heap.sort(key=lambda c: (c[0][0] - c[-1][0], c[0]))
        one, two = heap.pop(), heap.pop()
        heap.append(sorted(((a[0] + b[0], a[1] + b[1], a[2] + b[2]) for a, b in zip(one, reversed(two), strict=True)), reverse=True))
    return [[i for i, _ in members] for *_, members in heap[0]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30), st.integers(1, 9))
def test_differencing_agrees_with_padded_candidates(x, k):
    assert balance.differencing(x, k, False) == padded_differencing(x, k)


def test_differencing_takes_memory_by_items_not_by_items_and_bins():
    x = [(i * 37) % 91 + 30 for i in range(2000)]
    tracemalloc.start()
    bins = balance.differencing(x, 500, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(itertools.chain(*bins)) == list(range(2000)) and peak < 8_000_000


def test_microbatches_respect_groups_and_errors():
    bins = balance.microbatches([100] * 20, 300, group=2)
    assert sorted(itertools.chain(*bins)) == list(range(20)) and all(b[i] + 1 == b[i + 1] for b in bins for i in range(0, len(b), 2))
    with pytest.raises(ValueError):
        balance.microbatches([400], 300)
    assert balance.balanced_groups([1, 2, 3, 4], ["a", "a", "b", "b"], 2) in ([[0, 1], [2, 3]], [[2, 3], [0, 1]])


def test_balance_and_restore(spark):
    df = spark.createDataFrame([(i, (i * 37) % 91 + 1) for i in range(20)], "row_id long, seqlen long")
    out = balance.dynamic_batches(df, 300)
    assert balance.restore(out).collect() == df.orderBy("row_id").collect()
    named = balance.balance(df.select(F.format_string("r%02d", "row_id").alias("row_id"), "seqlen"), 4)
    assert named.count() == 20 and named.schema["bin"].dataType.typeName() == "integer"
    with pytest.raises(ValueError):
        balance.dynamic_batches(df, 300, most_rows=19)


@pytest.mark.parametrize("bad", [True, -1, "0", "2_1", "x", ""])
def test_weight_bands_refuse(bad):
    with pytest.raises((TypeError, ValueError)):
        correction.weight_band(bad)


def test_bands():
    assert correction.weight_band("0.5_2") == (2.0, 0.5) and correction.weight_band(3) == (3.0, None)
    assert correction.rejection_bands(["token_k1", "seq_sum_k2"], "2,0.1") == {"token_k1": (0.5, 2.0), "seq_sum_k2": (None, 0.1)}
    with pytest.raises(ValueError):
        correction.rejection_bands(["token_k2"], "1_2")


def test_rejection_does_not_depend_on_the_order_of_a_table(spark):
    rows = [(0, t, 1, v / 80) for t, v in enumerate((2, 59, 35, 27, 31))]  # half the squares: 0.5 this way, more the other
    kept = [
        {r.t: r.mask for r in correction.rejection_mask(spark.createDataFrame(made, "row_id int, t int, mask int, log_ratio double").coalesce(1), "seq_sum_k2", 0.5).collect()} for made in (rows, rows[::-1])
    ]
    assert kept[0] == kept[1]


def test_losses_exclude_empty_sequences(spark):
    df = spark.createDataFrame([(0, 0, 1, 2.0), (0, 1, 1, 4.0), (1, 0, 0, 9.0)], "row_id int, t int, mask int, loss double")
    assert losses.aggregate_loss(df, "loss", "seq-mean-token-sum").first()[0] == 6.0
    assert losses.aggregate_loss(df, "loss", "token-mean").first()[0] == 3.0
    with pytest.raises(ValueError):
        losses.aggregate_loss(df, "loss", "median")


@pytest.mark.parametrize(("text", "truth", "want"), [("#### 1,234", "1234", 1.0), ("#### 12 then #### 7", "7", 1.0), ("no answer", "1", 0.0), ("#### 5" + "x" * 400, "5", 0.0), ("#### 5", "6", 0.0)])
def test_number_score(spark, text, truth, want):
    df = spark.createDataFrame([(text, truth)], "t string, g string")
    assert df.select(scores.number_score(F.col("t"), F.col("g"))).first()[0] == want


def test_flexible_number(spark):
    df = spark.createDataFrame([("it is 3 or 4. .",), (".",), ("none",)], "t string")
    assert [r[0] for r in df.select(scores.final_number(F.col("t"), "flexible")).collect()] == ["4.", ".", None]


def test_question_score(spark):
    df = spark.createDataFrame([("<answer>The  Cat!</answer>", ["cat"]), ("<answer>x</answer>" * 12, ["x"]), ("cat", ["cat"])], "t string, g array<string>")
    assert [r[0] for r in df.select(scores.qa_score(F.col("t"), F.col("g"))).collect()] == [1.0, 0.25, 0.0]


@pytest.mark.parametrize(("a", "b"), [("\\dfrac12", "\\frac{1}{2}"), ("0.5", "\\frac{1}{2}"), ("1/2", "\\frac12"), ("x = 3", "3"), ("\\sqrt3", "\\sqrt{3}"), (".7", "0.7"), ("5\\text{ cm}", "5")])
def test_tex_forms(a, b):
    assert scores.tex_equal(a, b)


def test_boxes_and_numbers():
    assert scores.last_boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}} c") == "\\boxed{\\frac{1}{2}}"
    assert scores.last_boxed("none") is None and scores.last_boxed("\\boxed{1") is None
    assert scores.math_equal("50%", "0.5") and scores.math_equal("(1, 2)", "(1,2.0)") and not scores.math_equal("(1,2)", "(1,3)")
    assert not scores.math_equal("__import__('os')", "1")


def test_tool_reward():
    gold = [{"name": "f", "parameters": {"a": 1}}]
    assert scores.tool_call_reward(gold, gold) == 3.0
    assert scores.tool_call_reward(gold, [{"name": "f", "parameters": {"a": 2}}]) == 6 * (1 + 1) / 3 - 3
    assert scores.tool_call_reward(gold, []) == -3.0
    assert scores.tool_format("<think>a</think>\n<response>b</response>", "<response>") == 1.0


def test_actions():
    assert parsing.action_of('<think>{"name":"x","arguments":{}}</think>hello')[0] == "plain_text"
    assert parsing.action_of('go {"name": "f", "arguments": {"a": "[1]"}}') == ("tool_json", "f", '{"a": [1]}')
    assert parsing.action_of("<tool_call><function=g><parameter=k>5</parameter></function></tool_call>") == ("tool_qwen_xml", "g", '{"k": "5"}')
    assert parsing.action_of("f(x=1)")[0] == "tool_functional" and parsing.action_of("<think>open")[0] == "invalid"


def test_pseudonyms_are_stable_and_consistent():
    text = "pay credit_card_123 for HAT012 and HAT012 by anna_lee_1234, booking ZFA04Y"
    a, b = parsing.randomise_text(text, "1"), parsing.randomise_text(text, "1")
    assert a == b != text and len(a) == len(text) and a.split()[3] == a.split()[5] and a.split()[3].startswith("HAT") and "credit_card_" in a
    assert parsing.canonical_text(text).split()[1] == "credit_card_001" and parsing.canonical_text(text).split()[3] == "HAT001"


def test_text_reasons_and_argument_errors(spark):
    rows = ["fine", "x\nuser: hi", "```a", "use get_reservations", "<function=zap>", '{"name": "zap"}', "zap(1)", "book(1)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(parsing.text_reject_reason(F.col("t"), ["book"])).collect()]
    assert got == [None, "transcript_replay", "markdown_tool_or_fence", "known_fake_tool_get_reservations", "unknown_xml_tool:zap", "unknown_json_tool:zap", "unknown_functional_tool:zap", None]
    e = spark.createDataFrame([("Missing required argument: city; invalid argument size",), (None,)], "t string").select(parsing.argument_errors(F.col("t")).alias("e")).collect()
    assert (e[0].e.missing, e[0].e.invalid) == (["city"], ["size"]) and e[1].e.missing == []


def test_diagnosis_takes_the_first_rule(spark):
    ddl = "i int, reward double, terminal_reason string, final_text string, reward_text string, parse_error string, db_match boolean, calls array<struct<name:string,arguments:string>>"
    rows = [
        (0, 1.0, "", "ok", "", None, True, [("transfer_to_human_agents", "{}")]),
        (1, 0.0, "max_steps", "", "", None, False, []),
        (2, 0.0, "", "", "", "Missing argument", False, []),
        (3, 0.0, "", "I have cancelled it", "", None, False, []),
        (4, 0.0, "", "done", "", None, False, [("get_a", "{}"), ("update_b", "{}")]),
        (5, 0.0, "", "hm", "", None, False, [("get_a", "{}"), ("get_b", "{}")]),
        (6, 0.0, "", "which one", "", None, False, []),
        (7, 0.0, "", "hm", "", None, False, [("x", '{"order_id": 1}'), ("x", '{"order_id": 2}')]),
        (8, None, None, None, None, None, None, None),
    ]
    got = diagnostics.diagnose(spark.createDataFrame(rows, ddl)).orderBy("i").collect()
    assert [r.failure_type for r in got] == ["valid_escalation_or_transfer", "length_or_step_budget_failure", "missing_required_argument", "unsupported_final_claim", "unverified_write_action", "read_and_stall", "asks_user_instead_of_finishing", "state_tracking_error", "unknown"]


def test_events_take_the_next_call_of_their_name(spark):
    ddl = "episode int, pos int, name string, arguments string"
    live = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", "x"), (1, 2, "a", None)], ddl)
    sim = spark.createDataFrame([(1, 0, "a", "1"), (1, 1, "a", "2"), (1, 2, "c", "3")], ddl)
    got = diagnostics.match_events(live, sim).orderBy("pos").collect()
    assert [(r.arguments, r.matched) for r in got] == [("1", True), ("x", False), ("2", True)]


def test_protocol(spark):
    m = "array<struct<role:string,content:string,tools:array<string>>>"
    cases = [
        ([("user", "hi", []), ("assistant", "yo", [])], None),
        ([("assistant", "", ["f"]), ("tool", "1", []), ("assistant", "done", [])], None),
        ([("tool", "1", [])], "tool_without_call"),
        ([("assistant", "", ["f"]), ("user", "x", [])], "dangling_tool_calls"),
        ([("assistant", "", ["f"])], "dangling_tool_calls"),
        ([("assistant", "x", ["f"]), ("tool", "1", [])], "content_with_tool_calls"),
        ([("assistant", " ", [])], "empty_assistant"),
        ([("robot", "x", [])], "bad_role"),
        ([("assistant", "", ["g"]), ("tool", "1", [])], "unknown_tool"),
        ([], "missing_messages"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, m {m}")
    got = [r[0] for r in df.orderBy("i").select(messages.protocol_reason(F.col("m"), ["f"])).collect()]
    assert got == [w for _, w in cases]


def test_turns_skip_a_greeting_and_hide_thoughts(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "assistant", "hello"), (1, 2, "user", "q"), (1, 3, "assistant", "<think>t</think>a"), (1, 4, "user", "r"), (1, 5, "assistant", "b")]
    t = messages.expand_turns(messages.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = t.orderBy("assistant_turn_index").collect()
    assert [(r.assistant_turn_index, r.source_message_index) for r in got] == [(0, 3), (1, 5)]
    assert got[1].history[3]["content"] == "a"


def test_bootstrap_is_seeded_like_the_legacy_generator(spark):
    v = [0.8, 0.9, 0.1]
    df = spark.createDataFrame([("s", "u", i, x, "ab"[i % 2]) for i, x in enumerate(v)], "data_source string, uid string, pos int, score double, pred string")
    got = {r.metric: r.value for r in metrics.validation_metrics(df, vote="pred").collect()}
    np.random.seed(42)
    idx = np.random.choice(3, size=(1000, 2), replace=True)
    best = np.array(v)[idx].max(axis=1)
    assert np.isclose(got["mean@3"], np.mean(v)) and np.isclose(got["std@3"], np.std(v))
    assert np.isclose(got["best@2/mean"], best.mean()) and np.isclose(got["best@2/std"], best.std()) and "maj@3/mean" in got


def test_validation_golden(spark):
    df = spark.createDataFrame([("source1", "prompt1", 0, 0.8), ("source1", "prompt1", 1, 0.9)], "data_source string, uid string, pos int, score double")
    assert np.isclose({r.metric: r.value for r in metrics.validation_metrics(df).collect()}["mean@2"], 0.85)


def test_trajectories_stay_whole(spark):
    rows = [(i, "t", i // 3) for i in range(12)]
    out = curation.validation_trajectories(spark.createDataFrame(rows, "row_id long, task_id string, trajectory long"), 6, 3, 0).collect()
    sides = {}
    for r in out:
        sides.setdefault(r.trajectory, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values()) and sum(r.split == "test" for r in out) == 3 and sum(r.split == "train" for r in out) == 6


def test_manifest_overlap_raises(spark):
    a = spark.createDataFrame([("x",)], "task_id string")
    with pytest.raises(ValueError):
        curation.split_by_manifest(a, a, a)
    with pytest.raises(Exception, match="no such id"):
        curation.lookup_in_order(a, ["y"]).collect()


def test_queue_drops_the_oldest():
    q = SampleQueue(2)
    assert q.put("a", 0) and q.put("b", 0) and not q.put("c", 1)
    q.version = 2
    assert q.get(3) is None and q.get(2) == [("b", 2), ("c", 1)] and q.statistics() == {"waiting": 0, "produced": 3, "consumed": 2, "dropped": 1}
    q.closed = True
    assert q.get(1) == [] and capacity(10, 0.5, 2) == 30 and must_pause(2, 2, 0, 9)


def test_queue_as_a_stream(spark, tmp_path):
    rows = [("q", i, "put", f"s{i}", 0) for i in range(6)] + [("q", 6, "get", None, 3), ("q", 7, "close", None, 0)]
    log = spark.createDataFrame(rows, "queue string, seq long, kind string, sample_id string, n int")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = run_queue(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), 4)
    run = stream.writeStream.format("memory").queryName("queue_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [tuple(r) for r in spark.table("queue_out").collect()]
    assert got == [tuple(r) for r in run_queue_batch(log, 4).collect()]
    assert [g[2] for g in got if g[1] == "taken"] == ["s2", "s3", "s4"] and got[-1][7] == 2


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "i long, t string")
    df.write.parquet(str(tmp_path / "a.parquet"))
    files.write_lines(df, str(tmp_path / "b.jsonl"), one_file=True)
    both = files.read_files(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.jsonl")])
    assert both.count() == 10
    with pytest.raises(ValueError):
        files.read_files(spark, ["x.csv"])
    cache = files.StepCache(spark, str(tmp_path / "cache"), {"m": 1})
    assert cache.get(1, lambda: df).count() == cache.get(1, lambda: 1 / 0).count() == 5


def test_records_from_json_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"k": 1}, 5, {"k": 2}]')
    (tmp_path / "b.jsonl").write_text('{"k": 3}\n\n{"k": 4}\n')
    got = files.read_records(spark, str(tmp_path), "k int").orderBy("k").collect()
    assert [r.k for r in got] == [1, 2, 3, 4]


def test_logit_functions(spark):
    x = np.array([0.5, -1.0, 2.0])
    p = np.exp(x) / np.exp(x).sum()
    row = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(tk.entropy(F.col("x")), tk.sum_of_squared_probabilities(F.col("x")), tk.token_log_probability(F.col("x"), F.lit(2))).first()
    assert np.allclose(list(row), [-(p * np.log(p)).sum(), (p**2).sum(), np.log(p[2])])


def test_channel_and_typed_calls(spark):
    text = "<|channel|>analysis<|message|>secret<|end|><|start|>assistant<|channel|>commentary to=functions.f <|constrain|>json<|message|>{\"a\":1}<|call|>"
    row = spark.createDataFrame([(text,)], "t string").select(parsing.channel_calls(F.col("t"))).first()[0]
    assert [(c.name, c.arguments) for c in row] == [("f", '{"a":1}')]
    cases = [("5", "integer", "5"), ("x", "integer", '"x"'), ("True", "boolean", "true"), ("[1]", "array", "[1]"), ("a\"b", "string", '"a\\"b"'), ("null", "string", "null")]
    df = spark.createDataFrame([(i, v, k) for i, (v, k, _) in enumerate(cases)], "i int, v string, k string").orderBy("i")
    assert [r[0] for r in df.select(parsing.typed_argument(F.col("v"), F.col("k"))).collect()] == [w for *_, w in cases]


def test_episode_rewards(spark):
    ddl = "i int, label string, expected array<string>, n int, done array<string>, text string, final_reward double, over boolean, runtime string, scores array<double>"
    rows = [
        (0, "refuse", None, 0, [], "I cannot", None, False, "", None),
        (1, "refuse", None, 0, ["book_reservation"], "I cannot", None, False, "", [0.2, 0.7]),
        (2, "", ["a"], 0, ["a", "b"], "", 0.5, True, "official_gym", None),
        (3, "", None, 1, ["send_certificate"], "", None, True, "official_gym", None),
    ]
    df = spark.createDataFrame(rows, ddl)
    r = episodes.task_reward("label", "expected", "n", "done", "text")
    got = df.select("i", r.alias("r"), episodes.best_reward(["final_reward"], "over", "runtime", "scores", r).alias("b")).orderBy("i").collect()
    assert [x.r for x in got] == [1.0, 0.0, 1.0, 1.0]
    assert [(x.b.reward, x.b.source.split("_")[0]) for x in got] == [(1.0, "legacy"), (0.7, "propagated"), (0.5, "official"), (0.0, "official")]


def test_teacher_rows(spark):
    df = spark.createDataFrame([(0, "u", 1.0, "p", "good", None), (1, "u", 0.0, "p", "bad", " "), (2, "v", 0.0, "p", "bad", "try")], "row_id long, uid string, score double, prompt string, response string, feedback string")
    got = episodes.teacher_rows(df, 1.0, note=episodes.feedback(df)).orderBy("row_id").collect()
    assert [r.teacher_prompt for r in got] == [None, "p\n\nA correct solution:\ngood", "p\n\nFeedback:\ntry"]
    assert episodes.feedback(df.drop("feedback")) is not None


def test_dataset_maps(spark):
    df = spark.createDataFrame([(0, "q", "#### 1,000", "a", "b")], "k long, question string, answer string, chosen string, rejected string")
    row = datasets.prompts(df, "s", F.col("question"), datasets.after_mark(F.col("answer")), tool="calc").first()
    assert row.reward_model.ground_truth == "1000" and row.prompt[0].content == "q" and row.extra_info.tools_kwargs == '{"calc":{"create_kwargs":{"ground_truth":"1000"}}}'
    assert [(r.side, r.response) for r in datasets.preference_rows(df).collect()] == [("chosen", "a"), ("rejected", "b")]
    many = spark.range(8).withColumnRenamed("id", "k")
    assert datasets.positional_split(many, 0.75, "k").where("split = 'train'").count() == 6
    shown = datasets.answered(df, F.col("question"), F.col("answer"), "sys").select(datasets.renamed_roles(F.col("messages"), {"user": "human"})).first()[0]
    assert [m.role for m in shown] == ["system", "human", "assistant"]


def test_pretokenized_rows(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 0, 1])], "input_ids array<int>, loss_mask array<int>")
    assert datasets.pretokenized(df, 3).first().loss_mask == [0, 0, 1]
    with pytest.raises(Exception, match="valid"):
        datasets.pretokenized(df, 2).collect()
    pair = spark.createDataFrame([([1], [2, 3], [4])], "prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>")
    row = datasets.reward_pairs(pair, 3, 0).first()
    assert row.input_ids == [[1, 2, 3], [1, 4, 0]] and row.attention_mask == [[1, 1, 1], [1, 1, 0]]


def test_validation_draws_many_prompts_together(spark, monkeypatch):
    rows = [("s" if u % 3 else None, u, i, "ABC"[(u * i) % 3], None if u == 7 else float((u * 13 + i * 7) % 11)) for u in range(40) for i in range(1 + u % 5)]
    df = spark.createDataFrame(rows, "data_source string, uid long, pos long, pred string, score double")
    want = {}
    for source, uid in {r[:2] for r in rows} - {("s", 7)}:
        v, votes = (np.array([r[j] for r in rows if r[1] == uid]) for j in (4, 3))
        for k in metrics.sizes_for(len(v)):
            for draw in (drawn := np.random.RandomState(42).choice(len(v), size=(30, k))):
                said = votes[draw].tolist()
                want.setdefault((source, f"maj@{k}/mean", uid), []).append(v[draw[said.index(max(said, key=said.count))]])
            want[source, f"best@{k}/std", uid] = v[drawn].max(axis=1).std()
    each = {}
    for (source, metric, _), x in want.items():
        each.setdefault((source, metric), []).append(np.mean(x))
    for held in (metrics.MOST_DRAWN, 1):
        monkeypatch.setattr(metrics, "MOST_DRAWN", held)
        got = {(r.data_source, r.metric): r.value for r in metrics.validation_metrics(df, vote="pred", draws=30).collect()}
        assert all(np.isclose(got[k], np.mean(x)) for k, x in each.items()) and got["s", "mean@3"] is not None
