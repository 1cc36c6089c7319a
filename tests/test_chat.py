"""Training sequences of conversations: errors, masks, planted mismatches."""

import json

import pytest
from pyspark.sql import functions as F

from rolloom.operators import chat


def turns(spark, *convs):
    rows = [(i, k, r, t, c) for i, conv in enumerate(convs) for k, (r, t, *c) in enumerate(conv)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, calls array<string>")


THINK = "<think>" + " deep" * 40 + "</think>yes"


def test_segments_and_errors(spark):
    call = json.dumps({"type": "function", "function": {"name": "look", "arguments": {"a": 1}}})
    flat = json.dumps({"name": "look", "arguments": {}})
    df = turns(
        spark,
        [("system", "be kind"), ("user", "hi there"), ("assistant", None, call), ("tool", "42"), ("assistant", "it is 42")],
        [("user", "hi"), ("assistant", THINK), ("user", "so"), ("assistant", "done")],
        [("user", "nobody"), (None, None)],
        [("assistant", "first"), ("assistant", "second", flat)],
    )
    kept = {r.conv_id: r for r in chat.pretokenize(df).collect()}
    assert [(s.segment_type, s.assistant_turn_index, s.tool_names) for s in kept[0].segments] == [("system", None, []), ("user", None, []), ("assistant_tool_call", 0, ["look"]), ("tool", None, []), ("assistant_text", 1, [])]
    assert kept[0].error is None and kept[0].segments[-1].token_end == kept[0].seq_len == len(kept[0].loss_mask)
    assert all(kept[0].loss_mask[p] == s.loss for s in kept[0].segments for p in range(s.token_start, s.token_end))
    assert kept[1].error is None and kept[2].error == "no_labels" and kept[3].error == "span_count"  # two assistants make one span
    assert kept[3].loss_mask[0] == 0 and (kept[0].template_shape, kept[3].template_shape) == ("nested", "flat")
    assert chat.pretokenize(df, audit=False).where("conv_id = 3").first().error is None
    cut = {r.conv_id: r for r in chat.pretokenize(df, keep_thinking=False).collect()}
    assert cut[1].error == "prefix_shrinks" and cut[0].error is None
    assert chat.pretokenize(df, max_length=10).where("conv_id = 0").first().error == "too_long"
    for side, at in (("right", slice(0, 12)), ("left", slice(-12, None))):
        short = {r.conv_id: r for r in chat.pretokenize(df, max_length=12, truncation=side).collect()}
        assert short[0].truncated and short[0].input_ids == kept[0].input_ids[at] and short[0].seq_len == 12 and short[0].original_seq_len == kept[0].seq_len
        assert short[0].segments[0 if side == "right" else -1].role == ("system" if side == "right" else "assistant")
        assert all(0 <= s.token_start <= s.token_end <= 12 for s in short[0].segments)
    with pytest.raises(ValueError):
        chat.pretokenize(df, truncation="middle")
    told = chat.pretokenize_stats(chat.pretokenize(df.where("false"))).first()
    assert told.input_rows == 0 and told.p90_seq_len == 0.0


def test_a_planted_mismatch_is_reported(spark):
    df = turns(spark, [("user", "hi"), ("assistant", THINK), ("user", "so what is it"), ("assistant", "done")], [("user", "hi"), ("assistant", "plain")])
    same = {r.conv_id: r for r in chat.sft_examples(df, max_length=400).collect()}
    assert same[0].matches and same[1].matches and same[0].error is None
    lead = len(chat_ids(spark, "<|im_start|>assistant\n"))
    assert sum(same[1].loss_mask) == len(chat_ids(spark, "<|im_start|>assistant\nplain<|im_end|>\n")) - lead
    assert len(same[1].input_ids) == 400 and sum(same[1].attention_mask) == same[1].sequence_length and same[1].position_ids[same[1].sequence_length :] == [0] * (400 - same[1].sequence_length)
    cut = {r.conv_id: r for r in chat.sft_examples(df, keep_thinking=False, max_length=400).collect()}
    assert not cut[0].matches and cut[0].error == "ids_mismatch" and cut[1].matches
    assert chat.sft_examples(df, keep_thinking=False, ignore_mismatch=True).where("conv_id = 0").first().error is None
    bare = {r.conv_id: r for r in chat.sft_examples(df, max_length=5, pad_mode="no_padding", truncation="left").collect()}
    assert bare[0].input_ids == same[0].input_ids[:5] and bare[0].error is None
    assert chat.sft_examples(df, max_length=5).where("conv_id = 1").first().error == "too_long"


def chat_ids(spark, text):
    return spark.range(1).select(chat.word_ids(F.lit(text)).alias("x")).first().x


def test_messages_as_they_come(spark):
    given = [
        {"role": "assistant", "content": "hello", "tool_calls": None}, {"role": "user", "content": "x", "name": None},
        {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "f", "arguments": '{"a": null, "b": [null, {"c": null}]}'}}, {"name": "g", "arguments": 3}, {"id": "h"}]},
    ]
    text = spark.createDataFrame([(json.dumps(given),), (None,)], "t string")
    got = [None if r.x is None else json.loads(r.x) for r in text.select(chat.normalise_messages()("t").alias("x")).collect()]
    assert got == [[{"role": "user", "content": "x"}, {"role": "assistant", "tool_calls": [{"type": "function", "function": {"name": "f", "arguments": {"b": [None, {}]}}}, {"name": "g", "arguments": {"__value__": 3}}, {"id": "h"}]}], None]
    flat = json.loads(text.where("t is not null").select(chat.normalise_messages(flat=True)("t").alias("x")).first().x)
    assert flat[1]["tool_calls"][0] == {"name": "f", "arguments": {"b": [None, {}]}}
    with pytest.raises(ValueError):
        chat.normal_call("f")


def test_files_are_sampled_by_place(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "array(struct('user' as role, 'hi' as content), struct('assistant' as role, cast(id as string) as content)) as messages").coalesce(1)
    rows.write.parquet(f"{tmp_path}/a.parquet")
    rows.withColumn("id", F.col("id") + 5000).write.parquet(f"{tmp_path}/b.parquet")
    paths, chosen = [f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"], []
    from rolloom.sources.files import read_files

    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        chosen.append(sorted(r.id for r in read_files(spark, paths, most=50, seed=3).collect()))
        assert sorted(r.id for r in read_files(spark, paths, most=5).collect()) == [0, 1, 2, 3, 4]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert chosen[0] == chosen[1] and len(set(chosen[0])) == 50 and 5 < sum(i >= 5000 for i in chosen[0]) < 45
    made = chat.sft_examples(chat.read_conversations(spark, paths, most=7), max_length=64)
    assert made.count() == 7 and made.where("matches").count() == 7
