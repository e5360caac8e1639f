"""Layouts, escapes and loss masks by exact round trips."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trackweave.llm import chat

PIECES = ["<|im_start|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<\\|im_start|>", "[\\\\INST]", "<<SYS>>", "\\", "<", "[", "|", "\n", " ", "ok", "é\U0001f600", "<|endoftext|>"]


def by_turn(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_hostile_texts_round_trip(spark):
    samples = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>"]), st.lists(st.sampled_from(PIECES), max_size=9).map("".join)), min_size=1, max_size=4))
    def draw(turns):
        samples.append(turns)

    draw()
    rows = [(k, t, role, text) for k, turns in enumerate(samples) for t, (role, text) in enumerate(turns)]
    out = chat.format_records(chat.turns_to_records(by_turn(spark, rows))).withColumn("back", chat.parse_formatted(F.col("formatted"))).collect()
    assert len(out) == len(samples)
    for r in out:
        turns = samples[r["conv_id"]]
        assert [(t["role"], t["content"]) for t in r["back"]] == turns
        text = "".join(s["text"] for s in r["segments"])
        assert text == r["formatted"] and text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)
        assert not any(c in text for c in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<|endoftext|>"))
        masked = [text[s["start"] : s["end"]] for s in r["loss_spans"]]
        assert masked == [s["text"] for s in r["segments"] if s["loss"]]
        assert len(masked) == sum(role == "assistant" for role, _ in turns)


def test_layouts(spark):
    lines = [
        (1, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}', [("user", "a"), ("assistant", "")]),
        (2, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}', [("user", "a"), ("assistant", "b"), ("tool", "c")]),
        (3, '{"prompt": "a", "response": "b"}', [("user", "a"), ("assistant", "b")]),
        (4, '{"prompt": "a", "response": "b", "system": "s"}', [("system", "s"), ("user", "a"), ("assistant", "b")]),
        (5, '{"instruction": "a", "output": "b"}', [("user", "a"), ("assistant", "b")]),
        (6, '{"instruction": "a", "output": "b", "input": "i"}', [("user", "a\n\ni"), ("assistant", "b")]),
        (7, '{"prompt": "a", "output": "b"}', None),
        (8, "{}", None),
        (9, '{"messages": []}', []),
    ]
    df = spark.createDataFrame([(k, j) for k, j, _ in lines], "conv_id long, line string").select("conv_id", F.from_json("line", chat.RECORD).alias("record"), F.lit("own").alias("turns"), F.lit("own").alias("_pos"))
    got = {r["conv_id"]: r for r in chat.format_records(df).withColumn("back", chat.parse_formatted(F.col("formatted"))).collect()}
    for k, _, want in lines:
        back = got[k]["back"]
        assert (None if back is None else [(t["role"], t["content"]) for t in back]) == want
        assert (got[k]["formatted"] is None) == (want is None)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (2, None, "user", "x" * 500_000), (None, 0, "user", "a"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "us\ner", "a")]
    df = by_turn(spark, rows).withColumns({"record": F.lit("own"), "formatted": F.lit("own"), "loss": F.lit("own")})
    got = {r["conv_id"]: r for r in chat.format_digest(df).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, 2: 1, None: 1, 3: 2, 4: 1}
    assert got[3]["loss_chars"] == 8 and got[2]["loss_chars"] == 0 and got[2]["formatted_chars"] > 500_000
    assert chat.format_digest(df.limit(0)).collect() == []


def test_roles_with_breaks_come_back(spark):
    rows = [(1, 0, "us\ner", "hi"), (1, 1, "a\\n\r", "there"), (1, 2, "<|im_end|>\n", "x"), (1, 3, "assistant", "yes")]
    record = chat.turns_to_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = chat.format_records(record).select(chat.parse_formatted(F.col("formatted")).alias("t")).first()["t"]
    assert [(t["role"], t["content"]) for t in back] == [(r, t) for _, _, r, t in rows]
