import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import chat

HOSTILE = ["", "\\### Assistant: </turn> ok", "###", "\\", "\\b\\h\\t\\c", "</turn", "</turn></turn>\n", "<", "#", "a: b", ": ", "####\\\\#",
           "### user: hi</turn>\n", "é中\n\n", "</tu\\rn>", "x" * 100_000]


def python_escape(text):
    for a, b in chat.ESCAPES:
        text = text.replace(a, b)
    return text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("\\#</turn>bhtc: \n"), max_size=30))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    code = python_escape(text)
    assert "###" not in code and "</turn>" not in code and ": " not in code
    for a, b in reversed(chat.ESCAPES):
        code = code.replace(b, a)
    assert code == text


def test_round_trip(spark):
    rows = [(i, [{"role": r, "text": t} for r in ("user", "assistant", a) for t in (a, b)]) for i, a in enumerate(HOSTILE) for b in HOSTILE[:3]]
    rows += [(900, []), (901, None), (902, [{"role": None, "text": None}])]
    df = chat.chat_format(spark.createDataFrame(rows, f"conv_key int, turns {chat.TURNS}"))
    masked = F.transform("loss", lambda s: chat.unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    got = df.select("conv_key", chat.parsed(F.col("formatted")).alias("turns"), masked.alias("masked")).collect()
    plain = lambda turns: [(t["role"] or "", t["text"] or "") for t in turns or []]
    assert sorted((r["conv_key"], plain(r["turns"])) for r in got) == sorted((k, plain(t)) for k, t in rows)
    want = [(k, [x for r, x in plain(t) if r == "assistant"]) for k, t in rows]
    assert sorted((r["conv_key"], r["masked"]) for r in got) == sorted(want)


def test_layouts_become_turns(spark):
    u, a = ("user", "hi"), ("assistant", "yo")
    given_rows = [
        ({"prompt": "hi", "completion": "yo"}, [u, a]),
        ({"response": "yo", "prompt": "hi", "id": 7, "meta": {"x": [1]}}, [u, a]),
        ({"instruction": "hi", "output": "yo"}, [u, a]),
        ({"instruction": "be kind", "input": "hi", "output": "yo"}, [("system", "be kind"), u, a]),
        ({"question": None, "answer": "yo"}, [("user", ""), a]),
        ({"messages": [{"role": "user", "content": "hi", "n": 1}, {"content": "yo", "role": "assistant"}]}, [u, a]),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}, {"from": "tool", "value": None}]}, [u, a, ("tool", "")]),
        ({"conv_id": 3, "turn": 1, "role": "user", "text": "hi"}, [u]),
        ({"messages": [{"role": "user"}, {"role": "assistant", "content": "yo"}, 5]}, [("user", ""), a, ("", "")]),
        ({"prompt": 5, "completion": {"x": "yo"}}, [("user", "5"), ("assistant", '{"x":"yo"}')]),
        ({"unheard": "of"}, None),
        ({"prompt": "only"}, None),
    ]
    rows = [(i, json.dumps(x)) for i, (x, _) in enumerate(given_rows)] + [(50, None), (51, "no json"), (52, "[1]"), (53, "")]
    got = chat.canonical_turns(spark.createDataFrame(rows, "i int, record string")).collect()
    found = {r["i"]: ([(t["role"], t["text"]) for t in r["turns"]] if r["known"] else None) for r in got}
    assert found == {**{i: t for i, (_, t) in enumerate(given_rows)}, 50: None, 51: None, 52: None, 53: None}
    assert len({r["fingerprint"] for r in got if r["i"] < 8}) == 8
    assert [(r["conv_key"], r["turn_no"]) for r in got if r["i"] == 7] == [("3", 1)]


def test_query_takes_odd_rows(spark, tmp_path):
    fields = "conv_id long, turn long, role string, text string, record string, turns string"
    rows = [(1, 1, "assistant", None), (1, 0, None, "first"), (1, 1, "assistant", None), (2, None, "user", "x"), (None, 0, "user", "y"), (3, 0, "", "")]
    for name, given_rows in (("some", rows), ("none", [])):
        spark.createDataFrame([(*r, "a", "b") for r in given_rows], fields).write.parquet(str(tmp_path / name / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op5_chat_format(spark, str(tmp_path / "some")).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 1, -7: 2}
    assert got[1]["loss_chars"] == 0 and got[-7]["loss_chars"] == len(chat.HARD[0])
    assert [r["conv_id"] for r in chat.op5_chat_format(spark, str(tmp_path / "none")).collect()] == [-7]
    assert "Python" not in chat.op5_chat_format(spark, str(tmp_path / "some"))._jdf.queryExecution().executedPlan().toString()


def test_very_long_texts_are_whole(spark, tmp_path):
    n = 25_000_000
    long = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"),
                                 F.repeat(F.lit("x y: "), n // 5).alias("text"))
    long.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chat.op5_chat_format(spark, str(tmp_path)).collect()}
    assert got[1]["loss_chars"] == n and got[1]["formatted_chars"] > n and got[1]["n_turns"] == 1
    record = F.to_json(F.struct(F.lit("hi").alias("prompt"), F.col("text").alias("completion")))
    found = chat.canonical_turns(long.select(record.alias("record"))).select("known", F.length(F.col("turns")[1]["text"]).alias("n")).first()
    assert found["known"] and found["n"] == n


def test_tables_become_turns_by_their_schema(spark):
    def turns(fields, rows):
        found = chat.table_turns(spark.createDataFrame(rows, fields)).collect()
        return [[(t["role"], t["text"]) for t in r["turns"]] if r["known"] else None for r in found]

    assert turns("prompt string, completion string, known int", [("hi", None, 1)]) == [[("user", "hi"), ("assistant", "")]]
    message = "conversations array<struct<from:string,value:string>>, turns string"
    assert turns(message, [([("human", "hi"), ("gpt", "yo")], "x"), (None, "y")]) == [[("user", "hi"), ("assistant", "yo")], []]
    assert turns("prompt string", [("hi",)]) == [None] and turns("x int", [(1,)]) == [None]
    both = spark.createDataFrame([("a", "b")], "question string, answer string")
    record = both.select(F.to_json(F.struct("*")).alias("record"))
    assert chat.table_turns(both).first()["fingerprint"] == chat.canonical_turns(record).first()["fingerprint"]
