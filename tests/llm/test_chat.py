import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.llm import chat

from ..oracle import compare

RECORDS = [
    ({"messages": [{"role": "user", "content": "a", "extra": None}, {"role": "assistant", "content": "b"}], "id": 3}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [("system", "s"), ("user", "h"), ("assistant", "g")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction_input", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "more", "output": "o"}, "instruction_input", [("user", "i\n\nmore"), ("assistant", "o")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "r", "system_prompt": "y"}, "prompt_response", [("system", "y"), ("user", "p"), ("assistant", "r")]),
    ({"prompt": [{"role": "user", "content": "q"}], "completion": "c"}, "prompt_messages", [("user", "q"), ("assistant", "c")]),
    ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"dialog": [{"speaker": "bot", "text": "t"}]}, "dialog", [("assistant", "t")]),
    ({"role": "tool", "text": ""}, "row", [("tool", "")]),
    ({"other": 1}, None, []),
    ([1, "x"], None, []),
]
text = st.text(alphabet="\\<|turnd>\nab é\u2028🙂", max_size=30)


def test_layouts(spark):
    rows = [(i, json.dumps(r), "clash") for i, (r, *_) in enumerate(RECORDS)] + [(90, "{bad", "x"), (91, None, "x")]
    got = {r.id: r for r in chat.canonical(spark.createDataFrame(rows, "id int, record string, layout string"), "record", ["id", "layout"]).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert (got[i].layout, [tuple(t) for t in got[i].turns]) == (layout, turns)
    assert got[90].layout is None and got[91].turns == [] and got[90].fingerprint is None


def test_broken_and_odd_records(spark):
    deep, lists = '{"a":' * 3000 + "1" + "}" * 3000, "[" * 100_000 + "]" * 100_000
    parts = {"messages": [{"role": "user", "content": [{"type": "text", "text": "see "}, {"type": "image", "url": "u"}, "this"]}, {"role": "assistant", "content": "ok"}]}
    rows = [(0, deep), (1, lists), (2, '{"role": "user", "text": "a\\ud800b"}'), (3, '{"\\udc00": 1}'), (4, json.dumps(parts)), (5, '{"prompt": "x", "completion": "\\ud83d\\ude42"}'), (6, '{"messages": [{"role": "user", "content": "a"}, {"role": 3, "content": {"b": 1}}]}')]
    got = {r.id: r for r in chat.canonical(spark.createDataFrame(rows, "id int, record string"), "record", ["id"]).collect()}
    assert [got[i].layout for i in range(7)] == [None, None, "row", None, "messages", "prompt_completion", "messages"]
    assert [tuple(t) for t in got[2].turns] == [("user", "a\ufffdb")] and [tuple(t) for t in got[5].turns] == [("user", "x"), ("assistant", "🙂")]
    assert [tuple(t) for t in got[4].turns] == [("user", "see this"), ("assistant", "ok")] and tuple(got[6].turns[1]) == ("3", '{"b": 1}')


def test_layout_query(spark, data):
    compare(spark, data, chat.chat_layouts, chat.CHAT_LAYOUTS_SQL)


def test_fingerprints_see_paths_not_values():
    a, b = {"x": [{"y": "1"}, {"y": "2"}], "n": None}, {"x": [{"y": "zzz"}]}
    assert chat.fingerprint(a) == chat.fingerprint(b) != chat.fingerprint({"x": [{"y": 1}]})


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(text, text), min_size=20, max_size=40))
def test_template_reads_back(spark, turns):
    got = chat.formatted(spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(turns)], "i int, role string, text string"), loss_roles=("assistant", "")).orderBy("i").collect()
    assert chat.parse("".join(r.formatted for r in got)) == turns
    for r, (role, said) in zip(got, turns):
        assert chat.unescape(r.formatted[r.loss_begin : r.loss_end]) == (said if role in ("assistant", "") else "")


def test_query(spark, data):
    compare(spark, data, chat.op5_chat_formatting, chat.OP5_SQL)
    assert chat.op5_chat_formatting(spark, data).where("conv_id = -7").first().n_turns == 2


def test_edges(spark):
    rows = spark.createDataFrame([(1, 0, None, None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (None, 1, "user", "z" * 100_000)], "c long, t int, role string, text string")
    got = {r.c: r for r in chat.digests(chat.formatted(rows), "c", ["t", "role", "text"]).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[None].n_turns == 1 and got[None].loss_chars == 0
    assert chat.digests(chat.formatted(rows.where(F.lit(False))), "c", ["t"]).count() == 0
    clash = chat.formatted(rows.withColumns({"formatted": F.lit("x"), "loss_end": F.lit(0), "n_turns": F.lit(8)}))
    assert {r.c: r.n_turns for r in chat.digests(clash, "c", ["t"]).collect()} == {1: 3, None: 1}
