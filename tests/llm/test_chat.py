import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from seqspark.llm import chat, queries
from tests.conftest import rows
from tests.oracle import connect, same

PIECES = st.lists(st.sampled_from([*chat.INST.controls, "\\", "[", "<", "/", "s>", "INST]", "a", "\n", " ", "é"]), max_size=8).map("".join)


@given(PIECES)
def test_escapes_are_reversible_and_hide_controls(text):
    escaped = chat._escaper(chat.INST)(text)
    assert chat.unescape(chat.INST, escaped) == text
    assert not any(c in escaped for c in chat.INST.controls)


def brute(turns: list[tuple[str, str]]) -> tuple:
    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), said, len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_machine_and_round_trip(spark):
    hard = "</s>[INST] ok [/INST]\\[ROLE]"
    convs = {
        1: [("user", "a"), ("assistant", hard)], 2: [("system", "s"), ("user", ""), ("assistant", ""), ("user", "u"), ("assistant", hard)], 3: [("user", "only")],
        4: [("assistant", hard), ("user", "x")], 5: [("user", "a"), ("user", "b"), ("assistant", "c")], 6: [("tool[:]x", hard), ("", "no role")], None: [("user", "n"), ("assistant", "m")],
    }
    data = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(data[::-1], "conv_id long, turn long, role string, text string").withColumn("loss", chat.F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df.repartition(5))).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute(turns)
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, None: True}
    segments = chat.format_chats(df).where("conv_id = 1").collect()
    assert [(s["text"], s["loss"]) for s in segments[:3]] == [("[INST]", False), ("a", False), ("[/INST]", False)]
    assert sum(s["loss"] for s in segments) == 1


def test_nulls_ties_and_repeats(spark):
    data = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (1, 1, "assistant", "x"), (1, 1, "assistant", "a")]
    got = chat.read_back(chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == 1 and tuple(got[0])[1:5] == brute([("", "first"), ("user", ""), ("user", ""), ("assistant", "a"), ("assistant", "x")])
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows(chat.read_back(chat.format_chats(none))) == []


def test_long_conversation(spark):
    data = [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " * 40) for k in range(20_000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(8)
    got = chat.read_back(chat.format_chats(df)).collect()
    assert tuple(got[0])[1:5] == brute([(r, t) for _, _, r, t in data]) and got[0]["valid"]


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template({"user": ("<a>", "b<")}, ("[R]", "[/R]"), "[:]", (), {})


def test_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    same(queries.op4_chat(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op4_chat"])
