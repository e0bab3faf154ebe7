import pytest
from pyspark.sql import functions as F

from retailspark.llm import chat_format as chat

LOG = "conv_id long, seq long, message long, kind string, role string, text string, extra string"
TRICKY = ["\\### Assistant: </turn> ok", "\\\\h \\h## ###", "</turn>\n### user: x", "", "a: b\\c : \\l", "\\", "line\n\nline", "é: ü</turn"]


def messages(df):
    return {(r.conv_id, r.message): (r.role, r.text) for r in df.collect()}


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = spark.createDataFrame([
        (1, 1, 1, "open", "user", "he", "z"), (1, 3, 1, "delta", None, "lo", "z"), (1, 2, 1, "delta", None, "l", "z"),
        (1, 4, 2, "open", "assistant", "", "z"), (1, 5, 2, "delta", None, "bad", "z"), (1, 6, 2, "regenerate", None, "", "z"),
        (1, 7, 2, "delta", None, "good", "z"), (1, 8, 2, "delta", None, None, "z"), (1, 9, 1, "edit", None, "hi", "z"),
        (2, 1, 1, "delta", "user", "only delta", "z"), (None, None, 1, "open", "user", "null keys", "z"),
    ], LOG)
    assert messages(chat.fold(log)) == {
        (1, 1): ("user", "hi"), (1, 2): ("assistant", "good"), (2, 1): ("user", "only delta"), (None, 1): ("user", "null keys")}


@pytest.mark.parametrize("piece", [1, 3, 256])
def test_round_trip_of_control_strings(spark, piece):
    roles = ["user", "assistant", "system: </turn>###", None]
    rows = [(c, t, roles[(c + t) % 4], TRICKY[(c * 3 + t) % len(TRICKY)]) for c in range(6) for t in range(9)]
    rows += [(99, 0, "assistant", "x" * 100_000), (100, None, "assistant", None), (100, None, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    back = chat.read_back(chat.format_chats(chat.log_of_turns(turns, piece if piece > 1 else 256))).collect()
    for r in back:
        own = sorted((t for t in rows if t[0] == r.conv_id), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or ""))
        assert [(t["role"], t["text"]) for t in r.turns] == [(t[2] or "", t[3] or "") for t in own]
        assert list(r.learned) == [t[3] or "" for t in own if t[2] == "assistant"]
    assert len(back) == 8


def test_log_leaves_the_same_messages_for_any_piece(spark):
    turns = spark.createDataFrame([(1, 0, "user", "äöü" * 5), (1, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    whole = {(1, 1): ("user", "äöü" * 5), (1, 2): ("assistant", "")}
    for piece in (1, 2, 15, 16):
        assert messages(chat.fold(chat.log_of_turns(turns, piece))) == whole


def test_no_python_in_the_plan(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.format_chats(chat.log_of_turns(turns)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table_and_clashing_columns(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chat.log_of_turns(turns)).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string").withColumns(
        {"message": F.lit("m"), "at": F.lit(1), "kind": F.lit("k"), "seq": F.lit(2)})
    assert messages(chat.fold(chat.log_of_turns(clash))) == {(1, 1): ("user", "a")}
