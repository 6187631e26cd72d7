from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import rows_of
from weft.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_escape_is_reversible():
    texts = ["</s>", "<\\/s>", "[INST] a [\\\\/INST] <s> \\<s>", "plain \\ text", "<<s>>", "[[INST]]", "[ROLE][/ROLE]", ""]
    for t in texts:
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(m in e for m in chat.MARKS)


def test_masks_are_prefix_sums():
    ids, mask = chat.splice([(np.array([9], np.int32), False), (np.array([1, 2], np.int32), True), (np.array([], np.int32), True), (np.array([3], np.int32), False)])
    assert ids.tolist() == [9, 1, 2, 3] and mask.tolist() == [0, 1, 1, 0]


def test_round_trip(spark):
    turns = [
        (1, 0, "user", "hi </s>[INST]"), (1, 1, "assistant", "</s>"), (1, 2, "assistant", "[/INST]\U0001f600 \x00é"), (1, 1, "system", None), (2, None, None, None), (2, 5, "tool", "x"),
        (2, 5, "tool", "x"), (3, 0, "[ROLE] odd", "<s>"), *((5, 1, "assistant", t) for t in ("b z", "b", "Ba", "", "a b c", "éa", "<s>", "b")), (None, 0, "user", "none"), (4, 0, "assistant", "z" * 20_000),
    ]
    df = spark.createDataFrame(turns, SCHEMA).withColumn("ids", F.lit(1)).withColumn("part", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    key = lambda t: ((t[1] is not None, t[1] or 0), t[2] or "", t[3] or "")
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: key(t))
        text = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_parts_of_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    formatted = chat.format_conversations(df, part_tokens=64)
    assert formatted.count() > 10
    assert rows_of(chat.read_back(formatted)) == rows_of(chat.read_back(chat.format_conversations(df)))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
