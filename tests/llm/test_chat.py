"""Perspective rotation against a plain Python rendering."""

import hashlib
import random

import pytest

from gneiss.llm import chat

ROWS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", ""), (1, 3, "ann", ""), (2, 0, "system", "alone"), (None, 0, "cy", "x"), (None, 1, None, "y"), (3, None, "di", "z")]


LONG = [(7, i // 2 % 90, random.Random(i).choice(["ann", "bob", "cy", "system", None]), "word " * (i % 7)) for i in range(700)] + [(8, 5, "ann", "same")] * 30


def plain(rows):
    want = []
    for c in {r[0] for r in rows}:
        nulls_first = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", hashlib.md5((r[3] or "").encode()).digest())
        conv = sorted((r for r in rows if r[0] == c), key=nulls_first)
        for me in {r[2] for r in conv} - {None, "system"}:
            dialogue = ""
            for i, (_, turn, role, text) in enumerate(conv):
                said = "system" if role == "system" else "assistant" if role == me else "user"
                name = (role or "unknown") if said == "user" else None
                head = f"<|user name={name}|>\n" if said == "user" else f"<|{said}|>\n"
                line = f"{head}{text or ''}<|end|>\n"
                want.append((c, me, turn, i, said, name, line, int(role == me), len(dialogue), len(head), len(text or "")))
                dialogue += line
    return sorted(want, key=repr)


@pytest.mark.parametrize("step", [chat.STEP, 8])
def test_rotation(spark, monkeypatch, step):
    monkeypatch.setattr(chat, "STEP", step)
    for rows in (ROWS, ROWS + LONG):
        df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, participant string, mask int")
        assert sorted((tuple(r) for r in chat.rotate(df).collect()), key=repr) == plain(rows)


def test_dialogue_is_its_rows_in_order(spark):
    df = spark.createDataFrame(LONG, "conv_id long, turn long, role string, text string")
    rows = sorted((r.ordinal, r.start, r.rendered) for r in chat.rotate(df).where("conv_id = 7 and participant = 'ann'").collect())
    dialogue = "".join(x for _, _, x in rows)
    assert [r[0] for r in rows] == list(range(700)) and all(dialogue.startswith(x, at) for _, at, x in rows)


def test_empty(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
