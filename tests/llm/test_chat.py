import random

import duckdb
import pandas as pd

from tamperscope.llm import chat


def corpus():
    rnd = random.Random(3)
    rows = []
    for c in [*range(30), None]:
        people = rnd.sample(["user", "assistant", "ann", "bo é", "", None, "system", " ann "], rnd.randint(1, 6))
        for _ in range(rnd.randint(1, 40)):
            rows.append((c, rnd.choice([None, *range(12)]), rnd.choice(people), rnd.choice([None, "", "<|end|> é", "hi\nyou", "x" * 30])))
    return rows + rows[:5] + [(77, 0, "system", "alone")] + [(78, i, "ab"[i % 2], "w " * 50) for i in range(300)]


def plain(rows):
    out = []
    for c in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            turns.append((turn, (role or "").strip(" ") or "unknown", (text or "").replace("<|", "< |")))
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2].encode()))
        for who in {t[1] for t in turns} - {"system"}:
            at = 0
            for turn, speaker, text in turns:
                head = "<|assistant|>\n" if speaker == who else "<|system|>\n" if speaker == "system" else f"<|user name={speaker}|>\n"
                segment = head + text + "<|end|>\n"
                own = speaker == who
                out.append((c, who, turn, speaker, segment, at, at + len(segment), at + len(head) if own else None,
                            at + len(segment) - 1 if own else None))
                at += len(segment)
    return out


def test_query_and_sql_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, size long")
    want = sorted(map(repr, plain(rows)))
    for block in (4, chat.BLOCK):
        assert sorted(map(repr, map(tuple, chat.rotate(df.repartition(3), block).collect()))) == want
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype(  # noqa: F841  read by name
        {"conv_id": "Int64", "turn": "Int64"})
    assert sorted(map(repr, duckdb.sql(chat.rotate_sql("frame")).fetchall())) == want
    assert chat.rotate(df.limit(0)).count() == 0
