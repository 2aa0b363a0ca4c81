import hashlib
import random
import re

from txnlake.llm import chat

FIELDS = "conv_id long, turn long, role string, text string, segments string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_escapes_are_reversible():
    codec, r = chat.Codec(chat.TURNS), random.Random(4)
    marks = ["\\", "#", "##", "###", "</turn>", "</", "turn>", "\n", "a", "### User: ", "]: ", "]", "é"]
    for _ in range(3000):
        text = "".join(r.choices(marks, k=r.randint(0, 8)))
        role = r.choice(["user", "assistant", "system", "", "tool", "".join(r.choices(marks, k=3))])
        parts = codec.segments(role, text)
        assert codec.read("".join(p for p, _ in parts)) == (role, text)
        held = re.sub(r"\\(\\|###|</turn>)", ".", parts[1][0])
        assert "###" not in held and "</turn>" not in held and "\\" not in held


def test_rows_by_brute_force(spark):
    r = random.Random(6)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(r.randint(1, 9)):
            rows.append((conv, r.choice([turn, 2, None]),
                         r.choice(["user", "assistant", "system", None, "tool", "Assistant"]),
                         r.choice([None, "", "hi", "### User: x", "</turn>\n", "\\", "é\U0001f600"]), "z"))
    rows += [(50, i, role, f"t{i}", "z") for i, role in enumerate(["system", "user", "assistant"] * 1)]
    rows += [(51, i, ("user", "assistant")[i % 2], "x" * 1000, "z") for i in range(2000)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, FIELDS)
    got = {x.conv_id: x for x in chat.read_back(chat.format_chats(df)).collect()}
    assert len(got) == len({x[0] for x in rows})
    codec = chat.Codec(chat.TURNS)
    for conv, x in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "")
                        for c, t, role, text, _ in rows if c == conv))
        turns = [(role, text) for _, _, role, text in turns]
        said = "".join(t for role, t in turns if role == "assistant")
        assert x.n_turns == len(turns)
        assert x.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (x.loss_chars, x.loss_sha256) == (len(said), sha(said))
        assert x.formatted_chars == sum(len(p) for a, b in turns for p, _ in codec.segments(a, b))
        state = "start"
        for role, _ in turns:
            state = chat.TURNS.moves.get(state, {}).get(role)
        assert x.valid == (state == "assistant")
    assert got[50].valid and got[51].valid
    empty = chat.read_back(chat.format_chats(df.limit(0)))
    assert empty.count() == 0 and empty.columns == list(got[50].asDict())
