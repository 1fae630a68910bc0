import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm.chat import INSTRUCTION, READ, escaped, format_conversations, read_conversations, unescaped

PARTS = st.lists(st.one_of(st.sampled_from([*INSTRUCTION.controls, "\\", "<", "[", "/", "INST]", " ", "\n"]), st.text(max_size=5)), max_size=12)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_texts_are_escaped_reversibly(parts):
    text, pattern = "".join(parts), INSTRUCTION.pattern()
    out = escaped(text, INSTRUCTION, pattern)
    assert unescaped(out, INSTRUCTION) == text
    assert not any(c in out for c in INSTRUCTION.controls)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), PARTS), max_size=6))
def test_turns_are_read_back(turns):
    from fieldloom.llm.chat import Reader, segments

    said = [(r, "".join(p)) for r, p in turns]
    reader = Reader(INSTRUCTION, INSTRUCTION.reader())
    for _, _, part, _, text, loss, allowed in segments(((0, r, t) for r, t in said), INSTRUCTION):
        reader.add(text, loss, allowed, part)
    row = dict(zip([c.split()[0] for c in READ.split(", ")], reader.row(0), strict=True))
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    assert row["n_turns"] == len(said)
    assert row["turns_sha256"] == digest("".join(f"{r}\n{t}\n" for r, t in said))
    loss = "".join(t for r, t in said if r == "assistant")
    assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), digest(loss))


def test_order_nulls_and_the_machine(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, "assistant", None, 0), (3, 0, None, "x", 0), (None, None, "user", "q", 0), (4, 0, "user", "s", 1), (4, 0, "user", "s", 2), (5, 0, "system", "", 0), (5, 1, "user", "u", 0), (5, 2, "assistant", "w", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")
    got = {r["conv_id"]: r for r in read_conversations(format_conversations(turns)).collect()}
    assert {k: (r["n_turns"], r["valid"], r["first_refused"]) for k, r in got.items()} == {1: (2, True, None), 2: (1, False, 0), 3: (1, False, 0), None: (1, False, None), 4: (2, False, 1), 5: (3, True, None)}
    assert got[1]["loss_chars"] == 1
    assert format_conversations(turns.where("false")).count() == 0
