import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.chat_format import HARD, format_conversations, parse_turn, read_back, render_turn

texts = st.text() | st.lists(st.sampled_from(["###", "</turn>", "\\", "#", " ", "\n", "### Assistant: ", "a", "</", "<"])).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.sampled_from(["user", "assistant", "", "a:b\\n\n"]) | st.text(), texts)
def test_round_trip(role, text):
    rendered, a, b = render_turn(role, text)
    got = parse_turn(rendered)
    assert got[:2] == (role, text) and got[2:4] == (a, b) and got[4] == len(rendered)
    assert rendered.count("### ") >= 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), texts), min_size=1, max_size=5))
def test_a_whole_conversation_parses_turn_by_turn(turns):
    whole, at, back = "".join(render_turn(r, t)[0] for r, t in turns), 0, []
    while at < len(whole):
        role, text, _, _, at = parse_turn(whole, at)
        back.append((role, text))
    assert back == turns


def test_control_strings_do_not_stand_bare():
    body = render_turn("user", HARD)[0][len("### user: ") : -len(" </turn>\n")]
    assert "\\###" in body and "\\</turn>" in body and HARD not in body


def test_digests_of_a_table(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} é ### {t}") for t in range(300)]
    rows += [(2, 0, None, None), (2, 0, "assistant", ""), (None, None, "assistant", "x"), (None, None, "assistant", "x"), (-7, 1, "assistant", HARD), (-7, 0, "user", HARD)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    formatted = format_conversations(df)
    got = {r.conv_id: r for r in read_back(formatted).collect()}
    assert set(got) == {1, 2, None, -7}
    for conv, r in got.items():
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == conv)
        spoken = "".join(text for _, role, text in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
    text = "".join(r.rendered for r in sorted((r for r in formatted.collect() if r.conv_id == -7), key=lambda r: r.position))
    assert got[-7].formatted_chars == len(text)
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_the_joined_text_is_parsed_wherever_rows_cut_it(spark):
    import random

    from quarry.llm.chat_format import Reader, render_turn

    turns = [("user", HARD), ("assistant", HARD), ("a:b", "x </turn>\n### assistant: y"), ("assistant", ""), ("assistant", "é" * 50)]
    text, whole = "", Reader("assistant")
    for role, body in turns:
        rendered, a, b = render_turn(role, body)
        whole.feed(rendered, (len(text) + a, len(text) + b) if role == "assistant" else None)
        text += rendered
    want = whole.close()
    assert want[0] == 5 and want[2] == len(HARD) + 50
    for seed in range(20):
        rng, cut, at = random.Random(seed), Reader("assistant"), 0
        while at < len(text):
            n = rng.randint(1, 40)
            cut.feed(text[at : at + n])
            at += n
        assert cut.close() == want
