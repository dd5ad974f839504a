import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import chat

PARTS = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|im_sep|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "é", "\n", "|"]), max_size=8).map("".join)
STRINGS = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


@settings(max_examples=500, deadline=None)
@given(PARTS)
def test_escape_is_reversible_and_safe(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(s in chat.escape(text) for s in STRINGS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_spans_of_any_turns(turns):
    spans = list(chat.turn_spans(turns, chat.turn_markup))
    assert "".join(new for _, _, new, *_ in spans) == chat.turn_markup(turns)
    for (role, text), (_, _, new, a, z, rewrites) in zip(turns, spans, strict=True):
        assert chat.unescape(new[a:z]) == text and chat.parsed_role(new) == role and not rewrites


def test_rewriting_template_is_detected():
    def last_marked(turns):
        return "".join(f"<{'!' if i == len(turns) - 1 else ' '}{t}>" for i, (_, t) in enumerate(turns))

    assert [s[5] for s in chat.turn_spans([("u", "a"), ("a", "b"), ("u", "c")], last_marked)] == [False, True, True]


def wanted(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        all_text = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(all_text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.turn_markup(turns)))
    return out


def test_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "é"), (None, 0, "user", "x"), (None, 1, "assistant", "y</s>")]
    rows += [(2, t, ["user", "assistant"][t % 2], f"turn {t} [INST]") for t in range(200)] + [(1, 1, "assistant", "again")] * 2
    df = spark.createDataFrame([(*r, 5, "p") for r in rows], "conv_id long, turn long, role string, text string, place int, output string")
    for block in (1, 7, 64):
        got = {r["conv_id"]: tuple(r)[1:6] for r in chat.conversation_digests(df, block).collect()}
        assert got == wanted(rows)
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_control_conversation(spark):
    text = "</s>[INST] ok [/INST]"
    df = chat.with_control_conversation(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    (row,) = chat.conversation_digests(df).collect()
    assert (row["conv_id"], row["n_turns"], row["loss_chars"]) == (-7, 2, len(text))
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def templates():
    """Made here, as workers can't import this file."""

    def numbered(turns):
        return "".join(f"[{i}:{role}]{text}" for i, (role, text) in enumerate(turns))

    def headed(turns):
        return "# talk\n" * bool(turns) + "".join(f"{role}: {text}\n" for role, text in turns)

    def without_earlier_thoughts(turns):
        """Earlier assistant texts lose what stands before '|'."""
        return "".join(f"<{role}>{text.split('|')[-1] if role == 'assistant' and i < len(turns) - 1 else text}" for i, (role, text) in enumerate(turns))

    def pair_marked(turns):
        """Says whether the role is that of the turn before."""
        return "".join(f"<{'again' if i and turns[i - 1][0] == role else role}>{text}" for i, (role, text) in enumerate(turns))

    return numbered, headed, without_earlier_thoughts, pair_marked


numbered, headed, without_earlier_thoughts, pair_marked = templates()


def plain_spans(turns, render):
    out = []
    for k in range(1, len(turns) + 1):
        before, now = render(turns[: k - 1]), render(turns[:k])
        same = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
        out.append((k - 1, same, now[same:], same < len(before)))
    return out


TALK = [(["user", "assistant"][i % 3 > 0], f"say {i}| t{i % 7}") for i in range(210)]


@pytest.mark.parametrize(("render", "lookback"), [(numbered, None), (headed, None), (without_earlier_thoughts, None), (pair_marked, None), (headed, 1), (pair_marked, 1), (pair_marked, 5)])
def test_long_conversations_equal_whole_renderings(spark, render, lookback):
    df = spark.createDataFrame([(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate(TALK[: 210 // c])], "conv_id long, turn long, role string, text string")
    rows = chat.format_turns(df, chat.Template(render, lookback)).collect()
    for c in (1, 2):
        turns = TALK[: 210 // c]
        own = sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["place"])
        assert [(r["place"], r["start"], r["output"], r["rewrites"]) for r in own] == plain_spans(turns, render)
        assert [r["loss"] for r in own] == [role == "assistant" for role, _ in turns]
        assert all(r["output"][r["text_start"] : r["text_end"]] == text for r, (_, text) in zip(own, turns, strict=True))


@pytest.mark.parametrize(("render", "lookback"), [(numbered, 0), (numbered, 3), (headed, 0), (without_earlier_thoughts, 2), (pair_marked, 0)])
def test_a_wrong_declaration_fails(render, lookback):
    with pytest.raises(ValueError, match="declare no lookback"):
        now = chat.Conversation(chat.Template(render, lookback))
        for turn in TALK:
            list(now.add(*turn))


def test_very_long_texts_and_ties(spark):
    long = "x</s>" * 400_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", "a"), (1, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = chat.conversation_digests(df).collect()
    assert tuple(got)[1:6] == wanted(rows)[1]


def late(first):
    """Numbers the turns from ``first`` on; made here, as workers can't import this file."""

    def render(turns):
        return "".join(f"<{role}>{text}" + f"[{i}]" * (i >= first) for i, (role, text) in enumerate(turns))

    return render


@pytest.mark.parametrize(("turns", "first", "size"), [(60, 50, 100), (60, 50, 120_000), (200, 150, 5), (17, 16, 3)])
def test_a_wrong_declaration_fails_at_any_size(spark, turns, first, size):
    """Also where the first wrong turn stands after 4 MB of text, or after the last doubling of the turns."""
    df = spark.createDataFrame([(1, i, "user", "x" * size) for i in range(turns)], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="declare no lookback"):
        chat.format_turns(df, chat.Template(late(first), 0)).collect()
    if size < 1000:
        rows = chat.format_turns(df, chat.Template(late(first))).collect()
        assert "".join(r["output"] for r in sorted(rows, key=lambda r: r["place"])) == late(first)([("user", "x" * size)] * turns)


@pytest.mark.parametrize("lookback", [0, 1, 3])
def test_turn_by_turn_equals_whole_renderings(lookback):
    def one(before, turn):
        return f"<{len(before)}{''.join(r[0] for r, _ in before)}{turn[0]}>{turn[1]}"

    template = chat.turn_by_turn(one, lookback)
    now, held, spans = chat.Conversation(template), 0, []
    for turn in TALK:
        spans += now.add(*turn)
        held = max(held, len(now.turns))
    spans += now.end()
    assert [(k, at, new, rewrites) for k, at, new, _, _, rewrites in spans] == plain_spans(TALK, template.render)
    assert held <= chat.BLOCK + lookback and now.every is None


def test_the_query_holds_a_block_however_long_a_conversation_is():
    now = chat.Conversation(chat.TURN_MARKUP)
    for i in range(1000):
        list(now.add("user", f"turn {i}"))
        assert len(now.turns) < chat.BLOCK and now.every is None
