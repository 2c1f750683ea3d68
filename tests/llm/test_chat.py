import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from laurel.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\\\\", "<", "[", "s>", "INST]", "x", " ", "\n", "é", "/"]), max_size=12).map("".join)


@given(PIECES)
def test_escaped_texts_hold_no_control_string_and_read_back(text):
    out = chat.escape(text)
    assert not any(c in out for c in chat.CONTROL)
    assert chat.unescape(out) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]\\"]), PIECES), max_size=6))
def test_rendered_turns_read_back(turns):
    text = "".join(("<s>" if i == 0 else "") + chat.frame(r)[0] + chat.escape(t) + chat.frame(r)[1] for i, (r, t) in enumerate(turns))
    assert list(chat.Parser().turns(text)) == turns


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 0, 0, "message", "user", "hel"), (1, 1, 0, "delta", None, "lo"), (1, 2, 1, "message", "assistant", ""),
        (1, 3, 1, "delta", None, "bad "), (1, 4, 1, "delta", None, "answer"), (1, 5, 1, "regenerate", None, None),
        (1, 6, 1, "delta", None, "good "), (1, 7, 1, "delta", None, "answer"), (1, 8, 0, "edit", None, "hello!"),
        (2, 0, 0, "delta", "assistant", "late"), (2, 0, 0, "message", "user", None), (None, 3, None, "message", None, "x"),
        (3, 0, 0, "message", "user", "same"), (3, 0, 0, "message", "user", "same"),
    ]
    random.Random(1).shuffle(log)
    events = spark.createDataFrame([(*e, "extra") for e in log], "conv_id long, seq long, turn long, kind string, role string, text string, place string")
    got = sorted(map(tuple, chat.folded(events).collect()), key=repr)
    assert got == sorted([
        (1, 0, 0, "user", "hello!"), (1, 1, 0, "assistant", "good answer"), (2, 0, 0, "user", "late"),
        (None, None, 0, None, "x"), (3, 0, 0, "user", "same"), (3, 0, 1, "user", "same"),
    ], key=repr)
    assert chat.folded(events.limit(0)).count() == 0


def test_digest_of_whole_conversations(spark):
    rng, rows = random.Random(2), []
    for conv in range(40):
        for turn in range(rng.randint(1, 30)):
            text = "".join(rng.choice(["a", "</s>", "[INST]", "\\", "é", " "]) for _ in range(rng.randint(0, 20)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice([text, None])))
    rows.append((50, 0, "assistant", "y" * 300_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat.read_back(chat.rendered(chat.folded(chat.as_events(df)))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out = got[conv]
        assert (out.n_turns, out.loss_chars) == (len(own), len(loss))
        assert out.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert out.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
