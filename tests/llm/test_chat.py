import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.llm import chat
from presswork.llm.queries import TRICKY
from tests.llm.helpers import ODD, prose


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def model(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def corpus():
    rng = random.Random(8)
    rows = [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)]
    for c in range(12):
        rows += [(c, 0, "system", "be kind")] if c % 3 == 0 else []
        rows += [(c, k, ("user", "assistant")[k % 2], prose(rng, rng.randrange(0, 120))) for k in range(1, rng.randrange(2, 40))]
    rows += [(50, k, "assistant", t) for k, t in enumerate(ODD)] + [(51, None, None, None), (51, 1, "odd: role\\ ###", "x"), (51, 1, "assistant", "y"), (None, 0, "user", "z"), (52, 0, "system", "only")]
    return [*rows, rows[5]]


def test_read_back(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")
    for budget, history in ((2048, 512), (60, 20), (1, 0)):
        got = chat.read_back(chat.chat_windows(df, budget, history)).collect()
        assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == model(rows)
        assert len(got) == len(model(rows))


def test_windows_keep_to_the_budget(spark):
    df = spark.createDataFrame(corpus(), "conv_id bigint, turn bigint, role string, text string")
    tokens = chat.estimated_tokens
    for w in chat.chat_windows(df, 100, 30).collect():
        turns = chat.parse(w["formatted"])
        fresh = len(turns) - w["n_repeated"]
        assert fresh >= 1
        assert tokens(w["formatted"]) <= 100 + 3 * len(turns) or fresh - (turns[0][0] == "system") <= 1
        if w["conv_id"] in (0, 3, 6, 9):
            assert turns[0] == ("system", "be kind")
        spans = [chat.unescape(w["formatted"][s["start"] : s["end"]]) for s in w["loss"]]
        assert spans == [t for r, t in turns[w["n_repeated"] :] if r == "assistant" and t]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.chat_windows(df)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "a: b", "\\", "###"]), st.lists(st.sampled_from(["\\", "###", "### ", "</turn>", " </turn>\n", ": ", "x", "\n"]), max_size=8).map("".join)), min_size=1, max_size=5))
def test_escaping(turns):
    w = chat.Windows(10**6, 0, chat.estimated_tokens)
    made = [x for r, t in turns for x in w.add(r, t)] + list(w.close())
    assert chat.parse("".join(m["formatted"] for m in made)) == turns
