import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import byte_level, chat, runtime
from pagemill.llm.queries import BYTE_VOCABULARY

VOCABULARY = runtime.read_small_file(public_tokenizers.path(BYTE_VOCABULARY))
ODD = r"\### Assistant: </turn> ok"
TEXT = st.text(st.sampled_from("\\#<>:/ turn\né\U0001f600한A"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a:\\#<b", ""]), TEXT), max_size=6))
def test_round_trip_and_loss(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    offsets = np.array(byte_level.tokenizer(VOCABULARY).encode(formatted, add_special_tokens=False).offsets, dtype=int).reshape(-1, 2)
    mask = chat.token_mask(offsets, spans)
    brute = [any(max(s, a) < min(e, b) for a, b in spans) for s, e in offsets]
    assert mask.tolist() == brute
    pieces = chat.masked_pieces(formatted, offsets, mask, spans)
    assert [chat.unescape(p) for p in pieces] == [t for r, t in turns if r == "assistant"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_frames(spark):
    rows = [
        (1, 1, "assistant", ODD, 0), (1, 0, "user", ODD, 0), (2, 0, "user", None, 0), (2, 1, "assistant", None, 0),
        (None, None, None, "x", 0), (3, 0, "assistant", "same", 0), (3, 0, "assistant", "same", 0), (4, 0, "assistant", "word " * 50000, 0),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns, VOCABULARY)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert got[1].turns_sha256 == sha(f"user\n{ODD}\nassistant\n{ODD}\n") and got[1].loss_sha256 == sha(ODD) and got[1].loss_chars == len(ODD)
    assert got[2].n_turns == 2 and got[2].loss_chars == 0
    assert got[3].loss_sha256 == sha("samesame") and got[4].loss_chars == 250000
    assert chat.read_back(chat.format_chats(turns.limit(0), VOCABULARY)).collect() == []
