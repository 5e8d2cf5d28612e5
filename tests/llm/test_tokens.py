import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import bpe, byte_level, runtime, token_counts
from pagemill.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY

TRICKY = [
    "", " ", "a", "it''s 're don't !!'s it's'tis", "x<|endoftext|>y <|endoftext|>", "<|startoftext|>hello<|endoftext|>", "Å ΣΑΣ İstanbul",
    "é́ café ²³ ½ 12 34567", "日本語のテキスト", "\U0001f600\U0001f468‍\U0001f469 ok", "a b\u0085c\x1c\x1d d\x0b\x0c", "  lots   of \t\n\r\n space  ",
    "한글", "-" * 3000, "ab" * 5000, "1" * 4000, "!'" * 2000 + "s", "lorem ipsum dolor " * 900, "x" * 9000 + " y " + "z'll" * 3000, "é" * 5000, "á" * 4000, "日本" * 4000,
]


@pytest.fixture(scope="module")
def byte_json():
    return runtime.read_small_file(public_tokenizers.path(BYTE_VOCABULARY))


@pytest.fixture(scope="module")
def word_json():
    return runtime.read_small_file(public_tokenizers.path(WORD_VOCABULARY))


def test_counts_equal_the_library(byte_json):
    counter = token_counts.Counter(byte_json, token_counts.prove_whole_tokens(byte_json))
    library = byte_level.tokenizer(byte_json)
    for text in TRICKY:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:40]
    assert counter.count(None) == 0


@pytest.mark.parametrize("leaf,word_leaf,window", [(bpe.LEAF, bpe.WORD_LEAF, bpe.WINDOW), (64, 16, 4)])
def test_tree_equals_the_library(word_json, leaf, word_leaf, window):
    encoder = bpe.Encoder(word_json, leaf, word_leaf, window)
    library = byte_level.tokenizer(word_json)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeorst'1!-é ") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for text in [*TRICKY, " ".join(words), "".join(words), "".join(rng.choice("thering") for _ in range(20000))]:
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == want, text[:40]
        assert encoder.decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.fixture(scope="module")
def small(word_json, byte_json):
    return bpe.Encoder(word_json, 48, 8, 2), token_counts.Counter(byte_json, token_counts.prove_whole_tokens(byte_json))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400))
def test_any_text(small, word_json, byte_json, text):
    text = text.encode("utf-8", "ignore").decode()
    assert small[0].encode(text) == byte_level.tokenizer(word_json).encode(text, add_special_tokens=False).ids
    assert small[1].count(text) == len(byte_level.tokenizer(byte_json).encode(text, add_special_tokens=False).ids)


def test_frames_with_odd_rows(spark, word_json, byte_json):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (3, "", "n_tokens"), (4, "word " * 30000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = bpe.encode(docs, word_json).collect()
    assert [r.n_tokens for r in got] == [2, 2, 0, 0, 30000] and got[2].decoded == ""
    assert got[0].ids_sha256 == hashlib.sha256(" ".join(map(str, got[0].token_ids)).encode()).hexdigest()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, byte_json).collect()][2:] == [(0, 0, False), (0, 0, False), (150000, 30001, True)]
    assert bpe.encode(docs.limit(0), word_json).collect() == []


def test_new_words_reach_the_library_together(word_json, monkeypatch):
    """Most words of these texts are met once: neither a call nor a result of the library for each."""
    calls = []
    between = byte_level.between_spaces(word_json)

    class Counted:
        def encode_batch_fast(self, texts, **more):
            calls.append(len(texts))
            return between.encode_batch_fast(texts, **more)

    monkeypatch.setattr(byte_level, "between_spaces", lambda _: Counted())
    encoder = bpe.Encoder(word_json)
    monkeypatch.setattr(encoder, "word", lambda word: pytest.fail(f"{word} alone"))
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abdeinorstéñ") for _ in range(rng.randint(1, 14))) + rng.choice(["", ".", "'s 7", " </w>"]) for _ in range(300)) for _ in range(40)]
    library = byte_level.tokenizer(word_json)
    assert encoder.encode_all([None, "", *texts]) == [[], [], *[e.ids for e in library.encode_batch(texts, add_special_tokens=False)]]
    assert len(calls) == 1 and calls[0] <= 5
