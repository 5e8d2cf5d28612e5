"""The registered queries against brute force over their whole tables, and input columns called like results."""

import hashlib

import public_tokenizers
import pytest

from pagemill.llm import bpe, byte_level, decontaminate, language_id, licenses, pii, queries, runtime, token_counts

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library(name):
    return byte_level.tokenizer(runtime.read_small_file(public_tokenizers.path(name)))


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in queries.table(spark, SF, "documents").collect()}


def test_op1(spark, documents):
    import zlib

    got = queries.op1_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    right = known = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in documents[r.doc_id].text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and documents[r.doc_id].lang is not None:
            known, right = known + 1, right + (r.lang_pred == documents[r.doc_id].lang)
    assert known > 20 and right >= 0.95 * known


def test_op3(spark, documents):
    tok = library(queries.BYTE_VOCABULARY)
    for r in queries.op3_token_counts(spark, SF).collect():
        text = documents[r.doc_id].text or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_op5(spark, documents):
    tok = library(queries.WORD_VOCABULARY)
    for r in queries.op5_bpe(spark, SF).collect():
        ids = tok.encode(documents[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_op7(spark, documents):
    """All items against all documents by the whole text's least distance, without pieces or windows."""
    items = {r.item_id: decontaminate.normalise(r.text) for r in queries.table(spark, SF, "benchmark").collect()}
    patterns = {i: (decontaminate.Pattern(t), int(len(t) * decontaminate.RATE)) for i, t in items.items() if t}
    want = {}
    for k, r in documents.items():
        text = decontaminate.normalise(r.text)
        # an edit touches two words at most, and the ends of an item may lie inside words
        words = set(text.split())
        for i, (pattern, most) in patterns.items():
            own = items[i].split()
            if sum(w in words for w in own) >= len(own) - 2 * most - 2 and (d := pattern.distance(text, most)[0]) <= most:
                want[k, i] = d
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op7_decontaminate(spark, SF).collect()}
    assert got == want and want


def test_op10(spark):
    turns = {}
    for r in queries.table(spark, SF, "conversations").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    turns[-7] = [(0, "user", queries.ODD_TEXT), (1, "assistant", queries.ODD_TEXT)]
    got = {r.conv_id: r for r in queries.op10_chat(spark, SF).collect()}
    assert set(got) == set(turns)
    for k, said in turns.items():
        said.sort()
        loss = "".join(t for _, r, t in said if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(said), sha("".join(f"{r}\n{t}\n" for _, r, t in said)))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss))


def test_bpe_of_texts_without_spaces():
    import random

    text = runtime.read_small_file(public_tokenizers.path(queries.WORD_VOCABULARY))
    tok, encoder, choice = byte_level.tokenizer(text), bpe.Encoder(text), random.Random(3)
    small = bpe.Encoder(text, leaf=50, word_leaf=20, window=4)
    for alphabet, n in (("ab", 50_000), ("abcdefgh", 50_000), ("é中a", 9_000), ("a1-", 20_000), ("ab ", 20_000)):
        said = "".join(choice.choice(alphabet) for _ in range(n))
        assert encoder.encode(said) == tok.encode(said, add_special_tokens=False).ids
        assert small.encode(said[:3000]) == tok.encode(said[:3000], add_special_tokens=False).ids


def clashing(spark, made):
    """A table of two documents whose other columns have the names of results."""
    rows = [(1, "the one mail a.b@mail.example of it", *made), (2, None, *[None] * len(made))]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in made))


def kept(out, made):
    """What the input columns hold after an operator."""
    return sorted([tuple(r[f"{c}_input"] for c in made) for r in out.collect()], key=str)


def test_clashing_columns(spark):
    vocabulary = runtime.read_small_file(public_tokenizers.path(queries.WORD_VOCABULARY))
    labelled = spark.createDataFrame([(1, "the one and the other", "en"), (2, "der eine und die andere", "de")], "doc_id long, text string, lang string")
    model = language_id.fit(labelled)
    byte_vocabulary = runtime.read_small_file(public_tokenizers.path(queries.BYTE_VOCABULARY))
    for made, operator in (
        (language_id.MADE, lambda d: language_id.predict(d, model)),
        (token_counts.MADE, lambda d: token_counts.count_tokens(d, byte_vocabulary)),
        ((*bpe.MADE, "token_ids", "decoded"), lambda d: bpe.encode(d, vocabulary)),
        (("license_digest", "license_id"), lambda d: licenses.scan(d, licenses.known(spark))),
        (pii.MADE, pii.find),
    ):
        docs = clashing(spark, [*made, "__text", "__row"])
        out = operator(docs)
        assert out.columns[:2] == ["doc_id", "text"] and set(made) < set(out.columns) and {"__text", "__row"} < set(out.columns)
        assert kept(out, made) == sorted([tuple(made), (None,) * len(made)], key=str)


def test_redaction_of_clashing_columns(spark):
    docs = clashing(spark, ["__o", "__e", "__first", "__text", "n_email"])
    out = {r.doc_id: r for r in pii.redact(pii.find(docs)).collect()}
    assert out[1].text == "the one mail <email> of it" and out[1].n_email == 1 and out[1].n_email_input == "n_email" and out[1]["__o"] == "__o"
    assert out[2].text is None


def test_many_known_licenses(spark):
    """Beyond the bound of the broadcast the sides are joined by shuffle, with the same rows."""
    rows = [(1, "Released under the MIT License."), (2, "x y"), (3, None), (4, "..."), (5, "released under the mit license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (sorted(map(tuple, licenses.scan(docs, licenses.known(spark), broadcast_rows=n).collect())) for n in (10**5, 3))
    assert few == many and [r[-1] for r in few] == ["MIT-notice", None, None, None, "MIT-notice"]
