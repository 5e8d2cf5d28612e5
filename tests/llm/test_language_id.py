import numpy as np

from pagemill.llm import language_id
from pagemill.llm.queries import table

SF = "/root/testdata/sf0.001"


def by_hand(text, model):
    """Posterior of one text, n-gram by n-gram."""
    codes, _ = language_id._prepare(text)
    total = model.log_prior.astype(float).copy()
    for order in model.orders:
        for i in range(len(codes) - order + 1):
            total += model.log_prob[language_id._buckets(codes[i : i + order], order, len(model.log_prob))[0]]
    return total


def test_batches_equal_one_by_one_and_slices(monkeypatch):
    rng = np.random.default_rng(1)
    model = language_id.Model(("a", "b"), np.log(rng.random((1 << 8, 2))).astype(np.float32), np.log([0.5, 0.5]), (1, 2, 3))
    texts = ["x", "abc def", "", None, "...", "longer text with words " * 9, "zz"]
    want = {t: by_hand(t, model) for t in texts if t and t != "..."}
    for size in (1 << 20, 16):
        monkeypatch.setattr(language_id, "SLICE", size)
        pred, score = language_id.score_texts(texts, model)
        for t, p, s in zip(texts, pred, score, strict=True):
            if t in want:
                assert p == model.languages[want[t].argmax()]
                assert abs(s - 1 / np.exp(want[t] - want[t].max()).sum()) < 1e-4
            else:
                assert (p, s) == ("und", 0)


def test_slices_hold_each_gram_once(monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", 7)
    codes = np.arange(100, 161, dtype=np.uint64)
    for n in range(3, 62):
        for order in (1, 2, 3):
            seen = [tuple(p[i : i + order]) for p, body in language_id._parts(codes[:n], (1, 2, 3)) for i in range(min(body, len(p) - order + 1))]
            assert seen == [tuple(codes[i : i + order]) for i in range(n - order + 1)]


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    rows = language_id.predict(docs, model, keep=["lang", language_id.held_out().alias("h")]).where("h and lang is not null").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_odd_rows(spark):
    rows = [(1, "hello there", "en", "p"), (2, None, "en", None), (None, "12 34 !", None, None), (4, "", "de", None), (5, "das ist gut", "de", None), (5, "das ist gut", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score_ string")
    model = language_id.fit(docs)
    assert model.languages == ("de", "en")
    got = language_id.predict(docs, model).collect()
    assert [r.lang_pred for r in got] == ["en", "und", "und", "und", "de", "de"] and all(0 <= r.score <= 1 for r in got)
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
