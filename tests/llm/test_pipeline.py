import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pagemill.llm import byte_level, decontaminate, runtime
from pagemill.llm.queries import WORD_VOCABULARY, table
from tests.llm.test_decontaminate import least_distance
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, runtime.written(stage(spark, docs, SF), "test-stage")
        out.append((before, docs))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_language(stages):
    before, after = stages[0]
    for b, a in stages[:-1]:
        assert a.columns == b.columns
    assert ids(after) == ids(before.where(F.col("text").rlike("\\p{L}")))  # all of these texts are clean prose


def test_near_duplicates(stages):
    before, after = stages[1]
    classes = brute({r.doc_id: r.text for r in before.collect()})
    assert ids(after) == sorted(set(classes.values()))


def test_decontamination(spark, stages):
    before, after = stages[2]
    items = [decontaminate.normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
    gone = set(ids(before)) - set(ids(after))
    texts = {r.doc_id: decontaminate.normalise(r.text) for r in before.collect()}
    exact = {i for i, t in texts.items() if any(x in t for x in items)}
    assert exact <= gone
    assert all(any(least_distance(x, texts[i]) <= int(len(x) * decontaminate.RATE) for x in items) for i in list(gone - exact)[:3])


def test_personal_data(stages):
    before, after = stages[3]
    assert ids(after) == ids(before)
    was = {r.doc_id: r for r in before.collect()}
    changed = [r for r in after.collect() if r.text != was[r.doc_id].text]
    assert changed and all("<" in r.text and r.n_chars == len(r.text) for r in changed)
    assert not [r for r in after.collect() if "@mail" in r.text]


def test_encoding(stages):
    import public_tokenizers

    before, after = stages[4]
    library = byte_level.tokenizer(runtime.read_small_file(public_tokenizers.path(WORD_VOCABULARY)))
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.token_ids == want and r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, "the rest of it was here and then", "en"), (1, "the rest of it was here and then", "en"), (None, "and of the other one that was", "en"), (2, None, "en"), (3, "", None), (4, "12 !", "en")]
    docs = spark.createDataFrame([(*r, "s", 3, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, class_id_ string")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    # a row without a key is kept as any other that is the one of its class
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_clashing_columns(spark):
    """Columns called like what the stages make come through all of them unchanged."""
    made = ["lang_pred", "score", "class_id", "n_email", "base_spans", "pii_spans", "__text"]
    docs = spark.createDataFrame([(1, "the rest of it was here, mail a.b@mail.example and then", "en", "s", 3, *"abcdefg")], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in made))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert [tuple(r[c] for c in made) for r in docs.collect()] == [tuple("abcdefg")]
    assert "<email>" in docs.first().text
    assert corpus_pipeline.encode(spark, docs, SF).count() == 1


def test_no_class_vanishes_under_repeated_keys(spark):
    rows = [(1, "the first of them"), (5, "the first of them"), (5, "the other was here"), (7, "the other was here"), (7, "and this is a third one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.keep_one_of_each_class(spark, docs, SF).collect()
    assert sorted(map(tuple, got)) == [(1, "the first of them"), (5, "the other was here"), (7, "and this is a third one")]
