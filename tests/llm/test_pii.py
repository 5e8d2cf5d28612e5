import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import boosting, pii
from pagemill.llm.queries import op6_pii, table

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs).select("text", pii.listed(F.col("base_spans")).alias("b"), pii.listed(F.col("pii_spans")).alias("a"), *[f"n_{k}" for k in pii.KINDS]).collect():
        want = base_spans(r.text)
        assert r.b == ",".join(want), r.text[:200]
        assert set(want) <= set(filter(None, r.a.split(",")))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]


def test_base_equals_python(spark):
    texts = [
        None, "", "a@b.c_d@e.f", "x a.b+c@mail-x.example.com, y", "@@a@b@c.d..e@f.g", "1.2.3.4.5.6.7.8 999.1.1.1 00000255.1.1.1 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1111", "+1 (017) 555-7713 4111111111111111",
        "+1 (974) 555-3436", "é\U0001f600 +1 (974) 555-3436 \U0001f600 10.0.0.1 é", "1" * 9000, "1 " * 9000, "a" * 60000, "a." * 30000 + "@b", "x@" + "a." * 20000, "+1" + "(" * 20000, "12.34.56.78 " * 500, "4111111111111111\n" * 300, "+12345678\n0",
    ]
    rng = np.random.default_rng(6)
    pool = list("0123456789") * 3 + list("+-(). @abZ_%\né") + [" "] * 5
    texts += ["".join(rng.choice(pool, 80)) for _ in range(400)]
    check(spark, texts)


def test_base_without_two_digits_in_a_row(spark):
    card, phone = "card 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "tel +4 9 1 2 3 4 5 6 7 8"
    texts = [card, card.replace("1 1", "1-1"), phone, "+4-9.1(2)3 4 5 6 7 8", "+1(2(3(4(5(6(7(8(9", "4 1 1", "a 1, 2 and 3", "+ 4 9"]
    assert [len(base_spans(t)) for t in texts] == [1, 1, 1, 1, 1, 0, 0, 0]
    check(spark, texts)
    docs = spark.createDataFrame([(0, card), (1, phone)], "doc_id long, text string")
    assert [r.text for r in pii.redact(pii.find(docs)).orderBy("doc_id").collect()] == ["card <card>", "tel <phone>"]


def test_documents(spark):
    check(spark, [r.text for r in table(spark, SF, "documents").collect()])


def spans_of(spark, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [[f"{s.kind}:{r.text[s.start:s.end]}" for s in r.pii_spans] for r in pii.find(docs).orderBy("doc_id").collect()]


def test_trees_add_and_leave_alone(spark):
    got = spans_of(spark, "call +1 (417) 555-7713 9807915762804490 now", "write to jo.doe [at] mail [dot] com soon", "version 2.10.3 of 2024-05-06, order 1234567, 3.14 and 99,50", "plain words only", "in 1999-2001 about 12 000 or 10:45:30")
    assert "phone:+1 (417) 555-7713" in got[0] and "card:9807915762804490" in got[0]
    assert got[1] == ["email:jo.doe [at] mail [dot] com"]
    assert got[2:] == [[], [], []]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é +1 (417) 555-7713 9807915762804490 a@b.cd", "x"), (2, None, "y"), (3, "clean", None), (3, "clean", None)], "doc_id long, text string, kind string")
    got = pii.redact(pii.find(docs)).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["é <phone> <card> <email>", None, "clean", "clean"] and got[0].kind == "x"
    assert pii.find(docs.limit(0)).collect() == []


def test_query_digest(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in op6_pii(spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(base_spans(texts[r.doc_id])).encode()).hexdigest()


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**31))
def test_boosting(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 5, (600, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 1)).astype(float)
    model = boosting.calibrate(boosting.fit(x[:300], y[:300]), x[300:], y[300:])
    p = model.probability(x[300:])
    assert ((p > 0.5) == y[300:]).mean() > 0.97
    t = boosting.threshold_for(p, y[300:], 0.98)
    assert y[300:][p >= t].mean() >= 0.98


def test_prefix_sums(spark):
    rows = [([],), ([5],), (list(range(1, 40)),)]
    df = spark.createDataFrame([(v[0],) for v in rows], "v array<long>")
    assert [r[0] for r in df.select(pii.prefix_sums(F.col("v"))).collect()] == [[], [5], np.cumsum(range(1, 40)).tolist()]
