import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import decontaminate as d
from pagemill.llm.queries import table

SF = "/root/testdata/sf0.001"


def least_distance(item, text):
    """Least edit distance of the item to any stretch of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        before, row[0] = row[0], i + 1
        for j, b in enumerate(text):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (a != b))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", min_size=1, max_size=30))
def test_myers(item, text):
    best, end = d.Pattern(item).distance(text, len(item))
    assert best == least_distance(item, text)


def test_pigeonhole_equals_brute_force():
    rng = random.Random(8)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 90)))) for i in range(12)]
    items.append((12, items[0][1]))
    matcher = d.Matcher(items, 0.1)
    for _ in range(60):
        text = "".join(rng.choice("abcdefgh ") for _ in range(150))
        for _ in range(rng.randint(0, 2)):
            item = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(item))
                item[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yy"])
            at = rng.randrange(len(text))
            text = text[:at] + "".join(item) + text[at:]
        want = {i: n for i, (_, item) in enumerate(items) if (n := least_distance(item, text)) <= int(len(item) * 0.1)}
        assert matcher.find(text) == want


def test_frames(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away into the woods."
    rows = [(1, "xx " + item.upper() + " yy", 0), (2, "no", 0), (3, None, 0), (4, "", 0), (5, item.replace("lazy", "lasy").replace(" ", "  "), 0), (5, item, 0), (None, item, 0), (6, "word " * 40000 + item, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, distance int")
    bench = spark.createDataFrame([(7, item), (8, item + "!"), (9, None), (None, item), (10, "short")], "item_id long, text string")
    for block in (d.BLOCK_CHARS, 1):
        got = sorted(((r.doc_id or -1), r.item_id, r.distance) for r in d.matches(docs, bench, block_chars=block).collect())
        assert got == sorted((i, j, n) for i, n in ((1, 0), (5, 1), (5, 0), (-1, 0), (6, 0)) for j in (7, 8))
    assert d.matches(docs.limit(0), bench).collect() == [] == d.matches(docs, bench.limit(0)).collect()


def test_short_items_and_items_without_a_key(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away into the woods."
    texts = ["Q: What is 2+2? A: four", "what is 2 2", "somewhat is 2 22", "what is 3 2", "彼は東京の首都は何ですかと聞いた", item, "!!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is 2+2?"), (2, "東京の首都は何ですか"), (None, item), (3, "?!"), (4, None)], "item_id long, text string")
    want = [(0, 1, 0), (1, 1, 0), (4, 2, 0)]
    for block in (d.BLOCK_CHARS, 1):
        assert sorted(map(tuple, d.matches(docs, bench, block_chars=block).collect())) == want
        assert set(map(tuple, d.matches(docs, bench, block_chars=block, unnamed=True).collect())) == {*want, (5, None, 0)}
        assert sorted(r.doc_id for r in d.clean(docs, bench, block_chars=block).collect()) == [2, 3, 6, 7]


def test_documents(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id) for r in d.matches(docs, bench).collect()}
    texts = [(r.doc_id, d.normalise(r.text)) for r in docs.collect()]
    exact = {(i, b.item_id) for b in bench.collect() for i, t in texts if d.normalise(b.text) in t}
    assert exact and exact <= got
