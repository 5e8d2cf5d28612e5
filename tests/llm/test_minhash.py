import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import minhash, runtime
from pagemill.llm.queries import table

SF = "/root/testdata/sf0.001"


def sets(text):
    words = re.findall("[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def counted(text):
    """A set whose similarity is that of the shingles with their counts."""
    words = re.findall("[0-9a-z\u0080-\U0010ffff]+", text.lower())
    found = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return {(x, k) for x, n in found.items() for k in range(n)} if words else set()


def brute(rows, sets=sets):
    """Class of each (id, text): components of set similarity at least 0.8."""
    ids = sorted(rows)
    s = {i: sets(rows[i]) for i in ids}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            same = rows[i] == rows[j] if not s[i] or not s[j] else len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])
            if same:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("by_count", [False, True])
def test_agreement_is_similarity(by_count):
    rng = np.random.default_rng(2)
    for shared, own in ((40, 10), (300, 300), (3, 1)):
        base = rng.integers(0, 2**63, shared, dtype=np.uint64)
        values, counts = [], []
        for _ in range(2):
            v = np.concatenate([base, rng.integers(0, 2**63, own, dtype=np.uint64)])
            if by_count:
                v = np.repeat(v, rng.integers(1, 6, len(v)))
            values.append(v)
            counts.append(len(v))
        e, w, c = minhash.weighted(np.concatenate(values), np.array(counts), by_count)
        sig = minhash.signatures(e, w, c, 4096)
        a, b = (dict(zip(e[part].tolist(), w[part].tolist(), strict=True)) for part in (slice(c[0]), slice(c[0], None)))
        want = sum(min(a.get(x, 0), b.get(x, 0)) for x in {**a, **b}) / sum(max(a.get(x, 0), b.get(x, 0)) for x in {**a, **b})
        assert abs((sig[0] == sig[1]).mean() - want) < 0.04
        alone = minhash.signatures(e[: c[0]], w[: c[0]], c[:1], 4096)
        assert (alone[0] == sig[0]).all()


def test_shingles_match_words():
    texts = ["One two three four five six", "one TWO, three four\nfive", "a b", "", "...", "é è ê ë ē ĕ", "one two three four five"]
    values, counts, digest, check = minhash.shingles(texts)
    assert counts.tolist() == [2, 1, 1, 0, 0, 2, 1]
    assert digest[1] == digest[6] != digest[0] and digest[3] == digest[4] == 0
    assert check[1] == check[6] != check[0] and (digest != check)[[0, 1, 2, 5]].all()
    assert values[0] == values[2]


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, n = {}, 0
    for _ in range(25):
        base = list(rng.choice(vocabulary, 120))
        for _ in range(int(rng.integers(1, 9))):
            for at in rng.integers(0, len(base), rng.integers(0, 3)):
                base[at] = str(rng.choice(vocabulary))  # a chain: each differs from the one before
            rows[n] = " ".join(base)
            n += 1
    for text in ("", "", "...", "one two", "one two", "One, two", "x " * 3000, "x " * 3000):
        rows[n] = text
        n += 1
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want and len(set(want.values())) < len(want) - 20


@pytest.mark.parametrize("weights", ["set", "count"])
def test_group_just_below_the_threshold(spark, weights):
    """Copies of one text, each with its own edits, so that many pairs lie near 0.8 on both sides, and texts with one passage in common."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(300)]
    base = list(rng.choice(vocabulary, 150))
    if weights == "count":
        base = base[:75] * 2
    passage = list(rng.choice(vocabulary, 60))
    rows, n = {}, 0
    for k in range(120):
        edited = list(base)
        for at in rng.integers(0, len(base), 2 + k % 5):
            edited[at] = str(rng.choice(vocabulary))
        rows[n], n = " ".join(edited), n + 1
    for _ in range(40):
        rows[n], n = " ".join([*passage, *rng.choice(vocabulary, int(rng.integers(5, 60)))]), n + 1
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, weights=weights).collect()}
    want = brute(rows, sets if weights == "set" else counted)
    assert got == want and 10 < len(set(want.values())) < 150


def test_candidates_lose_no_pair(spark):
    """Every pair of members of one hub at or above the threshold is a candidate, linked by the base, or in one component."""
    rng = np.random.default_rng(11)
    texts, members, n = {}, [], 0
    for hub in range(6):
        base = [f"h{hub}x{i}" for i in rng.integers(0, 400, 90)]
        first = n
        for _ in range(25):
            edited = list(base)
            for at in rng.integers(0, 90, rng.integers(1, 6)):
                edited[at] = f"y{rng.integers(0, 40)}"
            texts[n], n = " ".join(edited), n + 1
        members += [(i, first, i, True) for i in range(first + 1, n)]
    s = {i: sets(t) for i, t in texts.items()}
    t = spark.createDataFrame(list(texts.items()), "words long, t string")
    with runtime.scope(spark):
        met = spark.createDataFrame([m[:2] for m in members], "words long, hub long")
        rows = minhash._differences(met, t, 5, False).selectExpr("*", "size(d) - n / 9 AS g", "words AS c", "true AS stray")
        near = {frozenset(p) for p in minhash._near_base(rows).collect()}
        found = {frozenset(p) for p in minhash._candidates(rows, 0.8).collect()}
    linked = {i: i for i in texts}

    def root(i):
        return i if linked[i] == i else root(linked[i])

    for a, b in map(tuple, near):
        assert len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])
        linked[root(a)] = root(b)
    hub_of = {i: h for i, h, *_ in members}
    similar = {frozenset((a, b)) for a in hub_of for b in hub_of if a < b and hub_of[a] == hub_of[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])}
    missed = [p for p in similar - found if len({root(i) for i in p}) > 1]
    assert similar and not missed
    assert len(found - similar) < 0.2 * 6 * 24 * 23 / 2


def test_names_of_different_texts(spark):
    """Two texts of one digest are told apart by the second one, before anything else is made of them."""
    signed = spark.createDataFrame([(1, 10, 7, 1, [5]), (2, 11, 7, 2, [6]), (3, 11, 7, 2, [6]), (4, 12, 8, 3, [6])], minhash.SIGNED)
    with runtime.scope(spark):
        got = {r.id: r.words for r in minhash._told_apart(signed).collect()}
    assert got[1] != got[2] == got[3] and got[4] == 8


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", 7, 8, "p"), (2, "A b c d e f!", 9, 10, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id long, __id long, Class_ID_input string")
    got = minhash.near_duplicates(df)
    assert got.columns == ["doc_id", "text", "class_id_input_input", "__id", "Class_ID_input", "class_id"]
    assert sorted(map(tuple, got.collect())) == sorted((*r, 1) for r in rows)
    assert list(map(tuple, minhash.one_of_each_class(df).collect())) == rows[:1]


def test_scopes_drop_what_they_wrote(spark):
    from pathlib import Path

    df = spark.createDataFrame([(i, f"a b c d e {i % 3}") for i in range(9)], "doc_id long, text string")
    root = Path(runtime.fresh_path(spark, "x").removeprefix("file:")).parent
    before = set(root.iterdir())
    out = minhash.near_duplicates(df)
    left = set(root.iterdir()) - before
    assert len(left) == 1 and next(iter(left)).name.startswith("dedup-named")
    assert out.count() == 9


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, None, 2), (None, "a b c d e f", 3), (3, "a b c d e f", 4), (3, "a b c d e f", 4), (4, "A b c d e f!", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words int")
    got = sorted(map(tuple, minhash.near_duplicates(df).select("doc_id", "words", "class_id").collect()))
    assert got == [(1, 1, 1), (2, 2, 2), (3, 4, 3), (3, 4, 3), (4, 5, 3)]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_repeated_and_null_keys(spark):
    a, b, c, d = ("a b c d e f", "g h i j k l m", "n o p q r s", "t u v w x y z 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c), (1, c), (None, a), (None, d), (None, d + " 25"), (None, None), (8, None), (8, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {a: 1, b: 5, c: 1, d: None, d + " 25": None}
    got = sorted(map(str, map(tuple, minhash.near_duplicates(df, unnamed=True).select("doc_id", "text", "class_id").collect())))
    assert got == sorted(str((i, t, classes.get(t, i))) for i, t in rows)
    got = sorted(map(str, map(tuple, minhash.near_duplicates(df).select("doc_id", "text", "class_id").collect())))
    assert got == sorted(str((i, t, classes.get(t, i))) for i, t in rows if i is not None)
    kept = [(1, a), (5, b), (1, c), (None, d), (None, None), (8, None)]  # d and its copy have no key: one of them stays
    got = sorted(map(str, map(tuple, minhash.one_of_each_class(df).collect())))
    assert got in (sorted(map(str, kept)), sorted(map(str, [*kept[:3], (None, d + " 25"), *kept[4:]])))


def test_documents(spark):
    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, SF, "documents")).collect()}
    assert got == brute(rows)


def test_short_texts_are_signed_in_little_memory():
    """Each set costs a thousand darts and more, so characters alone bound no memory."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 130))) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(range(1200)), pa.array(texts)], ["id", "h", "t"])
    tracemalloc.start()
    out = [len(x) for x in minhash._signer(minhash.WORDS, minhash.BANDS, minhash.ROWS, False)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(out) == 1200 and peak < 60 << 20  # at once: over 100 MB


def _resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


@pytest.mark.skipif(not Path("/proc/self/statm").exists(), reason="reads /proc")
def test_workers_hold_no_free_memory_after_a_task():
    held = []

    def run(batches):
        for x in batches:
            parts = [np.ones(12_000) for _ in range(2000)]  # 96 KB each: too small to be mapped on their own
            held.append(parts.pop())  # and the last one keeps the rest from being cut off
            yield x

    before = _resident()
    assert [*runtime.lean(run)(iter([1, 2]))] == [1, 2]
    assert _resident() - before < 60 << 20
