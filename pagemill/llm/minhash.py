"""Near-duplicate classes by DartMinHash signatures, banded joins and an exact check.

Signatures. Each element of a weighted set owns the region [0, weight) x ranks.
Darts fall on that plane as a Poisson process seeded by the element's hash
alone, each with a random coordinate; a set keeps, per coordinate, the earliest
dart inside its regions. Ranks are explored up to a bound that fills all
coordinates with high probability for the set's total weight, and doubled for
the sets where one is still empty, so signatures never depend on the bound. For
large sets most elements have no dart below the bound and cost one comparison.
Two sets agree in a coordinate with the probability of their weighted Jaccard
similarity.

Classes. Documents are sets of five-word shingles (weight 1, or the count of a
shingle with ``weights="count"``); two are near duplicates if the (weighted)
Jaccard similarity of their sets is at least ``threshold``; classes are the
connected components of that relation.

1. Every text gets a digest of its words and one key for each band of
   coordinates. Texts with the same words are one node, named by the digest, so
   copies add nothing to what follows but a row here. Names have 64 bits; a second
   digest of 64 bits finds different texts of one name, which are then renamed.
2. Of each key that several nodes have, one node is the hub: the one that meets
   the most others over all its keys, so the hub of a group of copies is near the
   text that they were made from. Members meet their hubs, not each other.
3. Each distinct (member, hub) pair is compared exactly. Pairs at or above the
   threshold are links.
4. Links are contracted to components by large-star and small-star rounds, with
   the edges written to the shared folder in each round.
5. Members of one hub in different components may still be linked. Their sets are
   written as differences from what more than half of the hub's members have. Two
   sets that are similar differ from that base in much the same elements, so a
   prefix filter on the differences, rare ones first, finds the pairs that can
   reach the threshold, exactly, and hardly any other, even in a group whose texts
   are all just below it. Sets near enough to the base are linked without a join.

So every pair that shares a key is compared, proven to be below the threshold,
or already in one class; there is no cap on partners.

Defined results: a null text is a class of its own. Texts of fewer than five
words have one shingle, of all their words. Texts without a word are in a class
with identical texts only. The class id is the smallest key in the class; a
repeated key gives a row each, with the class of the row's own text. So classes
whose smallest key is the same have one id; ``one_of_each_class`` tells them
apart by their texts. Rows with a null key are left out, or, with ``unnamed``,
take part: they have the id of their class, null if no row of it has a key.
Rows are told apart by key and a 64-bit hash of the text. Words are runs of ASCII
letters, digits and non-ASCII characters, lower-cased. Texts are read whole. Extra
columns pass through ``near_duplicates``; one that is called class_id becomes
class_id_input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import runtime

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
EPSILON = 1e-9
#: Most characters of text hashed at once, and most sets signed at once, as each costs a thousand darts and more however short it is.
CHUNK, SIGNED_AT_ONCE = 1 << 19, 256
#: Most characters of texts whose sets are kept.
KEPT = 8 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output looks random."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] from 64-bit words."""
    return ((h >> _U(11)).astype(np.float64) + 1) * 2.0**-53


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IS_WORD[data]
    edge = np.diff(inside)
    (starts,), (ends,) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    powers = np.full(len(data) + 1, _BASE)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers[:-1], out=sums[1:])
    inverse = np.full(len(data) + 1, _BASE_INVERSE)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingle hashes of the texts one after another, the number in each text, and two digests of each text's words (the first 0 if none)."""
    data = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    starts, hashes = word_hashes(np.frombuffer(b"".join(data), dtype=np.uint8))
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    first = np.searchsorted(starts, bounds)
    n_words = np.diff(first)
    position = np.arange(len(hashes)) - np.repeat(first[:-1], n_words)
    # a digest: each word's hash times a factor of its position, summed
    places = mix(position.astype(np.uint64) + _U(77))
    digest, check = (_summed(mix(hashes * factor ^ places), first, n_words) for factor in (_U(1), _U(0x9FB21C651E98DF25)))
    digest[n_words == 0] = 0
    padded = np.concatenate([hashes, np.zeros(words, dtype=np.uint64)])
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(words):
        rolled = mix(rolled * _U(31) + padded[k : k + len(hashes)])
    left = np.repeat(n_words, n_words) - position
    keep = left >= words
    short = (n_words > 0) & (n_words < words)
    at = first[:-1][short]
    rolled[at] = digest[short]
    keep[at] = True
    count = np.bincount(np.repeat(np.arange(len(texts)), n_words)[keep], minlength=len(texts))
    return rolled[keep], count, digest, check


def _summed(terms: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A digest of the terms of each run."""
    total = np.zeros(len(terms) + 1, dtype=np.uint64)
    np.cumsum(terms, out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))


def weighted(values: np.ndarray, counts: np.ndarray, by_count: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each set, their weights, and the number in each set."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.nonzero(new)[0]
    weight = np.diff(np.append(at, len(v))).astype(np.float64) if by_count else np.ones(len(at))
    return v[at], weight, np.bincount(o[at], minlength=len(counts))


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """The signature of each set, as a matrix of dart hashes. Every set has an element."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    out = np.zeros((n, coordinates), dtype=np.uint64)
    bound = (np.log(coordinates) + 3) / np.bincount(owner, weights, minlength=n)
    # weight bands [0, 1), [1, 2), [2, 4), ...: a band's darts are the same for every set that reaches it
    n_bands = int(np.ceil(np.log2(max(1.0, weights.max(initial=1.0))))) + 1
    todo = np.ones(n, dtype=bool)
    while todo.any():
        slots, ranks, darts = [], [], []
        for band in range(n_bands):
            low, width = (0.0, 1.0) if band == 0 else (2.0 ** (band - 1), 2.0 ** (band - 1))
            at = np.nonzero((weights > low) & todo[owner])[0]
            seed = mix(elements[at] ^ _U((band * 0x632BE59BD9B4E019 + 0x1F83D9ABFB41BD6B) & (2**64 - 1)))
            rank, step = np.zeros(len(at)), 0
            while len(at):
                step += 1
                h = mix(seed + _U((step * 0xD1342543DE82EF95) & (2**64 - 1)))
                rank = rank - np.log(_unit(h)) / (coordinates * width)
                on = rank <= bound[owner[at]]
                at, seed, rank = at[on], seed[on], rank[on]
                g = mix(h[on] + _U(0xA0761D6478BD642F))
                hit = low + width * (1 - _unit(g)) < weights[at]
                dart = mix(g[hit])
                slots.append(owner[at[hit]] * coordinates + (dart % _U(coordinates)).astype(np.int64))
                ranks.append(rank[hit])
                darts.append(dart)
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        late_first = np.argsort(-rank, kind="stable")
        filled = np.zeros(n * coordinates, dtype=bool)
        filled[slot] = True
        found = np.zeros(n * coordinates, dtype=np.uint64)
        found[slot[late_first]] = dart[late_first]  # of several darts at a coordinate the last one written, the earliest, stays
        done = todo & filled.reshape(n, coordinates).all(axis=1)
        out[done] = found.reshape(n, coordinates)[done]
        todo &= ~done
        bound = bound * 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band, different between bands."""
    keys = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(signature), axis=0)
    for r in range(rows):
        keys = mix(keys * _U(31) + signature[:, r : bands * rows : rows])
    return keys.view(np.int64)


def _elements(texts: list[str], words: int, by_count: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of each set, sorted; with counts, each repeat of a shingle is an element of its own, so that sets of these have the weighted similarity."""
    values, counts, _, _ = shingles(texts, words)
    elements, weights, n = weighted(values, counts, by_count)
    if not by_count:
        return elements, n
    repeats = weights.astype(np.int64)
    nth = np.arange(repeats.sum()) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    made = mix(np.repeat(elements, repeats) + mix(nth.astype(np.uint64)))
    owner = np.repeat(np.repeat(np.arange(len(n)), n), repeats)
    return made[np.lexsort((made, owner))], np.bincount(owner, minlength=len(n))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, given as sorted arrays."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - common
    return common / total if total else 0.0


class Sets:
    """The element sets of texts by node; keeps the last ones, as pairs of one hub come together."""

    def __init__(self, words: int, by_count: bool):
        self.words, self.by_count = words, by_count
        self.kept: dict[int, np.ndarray] = {}
        self.size = 0

    def pairs(self, batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
        """Row numbers of a batch of a, b, ta and tb, in runs, and both sets of each."""
        a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
        for part in runtime.slices([x if len(x) > len(y) else y for x, y in zip(ta, tb, strict=True)], CHUNK):
            named = {i: t for ids, texts in ((a, ta), (b, tb)) for i, t in ((ids[k], texts[k]) for k in part)}
            new = {i: t for i, t in named.items() if i not in self.kept}
            if self.size + sum(map(len, new.values())) > KEPT:
                self.kept.clear()
                new, self.size = named, 0
            self.size += sum(map(len, new.values()))
            if new:
                elements, counts = _elements(list(new.values()), self.words, self.by_count)
                for i, end, n in zip(new, np.cumsum(counts), counts, strict=True):
                    self.kept[i] = elements[end - n : end].copy()
            yield part, [(self.kept[a[k]], self.kept[b[k]]) for k in part]


SIGNED = "id long, h long, words long, check long, bands array<long>"


def _texts(docs: DataFrame, key: str, text: str, unnamed: bool) -> DataFrame:
    own, said = F.col(f"`{key}`"), F.col(f"`{text}`")
    return docs.where((F.lit(unnamed) | own.isNotNull()) & said.isNotNull()).select(own.cast("long").alias("id"), F.xxhash64(said).alias("h"), said.alias("t"))


def _digests(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What shingles() gives, but texts without a word are told by their bytes."""
    values, counts, digest, check = shingles(texts, words)
    for i in np.nonzero(digest == 0)[0]:
        raw = hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=16).digest()
        digest[i], check[i] = np.frombuffer(raw, dtype=np.uint64)
    return values, counts, digest, check


def _signer(words: int, bands: int, rows: int, by_count: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes batches of SIGNED from batches of id, h and t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for part in runtime.slices(texts, CHUNK, SIGNED_AT_ONCE):
                values, counts, digest, check = _digests([texts[i] for i in part], words)
                elements, weights, counts = weighted(values, counts, by_count)
                full = counts > 0
                keys = np.zeros((0, bands), dtype=np.int64)
                if full.any():
                    keys = band_keys(signatures(elements, weights, counts[full], bands * rows), bands, rows)
                ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                own = [batch.column(c).slice(part[0], len(part)) for c in ("id", "h")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digest.view(np.int64)), pa.array(check.view(np.int64)), lists], ["id", "h", "words", "check", "bands"])

    return run


def _sign(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int, by_count: bool, unnamed: bool) -> DataFrame:
    """id, hash of the text, both word digests and band keys of every row that takes part."""
    return _texts(docs, key, text, unnamed).mapInArrow(runtime.lean(_signer(words, bands, rows, by_count)), SIGNED)


def _told_apart(signed: DataFrame) -> DataFrame:
    """Nodes whose second digests differ get names of their own, made from both digests."""
    doubled = signed.groupBy("words").agg(F.min("check").alias("__low"), F.max("check").alias("__high")).where("__low < __high").select("words")
    if not doubled.limit(1).count():
        return signed
    marked = signed.join(doubled.withColumn("__two", F.lit(True)), "words", "left")
    return marked.select("id", "h", F.when(F.col("__two"), F.xxhash64("words", "check")).otherwise(F.col("words")).alias("words"), "check", "bands")


def _texts_of(docs: DataFrame, key: str, text: str, needed: DataFrame, unnamed: bool) -> DataFrame:
    """(words, t): one text of each needed node, found by the key and hash of a row that has it."""
    all_rows = _texts(docs, key, text, unnamed)
    same = [all_rows["id"].eqNullSafe(needed["id"]) if unnamed else all_rows["id"] == needed["id"], all_rows["h"] == needed["h"]]
    # the needed nodes grow with the data, so they are never broadcast
    return all_rows.join(needed.hint("merge"), same).select("words", "t").dropDuplicates(["words"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with both texts. Texts move with plain joins, whose hot keys Spark splits."""
    left = pairs.join(texts.select(F.col("words").alias("a"), F.col("t").alias("ta")), "a")
    return left.join(texts.select(F.col("words").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")


def _compared(pairs: DataFrame, texts: DataFrame, words: int, by_count: bool) -> DataFrame:
    """The similarity j of each (a, b), exact, from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words, by_count)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for part, both in sets.pairs(batch):
                out[part] = [similarity(x, y) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "j"])

    return _with_texts(pairs, texts).mapInArrow(runtime.lean(run), "a long, b long, j double")


def components(edges: DataFrame) -> DataFrame:
    """(id, class) of every node of the edges (a, b): class is the smallest id of its component.

    Each round hooks every node and its neighbours to the smallest of them, in
    alternation for the larger neighbours only and for all, so the depth halves.
    The minima are pre-aggregated and written, so what follows are plain joins of
    tables, in which Spark can split the edges of a node that has many.
    """
    with runtime.scope(edges.sparkSession):
        now = runtime.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        state = _state(now)
        while True:
            # large star: the larger neighbours of a node hook to its smallest neighbour, or to itself
            both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = runtime.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links")
            large = runtime.written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
            # small star: a node and its smaller neighbours hook to the smallest of them
            low = runtime.written(large.groupBy("u").agg(F.min("v").alias("m")), "links")
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low).distinct()
            now, before = runtime.written(small, "links"), state
            state = _state(now)
            if state == before:
                roots = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("class"))
                return runtime.written(now.select(F.col("u").alias("id"), F.col("v").alias("class")).unionAll(roots), "dedup-classes", lasting=True)


def _state(edges: DataFrame) -> tuple:
    """Tells one set of edges from another."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _met(signed: DataFrame) -> DataFrame:
    """Distinct (words, hub): the members of each key that several nodes have, with the hub of the key."""
    banded = signed.select("words", F.explode("bands").alias("band"))
    # copies share all keys, so a key concerns several nodes exactly if its smallest and largest names differ
    shared = banded.groupBy("band").agg(F.min("words").alias("low"), F.max("words").alias("high")).where("low < high").select("band")
    keyed = runtime.written(banded.join(shared, "band").distinct(), "dedup-keyed")
    members = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    meetings = keyed.join(runtime.written(members, "dedup-counted"), "band").groupBy("words").agg(F.sum("n").alias("n"))
    ranked = runtime.written(meetings.select("words", rank_of(F.col("n"), F.col("words")).alias("rank")), "dedup-ranked")
    keyed = runtime.written(keyed.join(ranked, "words"), "dedup-keyed")
    top = runtime.written(keyed.groupBy("band").agg(F.max("rank").alias("rank")), "dedup-top")
    hubs = runtime.written(keyed.join(top, ["band", "rank"]).select("band", F.col("words").alias("hub")), "dedup-hubs")
    return keyed.join(hubs, "band").where("words <> hub").select("words", "hub").distinct()


def rank_of(meetings: Column, words: Column) -> Column:
    """One number that orders nodes by their meetings, then by a hash."""
    return F.shiftleft(F.least(meetings, F.lit(2**31 - 1)), 32) + F.xxhash64(words).bitwiseAND(F.lit(2**32 - 1))


def _with_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (words, hub, ...) with c, the component of the member, and stray: whether the hub's is another."""
    own = classes.select(F.col("id").alias("words"), F.col("class").alias("__c"))
    hubs = classes.select(F.col("id").alias("hub"), F.col("class").alias("__hc"))
    c = F.coalesce("__c", "words")
    return pairs.join(own, "words", "left").join(hubs, "hub", "left").select(*pairs.columns, c.alias("c"), (c != F.coalesce("__hc", "hub")).alias("stray"))


def _open(members: DataFrame) -> DataFrame:
    """The members of hubs that have members in several components.

    Joins by hub are merge joins throughout: their number grows with the data, and
    Spark splits the members of a hub that has very many.
    """
    hubs = members.groupBy("hub").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("hub")
    return members.join(runtime.written(hubs, "dedup-hubs").hint("merge"), "hub")


def _differences(members: DataFrame, texts: DataFrame, words: int, by_count: bool) -> DataFrame:
    """(hub, words, n, d): the size of each member's set, and the elements in which it differs from what more than half of the hub's members have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words, by_count)
        for batch in batches:
            for part, both in sets.pairs(batch):
                apart = [np.setxor1d(x, hub, assume_unique=True) for x, hub in both]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in apart])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(apart).view(np.int64)))
                own = [batch.column(c).slice(part[0], len(part)) for c in ("b", "a")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) for x, _ in both], pa.int32()), lists], ["hub", "words", "n", "d"])

    pairs = members.select(F.col("words").alias("a"), F.col("hub").alias("b"))
    apart = runtime.written(_with_texts(pairs, texts).mapInArrow(runtime.lean(run), "hub long, words long, n int, d array<long>"), "dedup-apart")
    # an element in which more than half of the members differ from the hub is the hub's own oddity
    size = apart.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    count = runtime.written(apart.select("hub", F.explode("d").alias("e")).groupBy("hub", "e").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "dedup-counted")
    # a table between join and grouping, so that Spark can split the counts of a hub that has many
    odd = runtime.written(count.join(runtime.written(size, "dedup-sizes").hint("merge"), "hub").where("2 * k > m").select("hub", "e"), "dedup-odd")
    odd = odd.groupBy("hub").agg(F.collect_list("e").alias("odd"))  # at most twice as many as a member has on average
    none = F.array().cast("array<long>")
    flipped = F.concat(F.array_except("d", "odd"), F.array_except("odd", "d"))
    # a hub with two members keeps for each what the other lacks; one that has no odd element stays as it is
    joined = apart.join(runtime.written(odd, "dedup-odd").hint("merge"), "hub", "left")
    return joined.select("hub", "words", "n", F.when(F.col("odd").isNull(), F.coalesce("d", none)).otherwise(flipped).alias("d"))


def _near_base(rows: DataFrame) -> DataFrame:
    """Links (a, b) of members to the one that is nearest to the base of their hub, where the differences of both are too few to be apart."""
    best = rows.groupBy("hub").agg(F.min(F.struct("g", "words")).alias("best"))
    best = runtime.written(best.select("hub", F.col("best.g").alias("bg"), F.col("best.words").alias("b")), "dedup-best")
    return rows.join(best.hint("merge"), "hub").where((F.col("words") != F.col("b")) & (F.col("g") + F.col("bg") <= 1e-10 * F.col("n"))).select(F.col("words").alias("a"), "b").distinct()


def _candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members of one hub, in different components, that may reach the threshold.

    ``rows`` has hub, words, n, d, g, c and stray. With u = (1 - t) / (1 + t), sets of
    sizes n and n' have similarity t or more exactly if they differ in at most
    u (n + n') elements, so exactly if their differences from any base share at
    least (g + g') / 2 elements, where g = size of the difference - u n. Of two
    members the one with the larger g probes the other, so the elements that an
    indexed member must show are those before its last g, and a prober's those
    before its last (g + least g that it can meet) / 2, rare elements first.
    """
    least = runtime.written(rows.groupBy("hub", "c").agg(F.min("g").alias("low")), "dedup-least")
    first = least.groupBy("hub").agg(F.min(F.struct("low", "c")).alias("f")).select("hub", F.col("f.low").alias("g1"), F.col("f.c").alias("c1"))
    first = runtime.written(first, "dedup-least")
    second = least.join(first, "hub").where("c <> c1").groupBy("hub").agg(F.min("low").alias("g2"))
    floors = runtime.written(first.join(second, "hub"), "dedup-floors")
    known = rows.join(floors.hint("merge"), "hub").select("hub", "words", "n", F.size("d").alias("d"), "g", "c", "stray", F.when(F.col("c") == F.col("c1"), F.col("g2")).otherwise(F.col("g1")).alias("low"))
    known = runtime.written(known, "dedup-known")
    elements = rows.select("hub", "words", F.explode("d").alias("e"))
    count = runtime.written(elements.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "dedup-counted")
    # elements that one member alone has come first and meet nothing
    shared = elements.join(count, ["hub", "e"])
    own = Window.partitionBy("hub", "words")
    placed = shared.select("hub", "words", "e", (F.row_number().over(own.orderBy("k", "e")) - 1).alias("nth"), F.count(F.lit(1)).over(own).alias("of"))
    placed = placed.join(known, ["hub", "words"]).withColumn("place", F.col("nth") + F.col("d") - F.col("of"))

    def need(x: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(x - 1e-6))

    placed = placed.select("hub", "e", "words", "n", "d", "g", "c", "stray", "place", ((F.col("g") >= F.col("low")) & (F.col("place") <= F.col("d") - need((F.col("g") + F.col("low")) / 2))).alias("probes"), (F.col("place") <= F.col("d") - need(F.col("g"))).alias("indexed"))
    placed = runtime.written(placed.where("probes or indexed"), "dedup-prefixes")
    names = ("words", "n", "d", "g", "c", "stray", "place")
    a = placed.where("probes").select("hub", "e", *[F.col(x).alias(f"a_{x}") for x in names])
    b = placed.where("indexed").select("hub", "e", *[F.col(x).alias(f"b_{x}") for x in names])
    needed = need((F.col("a_g") + F.col("b_g")) / 2)
    above = (F.col("a_g") > F.col("b_g")) | (F.col("a_g") == F.col("b_g")) & (F.col("a_words") > F.col("b_words"))
    room = (F.col("a_place") <= F.col("a_d") - needed) & (F.col("b_place") <= F.col("b_d") - needed) & (F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n") - 1e-6)
    return a.join(b, ["hub", "e"]).where(above & (F.col("a_c") != F.col("b_c")) & (F.col("a_stray") | F.col("b_stray")) & room).select(F.col("a_words").alias("a"), F.col("b_words").alias("b")).distinct()


def _merged(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """The classes (id, class) with more edges (a, b): only the classes that an edge joins take part in the rounds."""
    ends = edges.join(classes.select(F.col("id").alias("a"), F.col("class").alias("ca")), "a", "left").join(classes.select(F.col("id").alias("b"), F.col("class").alias("cb")), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    alone = joined.select("id").join(classes, "id", "left_anti").select("id", F.col("id").alias("class"))
    new = joined.select(F.col("id").alias("class"), F.col("class").alias("__new"))
    return runtime.written(classes.unionAll(alone).join(new, "class", "left").select("id", F.coalesce("__new", "class").alias("class")), "dedup-classes")


def _classes(signed: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int, threshold: float, by_count: bool) -> DataFrame:
    """(id, class) of every node that is linked to another."""
    pairs = runtime.written(_met(signed), "dedup-pairs")
    # a row that has each node, pre-aggregated, so that many copies of a text are one row here
    firsts = signed.groupBy("words").agg(F.min_by("id", "h").alias("id"), F.min("h").alias("h"))
    needed = firsts.join(pairs.select(F.explode(F.array("words", "hub")).alias("words")).distinct(), "words")  # a semi-join would be pushed below the aggregation
    texts = runtime.written(texts_of(runtime.written(needed, "dedup-needed")), "dedup-texts")
    over = F.col("j") >= threshold - EPSILON
    links = runtime.written(_compared(pairs.select(F.col("words").alias("a"), F.col("hub").alias("b")), texts, words, by_count).where(over), "dedup-compared").select("a", "b")
    classes = components(links)
    members = runtime.written(_open(_with_classes(pairs, classes)).select("words", "hub"), "dedup-open")
    if not members.limit(1).count():
        return classes
    apart = (F.size("d") - (1 - threshold) / (1 + threshold) * F.col("n")).alias("g")
    rows = runtime.written(_differences(members, texts, words, by_count).select("*", apart), "dedup-differences")
    near = runtime.written(_near_base(rows), "dedup-near")
    if near.limit(1).count():
        classes = _merged(classes, near)
    rows = runtime.written(_open(_with_classes(rows, classes)), "dedup-open")
    found = runtime.written(_compared(_candidates(rows, threshold), texts, words, by_count).where(over), "dedup-more")
    return _merged(classes, found.select("a", "b")) if found.limit(1).count() else classes


def _classified(docs: DataFrame, key: str, text: str, words: int, threshold: float, bands: int, rows: int, weights: str, unnamed: bool) -> tuple[DataFrame, DataFrame]:
    """(id, h, class) of every row with a text, h being the hash of the text, and (class, class_id)."""
    spark = docs.sparkSession
    runtime.bound_batches(spark)
    by_count = {"set": False, "count": True}[weights]
    with runtime.scope(spark):
        signed = _told_apart(runtime.written(_sign(docs, key, text, words, bands, rows, by_count, unnamed), "dedup-signed"))
        classes = _classes(signed, lambda needed: _texts_of(docs, key, text, needed, unnamed), words, threshold, by_count)
        of = signed.select("id", "h", "words").join(classes.withColumnRenamed("id", "words"), "words", "left").select("id", "h", F.coalesce("class", "words").alias("class"))
        of = runtime.written(of, "dedup-members", lasting=True)
    return of, runtime.written(of.groupBy("class").agg(F.min("id").alias("class_id")), "dedup-least")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows, packed, with a key that has no null and a hash of the text, null for a null text."""
    own, said = F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")
    return runtime.packed(docs, __id=F.coalesce(own, F.lit(0)), __none=own.isNull(), __h=F.when(said.isNotNull(), F.xxhash64(said)))


KEYS = ["__id", "__none", "__h"]


def _as_keys(rows: DataFrame, *more: Column) -> DataFrame:
    """id and h of some rows as :func:`_keyed` has them."""
    return rows.select(F.coalesce("id", F.lit(0)).alias("__id"), F.col("id").isNull().alias("__none"), F.col("h").alias("__h"), *more)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weights: str = "set", unnamed: bool = False) -> DataFrame:
    """``docs`` with class_id: the smallest key among the documents of a row's near-duplicate class."""
    with runtime.scope(docs.sparkSession):
        of, least = _classified(docs, key, text, words, threshold, bands, rows, weights, unnamed)
        named = of.join(least, "class").groupBy("id", "h").agg(F.min("class_id").alias("class_id"))
        named = runtime.written(_as_keys(named, F.col("class_id").alias("__class_id")), "dedup-named", lasting=True)
    joined = _keyed(docs, key, text).where(F.lit(unnamed) | ~F.col("__none")).join(named, KEYS, "left")
    return joined.select(*runtime.unpacked(docs.columns, ["class_id"]), F.coalesce("__class_id", F.when(~F.col("__none"), F.col("__id"))).alias("class_id"))


def one_of_each_class(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """One row of each near-duplicate class: the one with the smallest key, nulls last, and of its texts in the class the one with the smallest hash. Rows with a null text are classes of their own, so all stay."""
    with runtime.scope(docs.sparkSession):
        of, _ = _classified(docs, key, text, words, threshold, bands, rows, weights, True)
        texts = of.groupBy("class", "id", "h").agg(F.count(F.lit(1)).alias("n"))
        chosen = texts.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "h", "n")).alias("row")).select("row.*")
        chosen = runtime.written(_as_keys(chosen, F.col("n").alias("__n")), "dedup-chosen", lasting=True)
    joined = _keyed(docs, key, text).join(chosen, KEYS, "left")
    kept = joined.where(F.col("__n").isNotNull() | F.col("__h").isNull())
    if chosen.where("__n > 1").limit(1).count():
        # rows that repeat in key and text: a struct as the key makes Spark drop what it can before rows move
        repeated = joined.where("__n > 1").withColumn("__same", F.struct(*KEYS)).dropDuplicates(["__same"]).drop("__same")
        kept = kept.where(F.coalesce(F.col("__n"), F.lit(1)) == 1).unionAll(repeated)
    return kept.select(*runtime.unpacked(docs.columns, []))
