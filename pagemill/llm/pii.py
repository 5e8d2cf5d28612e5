"""Personal data by candidate spans and gradient boosted trees, in DataFrame operations only.

Base spans are the leftmost non-overlapping matches of one pattern per kind that
pass the kind's check (octets, digits, Luhn). High-recall generators propose
further spans, which may overlap the base and each other: a number that a base
pattern swallowed together with its neighbour, national phone formats, card and
account numbers, obfuscated and non-ASCII addresses, IPv6. Each candidate gets
features of its format (digits, groups, separators, Luhn, octets, first digit)
and of its context (neighbouring characters, words that go before personal data
or before other numbers). Boosted trees score it; a calibrated probability at or
above the kind's threshold selects it. Base spans always stay.

The trees are fitted once per process from rows that this module labels by
construction: formats of personal data and of things that look like it (dates,
versions, prices, order numbers, time stamps, ISBNs), in neutral and telling
contexts. There are ``TRAINING_ROWS`` of them, whatever the size of the data;
half fit the trees, half calibrate them and set the thresholds.

Everything but that fit is SQL within one row: no shuffle, no Python. Positions
come from splitting a text at the matches: a prefix sum over the lengths, by
doubling steps, gives each match its place in n log n time. Repeats in the
patterns are possessive and their starts are tied to the end of a run or of the
last match, which changes no match and keeps them linear on long runs.

Defined results: null texts are empty and have no spans. Positions are code
points, ends exclusive. Spans are listed by kind, then start, then end; equal
spans are listed once. Texts are read whole. Extra columns pass through; one that
is called like a result column (n_email, base_spans, pii_spans and so on) has
_input appended to its name and keeps its values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import boosting, runtime

KINDS = ("email", "ip", "card", "phone")
#: The columns that find() makes.
MADE = (*[f"n_{k}" for k in KINDS], "base_spans", "pii_spans")
TRAINING_ROWS = 6000
PRECISION = 0.98
CONTEXT = 24

# Base patterns. The lookbehind and \G say: start where a run starts or where the last match ended;
# a start within a run cannot match unless the run's first character did.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NAME = r"\p{L}0-9._%+-"
GENERATORS = {
    "email": [
        rf"(?<![{_NAME}])[{_NAME}]{{1,64}}+(?: ?\[at\] ?| ?\(at\) ?|@)[\p{{L}}0-9-]{{1,63}}+(?:(?: ?\[dot\] ?| ?\(dot\) ?|\.)[\p{{L}}0-9-]{{1,63}}+){{1,8}}+",
    ],
    "ip": [
        r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9]|\.[0-9])",
        r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Za-z:])",
    ],
    "card": [
        r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
        r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+(?![0-9])",
    ],
    "phone": [
        r"(?<![0-9+])\+[0-9]{1,3}+[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}(?![0-9])",
        r"(?<![0-9+)])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])",
    ],
}
WORDS_BEFORE = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|reach|card|visa|account|iban|ip|host|address|from)\W{0,3}$"
OTHER_BEFORE = r"(?i)(?:order|invoice|isbn|version|release|ver|id|no|nr|code|serial|ticket|build|page|section|time|date|ref|sku)\W{0,3}$"

FEATURES = (
    "kind_email", "kind_ip", "kind_card", "kind_phone", "length", "digits", "letters", "groups", "plus", "paren", "at", "luhn", "octets", "first_digit",
    "same_digit", "after_letter", "before_letter", "after_mark", "money_near", "personal_word", "other_word", "tld",
)


def prefix_sums(values: Column) -> Column:
    """Inclusive sums of an array, by doubling steps."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.floor(F.log2(F.size(values))).cast("int"))).otherwise(F.array().cast("array<int>"))

    def double(acc: Column, k: Column) -> Column:
        width = F.least(F.pow(F.lit(2), k).cast("int"), F.size(acc))
        shifted = F.concat(F.array_repeat(F.lit(0).cast("long"), width), F.slice(acc, F.lit(1), F.size(acc) - width))
        return F.zip_with(acc, shifted, lambda a, b: a + b)

    return F.aggregate(steps, values, double)


def _spans(gaps: Column, matches: Column, kind: str) -> Column:
    """The matches with their places and what stands before and after."""
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    ends = prefix_sums(lengths)
    return F.transform(
        F.arrays_zip(matches.alias("m"), ends.alias("e")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            (x["e"] - F.length(x["m"])).alias("start"),
            x["e"].alias("end"),
            x["m"].alias("value"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(2)).alias("after"),
        ),
    )


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def octets_ok(value: Column) -> Column:
    """Whether all dotted parts are numbers of at most 255."""
    short = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.when(p == "", 0).otherwise(999)) <= 255))


def passes(kind: str, value: Column) -> Column:
    """The check of a base match."""
    n = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets_ok(value)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(F.lit(False))
    return n.between(9, 15)


def _passing(kind: str) -> Callable[[Column], Column]:
    return lambda x: passes(kind, x["value"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def features(x: Column) -> Column:
    """The features of a candidate, as a struct of doubles."""
    value, before, after = x["value"], x["before"], x["after"]
    digits = _digits(value)
    n = F.length(digits)
    out = {f"kind_{k}": x["kind"] == k for k in KINDS}
    out |= {
        "length": F.length(value),
        "digits": n,
        "letters": F.length(F.regexp_replace(value, r"[^\p{L}]", "")),
        "groups": F.size(F.split(value, "[^0-9A-Za-z]+")),
        "plus": F.startswith(value, F.lit("+")),
        "paren": F.contains(value, F.lit("(")),
        "at": F.contains(value, F.lit("@")),
        "luhn": F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False)),
        "octets": F.when(x["kind"] == "ip", octets_ok(value)).otherwise(F.lit(False)),
        "first_digit": F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(-1)),
        "same_digit": F.length(F.replace(digits, F.left(digits, F.lit(1)), F.lit(""))) == 0,
        "after_letter": before.rlike(r"[\p{L}0-9_]$"),
        "before_letter": after.rlike(r"^[\p{L}0-9_]"),
        "after_mark": before.rlike(r"[-#/.=$€£:]$"),
        "money_near": before.rlike(r"[$€£]\s?$") | after.rlike(r"^\s?[$€£%]"),
        "personal_word": before.rlike(WORDS_BEFORE),
        "other_word": before.rlike(OTHER_BEFORE),
        "tld": value.rlike(r"[.\])]\s?\p{L}{2,12}$"),
    }
    return F.struct(*[F.coalesce(out[name].cast("double"), F.lit(0.0)).alias(name) for name in FEATURES])


def _proposed(text: Column, pattern: str, kind: str) -> tuple[Column, Column]:
    """Gaps and matches of a pattern, or empty arrays where the text cannot hold any: each condition follows from every pattern of its kind."""
    possible = {"email": F.contains(text, F.lit("@")) | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")), "phone": text.rlike(r"\+[0-9]|[0-9]{2}"), "card": text.rlike("[0-9][ -]?[0-9]"), "ip": text.rlike("[0-9A-Fa-f][.:][0-9A-Fa-f]")}[kind]
    none = F.array().cast("array<string>")
    return F.when(possible, F.split(text, pattern, -1)).otherwise(none), F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def candidates(df: DataFrame) -> DataFrame:
    """``df``, whose __text has no null, with __base (base spans by kind) and __more (candidates of the generators), as arrays, in place of the text."""
    wanted = [(kind, f"__b_{kind}", BASE[kind]) for kind in KINDS]
    wanted += [(kind, f"__g{i}_{kind}", p) for kind in KINDS for i, p in enumerate(GENERATORS[kind])]
    split = {}
    for kind, name, pattern in wanted:
        split[f"{name}_gaps"], split[f"{name}_hits"] = _proposed(F.col("__text"), pattern, kind)
    df = df.withColumns(split).drop("__text")
    df = df.withColumns({name: F.when(F.size(f"{name}_hits") > 0, _spans(F.col(f"{name}_gaps"), F.col(f"{name}_hits"), kind)).otherwise(F.array().cast(_SPAN)) for kind, name, _ in wanted})
    df = df.drop(*split)
    df = df.withColumns({f"__b_{kind}": F.filter(f"__b_{kind}", _passing(kind)) for kind in KINDS})
    more = F.concat(*[F.col(name) for _, name, _ in wanted if name.startswith("__g")])
    base = F.concat(*[F.col(f"__b_{k}") for k in KINDS])
    df = df.withColumns({"__more": more, "__base": base, **{f"__n_{k}": F.size(f"__b_{k}").cast("long") for k in KINDS}})
    return df.drop(*[name for _, name, _ in wanted])


def _training(spark: SparkSession, rows: int) -> DataFrame:
    """Labelled candidates: value, kind, before, after, y."""
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    digit_string = lambda n, salt: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string"), n, "0")
    number = lambda low, high, salt: (pick(high - low + 1, salt) + low).cast("string")
    word = lambda salt: F.substring(F.translate(F.md5(F.concat(F.col("id").cast("string"), F.lit(salt))), "0123456789", "ghiklmnopr"), 1, 7)
    cat = F.concat
    any16 = cat(number(2, 9, "c1"), digit_string(15, "c2"))
    grouped = cat(digit_string(4, "d1"), F.lit(" "), digit_string(4, "d2"), F.lit(" "), digit_string(4, "d3"), F.lit(" "), digit_string(4, "d4"))
    phone = cat(F.lit("+"), number(1, 99, "p1"), F.lit(" ("), digit_string(3, "p2"), F.lit(") "), digit_string(3, "p3"), F.lit("-"), digit_string(4, "p4"))
    local = cat(F.lit("("), digit_string(3, "p2"), F.lit(") "), digit_string(3, "p3"), F.lit("-"), digit_string(4, "p4"))
    dashes = cat(digit_string(3, "p2"), F.lit("-"), digit_string(3, "p3"), F.lit("-"), digit_string(4, "p4"))
    spaced = cat(F.lit("+"), number(1, 99, "p1"), F.lit(" "), digit_string(3, "p2"), F.lit(" "), digit_string(3, "p3"), F.lit(" "), digit_string(3, "p4"))
    ip = cat(number(1, 255, "i1"), F.lit("."), number(0, 255, "i2"), F.lit("."), number(0, 255, "i3"), F.lit("."), number(0, 255, "i4"))
    version = cat(number(0, 9, "v1"), F.lit("."), number(0, 20, "v2"), F.lit("."), number(0, 9, "v3"), F.lit("."), number(256, 999, "v4"))
    mail = cat(word("m1"), F.lit("."), number(1, 99, "m2"), F.lit("@"), word("m3"), F.lit(".org"))
    masked = cat(word("m1"), F.lit(" [at] "), word("m3"), F.lit(" [dot] com"))
    handle = cat(word("m1"), F.lit("@"), number(1, 9, "h1"), F.lit("."), number(0, 99, "h2"))
    v6 = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.substring(F.md5(F.col("id").cast("string")), 4 * i - 3, F.lit(4))), ":")
    stamp = cat(F.lit("1"), number(5, 7, "t1"), digit_string(11, "t2"))
    isbn = cat(F.lit("978"), digit_string(10, "n1"))
    long_id = digit_string(18, "l1")
    same = F.repeat(number(0, 9, "s1"), 16)
    neutral = ["the rest of ", "and then ", "was in ", "on that ", "ing. ", ""]
    personal = ["call ", "phone: ", "my card ", "mail ", "contact ", "from "]
    other = ["order ", "invoice no ", "version ", "build ", "isbn ", "ref "]
    # kind, value, contexts that it stands in, whether it is personal
    kinds = [
        ("email", mail, neutral + personal, 1), ("email", masked, neutral + personal, 1), ("email", handle, neutral + other, 0), ("email", handle, neutral, 0),
        ("ip", ip, neutral + personal, 1), ("ip", v6, neutral + personal, 1), ("ip", version, neutral + other, 0), ("ip", ip, ["version ", "release ", "build ", "section "], 0),
        ("card", any16, neutral + personal, 1), ("card", grouped, neutral + personal, 1), ("card", stamp, neutral + other, 0), ("card", isbn, neutral + other, 0),
        ("card", long_id, neutral + other, 0), ("card", same, neutral + other, 0), ("card", any16, other, 0), ("card", any16, ["x", "a-", "#", "="], 0),
        ("phone", phone, neutral + personal, 1), ("phone", local, neutral + personal, 1), ("phone", dashes, neutral + personal, 1), ("phone", spaced, neutral + personal, 1),
        ("phone", dashes, other, 0), ("phone", dashes, ["x", "a-", "#", "=", "$"], 0),
    ]
    which = pick(len(kinds), "which")
    choose = lambda options: F.element_at(F.array(*options), which + 1)
    before = choose([F.element_at(F.array(*map(F.lit, c)), pick(len(c), "context") + 1) for _, _, c, _ in kinds])
    after = F.element_at(F.array(*map(F.lit, (" ", ".", ",", "", "\n"))), pick(5, "after") + 1)
    # one partition, one row order: the fit does not depend on the cluster
    base = spark.range(0, rows, 1, 1)
    return base.select("id", F.struct(choose([F.lit(k) for k, *_ in kinds]).alias("kind"), choose([v for _, v, *_ in kinds]).alias("value"), before.alias("before"), after.alias("after")).alias("x"), choose([F.lit(y) for *_, y in kinds]).alias("y"))


@cache
def _fitted(rows: int, precision: float) -> tuple[boosting.Model, tuple[float, ...]]:
    spark = SparkSession.getActiveSession()
    made = _training(spark, rows).select("id", features(F.col("x")).alias("f"), "y").orderBy("id").collect()
    x, y = np.array([tuple(r["f"]) for r in made], dtype=float), np.array([r["y"] for r in made], dtype=float)
    half = np.arange(len(y)) % 2 == 0
    model = boosting.calibrate(boosting.fit(x[half], y[half]), x[~half], y[~half])
    probability = model.probability(x[~half])
    thresholds = []
    for k in range(len(KINDS)):
        own = x[~half][:, k] == 1
        thresholds.append(boosting.threshold_for(probability[own], y[~half][own], precision))
    return model, tuple(thresholds)


def find(docs: DataFrame, text: str = "text", training_rows: int = TRAINING_ROWS, precision: float = PRECISION) -> DataFrame:
    """``docs`` with n_<kind> (base spans), base_spans and pii_spans (all spans): arrays of (kind, start, end, probability)."""
    model, thresholds = _fitted(training_rows, precision)
    margin = model.sql([f"c.f.{name}" for name in FEATURES])
    limits = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {t!r}D" for k, t in zip(KINDS, thresholds, strict=True)) + " END"
    df = candidates(runtime.packed(docs, __text=F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    df = df.withColumn("__more", F.transform("__more", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), features(x).alias("f"))))
    df = df.withColumn("__more", F.expr(f"transform(__more, c -> struct(c.kind as kind, c.start as start, c.end as end, 1 / (1 + exp(-{margin})) as probability))"))
    df = df.withColumn("__more", F.expr(f"filter(__more, c -> c.probability >= {limits})"))
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    df = df.withColumns({"__base": F.transform("__base", plain), "__more": F.transform("__more", plain)})
    by_kind = lambda spans: F.flatten(F.array(*[F.array_sort(F.filter(spans, _of_kind(k))) for k in KINDS]))
    df = df.withColumn("__all", F.array_distinct(F.concat("__base", "__more")))
    counts = [F.col(f"__n_{k}").alias(f"n_{k}") for k in KINDS]
    return df.select(*runtime.unpacked(docs.columns, MADE), *counts, by_kind(F.col("__base")).alias("base_spans"), by_kind(F.col("__all")).alias("pii_spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``docs`` with every span of the text replaced by the kind of the first span of its run in angle brackets; overlapping spans are one run."""
    ordered = F.array_sort(F.transform(F.col(f"`{spans}`"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    df = runtime.packed(docs, __o=ordered, __text=F.col(f"`{text}`"))
    # the furthest end so far, by doubling maxima: a span starts a run if it lies behind all before it
    ends = F.transform("__o", lambda x: x["end"])
    steps = F.when(F.size(ends) > 1, F.sequence(F.lit(0), F.floor(F.log2(F.size(ends))).cast("int"))).otherwise(F.array().cast("array<int>"))

    def furthest(acc: Column, k: Column) -> Column:
        width = F.least(F.pow(F.lit(2), k).cast("int"), F.size(acc))
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(-1).cast("long"), width), F.slice(acc, F.lit(1), F.size(acc) - width)), lambda a, b: F.greatest(a, b))

    df = df.withColumn("__e", F.aggregate(steps, ends, furthest))
    df = df.withColumn("__first", F.filter(F.transform("__o", lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("__e", i - 1)).alias("from"), (F.coalesce(F.get("__e", i - 1), F.lit(-1)) <= x["start"]).alias("new"))), lambda x: x["new"]))
    body = F.transform("__first", lambda x: F.concat(F.substring(F.col("__text"), (x["from"] + 1).cast("int"), (x["start"] - x["from"]).cast("int")), F.lit("<"), x["kind"], F.lit(">")))
    rest = F.substring(F.col("__text"), (F.array_max("__e") + 1).cast("int"), F.length("__text"))
    redacted = F.when(F.coalesce(F.size("__o"), F.lit(0)) > 0, F.concat(F.array_join(body, ""), rest)).otherwise(F.col("__text"))
    return df.select(*[redacted.alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in docs.columns])
