"""Personal data: spans by fixed patterns, and more by gradient boosted candidates.

High-recall generators propose spans that may overlap (key-value secrets, long keys, national
numbers, phone numbers without +, spelled-out e-mail addresses, account numbers). Boosted
trees of depth two weigh their format and the words around them; the trees are learnt on the
driver from 1,600 made-up examples, whose features come from the very expressions
that serve the documents, and run as nested CASE expressions. The threshold is calibrated on
held-back examples; every candidate over it is a span. All of it is DataFrame functions over each row, without a shuffle.
"""

from __future__ import annotations

import json
import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns; possessive repeats and left bounds only save backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Repeats are possessive and without a greatest length, so that a long secret is one candidate.
GENERATORS = {
    "secret": r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s*+[=:]\s*+[\"']?[^\s\"',;]{6,}+",
    "key": r"\b[A-Z]{4}[0-9A-Z]{12,}+\b",
    "national_id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b",
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\s?[\[(]at[\])]\s?[a-z0-9-]++(?:\s?(?:[\[(]dot[\])]|\.)\s?[a-z]{2,}+)++",
    "account": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?\b",
}
CONTEXT = 24
FEATURES = ("length", "digits", "uppers", "marks", "at", "hints", "near_number", "money", *(f"is_{k}" for k in GENERATORS))
HINTS = r"(?i)password|passwd|token|secret|key|phone|tel|call|mail|contact|ssn|social|account|iban|bank|fax|mobile|login|taxpayer|identity|ring|reach|write|schreib|escribe|llame|konto|cuenta|pay"


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


SPAN = "struct<kind:string,start:int,end:int,s:string>"


def _scanned(items: Column, state: Column, step, kind: str) -> Column:
    """`step(state, item)` gives (state, array of outputs); all outputs of the items in order.

    Arrays grow by copying, so they are built in blocks of about the root of the number of
    items: the work is its power of 1.5 and not its square."""

    def blocks(found):
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(found).cast("double"))).cast("int"))
        none = F.array().cast(f"array<{kind}>")

        def one(acc, x):
            return _let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

        def block(acc, k):
            inner = F.aggregate(F.slice(found, k * size + 1, size), F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return _let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

        count = F.ceil(F.size(found) / size).cast("int")
        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), count - 1), F.struct(state.alias("state"), none.alias("out")), block, lambda acc: acc["out"])).otherwise(none)

    return _let(items, blocks)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Code point spans of all matches: the text between matches gives the places."""

    def of(found):
        gaps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("s")))

        def step(pos, x):
            a = pos + x["gap"]
            b = a + F.length(x["s"])
            return F.struct(b.alias("state"), F.array(F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["s"].alias("s"))).alias("out"))

        return F.when(F.size(found) > 0, _scanned(gaps, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    def add(acc, i):
        x = F.substring(d, -i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    d = _digits(s)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & _luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _is_valid(kind: str):
    return lambda x: _valid(kind, x["s"])


def _of(kind: str):
    return lambda x: x["kind"] == kind


def base_spans(text: Column) -> Column:
    """The contract's spans, by kind as listed and then by start."""
    none = F.array().cast(f"array<{SPAN}>")
    need = {"email": text.contains("@"), "phone": text.contains("+"), "ip": F.lit(True), "card": F.lit(True)}
    parts = [F.when(need[k], F.filter(_spans(text, BASE[k], k), _is_valid(k))).otherwise(none) for k in KINDS]
    return F.concat(*parts)


def _features(text: Column, x: Column) -> dict[str, Column]:
    s = x["s"]
    left = F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), x["start"]))
    right = F.substring(text, x["end"] + 1, F.lit(CONTEXT))
    n = F.length(s)
    out = {
        "length": n,
        "digits": F.length(_digits(s)) * 100 / n,
        "uppers": F.length(F.regexp_replace(s, "[^A-Z]", "")) * 100 / n,
        "marks": F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")),
        "at": F.regexp_count(s, F.lit(r"(?i)[\[(](at|dot)[\])]")),
        "hints": F.when(F.concat(left, F.lit(" "), s).rlike(HINTS), 1).otherwise(0),
        "near_number": F.when(left.rlike(r"[0-9][\x20.,/-]{0,2}$") | right.rlike(r"^[\x20.,/-]?[0-9]"), 1).otherwise(0),
        "money": F.when(left.rlike(r"(?i)[$€£#]\x20?$|\b(isbn|order|item|part|model|version|no|invoice|serial|ref|lot|artikel)\b\W{0,3}$"), 1).otherwise(0),
    }
    out |= {f"is_{k}": F.when(x["kind"] == k, 1).otherwise(0) for k in GENERATORS}
    return {k: out[k].cast("double") for k in FEATURES}


# Words that stand before personal data, and before numbers of another use.
BEFORE = {
    "national_id": ("my ssn is", "ssn:", "social security number", "taxpayer id", "his number was", "identity no"),
    "phone": ("call", "phone", "tel.", "reach me at", "fax", "mobile:", "contact", "or ring", "telefon", "llame al"),
    "email": ("mail", "write to", "contact:", "reach me", "email", "schreib an", "escribe a"),
    "account": ("iban", "account", "bank transfer to", "pay to", "konto", "cuenta"),
}
OTHER = ("order", "order no", "part", "part no", "item", "isbn", "model", "version", "no.", "invoice", "serial", "ref", "lot", "artikel")


def _examples(n: int = 1600, seed: int = 11) -> list[dict]:
    """Made-up texts with one candidate each, amid prose of made-up words: personal or secret (1),
    or a number of another use (0); `template` numbers the rule that made it."""
    rng = random.Random(seed)

    def of(chars, k):
        return "".join(rng.choice(chars) for _ in range(k))

    def d(k):
        return of("0123456789", k)

    def up(k):
        return of("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", k)

    def word():
        return of("abcdefghijklmnopqrstuvwäéñ", rng.randint(2, 10))

    def prose(most=6):
        return " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(0, most)))

    def value():
        return of(rng.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789!#$%&*+-_./"]), rng.choice([8, 12, 16, 24, 32, 40, 64, 120, 300]))

    def said(name):
        name = rng.choice([name, name.upper(), name.capitalize()])
        return rng.choice(["{}={}", "{}: {}", "{} = {}", '{}="{}', "{}='{}"]).format(name, value())

    def before(kind):
        return rng.choice(BEFORE[kind]) + rng.choice([" ", " ", ": "])

    def other():
        return rng.choice(OTHER) + rng.choice([" ", ": ", " #"])

    def phone():
        return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(d(3), d(3), d(4))

    def mail():
        o, c = rng.choice(["[]", "()"])
        return f"{word().encode('ascii', 'ignore').decode() or 'a'}{rng.choice(['', ' '])}{o}at{c} {of('abcdefgh', 6)} {o}dot{c} {rng.choice(['com', 'org', 'net', 'de'])}"

    def iban():
        return f"{rng.choice(['DE', 'FR', 'ES', 'GB', 'IT', 'NL'])}{d(2)} " + " ".join(d(4) for _ in range(rng.randint(3, 5)))

    made = [
        (1, lambda: ("", said(rng.choice(["password", "passwd", "pwd"])))),
        (1, lambda: ("", said(rng.choice(["token", "secret", "api_key", "access-key"])))),
        (1, lambda: ("", rng.choice(["AKIA", "ASIA", "AIZA", "SKLV"]) + up(rng.choice([16, 16, 32, 60, 90])))),
        (1, lambda: (before("national_id"), f"{d(3)}-{d(2)}-{d(4)}")),
        (1, lambda: ("", f"{d(3)}-{d(2)}-{d(4)}")),
        (1, lambda: (before("phone"), phone())),
        (1, lambda: ("", f"({d(3)}) {d(3)}-{d(4)}")),
        (1, lambda: (before("email"), mail())),
        (1, lambda: ("", mail())),
        (1, lambda: (before("account"), iban())),
        (0, lambda: (other(), f"{d(3)}-{d(2)}-{d(4)}")),
        (0, lambda: (other(), f"{up(4)}{up(rng.randint(12, 30))}")),
        (0, lambda: ("", of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", rng.randint(16, 40)))),
        (0, lambda: (f"{rng.choice(['sum', 'from', 'about'])} {d(rng.randint(1, 3))} ", f"{d(3)} {d(3)} {d(4)}")),
        (0, lambda: (other(), rng.choice(["{}-{}-{}", "{}.{}.{}"]).format(d(3), d(3), d(4)))),
        (0, lambda: (other(), f"AB{d(2)} {up(4)} {up(4)}")),
        (0, lambda: ("$", f"{d(3)} {d(3)} {d(4)}")),
        (0, lambda: (other(), iban())),
    ]
    out = []
    for i in range(n):
        label, make = made[i % len(made)]
        left, s = make()
        tail = rng.choice(['"', ".", ",", ")", ";", ""]) if s[-1].isalnum() else ""
        out.append({"label": label, "template": i % len(made), "text": f"{prose()} {left}{s}{tail} {prose()}"})
    return out


def _boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> tuple[float, list]:
    """Logistic boosting with trees of depth two: (bias, [(f, t, (f, t, a, b), (f, t, a, b))])."""

    def split(rows, g, h):
        best = (0.0, 0, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(np.quantile(x[rows, f], np.linspace(0, 1, 33)))
            for t in (values[1:] + values[:-1]) / 2:
                left = x[rows, f] < t
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1.0) for m in (rows[left], rows[~left]))
                if gain > best[0] + 1e-9:
                    best = (gain, f, float(t))
        return best[1], best[2]

    p = y.mean()
    bias = float(np.log(p / (1 - p)))
    z, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z))
        g, h = y - q, q * (1 - q)
        f, t = split(np.arange(len(y)), g, h)
        sides = []
        for rows in (np.flatnonzero(x[:, f] < t), np.flatnonzero(x[:, f] >= t)):
            f2, t2 = split(rows, g, h) if len(rows) else (0, 0.0)
            parts = [rows[x[rows, f2] < t2], rows[x[rows, f2] >= t2]]
            leaves = [float(rate * g[m].sum() / (h[m].sum() + 1.0)) for m in parts]
            for m, v in zip(parts, leaves, strict=True):
                z[m] += v
            sides.append((f2, t2, *leaves))
        trees.append((f, t, *sides))
    return bias, trees


def _candidates(text: Column) -> Column:
    return F.concat(*[_spans(text, p, k) for k, p in GENERATORS.items()])


def example_features(spark: SparkSession, examples: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and template of every candidate in made-up examples, by the serving expressions."""
    rows = F.from_json(F.lit(json.dumps(examples)), "array<struct<label:int,template:int,text:string>>")
    frame = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    frame = frame.select("label", "template", "text", F.explode(_candidates(F.col("text"))).alias("c"))
    got = frame.select("label", "template", *[c.alias(k) for k, c in _features(F.col("text"), F.col("c")).items()]).collect()
    return np.array([[r[k] for k in FEATURES] for r in got]), np.array([r.label for r in got], float), np.array([r.template for r in got])


@cache
def _model(spark_id: str) -> tuple[float, tuple, float]:
    """(bias, trees, threshold on the log odds); a third of the examples calibrates."""
    spark = SparkSession.active()
    x, y, _ = example_features(spark, _examples())
    held = np.arange(len(y)) % 3 == 0
    bias, trees = _boost(x[~held], y[~held])

    def log_odds(row):
        return bias + sum(_leaf(t, row) for t in trees)

    z = np.array([log_odds(r) for r in x[held]])
    wrong = z[y[held] == 0]
    threshold = max(0.0, float(np.quantile(wrong, 0.99)) if len(wrong) else 0.0)  # one in a hundred wrong ones at most
    return bias, tuple(trees), threshold


def _leaf(tree, row) -> float:
    f, t, low, high = tree
    f2, t2, a, b = low if row[f] < t else high
    return a if row[f2] < t2 else b


def _log_odds(bias: float, trees, feature: dict[str, Column]) -> Column:
    at = [feature[k] for k in FEATURES]
    out = F.lit(bias)
    for f, t, low, high in trees:
        pick = [F.when(at[s[0]] < s[1], F.lit(s[2])).otherwise(F.lit(s[3])) for s in (low, high)]
        out = out + F.when(at[f] < t, pick[0]).otherwise(pick[1])
    return out


def added_spans(text: Column, base: Column, model) -> Column:
    """Candidates over the threshold, by start; those inside one base span add nothing and go.

    Added spans may overlap each other and base spans in part: every one is personal data."""
    bias, trees, threshold = model

    def selected(x):
        feature = _features(text, x)
        return _let(F.struct(*[feature[k].alias(k) for k in FEATURES]), lambda v: _log_odds(bias, trees, {k: v[k] for k in FEATURES}) >= threshold)

    def tagged(spans, added: int):
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(added).alias("added"), x["end"].alias("end"), x["kind"].alias("kind"), x["s"].alias("s")))

    def step(reach, x):
        new = (x["added"] == 1) & (x["end"] > reach)
        own = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"))
        return F.struct(F.when(x["added"] == 0, F.greatest(reach, x["end"])).otherwise(reach).alias("state"), F.when(new, F.array(own)).otherwise(F.array().cast(f"array<{SPAN}>")).alias("out"))

    def free(found):
        ordered = F.array_sort(F.concat(tagged(base, 0), tagged(found, 1)))
        return F.when(F.size(found) > 0, _scanned(ordered, F.lit(0), step, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.filter(_let(_candidates(text), free), selected)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, added): arrays of struct<kind, start, end, s>, in code points.

    Null text is empty; a long text is read whole; repeated rows are kept; an empty table gives
    no rows; columns other than doc_id and text are ignored, clashing names too. Work per row
    is linear in the text and grows as the power 1.5 of the number of its spans."""
    model = _model(docs.sparkSession.sparkContext.applicationId)
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    some = text.rlike(r"[0-9@]") | text.rlike(r"(?i)[\[(]at[\])]|password|passwd|pwd|secret|token|key|[A-Z]{16}")

    def both(t):
        return _let(base_spans(t), lambda b: F.struct(b.alias("base"), added_spans(t, b, model).alias("added")))

    found = F.when(some, _let(text, both)).otherwise(F.struct(none.alias("base"), none.alias("added")))
    return docs.select("doc_id", "text", found.alias("f")).select("doc_id", "text", F.col("f.base").alias("base"), F.col("f.added").alias("added"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by <kind>; of overlapping ones the first, longest
    names the place and all that any of them covers goes. Null text becomes empty."""
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind"))))
    text = F.coalesce(F.col("text"), F.lit(""))

    def step(pos, x):
        kept = F.concat(F.substring(text, pos + 1, x["start"] - pos), F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.greatest(pos, -x["less"]).alias("state"), F.when(x["start"] >= pos, F.array(kept)).otherwise(F.array().cast("array<string>")).alias("out"))

    ends = F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform("all", lambda x: -x["less"])), F.lit(0)))
    done = F.concat(F.array_join(_scanned(F.col("all"), F.lit(0), step, "string"), ""), F.substring(text, ends + 1, F.length(text)))
    return find(docs).withColumn("all", order).select("doc_id", done.alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row per document, from find()."""
    order = (*KINDS, *[k for k in GENERATORS if k not in KINDS])

    def joined(spans, kinds):
        parts = F.concat(*[F.array_sort(F.transform(F.filter(spans, _of(k)), lambda x: F.struct(x["start"], x["end"], x["kind"]))) for k in kinds])
        return F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return find(docs).select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "added"), order).alias("spans"))
