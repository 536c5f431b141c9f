"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans; those of further kinds are sought in what the base kinds' valid spans leave. Labelers (format,
gazetteer, context, borders) vote on each span. Votes are counted over the whole corpus; expectation-maximisation over
these counts estimates each labeler's reliability and the odds of each pattern of votes. With these odds as soft labels a
logistic classifier is trained on what spans look like (length, characters, what stands beside them), not on the votes.
The base kinds' valid spans always stay; the other spans stay where the classifier says so. Finding and scoring spans
stays within a row and takes time in proportion to its text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import read, written

BASE_KINDS = ("email", "ip", "card", "phone")
#: Pattern and gate (a cheap test that any text with a match passes) by kind. Same matches as the plain patterns, written
#: so that a long run of characters is tried once: a run starts where the last match ended or no earlier character joins.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"~[0-9]\.[0-9]"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])", r"~[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"~\+[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"~[A-Z]{2}[0-9]{2}[ A-Z0-9]"),
    "local_phone": (r"(?<![0-9+(.-])(?<![0-9+] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"~[0-9]{3}[ .-][0-9]{4}"),
    "secret": (r"(?<![A-Za-z])(?:(?i:token|secret|password|passwd|api[_-]?key))\s{0,3}[=:]\s{0,3}[\x22\x27]?[A-Za-z0-9_+/-]{16,}+", r"~(?i)(?:token|secret|passw|api[_-]?key)"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"~[0-9]-[0-9]{2}-[0-9]"),
}
KINDS = tuple(PATTERNS)
#: Words before a span that speak for its kind, and words that speak against any kind.
CUES = {
    "email": "mail|contact|write|reach|e-mail|courriel|correo|kontakt",
    "ip": "ip|host|address|server|adresse|login|client",
    "card": "card|visa|master|amex|credit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|cell|whatsapp|numéro|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "local_phone": "phone|call|tel|mobile|fax|cell",
    "secret": "token|secret|password|key",
    "ssn": "ssn|social|security",
}
COUNTER_CUES = "version|release|isbn|issn|order|invoice|part no|serial|section|chapter|build|rfc"
#: Gazetteers: endings of mail domains, country calling codes, first digits of card issuers, countries of accounts.
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|it|uk|eu|info|co|us|ca|ch|at|be|nl|example"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|42[013]|85[0-9]|97[0-9]"
ISSUERS = "3[47]|3[0689]|4|5[1-5]|2[2-7]|6"
ACCOUNTS = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR"
GAZETTEER = {
    "email": rf"(?i)\.(?:{DOMAINS})$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": rf"^(?:{ISSUERS})",
    "phone": rf"^\+(?:{CALLING})",
    "iban": rf"^(?:{ACCOUNTS})",
    "local_phone": r"^\(?[2-9]",
    "secret": r"[0-9].*[A-Za-z]|[A-Za-z].*[0-9]",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
LABELERS = ("format", "gazetteer", "context", "borders")
BEFORE = 48
ROUNDS, STEPS, STEP, DECAY = 50, 300, 0.5, 1e-3
#: What a span looks like, each with so many values: length, share of digits, other characters than letters and digits, what stands before and after.
LOOKS = {"size": 8, "digits": 5, "marks": 4, "lead": 5, "tail": 5}
SPAN = f"struct<kind:string,start:bigint,end:bigint,valid:boolean,votes:array<int>,{','.join(f'{c}:int' for c in LOOKS)}>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"
#: Matches whose lengths are added up at a time.
BLOCK = 64
#: Stands for each character of a span that is taken.
TAKEN = "\u0001"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def pieces(text: Column, pattern: str) -> Column:
    """m: the matches; p: what stands between them, before the first and after the last; k: 1 up to their number."""
    found = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return once(found, lambda x: F.struct(x["p"].alias("p"), x["m"].alias("m"), F.when(F.size(x["m"]) > 0, F.sequence(F.lit(1), F.size(x["m"]))).otherwise(F.expr("cast(array() as array<int>)")).alias("k")))


def starts(lengths: Column) -> Column:
    """The sums of the elements before each. Sums of whole blocks first, so that no element adds up more than a block."""

    def block_sum(b: Column) -> Column:
        return F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("long"), lambda s, x: s + x)

    def step(state: Column, b: Column) -> Column:
        return F.struct((state["at"] + block_sum(b)).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    first = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out")), step, lambda s: s["out"])

    def start(k: Column, before: Column) -> Column:
        b = F.floor(k / BLOCK).cast("int")
        return before[b] + F.aggregate(F.slice(lengths, b * BLOCK + 1, k - b * BLOCK), F.lit(0).cast("long"), lambda s, x: s + x)

    return once(first, lambda before: F.transform(lengths, lambda x, k: start(k, before)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    back = F.split(F.reverse(digits), "")
    values = F.transform(back, lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return text.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return F.length(F.replace(text, F.lit(" "), F.lit(""))).between(15, 34)
    return F.lit(True)


def beside(c: Column) -> Column:
    """What a character is: none or a line's end, blank, an opening or assigning mark, a letter or digit, any other."""
    return F.when((c == "") | c.isin("\n", "\r"), 0).when(c.rlike(r"^\s"), 1).when(c.isin(*":=\"'([{<"), 2).when(c.rlike(r"^[\p{L}\p{N}]"), 3).otherwise(4)


def described(kind: str, text: Column, before: Column, after: Column, start: Column) -> Column:
    """A span (SPAN) from its text and the text before and after it."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    ok, cues, last, first = valid(kind, text), F.lower(F.right(before, F.lit(BEFORE))), F.right(before, F.lit(1)), F.left(after, F.lit(1))
    glued = last.rlike(r"[\p{L}\p{N}]") | first.rlike(r"[\p{L}\p{N}]")
    votes = F.array(
        vote(ok, ~ok),
        vote(text.rlike(GAZETTEER[kind]), ~text.rlike(GAZETTEER[kind])),
        vote(cues.rlike(rf"(?:{CUES[kind]})"), cues.rlike(rf"(?:{COUNTER_CUES})")),
        vote(~glued, glued),
    )
    length = F.length(text)
    looks = {
        "size": F.least(F.lit(7), F.floor(length / 6)),
        "digits": F.floor(4 * F.length(F.regexp_replace(text, "[^0-9]", "")) / length),
        "marks": F.least(F.lit(3), F.length(F.regexp_replace(text, r"[\p{L}\p{N}]", ""))),
        "lead": beside(last),
        "tail": beside(first),
    }
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + length).alias("end"), ok.alias("valid"), votes.alias("votes"), *(v.cast("int").alias(c) for c, v in looks.items()))


def gated(kind: str, text: Column) -> Column:
    gate = PATTERNS[kind][1]
    return text.rlike(gate[1:]) if gate[0] == "~" else F.contains(text, F.lit(gate))


def spans_of(kind: str, text: Column) -> Column:
    def spans(x: Column) -> Column:
        lengths = F.transform(x["k"], lambda k: (F.length(x["p"][k - 1]) + F.length(x["m"][k - 1])).cast("long"))
        placed = once(starts(lengths), lambda at: F.transform(x["k"], lambda k: described(kind, x["m"][k - 1], x["p"][k - 1], x["p"][k], at[k - 1] + F.length(x["p"][k - 1]))))
        return F.when(F.size(x["m"]) > 0, placed).otherwise(F.expr(NO_SPANS))

    return F.when(gated(kind, text), once(pieces(text, PATTERNS[kind][0]), spans)).otherwise(F.expr(NO_SPANS))


def replaced(kind: str, text: Column, new: Callable[[Column, Column, Column], Column]) -> Column:
    """text with each match m of a kind as new(m, what stands before, what stands after)."""

    def put(x: Column) -> Column:
        parts = F.transform(x["k"], lambda k: F.concat(x["p"][k - 1], new(x["m"][k - 1], x["p"][k - 1], x["p"][k])))
        return F.when(F.size(x["m"]) > 0, F.concat(F.array_join(parts, ""), x["p"][F.size(x["m"])])).otherwise(text)

    return F.when(gated(kind, text), once(pieces(text, PATTERNS[kind][0]), put)).otherwise(text)


def proposed(docs: DataFrame) -> DataFrame:
    """docs with _text (null: empty) and _spans: all proposed spans by kind as listed, then start."""
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("_spans", F.concat(*(spans_of(k, F.col("_text")) for k in BASE_KINDS))).withColumn("_left", F.col("_text"))
    for kind in BASE_KINDS:
        held = F.exists("_spans", lambda s: s["valid"] & (s["kind"] == kind))  # noqa: B023
        taken = replaced(kind, F.col("_left"), lambda m, *_: F.when(valid(kind, m), F.repeat(F.lit(TAKEN), F.length(m))).otherwise(m))  # noqa: B023
        out = out.withColumn("_left", F.when(held, taken).otherwise(F.col("_left")))
    return out.withColumn("_spans", F.concat("_spans", *(spans_of(k, F.col("_left")) for k in KINDS if k not in BASE_KINDS))).drop("_left")


def estimate(counts: dict[tuple, int]) -> dict[tuple, float]:
    """Expectation-maximisation: the probability that a span is personal data, by (kind, votes).

    Each labeler has a chance of each vote for true and for false spans; each kind a share of true ones. The start trusts
    the majority of votes. There are at most kinds x 3 ** labelers patterns, however large the corpus.
    """
    p = {key: 1 / (1 + math.exp(-1.5 * sum(key[1]))) for key in counts}
    for _ in range(ROUNDS):
        share = {}
        for kind in {key[0] for key in counts}:
            rows = [(n, p[key]) for key, n in counts.items() if key[0] == kind]
            share[kind] = (sum(n * q for n, q in rows) + 1) / (sum(n for n, _ in rows) + 2)
        chance: dict[tuple, float] = {}
        for k in range(len(LABELERS)):
            for truth in (0, 1):
                weight = {v: 1.0 for v in (-1, 0, 1)}
                for key, n in counts.items():
                    weight[key[1][k]] += n * (p[key] if truth else 1 - p[key])
                for v in weight:
                    chance[k, truth, v] = weight[v] / sum(weight.values())
        for key in counts:
            yes, no = math.log(share[key[0]]), math.log(1 - share[key[0]])
            for k, v in enumerate(key[1]):
                yes += math.log(chance[k, 1, v])
                no += math.log(chance[k, 0, v])
            p[key] = 1 / (1 + math.exp(max(-40, min(40, no - yes))))
    return p


def inputs(key: tuple) -> list[float]:
    """One of each: 1, the kind, and what a span of (kind, *LOOKS) looks like."""
    return [1.0, *(float(key[0] == k) for k in KINDS), *(float(v == k) for v, n in zip(key[1:], LOOKS.values(), strict=True) for k in range(n))]


def train(rows: dict[tuple, tuple[int, float]]) -> list[float]:
    """Weights of the span classifier: logistic regression on the looks, each weighted by the logarithm of its count, with the mean odds as labels."""
    if not rows:
        return [0.0] * (1 + len(KINDS) + sum(LOOKS.values()))
    keys = sorted(rows)
    x = np.array([inputs(k) for k in keys])
    n, q = np.log1p([rows[k][0] for k in keys]), np.array([rows[k][1] / rows[k][0] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        error = n / n.sum() * (1 / (1 + np.exp(-np.clip(x @ w, -40, 40))) - q)
        w -= STEP * (x.T @ error + DECAY * w)
    return w.tolist()


def fit(spans: DataFrame) -> list[float]:
    """Trains the classifier on all of _spans; the driver gets a row for each pattern of votes and for each look."""
    flat = spans.select(F.explode("_spans").alias("s")).select("s.*")
    counts = {(r["kind"], tuple(r["votes"])): r["n"] for r in flat.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # 648 at most
    if not counts:
        return train({})
    odds = spans.sparkSession.createDataFrame([(k, list(v), q) for (k, v), q in estimate(counts).items()], "kind string, votes array<int>, odds double")
    seen = flat.join(F.broadcast(odds), ["kind", "votes"]).groupBy("kind", *LOOKS).agg(F.count(F.lit(1)).alias("n"), F.sum("odds").alias("odds"))
    return train({tuple(r[c] for c in ("kind", *LOOKS)): (r["n"], r["odds"]) for r in seen.collect()})  # 32,000 at most


def score(s: Column, weights: list[float]) -> Column:
    """The classifier's log odds of a span."""
    parts = iter(weights)
    out = F.lit(next(parts)) + F.create_map(*(x for k in KINDS for x in (F.lit(k), F.lit(next(parts)))))[s["kind"]]
    for c, n in LOOKS.items():
        out = out + F.get(F.array(*(F.lit(next(parts)) for _ in range(n))), s[c])
    return out


def chosen(spans: DataFrame, weights: list[float]) -> DataFrame:
    """spans with _base and _all: the base kinds' valid spans, and with them the others that the classifier keeps."""
    with_base = spans.withColumn("_base", F.filter("_spans", lambda s: s["kind"].isin(*BASE_KINDS) & s["valid"]))
    more = F.filter("_spans", lambda s: ~s["kind"].isin(*BASE_KINDS) & s["valid"] & (score(s, weights) > 0))
    return with_base.withColumn("_all", F.concat("_base", more))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no spans. The fit sees every span, so the texts are searched once."""
    spans = written(proposed(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_spans"), "spans")
    out = chosen(spans, fit(spans))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every found span in the text replaced by its kind in brackets, kind by kind as listed; null texts stay null."""
    weights = fit(written(proposed(docs.select("text")).select("_spans"), "spans"))
    text = "_redacted"
    out = docs.withColumn(text, F.col("text").cast("string"))
    for kind in KINDS:

        def new(m: Column, before: Column, after: Column, kind: str = kind) -> Column:
            keep = valid(kind, m)
            if kind not in BASE_KINDS:
                keep = keep & (score(described(kind, m, before, after, F.lit(0).cast("long")), weights) > 0)
            return F.when(keep, F.lit(f"[{kind.upper()}]")).otherwise(m)

        out = out.withColumn(text, replaced(kind, F.col(text), new))
    return out.withColumn("text", F.col(text)).select(docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data redacted; n_chars follows the text."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


QUERIES = {"op7_personal_data": query}
