r"""Personal data by weak supervision (DataFrame functions only).

Candidate spans come from one strict and one loose pattern per kind.  Three labelers
vote on each (for, against or silent): the pattern with its arithmetic checks, a
gazetteer of endings, issuer and country prefixes, and the words around the span.
Expectation-maximisation over the table of vote patterns estimates each labeler's
reliability without any labels, and the posteriors train the final span classifier, a
logistic regression over the votes and the span's shape.  It decides on every span
that the strict rules do not settle; spans that pass the strict rules always stay.

The patterns find the same spans as their plain forms (``STRICT_PLAIN``), but never
look twice at a character: runs are possessive and begin where a run begins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import any_of, stored

KINDS = ("email", "ip", "card", "phone")

#: The strict patterns as they are defined.
STRICT_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: \G: a run that begins where the last match ended is a beginning too.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Written-out addresses, version 6 addresses, bare national and 00 numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+"
             r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"
             r"|(?<![0-9+.-])00[1-9][0-9](?:[\x20-]?[0-9]){6,11}+(?![0-9.-])",
}
#: Fixed values of the gazetteer: common ends of domains, issuers' first digits, calling codes.
ENDINGS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu|us|ca|au|ch|at|be|pl|pt|br|mx|ar|jp|cn|in|ru"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
CODES = r"^(?:00)?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "e-?mail|mail|contact|write|reach",
    "ip": "ip|host|server|address|login|ping",
    "card": "card|visa|mastercard|amex|credit|debit|payment|pay",
    "phone": "tel|phone|call|fax|mobile|cell|ring|dial",
}
AGAINST = "version|release|isbn|issn|order|invoice|section|chapter|page|figure|table|serial|part"
BEFORE, AFTER = 32, 16


def _found(text: Column, pattern: str, kind: str, strict: bool, maybe: Column) -> Column:
    """Matches of one pattern, each with the length of the gap before it and some text on both sides."""
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"),
                          F.slice(gaps, F.lit(2), F.greatest(F.size(gaps), F.lit(1))).alias("next"))
    each = F.transform(F.filter(zipped, lambda z: z["m"].isNotNull()), lambda z: F.struct(
        F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), F.length(z["g"]).cast("bigint").alias("gap"),
        z["m"].alias("m"), F.lower(F.right(z["g"], F.lit(BEFORE))).alias("before"),
        F.lower(F.left(z["next"], F.lit(AFTER))).alias("after")))
    return F.when(maybe, each)


def candidates(docs: DataFrame) -> DataFrame:
    """Stored table: one row per document (row, doc_id) with the array of its candidate spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                         text.alias("text"))
    text = F.col("text")
    digits = text.rlike("[0-9]")
    may = {"email": F.contains(text, F.lit("@")), "ip": digits, "card": digits,
           "phone": F.contains(text, F.lit("+")) & digits}
    loose = {"email": text.rlike(r"[(\[{]at[)\]}]"), "ip": F.contains(text, F.lit(":")) & digits, "phone": digits}
    arrays = [_found(text, p[k], k, p is STRICT, m[k]) for p, m in ((STRICT, may), (LOOSE, loose)) for k in p]
    return stored(marked.select("row", "doc_id", F.array_compact(F.array(*arrays)).alias("found")), "pii")


def _luhn(digits: Column, n: Column) -> Column:
    def one(i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + one(i)) % 10 == 0


def _case(values: dict[str, Column], other: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col("kind") == k, v) if out is None else out.when(F.col("kind") == k, v)
    return out.otherwise(other)


def spans(found: DataFrame) -> DataFrame:
    """One row per candidate: row, kind, order, start, end (code points, end exclusive), base, votes and shape."""
    each = (found.select("row", F.posexplode(F.flatten("found")).alias("at", "s")).select("row", "at", "s.*"))
    upto = W.partitionBy("row", "kind", "strict").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.length("m")
    each = (each.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
            .withColumn("digits", F.regexp_replace("m", "[^0-9]", "")).withColumn("n", F.length("digits")))
    d, n = F.col("digits"), F.col("n")
    short = lambda p: F.regexp_replace(p, "^0+", "")  # noqa: E731  compared as text of equal length
    bytes_ok = F.forall(F.split("m", r"\."), lambda p: (F.length(short(p)) < 3)
                        | ((F.length(short(p)) == 3) & (short(p) <= "255")))
    luhn = F.when(n.between(13, 19), _luhn(d, n)).otherwise(False)
    valid = _case({"email": F.lit(True), "ip": bytes_ok, "card": n.between(16, 19) & luhn,
                   "phone": n.between(8, 15)}, F.lit(False))
    passes = _case({"card": luhn}, valid | ~F.col("strict"))  # shorter card numbers may be cards too
    gazetteer = _case({
        "email": F.col("m").rlike(rf"(?i)(?:\.|dot[)\]}}]) ?(?:{ENDINGS})$"), "ip": ~d.rlike("^0"),
        "card": d.rlike(ISSUERS), "phone": d.rlike(CODES)}, F.lit(False))
    cue = any_of([(F.col("kind") == k) & F.col("before").rlike(rf"\b(?:{w})\b") for k, w in CUES.items()])
    against = F.col("before").rlike(rf"\b(?:{AGAINST})\b[^a-z]*$")
    sign = lambda c: F.when(c, 1).otherwise(-1)
    return each.select(
        "row", "kind", _case({k: F.lit(i) for i, k in enumerate(KINDS)}, F.lit(9)).alias("order"), "start", "end",
        "strict", (F.col("strict") & valid).alias("base"), sign(passes).alias("v_pattern"),
        sign(gazetteer).alias("v_gazetteer"),
        F.when(against, -1).when(cue, 1).otherwise(0).alias("v_context"),
        (F.col("before").rlike(r"(?:^|[^\p{L}0-9])$") & F.col("after").rlike(r"^(?:$|[^\p{L}0-9])")).alias("apart"),
        F.col("m").rlike(r"[\x20()-]").alias("grouped"))


VOTES = ("v_pattern", "v_gazetteer", "v_context")
SHAPE = ("strict", "apart", "grouped")


def reliabilities(patterns: list[dict], rounds: int = 60) -> dict[str, dict]:
    """Expectation-maximisation over counted vote patterns, for one kind after the other.

    Returns for each kind the prior and, for each labeler, the chance of each vote given a
    true and a false span.  It starts from labelers that are right four times in five.
    """
    out = {}
    for kind in KINDS:
        own = [p for p in patterns if p["kind"] == kind]
        prior = 0.5
        table = {v: {True: {1: 0.8, 0: 0.5, -1: 0.2}, False: {1: 0.2, 0: 0.5, -1: 0.8}} for v in VOTES}
        for _ in range(rounds if own else 0):
            for p in own:
                p["q"] = posterior(p, prior, table)
            total = sum(p["n"] for p in own)
            # counts of one half keep every chance off zero and one
            prior = (sum(p["n"] * p["q"] for p in own) + 0.5) / (total + 1)
            for v in VOTES:
                for truth in (True, False):
                    share = {x: 0.5 + sum(p["n"] * (p["q"] if truth else 1 - p["q"]) for p in own if p[v] == x)
                             for x in (1, 0, -1)}
                    table[v][truth] = {x: s / sum(share.values()) for x, s in share.items()}
        out[kind] = {"prior": prior, "table": table}
    return out


def posterior(p: dict, prior: float, table: dict) -> float:
    yes = math.log(prior) + sum(math.log(table[v][True][p[v]]) for v in VOTES)
    no = math.log(1 - prior) + sum(math.log(table[v][False][p[v]]) for v in VOTES)
    return 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))


def _features(p: dict) -> list[float]:
    return [1.0, *[float(p[v]) for v in VOTES], *[float(p[s]) for s in SHAPE],
            *[float(p["kind"] == k) for k in KINDS[1:]]]


def train(patterns: list[dict], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Logistic regression from features to the posteriors ``q`` of counted patterns."""
    w = [0.0] * (1 + len(VOTES) + len(SHAPE) + len(KINDS) - 1)
    total = sum(p["n"] for p in patterns) or 1
    rows = [(_features(p), p["n"] / total, p["q"]) for p in patterns]
    for _ in range(rounds):
        grad = [decay * x for x in w]
        for f, share, q in rows:
            z = sum(a * b for a, b in zip(w, f))
            err = share * (1 / (1 + math.exp(-max(-60.0, min(60.0, z)))) - q)
            for i, x in enumerate(f):
                grad[i] += err * x
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


@dataclass
class SpanModel:
    """What was learnt: reliabilities by kind, and the classifier's weights."""

    reliability: dict[str, dict]
    weights: list[float]

    def probability(self) -> Column:
        cols = [F.lit(1.0), *[F.col(v).cast("double") for v in (*VOTES, *SHAPE)],
                *[(F.col("kind") == k).cast("double") for k in KINDS[1:]]]
        z = sum((F.lit(w) * c for w, c in zip(self.weights, cols)), F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def learn(each: DataFrame) -> SpanModel:
    """Fit the model on all candidate spans; the driver sees counts of patterns only (at most
    4 kinds x 18 votes x 8 shapes)."""
    keys = ["kind", *VOTES, *SHAPE]
    patterns = [r.asDict() for r in each.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys).collect()]
    known = reliabilities(patterns)
    for p in patterns:
        p["q"] = posterior(p, **known[p["kind"]])
    return SpanModel(known, train(patterns))


def personal_data(docs: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, SpanModel]:
    """For each row of ``docs``: row, doc_id and ``spans``, an array of (order, kind, start, end,
    base, probability) sorted by kind and start; and the model.

    Null texts count as empty and have no spans; repeated rows are told apart.  A loose
    span that touches a strict match of its kind is left to that match.
    """
    found = candidates(docs)
    each = stored(spans(found), "spans")
    model = learn(each)
    by = W.partitionBy("row", "kind").orderBy("start", "end")
    strict_end = F.max(F.when(F.col("strict"), F.col("end"))).over(by.rowsBetween(W.unboundedPreceding, -1))
    strict_start = F.min(F.when(F.col("strict"), F.col("start"))).over(by.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(strict_end <= F.col("start"), F.lit(True))
            & F.coalesce(strict_start >= F.col("end"), F.lit(True)))
    judged = (each.withColumn("free", F.col("strict") | free).withColumn("probability", model.probability())
              .where(F.col("base") | (F.col("free") & (F.col("probability") >= threshold))))
    # a document's own spans, no more, come together here
    lists = judged.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("order", "start", "end", "kind", "base", "probability"))).alias("spans"))
    return found.select("row", "doc_id").join(lists, "row", "left"), model
