"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens.

Every step is a built-in expression. Tokens are whole runs of the characters of
common encodings, and the parts of such runs between / _ and -, as a path or a
name may stand before a secret. A token's encoding is inferred from its
characters; over that alphabet three statistics are computed from one pass of
counts: chi-squared uniformity, the runs test about the middle of the alphabet,
and the lag-one serial correlation. Each is read twice:

* as a test of randomness; the three p-values are combined (Fisher);
* as a test against structure: that the token is no nearer to uniform than
  written language (chi-squared), or than the stated distances (runs, serial).
  All three have to say so, so the largest p-value counts.

Both p-values are controlled for false discoveries (Benjamini-Hochberg) inside
each stratum of token lengths, from counts over all documents: a token is
reported if structure is rejected and randomness is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

# The base kinds and their patterns; the groups of "assign" are the keyword and the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short can hold no longer one, so the least length may stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 12

#: Candidates of the battery: whole runs of the characters of common encodings; they end at "=", after it if it is padding.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
#: What may join a token to the path or the name before it.
JOINT = "[/_-]"
#: Pattern and alphabet of each encoding, the narrowest first; the last holds every run.
ENCODINGS = (
    ("[0-9]+", "0123456789"),
    ("[0-9a-f]+", "0123456789abcdef"),
    ("[0-9A-F]+", "0123456789ABCDEF"),
    ("[a-z]+", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("[a-z0-9]+", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("[A-Za-z0-9+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("[A-Za-z0-9_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Written language: the probability that two of its letters are equal, at least this multiple of the uniform one, and the variance of the number of equal pairs against that of independent pairs.
LANGUAGE_PAIRS, LEAST_EXCESS, SPREAD = 0.066, 2.0, 1.5
#: Structure in the order of characters: distance of the rate of changes between halves of the alphabet from the expected one, and correlation of neighbours.
APART, CORRELATED = 0.35, 0.7
#: The false-discovery rate of either decision.
FDR = 0.01
#: Lower ends of the strata of token lengths.
STRATA = (20, 24, 32, 48, 64, 96)
#: Elements that running sums are made of at once.
BLOCK = 512

SPAN = "array<struct<start:int,end:int,token:string>>"


def running(values: Column) -> Column:
    """Running sums of an array of int, each element included.

    Appending to an array copies it, so sums are made inside blocks, then over the blocks.
    """

    def sums(v: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"))
        return F.aggregate(v, start, step, lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda at: sums(F.slice(v, at, BLOCK)))

    def joined(b: Column) -> Column:
        ends = sums(F.transform(b, lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0))))
        return F.flatten(F.zip_with(b, ends, lambda x, end: F.transform(x, lambda y: y + end - F.element_at(x, -1))))

    return let(values, lambda v: let(blocks(v), joined))


def _placed(tokens: Column, ends: Column) -> Column:
    return F.zip_with(tokens, ends, lambda t, end: F.struct((end - F.length(t)).alias("start"), end.alias("end"), t.alias("token")))


def spans(text: Column, pattern: str, keep=None, may: Column | None = None) -> Column:
    """Array of (start, end, token) of all leftmost non-overlapping matches, in code points; keep filters the matched strings.

    may: a cheap condition that every text with a match meets.
    The gaps that split() leaves and the matches alternate, so their running lengths are the positions.
    """

    def place(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        lengths = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda t, gap: F.length(gap) + F.length(t))
        return _placed(found, running(lengths))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["token"]))
    has = F.regexp_like(text, F.lit(pattern))
    return F.when(has if may is None else may & has, found).otherwise(F.array().cast(SPAN))


def with_parts(tokens: Column) -> Column:
    """Array of (start, end, token) -> for each token an array of it and its parts between joints that are long enough."""

    def parts(t: Column) -> Column:
        def place(p: Column) -> Column:
            ends = F.transform(running(F.transform(p, lambda x: F.length(x) + 1)), lambda end: t["start"] + end - 1)
            return F.filter(_placed(p, ends), lambda s: F.length(s["token"]) >= STRATA[0])

        return F.when(F.regexp_like(t["token"], F.lit(JOINT)), let(F.split(t["token"], JOINT), place)).otherwise(F.array().cast(SPAN))

    return F.transform(tokens, lambda t: F.concat(F.array(t), parts(t)))


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to about two digits; never quite 0."""
    x = F.abs(z)
    p = F.greatest(0.5 * F.exp(-0.717 * x - 0.416 * x * x), F.lit(1e-300))
    return F.when(z >= 0, p).otherwise(1 - p)


def encoded(token: Column) -> Column:
    """token -> struct of body (without padding) and alphabet (empty without an encoding)."""
    body = F.rtrim(token, F.lit("="))
    alphabet = reduce(lambda rest, e: F.when(F.regexp_like(body, F.lit(f"^{e[0]}$")), F.lit(e[1])).otherwise(rest), reversed(ENCODINGS), F.lit(""))
    return F.struct(body.alias("body"), alphabet.alias("alphabet"))


def counted(x: Column) -> Column:
    """(body, alphabet) -> what the statistics need: n, k, counts of the symbols, characters in the upper half of the alphabet, changes between halves, first, last, and the sum of products of neighbouring codes.

    Work grows with the length of the token, not with its square: nothing inside a lambda depends on the whole of it but bulk string functions, once per symbol.
    """
    n, k = F.length(x["body"]), F.length(x["alphabet"])
    lower = F.ceil(k / 2).cast("int")
    halves = F.call_function("translate", x["body"], x["alphabet"], F.concat(F.repeat(F.lit("0"), lower), F.repeat(F.lit("1"), k - lower)))
    without = lambda s, part: F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))
    codes = F.transform(F.split(x["body"], ""), lambda c: F.instr(x["alphabet"], c) - 1)
    products = lambda c: F.aggregate(F.zip_with(c, F.slice(c, 2, F.size(c)), lambda a, b: (a * b).cast("long")), F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p, F.lit(0).cast("long")))
    order = let(codes, lambda c: F.struct(F.element_at(c, 1).alias("first"), F.element_at(c, -1).alias("last"), products(c).alias("products")))
    counts = F.transform(F.split(x["alphabet"], ""), lambda c: n - F.length(F.replace(x["body"], c, F.lit(""))))
    half = let(halves, lambda h: F.struct(without(h, "1").alias("high"), ((without(h, "01") + without(h, "10")) / 2).alias("changes")))
    return F.struct(n.cast("double").alias("n"), k.cast("double").alias("k"), counts.alias("counts"), half.alias("half"), order.alias("order"))


def statistics(c: Column) -> Column:
    """The result of counted() -> n, k, chi2, z_runs, rate (of changes, less the expected one), serial (correlation); z_runs and serial are null if all characters are in one half, or are equal."""
    n, k = c["n"], c["k"]
    sums = F.aggregate(F.transform(c["counts"], lambda m, i: F.struct(m.cast("double").alias("m"), i.cast("double").alias("i"))), F.struct(F.lit(0.0).alias("same"), F.lit(0.0).alias("one"), F.lit(0.0).alias("two")), lambda a, x: F.struct((a["same"] + x["m"] * x["m"]).alias("same"), (a["one"] + x["m"] * x["i"]).alias("one"), (a["two"] + x["m"] * x["i"] * x["i"]).alias("two")))

    def formed(s: Column) -> Column:
        high, low = c["half"]["high"].cast("double"), n - c["half"]["high"]
        expected, variance = 2 * high * low / n, 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
        mean = s["one"] / n
        square = s["two"] - n * mean * mean
        cross = c["order"]["products"] - mean * (2 * s["one"] - c["order"]["first"] - c["order"]["last"]) + (n - 1) * mean * mean
        return F.struct(
            n.alias("n"),
            k.alias("k"),
            (s["same"] * k / n - n).alias("chi2"),
            F.when(variance > 0, (c["half"]["changes"] - expected) / F.sqrt(variance)).alias("z_runs"),
            ((c["half"]["changes"] - expected) / (n - 1)).alias("rate"),
            F.when(square > 1e-9, cross / square).alias("serial"),
        )

    return let(sums, formed)


def p_values(s: Column) -> Column:
    """The result of statistics() -> p_random and p_structured, both 0 to 1."""
    n, df = s["n"], s["k"] - 1
    z_chi = (F.pow(F.greatest(s["chi2"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    runs = F.coalesce(2 * tail(F.abs(s["z_runs"])), F.lit(1e-300))
    serial = F.coalesce(2 * tail(F.abs(s["serial"] + 1 / (n - 1)) * F.sqrt(n)), F.lit(1e-300))
    y = -(F.ln(F.least(tail(z_chi), F.lit(1.0))) + F.ln(F.least(runs, F.lit(1.0))) + F.ln(F.least(serial, F.lit(1.0))))
    pairs, kappa = n * (n - 1) / 2, F.greatest(F.lit(LANGUAGE_PAIRS), LEAST_EXCESS / s["k"])
    equal = (n * (s["chi2"] + n) / s["k"] - n) / 2  # pairs of equal characters
    against_chi = tail((pairs * kappa - equal) / F.sqrt(pairs * kappa * (1 - kappa) * SPREAD))
    against_runs = tail((APART - F.abs(s["rate"])) * 2 * F.sqrt(n - 1))
    r = F.least(F.abs(s["serial"]), F.lit(0.999999))
    against_serial = F.coalesce(tail((F.atanh(F.lit(CORRELATED)) - F.atanh(r)) * F.sqrt(n - 3)), F.lit(1.0))
    return F.struct(F.least(F.exp(-y) * (1 + y + y * y / 2), F.lit(1.0)).alias("p_random"), F.greatest(against_chi, against_runs, against_serial).alias("p_structured"))


def battery(tokens: Column) -> Column:
    """A token and its parts, as an array of (start, end, token) -> those with an encoding, as (start, end, whole, stratum, p_random, p_structured)."""
    known = F.filter(F.transform(tokens, lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), (i == 0).alias("whole"), encoded(t["token"]).alias("x"))), lambda t: (F.length(t["x"]["alphabet"]) > 0) & (F.length(t["x"]["body"]) >= STRATA[0]))
    stratum = lambda n: reduce(lambda s, least: F.when(n >= least, F.lit(least)).otherwise(s), STRATA, F.lit(0))

    def tested(t: Column) -> Column:
        p = let(counted(t["x"]), lambda c: let(statistics(c), p_values))
        return let(p, lambda q: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["whole"].alias("whole"), stratum(F.length(t["x"]["body"])).alias("stratum"), q["p_random"].alias("p_random"), q["p_structured"].alias("p_structured")))

    return F.transform(known, tested)


#: p-values are counted on a grid of this many steps per power of ten, as far as LAST.
STEPS, LAST = 10, 400


def _step(p: Column) -> Column:
    return F.least(F.lit(LAST), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * STEPS)).cast("int")


def thresholds(found: DataFrame, fdr: float = FDR) -> DataFrame:
    """kind (of p-value), stratum, least: the grid step from which a p-value is a discovery; a row per kind and stratum at most."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col("c.stratum").alias("stratum"), _step(F.col(f"c.{k}")).alias("step")) for k in ("p_random", "p_structured")]
    counts = found.select(F.explode(F.flatten("candidates")).alias("c")).select(F.inline(F.array(*kinds))).groupBy("kind", "stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("kind", "stratum").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("kind", "stratum")
    counts = counts.withColumns({"as_small": F.sum("n").over(up), "tests": F.sum("n").over(whole)})
    met = F.pow(F.lit(10.0), -F.col("step") / STEPS) <= fdr * F.col("as_small") / F.col("tests")
    return counts.filter(met).groupBy("kind", "stratum").agg(F.min("step").alias("least"))


def _of_kind(name: str, kind: int) -> Column:
    return F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["token"].alias("token")))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, found: array of (start, end, kind, token), by start and then kind, one row per row of docs.

    Positions are code points, the end exclusive. Null and empty texts have no
    spans. Spans of kind ``random`` overlap no other span. Other columns of docs
    are not read, rows may repeat, and an empty table gives an empty table.
    Runs in part at once: the candidates' p-values are written and counted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    found = docs.select(
        "doc_id",
        spans(text, ASSIGN, keep=lambda m: F.length(value(m)) >= MIN_VALUE, may=F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))).alias("assign"),
        spans(text, ACCESS, may=F.contains(text, F.lit("AKIA"))).alias("access"),
        spans(text, HEX).alias("hex"),
        F.transform(with_parts(spans(text, TOKEN)), battery).alias("candidates"),
    )
    found = cut(found)  # a few spans per document: both the counts and the spans are read from it
    limit = thresholds(found, fdr).agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.col("stratum").cast("string")), "least"))).alias("limit"))
    found = found.withColumn("_one", F.lit(1)).join(F.broadcast(limit.withColumn("_one", F.lit(1))), "_one", "left")  # one row of twelve entries at most
    base = F.concat(*[_of_kind(k, i) for i, k in enumerate(KINDS[:3])])
    found = found.withColumn("base", F.array_sort(base))
    rejected = lambda c, kind: F.coalesce(_step(c[kind]) >= F.col("limit")[F.concat(F.lit(kind), c["stratum"].cast("string"))], F.lit(False))
    is_random = lambda c: rejected(c, "p_structured") & ~rejected(c, "p_random") & ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    # A part of a run that is reported as a whole says nothing more.
    alone = lambda run: F.when(F.try_element_at(run, F.lit(1))["whole"], F.slice(run, 1, 1)).otherwise(run)
    chosen = F.flatten(F.transform("candidates", lambda run: let(F.filter(run, is_random), alone)))
    more = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"), F.lit("").alias("token")))
    return found.select("doc_id", "assign", "access", "hex", "base", F.array_sort(F.concat("base", more)).alias("found"))


def _joined(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scan(docs).select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
