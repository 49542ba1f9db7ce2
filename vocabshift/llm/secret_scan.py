"""Secret scan: base patterns plus a randomness test battery, in DataFrame functions only.

Base kinds (``assign access hex``) are pattern matches with a least length.  The added kind ``random`` covers
tokens in no base span that look drawn at random:

1. A *token* is a maximal run of at least ``LEAST`` letters, digits and ``+/_-`` (with ``=`` padding) that holds
   letters.
2. The *encoding* is the smallest alphabet that has all its characters: hexadecimal, letters of one case, base 32,
   base 36 (one case), letters, base 62, base 64 (standard or URL-safe).
3. Four tests of "drawn independently and uniformly from this alphabet", each a two-sided normal score:
   chi-squared uniformity of the symbols, the number of runs of the lower and upper half of the alphabet,
   the serial correlation of neighbouring symbols, and the mean log frequency that the symbols have in prose (which
   tells words).  The token's p-value is four times the least (at most 1).
4. *False-discovery control*: in each length class the Benjamini-Hochberg step-up rule at level ``FDR`` over all
   tokens of the corpus says which are not random.  Long tokens, whose tests have power, are so held to
   their own kind and not to the many short ones.  Tokens that are not rejected are reported.

Step 4 needs counts over the whole corpus: p-values are counted in ``BINS_PER_DECADE`` logarithmic bins, at most
``MOST_BINS`` per length class, so what reaches the driver is bounded whatever the corpus.  A bin counts by its
upper edge, which can only reject fewer tokens.

Defined cases: a null text is an empty one; offsets count code points, end exclusive; each input row gives one
output row, so repeated rows stay; an empty table has no thresholds and gives no rows; extra columns of the
input stay, but one called as the result column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.spans import NO_SPANS, joined, let, match_spans, tagged

# The base patterns and the alphabets.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+"

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: (least alphabet first) pattern of the whole token without padding, alphabet in order
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[A-Za-z]+$", UPPER + LOWER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)

#: letters of a thousand in prose; capitals among small letters and what is no letter are rarer
PROSE = dict(zip(LOWER, (82, 15, 28, 43, 127, 22, 20, 61, 70, 3, 8, 40, 24, 67, 75, 19, 3, 60, 63, 91, 28, 10, 24, 3, 20, 3), strict=True))
PROSE_CAPITAL, PROSE_OTHER = 0.1, 2.0


def _prose(alphabet: str) -> str:
    """Log frequency in prose of every symbol, scaled to mean 0 and variance 1 over the alphabet, comma-joined."""
    mixed = "a" in alphabet and "A" in alphabet
    size = [PROSE.get(c.lower(), PROSE_OTHER) * (PROSE_CAPITAL if mixed and c.isupper() else 1) for c in alphabet]
    logs = [math.log(x) for x in size]
    mean = sum(logs) / len(logs)
    spread = math.sqrt(sum((x - mean) ** 2 for x in logs) / len(logs))
    return ",".join(f"{(x - mean) / spread:.9f}" for x in logs)


BASE = ("assign", "access", "hex")
LEAST = 20
FDR = 0.05
BINS_PER_DECADE = 8
MOST_BINS = 96
TESTED = "array<struct<start:int,end:int,match:string,len_class:int,p:double>>"


def _when(has: Column, spans: Column) -> Column:
    return F.when(has, spans).otherwise(F.array().cast(NO_SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds."""
    value_6 = r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}$"
    head = r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*"
    assign = F.filter(
        _when(text.rlike("[:=]"), match_spans(text, ASSIGN)), lambda s: s["match"].rlike(head + value_6)
    )
    access = _when(F.contains(text, F.lit("AKIA")), match_spans(text, ACCESS))
    return {"assign": assign, "access": access, "hex": match_spans(text, HEX)}


def _two_sided(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by a rational approximation of the error function (error below 1.5e-7)."""

    def erfc(x: Column) -> Column:
        t = 1 / (1 + x * 0.3275911)
        poly = ((((t * 1.061405429 - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
        return F.greatest(poly * F.exp(-x * x), F.lit(1e-12))

    return let(F.abs(z) / F.sqrt(F.lit(2.0)), erfc)


def _battery(values: Column, k: Column, prose: Column) -> Column:
    """p-value of the four tests for symbol numbers ``values`` of an alphabet of ``k`` symbols."""
    n = F.size(values).cast("double")
    each = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda i: F.size(F.filter(values, lambda v: v == i)))
    squares = F.aggregate(each, F.lit(0.0), lambda acc, c: acc + c.cast("double") * c)
    chi = squares * k / n - n
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    pairs = F.zip_with(
        F.slice(values, F.lit(1), F.size(values) - 1),
        F.slice(values, F.lit(2), F.size(values) - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )

    def rest(pairs: Column) -> Column:
        half, mean = k / 2, (k - 1) / 2
        changes = F.aggregate(
            pairs, F.lit(0.0), lambda acc, x: acc + F.when((x["a"] < half) != (x["b"] < half), 1.0).otherwise(0.0)
        )
        z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        products = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + (x["a"] - mean) * (x["b"] - mean))
        z_serial = products / ((k * k - 1) / 12) / F.sqrt(n - 1)
        z_prose = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.get(prose, v)) / F.sqrt(n)
        least = F.least(_two_sided(z_chi), _two_sided(z_runs), _two_sided(z_serial), _two_sided(z_prose))
        return F.least(least * 4, F.lit(1.0))

    return let(pairs, rest)


def tested_tokens(text: Column) -> Column:
    """The tokens of a text with their length class (power of two) and p-value."""

    def test(s: Column) -> Column:
        core = F.regexp_replace(s["match"], "=+$", "")
        number = F.coalesce(*[F.when(core.rlike(pattern), i) for i, (pattern, _) in enumerate(ENCODINGS)], F.lit(-1))

        def run(number: Column) -> Column:
            alphabet = F.get(F.split(F.lit(" ".join(a for _, a in ENCODINGS)), " "), number)
            prose = F.get(F.split(F.lit(" ".join(_prose(a) for _, a in ENCODINGS)), " "), number)
            weights = F.split(prose, ",").cast("array<double>")
            values = F.transform(F.split(core, ""), lambda c: F.call_function("instr", alphabet, c) - 1)
            p = let(values, lambda v: let(weights, lambda w: _battery(v, F.length(alphabet).cast("double"), w)))
            return F.when(number < 0, 0.0).otherwise(p)

        p = let(number, run)
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["match"].alias("match"),
            F.floor(F.log2(F.length(core).cast("double"))).cast("int").alias("len_class"),
            p.alias("p"),
        )

    lettered = F.filter(match_spans(text, TOKEN), lambda s: s["match"].rlike("[A-Za-z]"))
    return F.when(text.rlike(TOKEN), F.transform(lettered, test)).otherwise(F.array().cast(TESTED))


def rejection_levels(documents: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[int, float]:
    """Per length class the largest p-value that the step-up rule rejects (absent: it rejects none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = documents.select(F.explode(tested_tokens(text)).alias("t"))
    bin_no = F.least(
        F.floor(-F.log10(F.greatest(F.col("t.p"), F.lit(1e-12))) * BINS_PER_DECADE).cast("int"), F.lit(MOST_BINS)
    )
    counts = tokens.groupBy(F.col("t.len_class").alias("c"), bin_no.alias("b")).count().collect()
    levels: dict[int, float] = {}
    for c in {r["c"] for r in counts}:
        own = sorted(((r["b"], r["count"]) for r in counts if r["c"] == c), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            edge = 10.0 ** (-b / BINS_PER_DECADE)
            if edge <= fdr * seen / total:
                levels[c] = edge
    return levels


def secrets(documents: DataFrame, text_col: str = "text", into: str = "secrets", fdr: float = FDR) -> DataFrame:
    """Every input column + ``into``: all spans (start, rank, end, kind, match), by start, then kind."""
    levels = rejection_levels(documents, text_col, fdr)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [tagged(kind, i, spans) for i, (kind, spans) in enumerate(base_spans(text).items())]
    staged = documents.withColumn(into, F.array_sort(F.concat(*kinds)))
    random = F.filter(
        tested_tokens(text),
        lambda t: (t["p"] > _level(t["len_class"], levels))
        & ~F.exists(F.col(into), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    added = tagged("random", len(BASE), random)
    return staged.withColumn(into, F.array_sort(F.concat(F.col(into), added)))


def _level(len_class: Column, levels: dict[int, float]) -> Column:
    out = F.lit(0.0)
    for c, p in sorted(levels.items()):
        out = F.when(len_class == c, F.lit(p)).otherwise(out)
    return out


def report(found: DataFrame, spans: str = "secrets") -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col(spans)).alias("spans"),
    )
