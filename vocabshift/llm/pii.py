"""Personal data by patterns, checksums and context, in DataFrame functions only.

Patterns propose spans; validators confirm them (octets up to 255, Luhn, digit counts, mod-97); words near
an uncertain span move its score up or down.

* ``email ip card phone`` are the base kinds: a proposal that passes its validator has score 1 and stays.
* ``iban`` (added): country code, two check digits, 11 to 30 letters or digits with single spaces; kept when the
  rearranged number is 1 modulo 97.  Words and numbers may follow after a space, so every word end of the run is
  tried: that with the country's length, else (where the length is not known) the last that leaves an
  unspaced number or groups of four, else the end of the run.
* ``tel`` (added): national numbers of 8 to 15 digits without ``+``, in two or more groups.  Base score 0.3;
  a telephone word within ``NEAR`` characters before it adds 0.4, a word for amounts, orders or references
  takes 0.3; kept from 0.5.  A ``tel`` inside a base span or an ``iban`` is dropped.

The email and address patterns look at the character before a start, or at the end of the last match,
and use possessive repeats: that finds the spans that the plain patterns find, in time proportional to the
text, where the plain ones try every suffix of a long run again.

Defined cases: a null text is an empty one (no spans, digest of the empty string); offsets count code
points; each input row gives one output row, so repeated rows and ids stay; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocabshift.llm.spans import BLOCK, NO_SPANS, TAGGED, joined, let, match_spans, tagged

# The base patterns in possessive form, and the added ones.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: the head of a number, looking ahead at the longest run after it (and a letter or digit that cuts the run's last word)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))"
IBAN_GROUPS = r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]+|(?:\x20[A-Z0-9]{4})*\x20[A-Z0-9]{1,4})$"
IBAN_MOST = 34
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
TEL = r"(?<![0-9A-Za-z+])[0-9(][0-9()]{1,6}+(?:[\x20./-][0-9()]{2,9}+){1,5}+(?![0-9A-Za-z])"

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
NEAR = 30
TEL_WORDS = r"(?i)(?:\btel\b|tel\.|t[eé]l[eé]fono?|t[eé]l[eé]phone|\bphone|\bcall\b|\bfax\b|\bmobil|m[oó]vil|\bhandy\b|\banruf)"
OTHER_WORDS = r"(?i)(?:\border|\binvoice|\brechnung|\bfactur|\bcommande|\bpedido|\bref\b|\bnr\b|\bisbn|[$€£])"
TEL_BASE, TEL_UP, TEL_DOWN, KEEP = 0.3, 0.4, 0.3, 0.5

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "tel")
MASK_BLOCKS = (4_096, 64)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _octets_ok(match: Column) -> Column:
    return match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")


def _mod97(match: Column) -> Column:
    """The ISO 7064 remainder of an IBAN, character by character (A is 10 ... Z is 35)."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(
        F.split(moved, ""),
        lambda ch: F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55),
    )
    step = lambda acc, v: F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97
    return F.aggregate(values, F.lit(0), step)


def _when(has: Column, spans: Column) -> Column:
    return F.when(has, spans).otherwise(F.array().cast(NO_SPANS))


def _ibans(text: Column) -> Column:
    """Confirmed account numbers, the leftmost of those that overlap."""

    def confirmed(head: Column, run: Column) -> Column:
        return let(F.concat(head["match"], run), lambda whole: let(ends(whole), lambda e: span(head, whole, e)))

    def ends(whole: Column) -> Column:
        upto = lambda e: F.substring(whole, F.lit(1), e)
        plain = lambda e: F.length(F.regexp_replace(upto(e), " ", ""))
        country = F.substring(whole, 1, 2)
        length = F.coalesce(*[F.when(country.isin(c.split()), n) for n, c in IBAN_LENGTHS.items()], F.lit(0))
        good = F.filter(
            F.sequence(F.lit(15), F.length(whole)),
            lambda e: F.substring(whole, e + 1, F.lit(1)).isin("", " ")
            & upto(e).rlike("[A-Z0-9]$")
            & plain(e).between(15, IBAN_MOST)
            & (_mod97(upto(e)) == 1),
        )

        def best(good: Column, length: Column) -> Column:
            usual = F.filter(good, lambda e: plain(e) == length)
            other = F.filter(
                good, lambda e: (e == F.length(whole)) | ((length == 0) & upto(e).rlike(IBAN_GROUPS))
            )
            return F.coalesce(F.array_max(usual), F.array_max(other), F.lit(0))

        return let(good, lambda g: let(length, lambda n: best(g, n)))

    def span(head: Column, whole: Column, end: Column) -> Column:
        return F.struct(
            head["start"].alias("start"),
            (head["start"] + end).alias("end"),
            F.substring(whole, F.lit(1), end).alias("match"),
        )

    def apart(spans: Column) -> Column:
        dropped = F.aggregate(
            spans,
            F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("starts")),
            lambda acc, s: F.struct(
                F.when(s["start"] < acc["upto"], acc["upto"]).otherwise(s["end"]).alias("upto"),
                F.when(s["start"] < acc["upto"], F.concat(acc["starts"], F.array(s["start"])))
                .otherwise(acc["starts"])
                .alias("starts"),
            ),
            lambda acc: acc["starts"],
        )
        return let(dropped, lambda d: F.filter(spans, lambda s: ~F.array_contains(d, s["start"])))

    runs = F.regexp_extract_all(text, F.lit(IBAN), F.lit(1))
    found = F.filter(F.zip_with(match_spans(text, IBAN), runs, confirmed), lambda s: s["end"] > s["start"])
    return let(found, apart)


def proposals(text: Column) -> dict[str, Column]:
    """Confirmed spans of every kind but ``tel``, by kind."""
    digit = text.rlike("[0-9]")
    email = _when(F.contains(text, F.lit("@")), match_spans(text, EMAIL))
    ip = F.filter(_when(text.rlike(r"[0-9]\.[0-9]"), match_spans(text, IP)), lambda s: _octets_ok(s["match"]))
    card = F.filter(
        _when(digit, match_spans(text, CARD)),
        lambda s: F.length(_digits(s["match"])).between(14, 19) & F.call_function("luhn_check", _digits(s["match"])),
    )
    phone = F.filter(
        _when(text.rlike(r"\+[0-9]"), match_spans(text, PHONE)),
        lambda s: F.length(_digits(s["match"])).between(10, 15),
    )
    iban = _when(text.rlike("[A-Z]{2}[0-9]{2}"), _ibans(text))
    return {"email": email, "ip": ip, "card": card, "phone": phone, "iban": iban}


def _tel(text: Column, taken: Column) -> Column:
    """National telephone numbers whose context makes them likely."""

    def score(s: Column) -> Column:
        first = F.greatest(s["start"] - NEAR, F.lit(0))
        before = F.substring(text, first + 1, s["start"] - first)
        up = F.when(before.rlike(TEL_WORDS), TEL_UP).otherwise(0.0)
        down = F.when(before.rlike(OTHER_WORDS), TEL_DOWN).otherwise(0.0)
        return F.lit(TEL_BASE) + up - down

    found = _when(text.rlike(TEL_WORDS), match_spans(text, TEL))
    return F.filter(
        found,
        lambda s: F.length(_digits(s["match"])).between(8, 15)
        & (score(s) >= KEEP)
        & ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])),
    )


def personal_data(documents: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """Every input column + ``into``: all spans of all kinds (start, rank, end, kind, match), by start.

    An input column of that name is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = proposals(text)
    kinds = [tagged(kind, i, spans) for i, (kind, spans) in enumerate(found.items())]
    some = text.rlike("[0-9@]")
    staged = documents.withColumn(into, F.when(some, F.concat(*kinds)).otherwise(F.array().cast(TAGGED)))
    tel = tagged("tel", len(found), _tel(text, F.col(into)))
    return staged.withColumn(into, F.when(some, F.array_sort(F.concat(F.col(into), tel))).otherwise(F.col(into)))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of the base spans, and all spans."""
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )


def _masks(text: Column, base: Column, gaps: Column, sizes: tuple[int, ...]) -> Column:
    """The texts of ``gaps`` (start, end, kind), each followed by its mask; ``text`` begins at offset ``base``.

    Gaps are cut from their block's own text, so a gap costs its block and not all of the text before it.
    """
    if not sizes:
        piece = lambda g: F.concat(
            F.substring(text, g["start"] - base + 1, g["end"] - g["start"]), F.lit("<"), g["kind"], F.lit(">")
        )
        return F.array_join(F.transform(gaps, piece), "")
    size, *rest = sizes
    last = F.ceil(F.size(gaps) / F.lit(size)).cast("int") - 1

    def block(own: Column) -> Column:
        first, end = own[0]["start"], F.element_at(own, -1)["end"]
        inner = F.substring(text, first - base + 1, end - first)
        return let(F.struct(inner.alias("text"), first.alias("base")), lambda b: _masks(b["text"], b["base"], own, rest))

    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(gaps, b * size + 1, F.lit(size)))
    return F.array_join(F.transform(blocks, block), "")


def _running_max(ends: Column) -> Column:
    """Inclusive running maxima of an int array that is not empty, in blocks."""
    last = F.ceil(F.size(ends) / F.lit(BLOCK)).cast("int") - 1

    def upto(values: Column, start: Column) -> Column:
        none = F.array().cast("array<int>")
        step = lambda acc, x: F.struct(
            F.greatest(acc["top"], x).alias("top"), F.concat(acc["tops"], F.array(F.greatest(acc["top"], x))).alias("tops")
        )
        return F.aggregate(values, F.struct(start.alias("top"), none.alias("tops")), step, lambda acc: acc["tops"])

    def of(blocks: Column) -> Column:
        before = lambda t: F.concat(F.array(F.lit(0)), F.slice(t, 1, F.size(t) - 1))
        tops = let(F.transform(blocks, lambda b: F.array_max(b)), lambda t: before(upto(t, F.lit(0))))
        return F.flatten(F.zip_with(blocks, tops, upto))

    return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(ends, b * BLOCK + 1, F.lit(BLOCK))), of)


def masked(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The input columns with every found span of the text replaced by ``<kind>``.

    Of overlapping spans the first (then the first listed kind) names the mask and the mask covers all of
    them; null texts stay null.
    """
    text = F.col(text_col)
    into = "__pii"
    while into in (c.lower() for c in documents.columns):
        into += "_"

    def replaced(spans: Column) -> Column:
        tops = _running_max(F.transform(spans, lambda s: s["end"]))
        upto = let(tops, lambda t: F.concat(F.array(F.lit(0)), F.slice(t, 1, F.size(t) - 1)))
        gap = lambda s, u: F.struct(u.alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))
        gaps = F.filter(F.zip_with(spans, upto, gap), lambda g: g["start"] <= g["end"])
        rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
        return F.concat(let(gaps, lambda g: _masks(text, F.lit(0), g, MASK_BLOCKS)), rest)

    new = F.when(F.size(into) > 0, replaced(F.col(into))).otherwise(text).alias(text_col)
    found = personal_data(documents, text_col, into)
    return found.select(*[new if c == text_col else F.col(c) for c in documents.columns])
