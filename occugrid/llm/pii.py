"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occugrid.llm.shared import text_of

#: Characters before and after a span in which context words count.
NEAR = 48

SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    A guard before a pattern keeps the search from starting inside a run that the pattern
    would have matched from its start (``\\G``: or right after the last match). It changes no
    match, but keeps long runs linear. The possessive ``++`` does the same for the way back.
    """

    name: str
    pattern: str
    worth_a_look: str
    prior: float
    helps: str
    hurts: str
    always: bool = True


#: Length of an IBAN by country.
IBAN_LENGTHS = {
    code: length
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI",
        20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}

# Patterns, context words and prior scores of each kind, in the order of output.
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        0.9,
        r"mail|contact|write to|reach",
        r"noreply|no-reply|placeholder",
    ),
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
        r"[0-9]\.[0-9]",
        0.6,
        r"\bip\b|address|server|host|login",
        r"version|release|section|chapter",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"(?:[0-9][\x20-]?){12}[0-9]",
        0.8,
        r"card|visa|credit|payment|expir",
        r"isbn|serial|order|tracking",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        0.7,
        r"phone|call|tel\b|mobile|fax",
        r"version|score|points",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
        r"(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
        r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]",
        0.7,
        r"iban|bank|account|transfer|konto|compte|cuenta",
        r"serial|model|part no",
        always=False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        0.3,
        r"social security|\bssn\b|taxpayer",
        r"order|part no|serial",
        always=False,
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9])",
        r"[A-Za-z0-9+/_-]{16}",
        0.3,
        r"token|secret|passw|pwd|api[ _-]?key|access[ _-]?key|credential|bearer|authorization",
        r"sha-?[0-9]|md5|checksum|commit|digest|uuid",
        always=False,
    ),
)
BASE = tuple(kind.name for kind in KINDS if kind.always)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod_97(value: Column) -> Column:
    """Remainder of an IBAN: first four characters last, letters as 10 to 35."""
    compact = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    return F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda rest, char: F.when(
            char.between("0", "9"), (rest * 10 + F.ascii(char) - 48) % 97
        ).otherwise((rest * 100 + F.ascii(char) - 55) % 97),
    )


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."),
            lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"),
        )
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function(
            "luhn_check", _digits(value)
        )
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, r"\x20", "")).between(15, 34) & (
            _mod_97(value) == 1
        )
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        # Keys mix digits and letters at random; words, numbers and paths do not.
        digits = F.length(_digits(value))
        letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
        return (digits >= 3) & (letters >= 3) & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    return F.lit(True)


def _found(text: Column, kind: Kind) -> Column:
    """Spans of one kind: a match starts after all earlier matches and the gaps between them."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    nothing = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            pair["match"].alias("value"),
            F.lit(kind.prior).alias("score"),
        )
        kept = F.when(
            _valid(kind.name, pair["match"]), F.concat(state["spans"], F.array(span))
        ).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    pairs = F.zip_with(
        gaps, matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match"))
    )
    spans = F.aggregate(
        F.filter(pairs, lambda pair: pair["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), nothing.alias("spans")),
        step,
        lambda state: state["spans"],
    )
    return F.when(text.rlike(kind.worth_a_look), spans).otherwise(nothing)


def _ibans(text: Column, kind: Kind) -> Column:
    """Spans of IBANs. Words after one may look like its groups, so shorter ones are tried too.

    The pattern is looked for from every head (two letters, two digits), also inside an earlier
    match that failed. Each match is taken without its last groups where that gives the length
    of its country, or, for a country not in ``IBAN_LENGTHS``, any length; else as a whole.
    """
    head = r"[A-Z]{2}[0-9]{2}"
    guard, rest = kind.pattern.split(head, 1)
    ahead = f"{guard}(?=({head}{rest})){head}"
    found = F.regexp_extract_all(text, F.lit(ahead), F.lit(1))
    gaps = F.split(text, ahead, -1)
    nothing = F.array().cast(f"array<{SPAN}>")
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])

    def iban(match: Column) -> Column:
        parts = F.split(match, r"\x20")
        known = F.try_element_at(lengths, F.substring(match, 1, 2))
        shorter = F.transform(
            F.sequence(F.lit(0), F.size(parts) - 1),
            lambda less: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - less), " "),
        )
        valid = F.filter(shorter, lambda value: _valid(kind.name, value))
        right = F.filter(valid, lambda value: F.length(F.replace(value, F.lit(" "), F.lit(""))) == known)
        rest = F.filter(valid, lambda value: known.isNull() | (value == match))
        return F.coalesce(F.get(right, F.lit(0)), F.get(rest, F.lit(0)))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(
            F.lit(kind.name).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            pair["value"].alias("value"),
            F.lit(kind.prior).alias("score"),
        )
        taken = pair["value"].isNotNull() & (start >= state["free"])
        return F.struct(
            (start + 4).alias("at"),
            F.when(taken, end).otherwise(state["free"]).alias("free"),
            F.when(taken, F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)),
        found,
        lambda gap, match: F.struct(gap.alias("gap"), iban(match).alias("value")),
    )
    spans = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), nothing.alias("spans")),
        step,
        lambda state: state["spans"],
    )
    return F.when(text.rlike(kind.worth_a_look), spans).otherwise(nothing)


def _scored(text: Column, spans: Column, kind: Kind) -> Column:
    def score(span: Column) -> Column:
        first = F.greatest(span["start"] - NEAR, F.lit(0))
        around = F.lower(
            F.concat_ws(
                " ",
                F.substring(text, first + 1, span["start"] - first),
                F.substring(text, span["end"] + 1, F.lit(NEAR)),
            )
        )
        moved = (
            span["score"]
            + F.when(around.rlike(kind.helps), 0.25).otherwise(0.0)
            - F.when(around.rlike(kind.hurts), 0.3).otherwise(0.0)
        )
        return span.withField("score", F.round(F.least(F.lit(1.0), moved), 2))

    return F.transform(spans, score)


def detect(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_score: float = 0.5,
) -> DataFrame:
    """Spans of personal data in every whole text: ``(id, spans)``, one row per input row.

    ``spans`` is an array of ``(kind, start, end, value, score)``, by kind in the order of
    ``KINDS``, then by start; offsets are code points, the end is exclusive. Matches of a kind
    are leftmost and do not overlap; a match that fails its check (octets up to 255, Luhn,
    number of digits, mod-97) is dropped and not retried, but for IBANs (see ``_ibans``). Context words within ``NEAR``
    characters move the score. Spans of the kinds in ``BASE`` are kept whatever their score (it
    says how sure they are), others from ``min_score``: an IBAN goes where words speak against it, a
    social security number or a secret (key, token, password: 16 characters or more of
    letters and digits mixed) needs words that speak for it.

    A null or empty text has no spans. Repeated rows and null ids give a row each. Other
    columns are not read, so their names do not matter.
    """
    text = F.col("__text")
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    raw = rows.select(
        "__id",
        "__text",
        *[
            (_ibans if kind.name == "iban" else _found)(text, kind).alias(f"__{kind.name}")
            for kind in KINDS
        ],
    )
    scored = [
        _scored(text, F.col(f"__{kind.name}"), kind)
        if kind.always
        else F.filter(
            _scored(text, F.col(f"__{kind.name}"), kind),
            lambda span: span["score"] >= min_score,
        )
        for kind in KINDS
    ]
    return raw.select(F.col("__id").alias(id_col), F.concat(*scored).alias("spans"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda span: F.concat_ws(
                ":", span["kind"], span["start"].cast("string"), span["end"].cast("string")
            ),
        ),
        ",",
    )


def summary(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the kinds, digests and scores of the spans, one row per row of ``detect``.

    ``scores`` holds the score of every span of ``spans``, in its order. No spans (a null or empty
    text) give counts of 0 and empty digests.
    """
    found = F.col("spans")
    base = F.filter(found, lambda span: span["kind"].isin(*BASE))

    def count_of(name: str) -> Column:
        return F.size(F.filter(found, lambda span: span["kind"] == name)).cast("long")

    counts = [count_of(name).alias(f"n_{name}") for name in BASE]
    return spans.select(
        id_col,
        *counts,
        F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"),
        digest(found).alias("spans"),
        F.array_join(
            F.transform(found, lambda span: F.format_number(span["score"], 2)), ","
        ).alias("scores"),
        *[count_of(kind.name).alias(f"n_{kind.name}") for kind in KINDS if not kind.always],
    )
