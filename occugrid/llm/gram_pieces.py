"""Winnowing of character grams in SQL: a text is cut into pieces, a piece's grams are columns.

The hashes are those of ``rolling``: a run of characters is a number to a fixed base, modulo 2**64,
whose bits are then mixed. Hashes compare as unsigned.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Windows that are decided in a piece. More than a hundred columns: Spark then compiles a projection
#: to many methods that are short enough to be compiled further, not to one.
PIECE = 96
#: Turns the order of unsigned numbers into that of longs.
_SIGN = "shiftleft(1L, 63)"
_ANSI = "spark.sql.ansi.enabled"


@contextmanager
def _wrapping(spark: SparkSession) -> Iterator[None]:
    """Columns resolved inside take sums and products modulo 2**64, instead of refusing them."""
    before = spark.conf.get(_ANSI)
    spark.conf.set(_ANSI, "false")
    try:
        yield
    finally:
        spark.conf.set(_ANSI, before)


def same_pieces(size: Column, k: int, window: int) -> Column:
    """Whole pieces decided by the first ``size`` characters alone."""
    return F.floor(F.greatest(size - (k + window - 2), F.lit(0)) / PIECE).cast("int")


def pieces(text: Column, first: Column, k: int, window: int) -> Column:
    """Pieces of a text in normal form from number ``first`` on, at least one if that is 0.

    A piece has ``PIECE`` characters, one before and as many after as the last window has. Blanks
    stand before the beginning and make a text of ``k`` characters of a shorter one.
    """
    blanks = F.repeat(F.lit(" "), F.lit(1) + F.greatest(F.lit(k) - F.length(text), F.lit(0)))
    padded = F.when(first == 0, F.concat(blanks, text)).otherwise(
        F.substring(text, first * PIECE, F.length(text))
    )
    seen = 1 + PIECE + window + k - 2
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{1,{seen}}})).{{1,{PIECE}}}"), F.lit(1))


def with_prints(df: DataFrame, carried: list[str], k: int, window: int, text: bool = False) -> DataFrame:
    """``(carried, hashes, positions)``: arrays of the chosen grams of a piece's windows.

    With ``text`` there is ``(carried, hashes, written)``: in place of positions ``hash@position``
    of each gram, hash in hexadecimal, joined by commas; null if there is none.

    ``df`` has a ``piece``, its ``number`` in the text and the ``size`` of that text. Shorter texts
    than ``k`` are one gram. Of every window the least gram is chosen, the rightmost of equal ones;
    one that the window before has chosen is left out.
    """
    with _wrapping(df.sparkSession):
        return _prints(df, carried, k, window, text)


def _prints(df: DataFrame, carried: list[str], k: int, window: int, text: bool) -> DataFrame:
    # Gram 0 and window 0 are those before the piece.
    n = PIECE + window
    size = F.col("size")
    out = df.select(
        *carried,
        F.greatest(F.lit(k) - size, F.lit(0)).alias("lacking"),
        F.when(size == 0, 0).otherwise(F.greatest(size - (k - 1), F.lit(1))).alias("grams"),
        (F.col("number") * PIECE - 1).alias("start"),
        "piece",
    )
    kept = [*carried, "grams", "start"]
    out = out.selectExpr(*kept, *[f"{_code(i, k)} as c{i}" for i in range(n + k - 1)])
    # Each of these writes out an expression twice; Spark computes it once.
    mixed = [_mixed(f"({_number(i, k)})", 30, _MIX[0]) for i in range(n)]
    out = out.selectExpr(*kept, *[f"{hashed} as h{i}" for i, hashed in enumerate(mixed)])
    mixed = [_xor_shift(_mixed(f"h{i}", 27, _MIX[1]), 31) for i in range(n)]
    out = out.selectExpr(
        *kept,
        *[f"if(start + {i} < grams, {hashed} ^ {_SIGN}, 9223372036854775807L) as h{i}" for i, hashed in enumerate(mixed)],
    )
    # The least but for a window's last gram; that is chosen if it is no greater.
    n, last = PIECE + 1, window - 1
    if last:
        out = out.selectExpr(
            *kept, *[f"h{i}" for i in range(n + last)], *[f"{_least(i, last)} as t{i}" for i in range(1, n)]
        )
    out = out.selectExpr(
        *kept,
        *[f"least(t{i}, h{i + last}) as h{i}" if last else f"h{i}" for i in range(1, n)],
        *[f"if({_first_chosen(i, window)}, {_place(i, window)}, -1) as p{i}" for i in range(1, n)],
    )
    # A hash of -1 is the greatest: chosen only where all of a window are it.
    hashes = ", ".join(f"if(p{i} < 0, -1L, h{i} ^ {_SIGN})" for i in range(1, n))
    places = [f"least(start + p{i}, grams - 1)" for i in range(1, n)]
    if text:
        written = ", ".join(
            f"if(p{i} < 0, null, concat(hex(h{i} ^ {_SIGN}), '@', cast({place} as string)))"
            for i, place in enumerate(places, 1)
        )
        prints = f"lower(nullif(concat_ws(',', {written}), '')) as written"
    else:
        positions = ", ".join(f"if(p{i} < 0, -1, {place})" for i, place in enumerate(places, 1))
        prints = f"array_remove(array({positions}), -1) as positions"
    return out.selectExpr(*carried, f"array_remove(array({hashes}), -1L) as hashes", prints)


def _long(value: int) -> str:
    return f"{(value ^ 1 << 63) - (1 << 63)}L"


def _code(i: int, k: int) -> str:
    """A character's code point plus one (the split is computed once for all); nothing for a character that a short text lacks."""
    code = f"cast(ascii(coalesce(get(split(piece, ''), {i}), '')) + 1 as bigint)"
    if 1 <= i < k:
        code = f"if({i - 1} < lacking, 0L, {code})"
    return code


def _number(i: int, k: int) -> str:
    """A run of ``k`` codes as a number to the base."""
    powers = [_long(pow(_BASE, k - 1 - t, 1 << 64)) for t in range(k)]
    return " + ".join(f"c{i + t} * {power}" for t, power in enumerate(powers))


def _mixed(value: str, by: int, factor: int) -> str:
    return f"({_xor_shift(value, by)} * {_long(factor)})"


def _xor_shift(value: str, by: int) -> str:
    return f"({value} ^ shiftrightunsigned({value}, {by}))"


def _least(i: int, count: int) -> str:
    grams = [f"h{i + t}" for t in range(count)]
    return f"least({', '.join(grams)})" if count > 1 else grams[0]


def _place(i: int, window: int) -> str:
    """The rightmost of a window's least grams."""
    place = str(i)
    for at in range(i + 1, i + window - 1):
        place = f"if(h{at} = t{i}, {at}, {place})"
    return f"if(h{i + window - 1} <= t{i}, {i + window - 1}, {place})" if window > 1 else place


def _first_chosen(i: int, window: int) -> str:
    """Whether a window is one, whole or the only one, and chooses another gram than the one before.

    It does if it chooses its last gram, or if the one before has chosen its first one.
    """
    whole = f"start + {i} + {window} <= grams"
    other = f"(h{i + window - 1} <= t{i} or h{i - 1} < t{i})" if window > 1 else "true"
    return f"if(start + {i} = 0, grams > 0, {whole} and {other})"
