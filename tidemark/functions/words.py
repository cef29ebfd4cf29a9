"""Wide integers as 64-digit hexadecimal words (two's complement), without a UDF where semantics allow.

Equality, sign, bit length, range checks, narrowing and exact sums are native; products and quotients
of wide values use one vectorised function over Python integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limbs of an exact sum: eight of 32 bits.
LIMBS = 8


def word_from_long(x: Column) -> Column:
    """The word of a bigint."""
    return F.concat(F.when(x < 0, "f" * 48).otherwise("0" * 48), F.lower(F.lpad(F.hex(x.cast("long")), 16, "0")))


def is_word(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_negative(x: Column) -> Column:
    return F.substring(x, 1, 1) >= "8"


def bit_length(x: Column) -> Column:
    """Significant bits of an unsigned word; 0 for zero."""
    digits = F.regexp_replace(x, "^0+", "")
    first = F.substring(digits, 1, 1)
    top = F.when(first == "1", 1).when(first.isin("2", "3"), 2).when(first.isin("4", "5", "6", "7"), 3).otherwise(4)
    return F.when(F.length(digits) == 0, 0).otherwise((F.length(digits) - 1) * 4 + top).cast("int")


def fits_unsigned(x: Column, bits: int) -> Column:
    """Whether a word is below 2 ** bits (bits a multiple of 4)."""
    return F.substring(x, 1, (256 - bits) // 4) == "0" * ((256 - bits) // 4)


def fits_signed(x: Column, bits: int) -> Column:
    """Whether a word is a two's complement value of so many bits (a multiple of 4)."""
    head, sign = F.substring(x, 1, (256 - bits) // 4), F.substring(x, (256 - bits) // 4 + 1, 1)
    n = (256 - bits) // 4
    return ((head == "0" * n) & (sign < "8")) | ((head == "f" * n) & (sign >= "8"))


def to_long(x: Column) -> Column:
    """The value of a word between -2**59 and 2**59; null beyond."""
    low = F.conv(F.substring(x, 50, 15), 16, 10).cast("long")
    return F.when(F.substring(x, 1, 49) == "0" * 49, low).when(F.substring(x, 1, 49) == "f" * 49, low - F.lit(1 << 60))


def _limb(x: Column, i: int) -> Column:
    return F.conv(F.substring(x, 1 + 8 * i, 8), 16, 10).cast("long")


def limbs(x: Column) -> Column:
    """Eight 32-bit limbs of a word, the highest first."""
    return F.array(*[_limb(x, i) for i in range(LIMBS)])


def limb_sums(x: Column) -> list[Column]:
    """Aggregates that add a word's limbs; `carry` turns them into a word.  Up to 2**31 rows are exact."""
    return [F.sum(_limb(x, i)).alias(f"limb{i}") for i in range(LIMBS)]


def carry(parts: Column) -> Column:
    """The word of an array of summed limbs, the highest first, modulo 2**256."""
    start = F.struct(F.lit(0).cast("long").alias("over"), F.lit("").alias("word"))

    def add(acc: Column, limb: Column) -> Column:
        total = acc["over"] + limb
        low = F.lower(F.lpad(F.hex(total.bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))
        # An arithmetic shift is a floored division.
        return F.struct(F.shiftright(total, 32).alias("over"), F.concat(low, acc["word"]).alias("word"))

    return F.aggregate(F.reverse(parts), start, add, lambda acc: acc["word"])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that stands once in the plan however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_from_text(x: Column) -> Column:
    """The word of a canonical decimal string, for all 256 bits; null for other text.  Up to 37 digits two exact decimal
    quotients give it; beyond, nine digits at a time are carried into limbs."""

    def times(limbs_: Column, nine: Column) -> Column:
        start = F.struct(nine.alias("over"), F.array().cast("array<bigint>").alias("out"))

        def one(acc: Column, limb: Column) -> Column:
            total = limb * 1_000_000_000 + acc["over"]
            return F.struct(F.shiftright(total, 32).alias("over"), F.concat(acc["out"], F.array(total.bitwiseAND(F.lit((1 << 32) - 1)))).alias("out"))

        return F.aggregate(limbs_, start, one, lambda acc: acc["out"])

    def long(size: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.substr(F.lpad(size, 81, "0"), 1 + 9 * i, F.lit(9)).cast("bigint"))
        parts = F.aggregate(chunks, F.array_repeat(F.lit(0).cast("long"), LIMBS), times)
        return F.array_join(F.transform(F.reverse(parts), lambda limb: F.lower(F.lpad(F.hex(limb), 8, "0"))), "")

    def short(value: Column) -> Column:
        half, quarter = F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lit(1 << 32).cast("decimal(10,0)")
        pieces = [(F.call_function("div", value, half), 16), (F.call_function("div", value % half, quarter), 8), ((value % quarter).cast("long"), 8)]
        return F.lower(F.concat(F.lit("0" * 32), *[F.lpad(F.hex(part), n, "0") for part, n in pieces]))

    word = lambda size: F.when(F.length(size) <= 37, _let(size.cast("decimal(38,0)"), short)).otherwise(long(size))
    signed = lambda t: _let(word(F.regexp_replace(t, "^-", "")), lambda w: F.when(F.startswith(t, F.lit("-")), negated(w)).otherwise(w))
    return _let(x, lambda t: F.when(t.rlike("^(0|-?[1-9][0-9]{0,77})$"), signed(t)))


def negated(x: Column) -> Column:
    """The word of the negative value, modulo 2**256."""
    return carry(F.transform(limbs(x), lambda limb: -limb))


def is_positive(x: Column) -> Column:
    return _let(x, lambda w: ~is_negative(w) & (w != "0" * 64))


def _short_text(size: Column) -> Column:
    """A word below 2**120 as a decimal string."""
    part = lambda at: F.conv(F.substring(size, at, 15), 16, 10).cast("decimal(19,0)")
    return (part(35) * F.lit(str(1 << 60)).cast("decimal(19,0)") + part(50)).cast("decimal(38,0)").cast("string")


def given_text(x: Column) -> Column:
    """`decimal_text` of a word that is cheap to read, such as a field; words below 2**120 take no lambda."""
    return F.when(fits_unsigned(x, 120), _short_text(x)).otherwise(decimal_text(x))


def decimal_text(x: Column) -> Column:
    """A word as a canonical decimal string, for all 256 bits.  Sizes below 2**120 go through an exact decimal; the limbs of
    larger ones are carried into digits of base 10**9."""
    base = 1_000_000_000

    def times(digits: Column, limb: Column) -> Column:
        start = F.struct(limb.alias("over"), F.array().cast("array<bigint>").alias("out"))

        def one(acc: Column, digit: Column) -> Column:
            total = digit * F.lit(1 << 32) + acc["over"]
            return F.struct(F.call_function("div", total, F.lit(base)).alias("over"), F.concat(acc["out"], F.array(total % base)).alias("out"))

        return F.aggregate(digits, start, one, lambda acc: acc["out"])

    def long(size: Column) -> Column:
        digits = F.aggregate(limbs(size), F.array_repeat(F.lit(0).cast("long"), 9), times)
        return F.regexp_replace(F.array_join(F.transform(F.reverse(digits), lambda d: F.lpad(d.cast("string"), 9, "0")), ""), "^0+(?=.)", "")

    plain = lambda size: F.when(fits_unsigned(size, 120), _short_text(size)).otherwise(long(size))
    return _let(x, lambda w: F.when(is_negative(w), F.concat(F.lit("-"), _let(negated(w), plain))).otherwise(plain(w)))


def _value(word: str) -> int:
    raw = int(word, 16)
    return raw - (1 << 256) if raw >> 255 else raw


@F.pandas_udf(T.LongType())
def price_return_bps(start: pd.Series, end: pd.Series) -> pd.Series:
    """Floored return of 1 / sqrt_price**2 between two sqrt prices given as words: (s0**2 - s1**2) * 10000 // s1**2."""

    def one(a: str | None, b: str | None) -> int | None:
        if a is None or b is None or not _value(b):
            return None
        s0, s1 = _value(a) ** 2, _value(b) ** 2
        return (s0 - s1) * 10_000 // s1

    return pd.Series([one(a, b) for a, b in zip(start, end, strict=True)], dtype="Int64")


@F.pandas_udf(T.StructType().add("amount0", T.StringType()).add("amount1", T.StringType()))
def liquidity_amounts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Token amounts (decimal strings) of a position from its liquidity and the current, lower and upper sqrt price, all Q96 words."""
    q96 = 1 << 96
    for liquidity, price, lower, upper in batches:
        rows = []
        for l, p, a, b in zip(liquidity, price, lower, upper, strict=True):
            if None in (l, p, a, b):
                rows.append((None, None))
                continue
            l, p, a, b = _value(l), _value(p), _value(a), _value(b)
            p = min(max(p, a), b)
            rows.append((str(l * q96 * (b - p) // (b * p)), str(l * (p - a) // q96)))
        yield pd.DataFrame(rows, columns=["amount0", "amount1"])


@F.pandas_udf(T.StringType())
def fees_owed(growth: pd.Series, liquidity: pd.Series) -> pd.Series:
    """growth * liquidity >> 128 as a decimal string."""
    return pd.Series([None if g is None or l is None else str(int(g, 16) * _value(l) >> 128) for g, l in zip(growth, liquidity, strict=True)])


MIN_TICK, MAX_TICK = -887_272, 887_272
#: 2**128 / 1.0001**(2**i / 2) for i = 0..19, as pools on chain round them.
_TICK_FACTORS = (
    0xFFFCB933BD6FAD37AA2D162D1A594001, 0xFFF97272373D413259A46990580E213A, 0xFFF2E50F5F656932EF12357CF3C7FDCC, 0xFFE5CACA7E10E4E61C3624EAA0941CD0,
    0xFFCB9843D60F6159C9DB58835C926644, 0xFF973B41FA98C081472E6896DFB254C0, 0xFF2EA16466C96A3843EC78B326B52861, 0xFE5DEE046A99A2A811C461F1969C3053,
    0xFCBE86C7900A88AEDCFFC83B479AA3A4, 0xF987A7253AC413176F2B074CF7815E54, 0xF3392B0822B70005940C7A398E4B70F3, 0xE7159475A2C29B7443B29C7FA6E889D9,
    0xD097F3BDFD2022B8845AD8F792AA5825, 0xA9F746462D870FDF8A65DC1F90E061E5, 0x70D869A156D2A1B890BB3DF62BAF32F7, 0x31BE135F97D08FD981231505542FCFA6,
    0x9AA508B5B7A84E1C677DE54F3E99BC9, 0x5D6AF8DEDB81196699C329225EE604, 0x2216E584F5FA1EA926041BEDFE98, 0x48A170391F7DC42444E8FA2,
)


def sqrt_prices(ticks: np.ndarray) -> np.ndarray:
    """Q96 square-root prices of an array of ticks, as Python integers: the factors of the set bits of |tick| multiplied with
    128 bits after the point, inverted for positive ticks, rounded up at the end."""
    size = np.abs(ticks)
    price = np.full(len(ticks), 1 << 128, dtype=object)
    for i, factor in enumerate(_TICK_FACTORS):
        has = (size >> i) & 1 == 1
        price[has] = (price[has] * factor) >> 128
    up = ticks > 0
    price[up] = ((1 << 256) - 1) // price[up]
    return -(-price >> 32)


@F.pandas_udf(T.StringType())
def sqrt_price_of_tick(tick: pd.Series) -> pd.Series:
    """The Q96 square-root price of a tick as a word; null beyond MIN_TICK and MAX_TICK."""
    known = tick.notna() & tick.between(MIN_TICK, MAX_TICK)
    out = pd.Series([None] * len(tick), dtype=object)
    out[known.to_numpy()] = [f"{p:064x}" for p in sqrt_prices(tick[known].to_numpy(np.int64))]
    return out


def growth_inside(tick: Column, lower: Column, upper: Column, everywhere: Column, below: Column, above: Column) -> Column:
    """Fee growth inside a range, from the growth everywhere and outside of its lower and upper tick (words, modulo 2**256):
    of a price below the range, inside and above it."""
    inside = carry(F.zip_with(F.zip_with(limbs(everywhere), limbs(below), lambda x, y: x - y), limbs(above), lambda x, y: x - y))
    return F.when(tick < lower, modular_difference(below, above)).when(tick < upper, inside).otherwise(modular_difference(above, below))


def word_sum(values: Column) -> Column:
    """The sum of an array of words modulo 2**256, nulls left out; null without any."""
    given = F.filter(values, lambda w: w.isNotNull())
    return F.when(F.size(given) > 0, F.aggregate(given, F.lit("0" * 64), lambda acc, w: carry(F.zip_with(limbs(acc), limbs(w), lambda x, y: x + y))))


def is_greater(a: Column, b: Column) -> Column:
    """Whether (a - b) modulo 2**256 is positive.  Words that aren't negative compare as text."""
    return F.when(~is_negative(a) & ~is_negative(b), a > b).otherwise(is_positive(modular_difference(a, b)))


def modular_difference(a: Column, b: Column) -> Column:
    """(a - b) modulo 2**256 of words, for growth counters that may wrap: limb by limb, without a UDF."""
    return carry(F.zip_with(limbs(a), limbs(b), lambda x, y: x - y))
