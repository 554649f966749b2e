"""Numbers that arrive as text: fills, spellings of non-finite values, exactness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spellings that sources use for values that are not numbers, and the fill value.
NONFINITE = ("NaN", "nan", "Infinity", "-Infinity", "inf", "-inf")
FILL = 99999.0


def number(text: Column) -> Column:
    """Double of a text; null for spellings of non-finite values and for what is no number; -0 is 0."""
    value = F.when(~text.isin(*NONFINITE), text.try_cast("double"))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value + F.lit(0.0))


def filled(value: Column, fills: tuple[float, ...] = (FILL,)) -> tuple[Column, Column]:
    """(value or null, reason): declared fill values are ``fill``."""
    fill = F.coalesce(value.isin(*fills), F.lit(False))
    return F.when(~fill, value), F.when(fill, "fill")


def finite(value: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~(F.isnan(value) | (F.abs(value) == float("inf"))), value)


# Exact decimal text ----------------------------------------------------------------------------------

_DECIMAL = r"^([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,9}))?$"
SMALLEST_NORMAL = 2.0**-1022
# Limbs of nine digits, least first. Factors are under 10^9 too, so that a carry is a limb.
_TIMES = """aggregate({limbs}, named_struct('o', cast(array() as array<bigint>), 'c', 0L), (s, x) -> named_struct('o', concat(s.o, array((x * f + s.c) % 1000000000L)), 'c', (x * f + s.c) div 1000000000L), s -> if(s.c > 0, concat(s.o, array(s.c)), s.o))"""
_DIGITS = f"""array_join(transform(reverse(aggregate(concat(array_repeat({{big}}, cast({{n}} div {{each}} as int)), array(cast(pow({{base}}, {{n}} % {{each}}) as bigint))), array({{m}} % 1000000000L, {{m}} div 1000000000L), (acc, f) -> {_TIMES.format(limbs="acc")})), x -> lpad(cast(x as string), 9, '0')), '')"""


def _significant(digits: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")


def _point(digits: Column, exponent: Column) -> Column:
    """Where the decimal point stands from the first significant digit, for digits that count units of 10 ^ exponent."""
    return F.char_length(F.regexp_replace(digits, "^0+", "")) + exponent


def exact_numbers(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with value, reject and flags of the decimal text in column ``text``: the nearest double (ties to even), -0 as 0.

    ``reject``: not_a_number, float64_overflow, or float64_underflow (not nought, but its double is); the value is null then.
    ``flags``: rounded if the double is not exactly the text, whatever its exponent and length, and subnormal. A null text is all null.
    The double is taken apart into an odd integer and a power of two, whose decimal digits are multiplied out and held against the text's.
    """
    part = lambda k: F.regexp_extract(text, _DECIMAL, k)
    known = F.coalesce(F.col(text).rlike(_DECIMAL) & (F.concat(part(2), part(3)) != ""), F.lit(False))
    exponent = F.when(part(4) == "", 0).otherwise(part(4).try_cast("int")) - F.char_length(part(3))
    rows = rows.withColumn("_v", F.when(known, F.col(text).try_cast("double"))).withColumn("_d", F.when(known, F.concat(part(2), part(3)))).withColumn("_e", exponent)
    bits = lambda k: F.regexp_extract(F.format_string("%a", F.abs("_v")), r"^0x([01])\.([0-9a-f]+)p(-?\d+)$", k)
    rows = rows.withColumn("_m", F.conv(F.concat(bits(1), F.rpad(bits(2), 13, "0")), 16, 10).cast("long")).withColumn("_x", bits(3).try_cast("int") - 52)
    # An odd integer, as far as the power of two is below nought; low is the largest power of two that divides the mantissa.
    low = F.least(F.col("_m").bitwiseAND(-F.col("_m")), F.when(F.col("_x") < 0, F.pow(F.lit(2.0), F.least(-F.col("_x"), F.lit(62))).cast("long")).otherwise(F.lit(1).cast("long")))
    rows = rows.withColumn("_low", F.greatest(low, F.lit(1).cast("long"))).withColumn("_o", F.expr("_m div _low")).withColumn("_s", F.col("_x") + F.round(F.log2("_low")).cast("int"))
    own = F.when(F.col("_s") >= 0, F.expr(_DIGITS.format(big=f"{1 << 29}L", base=2, each=29, n="_s", m="_o"))).otherwise(F.expr(_DIGITS.format(big=f"{5**12}L", base=5, each=12, n="(-_s)", m="_o")))
    rows = rows.withColumn("_own", own)
    same = (_significant(F.col("_own")) == _significant(F.col("_d"))) & (_point(F.col("_own"), F.least(F.col("_s"), F.lit(0))) == _point(F.col("_d"), F.col("_e")))
    nought = _significant(F.col("_d")) == ""
    reject = (
        F.when(F.col(text).isNull(), None).when(F.col("_v").isNull(), "not_a_number").when(F.abs("_v") == float("inf"), "float64_overflow")
        .when((F.col("_v") == 0) & ~nought, "float64_underflow")
    )
    rows = rows.withColumn("reject", reject)
    sound = F.col("reject").isNull() & F.col("_v").isNotNull()
    flags = F.array_compact(F.array(F.when(~nought & ~same, "rounded"), F.when((F.col("_v") != 0) & (F.abs("_v") < SMALLEST_NORMAL), "subnormal")))
    return rows.withColumn("value", F.when(sound, F.when(nought, 0.0).otherwise(F.col("_v")))).withColumn("flags", F.when(sound, flags)).drop("_v", "_d", "_e", "_m", "_x", "_low", "_o", "_s", "_own")
