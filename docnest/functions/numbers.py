"""Exact sums and rounding to a multiple, as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the decimal number grammar accepted in text columns.
NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"

# Scale used for doubles and text when the caller names none. A printed double below 1 has its
# 17 digits within it unless it is smaller than 0.1.
DEFAULT_SCALE = 18

SMALL_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType)
INTEGERS = (*SMALL_INTEGERS, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)


def _finite(col: Column) -> Column:
    return ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


# Whole numbers below this are summed as two longs of 25 and 20 bits: safe for 2**38 rows of a key.
SPLIT_BITS = 20
SPLIT_LIMIT = 2**45
# Any long is summed as three longs of at most so many bits.
LONG_BITS = 22
# Decimals a double may have to be summed as a scaled whole number.
FAST_SCALE = 4
# Text of so many characters has no more digits than a double keeps.
SAFE_LENGTH = 15

# Any other printed number is summed as groups of digits: safe for 2**39 rows of a key.
GROUP = 7
WHOLE_GROUPS = 6
PLACE_GROUPS = 6
WHOLE_DIGITS = GROUP * WHOLE_GROUPS
PLACES = GROUP * PLACE_GROUPS
# Digits after PLACES are left out. So many rows of a key can not move the sum past this place by that.
SURE_PLACES = PLACES - 12


def _fail(what: str) -> Column:
    return F.raise_error(F.lit(what))


@dataclass
class Total:
    """An exact sum in steps, so that no expression is written out more than once in a plan.

    ``before`` adds columns to the rows, ``sums`` are the aggregates, ``after`` adds columns to their result; the last one is ``name``.
    The names of all of them start with it. The value of ``name`` is null where nothing was added.
    """

    name: str
    dtype: T.DataType
    sums: dict[str, Column]
    before: list[dict[str, Column]] = field(default_factory=list)
    after: list[dict[str, Column]] = field(default_factory=list)


def prepared(rows: DataFrame, totals: Sequence[Total]) -> DataFrame:
    """``rows`` with the columns that the aggregates of ``totals`` read."""
    for step in range(max((len(t.before) for t in totals), default=0)):
        rows = rows.withColumns({n: c for t in totals for n, c in (t.before[step] if step < len(t.before) else {}).items()})
    return rows


def aggregates(totals: Sequence[Total]) -> list[Column]:
    return [c.alias(n) for t in totals for n, c in t.sums.items()]


def finished(grouped: DataFrame, totals: Sequence[Total]) -> DataFrame:
    """The result of the aggregates with one column per total, and nothing else of theirs."""
    for step in range(max((len(t.after) for t in totals), default=0)):
        grouped = grouped.withColumns({n: c for t in totals for n, c in (t.after[step] if step < len(t.after) else {}).items()})
    made = {n for t in totals for part in (t.sums, *t.after) for n in part}
    return grouped.drop(*(made - {t.name for t in totals}))


# The steps are written as SQL over columns of their own names: one call to Spark each.


def _split(name: str, k: str) -> tuple[dict[str, Column], str]:
    """Sums of a BIGINT column within the split limit, and their total as DECIMAL(28,0)."""
    high, low = f"{name}_high", f"{name}_low"
    sums = {high: F.expr(f"sum(shiftright({k}, {SPLIT_BITS}))"), low: F.expr(f"sum({k} & {2**SPLIT_BITS - 1}L)")}
    return sums, f"cast({high} AS decimal(19,0)) * {2**SPLIT_BITS} + cast({low} AS decimal(19,0))"


def _split_long(name: str, k: str) -> tuple[dict[str, Column], str]:
    """Sums of any BIGINT column, and their total as DECIMAL(38,0)."""
    mask = f"{2**LONG_BITS - 1}L"
    parts = [f"shiftright({k}, {2 * LONG_BITS})", f"shiftright({k}, {LONG_BITS}) & {mask}", f"{k} & {mask}"]
    sums = {f"{name}_{i}": F.expr(f"sum({p})") for i, p in enumerate(parts)}
    high, middle, low = [f"cast({n} AS decimal(19,0))" for n in sums]
    return sums, f"cast(({high} * {2**LONG_BITS} + {middle}) * {2**LONG_BITS} + {low} AS decimal(38,0))"


def _decimal_total(value: Column, what: str) -> Column:
    """The sum of a decimal column; an error when it overflows, whatever the ANSI setting."""
    total = F.try_sum(value)
    return F.when(total.isNull() & (F.count(value) > 0), _fail(f"{what}: the sum is out of range")).otherwise(total)


def _whole_result(total: Column, wide: bool, what: str) -> tuple[Column, T.DataType]:
    if wide:
        return total.cast("decimal(38,0)"), T.DecimalType(38, 0)
    small = total.try_cast("bigint")
    lost = total.isNotNull() & small.isNull()
    return F.when(lost, _fail(f"{what} is out of BIGINT range; ask for a wide result")).otherwise(small), T.LongType()


def _sql(what: str) -> str:
    """Text as a literal of SQL."""
    return "'" + what.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(name: str, printed: Column, what: str) -> list[dict[str, Column]]:
    """Steps that make a printed number into ``name``: WHOLE_DIGITS and PLACES digits around the point, its sign before each GROUP of
    them, and at the end whether there are more."""
    p, mantissa, power, pad, digits, first = [f"{name}_{k}" for k in ("printed", "mantissa", "power", "pad", "digits", "first")]
    kept = WHOLE_DIGITS + PLACES
    lost = _sql(f"{what}: a value does not fit a decimal")
    return [
        {p: printed},
        # Exponents of this size only move zeros or are out of range in any case.
        {
            mantissa: F.regexp_extract(p, r"^[+-]?([0-9.]*)", 1),
            power: F.expr(f"greatest(-999, least(999, coalesce(try_cast(regexp_extract({p}, '[eE](.*)$', 1) AS int), 0)))"),
        },
        {pad: F.expr(f"{WHOLE_DIGITS} + abs({power})")},
        {
            digits: F.expr(f"repeat('0', {pad}) || replace({mantissa}, '.', '') || repeat('0', {pad})"),
            first: F.expr(f"{pad} + length(substring_index({mantissa}, '.', 1)) + {power} - {WHOLE_DIGITS}"),  # digits left of the first one kept
        },
        {
            name: F.expr(
                f"CASE WHEN {p} IS NULL THEN NULL WHEN rtrim('0', substr({digits}, 1, {first})) = ''"
                f" THEN regexp_replace(substr({digits}, {first} + 1, {kept}), '(.{{{GROUP}}})', if(startswith({p}, '-'), '-', '+') || '$1')"
                f" || if(rtrim('0', substr({digits}, {first} + {1 + kept})) = '', '0', '1') ELSE raise_error({lost}) END"
            )
        },
    ]


def _joined(sums: Sequence[str]) -> str:
    """Three sums of groups of digits, highest first, as one decimal."""
    return "cast(" + " + ".join(f"cast(coalesce({s}, 0) AS decimal(19,0)) * {10 ** (GROUP * i)}" for i, s in zip((2, 1, 0), sums, strict=True)) + " AS decimal(38,0))"


def _rounded(name: str, sums: Sequence[str], left_out: str, fast: str, scale: int, what: str) -> list[dict[str, Column]]:
    """Steps from the sums of all groups of digits and ``fast`` to DECIMAL(38, scale): rounded down, then up where a half or more is over."""
    part = f"decimal(37,{scale})"  # two of these add up to DECIMAL(38, scale), where Spark takes no places off
    n, sure, far = PLACES - scale, SURE_PLACES - scale, 10 ** (3 * GROUP)
    quick, higher, lower, first, second, third, last, whole, places, down, tail = [
        f"{name}_{k}" for k in ("quick", "higher", "lower", "first", "second", "third", "last", "whole", "places", "down", "tail")
    ]
    groups = zip((higher, lower, first, second), (sums[i : i + 3] for i in range(0, len(sums), 3)), strict=True)
    text = lambda v: f"lpad(cast(cast({v} AS decimal(21,0)) AS string), {3 * GROUP}, '0')"
    near = f"substr({tail}, 1, {sure}) IN ('5{'0' * (sure - 1)}', '4{'9' * (sure - 1)}')" if sure > 0 else "true"
    up = f"{tail} > '5{'0' * (n - 1)}' OR {tail} = '5{'0' * (n - 1)}' AND {down} >= 0"
    unit = f"cast({Decimal(1).scaleb(-scale):f} AS {part})"
    unsure, lost = _sql(f"{what}: digits after place {PLACES} decide the last one of the sum"), _sql(f"{what}: the sum is out of range")
    steps = [
        {quick: fast, **{k: f"if({left_out} IS NULL, NULL, {_joined(g)})" for k, g in groups}},
        # what is left of a group is never negative, so everything is rounded down
        {last: f"pmod({second}, {far})"},
        {first: f"cast({first} + ({second} - {last}) div {far} AS decimal(38,0))"},
        {third: f"pmod({first}, {far})"},
        {
            whole: f"try_cast(try_add(try_multiply({higher}, {far}), cast({lower} + ({first} - {third}) div {far} AS decimal(38,0))) AS decimal(38,0))",
            places: f"{text(third)} || {text(last)}",
        },
        {
            down: f"try_cast(try_add(try_cast(try_add(try_cast({whole} AS {part}), cast('0.' || substr({places}, 1, {scale}) || '0' AS {part})) AS {part}),"
            f" coalesce({quick}, cast(0 AS {part}))) AS {part})",
            tail: f"substr({places}, {scale + 1})",
        },
        {
            name: f"cast(CASE WHEN {left_out} IS NULL THEN {quick} WHEN {left_out} > 0 AND {near} THEN raise_error({unsure})"
            f" ELSE coalesce(if({up}, try_add({down}, {unit}), {down}), raise_error({lost})) END AS decimal(38,{scale}))"
        },
    ]
    return [{k: F.expr(v) for k, v in step.items()} for step in steps]


def _scaled(name: str, x: Column, is_number: Column, safe: Column, printed: Column, scale: int, what: str) -> Total:
    """The sum of numbers as they are printed, rounded once.

    ``x`` is the number as a double. ``k / 10**f == x`` with a ``k`` of at most 14 digits means that x prints as exactly that decimal, and
    that a text which is ``safe`` (of no more digits than a double keeps) is it, so those are added as whole numbers. Of
    the others each group of digits has a sum of its own, and one carry at the end makes a number of them.
    """
    f = min(scale, FAST_SCALE)
    number, value, k, exact, text, left_out = [f"{name}_{k}" for k in ("number", "x", "k", "exact", "text", "left_out")]
    before = [
        {number: F.coalesce(is_number, F.lit(False))},
        {value: F.when(F.col(number), x)},
        {k: F.when(safe, F.expr(f"if(abs({value}) < {SPLIT_LIMIT // 10**f}, cast(rint({value} * {10**f}D) AS bigint), NULL)"))},
        {exact: F.expr(f"if(cast({k} AS double) / {10**f}D = {value}, {k}, NULL)")},
        *_digits(text, F.when(F.expr(f"{number} AND {exact} IS NULL"), printed), what),
    ]
    sums, whole = _split(name, exact)
    groups = {f"{name}_group_{i}": F.expr(f"sum(cast(substr({text}, {1 + (GROUP + 1) * i}, {GROUP + 1}) AS bigint))") for i in range(WHOLE_GROUPS + PLACE_GROUPS)}
    sums |= {**groups, left_out: F.expr(f"max(cast(right({text}, 1) AS int))")}
    part, lost = f"decimal(37,{scale})", _sql(f"{what}: the sum is out of range")
    scaled = f"try_cast(({whole}) * cast({Decimal(1).scaleb(-f):f} AS decimal({f + 1},{f})) AS {part})"
    fast = f"CASE WHEN {name}_high IS NOT NULL AND {scaled} IS NULL THEN raise_error({lost}) ELSE {scaled} END"
    return Total(name, T.DecimalType(38, scale), sums, before, _rounded(name, list(groups), left_out, fast, scale, what))


def exact_total(name: str, col: Column, dtype: T.DataType, what: str, scale: int | None = None, wide: bool = False) -> Total | None:
    """The exact sum of a column.

    Null, NaN, infinities and text that is no number add nothing. Whole numbers give BIGINT (``wide``: DECIMAL(38,0)), decimals keep
    their scale, doubles and text have ``scale``. A result or a value out of range is an error, never a null. ``None`` for types that
    never hold a number.
    """
    places = DEFAULT_SCALE if scale is None else scale
    if isinstance(dtype, INTEGERS):
        split, k = _split_long if isinstance(dtype, T.LongType) else _split, f"{name}_k"
        sums, total = split(name, k)
        value, kind = _whole_result(F.expr(total), wide, what)
        return Total(name, kind, sums, [{k: col.cast("bigint")}], [{name: value}])
    if isinstance(dtype, T.DecimalType):
        kind = T.DecimalType(min(38, dtype.precision + 10), dtype.scale)
        return Total(name, kind, {name: _decimal_total(col, what).cast(kind)})
    if isinstance(dtype, T.DoubleType):
        return _scaled(name, col, col.isNotNull() & _finite(col), F.lit(True), col.cast("string"), places, what)
    if isinstance(dtype, T.FloatType):
        # A float is read as it prints, not as its nearest double.
        return _scaled(name, col.cast("string").try_cast("double"), col.isNotNull() & _finite(col), F.lit(True), col.cast("string"), places, what)
    if isinstance(dtype, T.StringType):
        return _scaled(name, col.try_cast("double"), col.rlike(NUMBER_PATTERN), F.length(col) <= SAFE_LENGTH, col, places, what)
    return None


def _nearest_integer_multiple(col: Column, g: int, wide: bool) -> Column:
    if wide:
        return _nearest_decimal_multiple(col.cast("decimal(19,0)"), g)
    value = col.cast("bigint")
    rest = value % F.lit(g).cast("bigint")
    base = value - rest
    up = F.try_add(base, F.lit(g).cast("bigint"))
    down = F.try_subtract(base, F.lit(g).cast("bigint"))
    stepped = F.when(rest * 2 >= g, up).when(rest * 2 <= -g, down).otherwise(base)
    failure = _fail("a rounded value is out of BIGINT range; ask for a wide result")
    return F.when(value.isNotNull() & stepped.isNull(), failure).otherwise(stepped)


def _nearest_decimal_multiple(col: Column, g: int) -> Column:
    step = F.lit(g).cast("decimal(10,0)")
    size = F.abs(col)
    rest = size % step
    near = size - rest + F.when(rest * 2 >= step, step).otherwise(F.lit(0).cast("decimal(10,0)"))
    return F.when(col < 0, -near).otherwise(near).cast("decimal(38,0)")


def _nearest_double_multiple(col: Column, g: int) -> Column:
    """Floating remainders are exact, and so is ``g - rest`` once ``rest`` is at least half of g,
    so the only rounding is that of the result itself."""
    value = col.cast("double")
    size = F.abs(value)
    rest = size % F.lit(float(g))
    near = F.when(rest >= g / 2.0, size + (F.lit(float(g)) - rest)).otherwise(size - rest)
    signed = F.when(value < 0, F.lit(0.0) - near).otherwise(near)  # 0 - x, so that there is no -0.0
    return F.when(_finite(value), signed).otherwise(value)


# Whole numbers in text with so many digits are rounded as longs, others as digits.
LONG_DIGITS = 18
# Fixed value: the text rounded as a long.
PLAIN_PATTERN = rf"^[+-]?\d{{1,{LONG_DIGITS}}}(\.\d*)?$"
# Digits an exponent may ask for.
MOST_ZEROS = 9999


def _rounds_up(rest: Column, place: Column, g: int) -> Column:
    """Whether ``rest`` and a first decimal place are half of g or more."""
    return (rest * 2 >= g) | (rest * 2 == g - 1) & (place >= "5")


def _named(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of a struct of values, each worked out once however often it is used."""
    return F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), use)[0]


def _stepped(digits: Column, up: bool) -> Column:
    """Digits plus or minus one."""
    full, empty = ("9", "0") if up else ("0", "9")

    def moved(v: Column) -> Column:
        kept = v["kept"]
        last = F.right(kept, F.lit(1)).cast("int") + (1 if up else -1)
        front = F.concat(F.substr(kept, F.lit(1), F.length(kept) - 1), last.cast("string"))
        return F.concat(F.when(kept == "", "1" if up else "").otherwise(front), F.repeat(F.lit(empty), v["size"] - F.length(kept)))

    return _named({"kept": F.rtrim(digits, F.lit(full)), "size": F.length(digits)}, moved)


def _nearest_long_text(text: Column, g: int) -> Column:
    """A number in text of any length, by its digits: the remainder comes out of groups of them, and a carry goes on to those above."""
    step, limit = F.lit(g).cast("bigint"), F.lit(10**LONG_DIGITS).cast("bigint")
    exponent = F.regexp_extract(text, "[eE](.*)$", 1)
    power = F.coalesce(exponent.try_cast("int"), F.when(exponent.startswith("-"), -MOST_ZEROS).when(exponent != "", MOST_ZEROS + 1).otherwise(0))

    def padded(v: Column) -> Column:
        digits = F.replace(v["mantissa"], F.lit("."), F.lit(""))
        point = F.length(F.substring_index(v["mantissa"], ".", 1)) + F.greatest(v["power"], F.lit(-MOST_ZEROS))
        lost = (v["power"] > MOST_ZEROS) & (F.rtrim(digits, F.lit("0")) != "")
        zeros = lambda n: F.repeat(F.lit("0"), F.greatest(F.lit(0), n))
        wide = F.concat(zeros(-point), digits, zeros(F.least(point, F.lit(2 * MOST_ZEROS)) - F.length(digits)))
        kept = F.when(lost, _fail("a number in text is too long to round")).otherwise(wide)
        return _named({"digits": kept, "at": F.greatest(F.lit(0), point)}, split)

    def split(v: Column) -> Column:
        # at least two groups of LONG_DIGITS, in whole groups of GROUP
        short = F.greatest(F.lit(2 * LONG_DIGITS) - v["at"], F.pmod(-v["at"], F.lit(GROUP)))
        fill = short + F.pmod(-(short + v["at"]), F.lit(GROUP))
        number = F.concat(F.repeat(F.lit("0"), fill), F.substr(v["digits"], F.lit(1), v["at"]))
        return _named({"number": number, "place": F.substr(v["digits"], v["at"] + 1, F.lit(1))}, divided)

    def divided(v: Column) -> Column:
        number = v["number"]
        starts = F.sequence(F.lit(1), F.length(number) - GROUP + 1, F.lit(GROUP))
        rest = F.aggregate(starts, F.lit(0).cast("bigint"), lambda r, i: F.pmod(r * 10**GROUP + F.substr(number, i, F.lit(GROUP)).cast("bigint"), step))
        return _named({"number": number, "place": v["place"], "rest": rest}, moved)

    def moved(v: Column) -> Column:
        low = F.right(v["number"], F.lit(LONG_DIGITS)).cast("bigint")
        to = low - v["rest"] + F.when(_rounds_up(v["rest"], v["place"], g), step).otherwise(F.lit(0).cast("bigint"))
        return _named({"high": F.substr(v["number"], F.lit(1), F.length(v["number"]) - LONG_DIGITS), "to": to}, put_together)

    def put_together(v: Column) -> Column:
        above = F.when(v["to"] >= limit, _stepped(v["high"], True)).when(v["to"] < 0, _stepped(v["high"], False)).otherwise(v["high"])
        found = F.ltrim(F.concat(above, F.lpad(F.pmod(v["to"], limit).cast("string"), LONG_DIGITS, "0")), F.lit("0"))
        return _named({"found": found}, lambda f: F.when(f["found"] == "", "0").otherwise(f["found"]))

    whole = _named({"mantissa": F.regexp_extract(text, r"^[+-]?([0-9.]*)", 1), "power": power}, padded)
    return _named({"whole": whole}, lambda v: F.concat(F.when(text.startswith("-") & (v["whole"] != "0"), "-").otherwise(""), v["whole"]))


def _nearest_text_multiple(col: Column, g: int) -> Column:
    text = F.trim(col)
    whole = F.abs(F.substring_index(text, ".", 1).try_cast("bigint"))
    place = F.substr(F.substring_index(F.concat(text, F.lit(".")), ".", 2), F.instr(F.concat(text, F.lit(".")), ".") + 1, F.lit(1))
    rest = whole % F.lit(g).cast("bigint")
    near = whole - rest + F.when(_rounds_up(rest, place, g), F.lit(g).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    short = F.concat(F.when(text.startswith("-") & (near > 0), "-").otherwise(""), near.cast("string"))
    return F.when(text.rlike(PLAIN_PATTERN), short).when(text.rlike(NUMBER_PATTERN), _nearest_long_text(text, g)).otherwise(col)


def nearest_multiple(col: Column, dtype: T.DataType, granularity: int, wide: bool = False) -> Column | None:
    """Round to the nearest multiple, halves away from zero; ``None`` for non-numeric types.

    Whole numbers give BIGINT (``wide``: DECIMAL(38,0)), decimals DECIMAL(38,0), floats DOUBLE
    with NaN and infinities left alone, text stays text with unparsable values left alone.
    """
    if isinstance(dtype, INTEGERS):
        return _nearest_integer_multiple(col, granularity, wide)
    if isinstance(dtype, T.DecimalType):
        return _nearest_decimal_multiple(col, granularity)
    if isinstance(dtype, FLOATS):
        return _nearest_double_multiple(col, granularity)
    if isinstance(dtype, T.StringType):
        return _nearest_text_multiple(col, granularity)
    return None
