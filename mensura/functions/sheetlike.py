"""Spreadsheet function names as Spark columns and aggregates, so that such formulas run over tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.errors import FormulaError
from mensura.functions import special
from mensura.scratch import same_keys, small

L = F.lit


def _even(x: Column) -> Column:
    return F.signum(x) * F.ceil(F.abs(x) / 2) * 2


def _odd(x: Column) -> Column:
    return F.when(x == 0, L(1.0)).otherwise(F.signum(x) * (2 * F.ceil((F.abs(x) - 1) / 2) + 1))


def _trunc(x: Column, n: Column = None) -> Column:
    k = F.pow(L(10.0), n if n is not None else L(0))
    return F.signum(x) * F.floor(F.abs(x) * k) / k


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's rounds unrolled: 92 suffice for any 64-bit pair."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(L(1), L(92)), start, step, lambda s: s["a"])


def _proper(s: Column) -> Column:
    return F.initcap(F.lower(s))


def _days360(a: Column, b: Column) -> Column:
    d1 = F.least(F.dayofmonth(a), L(30))
    d2 = F.when((F.dayofmonth(b) == 31) & (d1 == 30), 30).otherwise(F.dayofmonth(b))
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + d2 - d1


def _months(a: Column, b: Column) -> Column:
    """Whole months from a to b: one is whole on the day of the month it began."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")


def _datedif(a: Column, b: Column, unit: Column) -> Column:
    """DATEDIF: D days, M and Y whole months and years, MD days past whole months, YM months past whole years, YD days past whole years; other units, and a start after the end, are errors."""
    months, u = _months(a, b), F.upper(unit)
    before = F.dayofmonth(F.last_day(F.add_months(b, -1)))
    days = F.dayofmonth(b) - F.dayofmonth(a)
    same_year = F.add_months(a, (F.year(b) - F.year(a)) * 12)
    anniversary = F.when(same_year <= b, same_year).otherwise(F.add_months(a, (F.year(b) - F.year(a) - 1) * 12))
    out = (
        F.when(a > b, F.raise_error(L("DATEDIF: the start lies after the end")).cast("int"))
        .when(u == "D", F.datediff(b, a)).when(u == "M", months).when(u == "Y", F.floor(months / 12).cast("int"))
        .when(u == "MD", F.when(days >= 0, days).otherwise(days + before)).when(u == "YM", months % 12).when(u == "YD", F.datediff(b, anniversary))
    )
    return F.when(a.isNotNull() & b.isNotNull(), out.otherwise(F.raise_error(F.concat(L("DATEDIF: unknown unit "), unit)).cast("int")))


def _workday(start: Column, n: Column) -> Column:
    """WORKDAY: the date ``n`` working days (Monday to Friday) after the start, or before it."""
    # from the last working day at or before the start (at or after it, going back), whole weeks and a rest
    wd = F.weekday(start)
    ahead = F.date_sub(start, F.greatest(wd - 4, L(0)))
    back = F.date_add(start, F.when(wd > 4, 7 - wd).otherwise(0))
    d, m = F.weekday(ahead), F.weekday(back)
    forth = F.date_add(ahead, (F.floor((d + n) / 5) * 7 + (d + n) % 5 - d).cast("int"))
    left = m - F.abs(n)
    back = F.date_add(back, (F.floor(left / 5) * 7 + (left - F.floor(left / 5) * 5) - m).cast("int"))
    return F.when(n == 0, start).when(n > 0, forth).otherwise(back)


def _if_error(x: Column, other) -> Column:
    """IFERROR: ``other`` where computing ``x`` fails, or gives null, NaN or infinity. The result is a text if ``other`` is one, else a double.

    The value passes a function that turns any error below it into null, as its text.
    """
    text = F.decode(F.try_to_binary(x.cast("string"), L("utf-8")), "UTF-8")
    if isinstance(other, str):
        return F.coalesce(text, L(other))
    number = text.try_cast("double")
    good = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return F.coalesce(good, (other if isinstance(other, Column) else L(other)).cast("double"))


def _counted(x: Column) -> Column:
    """A cell's number for AVERAGEA and its like: true 1, other texts and false 0, nulls none."""
    text = F.lower(x.cast("string"))
    return F.when(x.isNotNull(), F.when(text == "true", 1.0).otherwise(F.coalesce(text.try_cast("double"), L(0.0))))


def _workdays(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.sequence(a, b), lambda d: F.weekday(d) < 5))


#: Scalar functions by name; each takes columns and is built from built-in functions.
SCALARS: dict[str, Callable[..., Column]] = {
    # math
    "ABS": F.abs, "SIGN": F.signum, "INT": F.floor, "TRUNC": _trunc, "SQRT": F.sqrt, "EXP": F.exp, "LN": F.ln, "LOG10": F.log10, "PI": F.pi, "POWER": F.pow, "CBRT": F.cbrt, "EVEN": _even, "ODD": _odd,
    "LOG": lambda x, b=None: F.log10(x) if b is None else F.ln(x) / F.ln(b), "MOD": lambda a, b: a - b * F.floor(a / b), "QUOTIENT": lambda a, b: _trunc(a / b), "SQRTPI": lambda x: F.sqrt(x * math.pi),
    "ROUND": lambda x, n=None: F.round(x, n if n is not None else L(0)), "ROUNDBANK": lambda x, n=None: F.bround(x, n if n is not None else L(0)), "ROUNDDOWN": _trunc, "ROUNDUP": lambda x, n=None: F.signum(x) * F.ceil(F.abs(x) * F.pow(L(10.0), n if n is not None else L(0))) / F.pow(L(10.0), n if n is not None else L(0)),
    "MROUND": lambda x, m: m * F.round(x / m), "CEILING": lambda x, s: s * F.ceil(x / s), "FLOOR": lambda x, s: s * F.floor(x / s), "DEGREES": F.degrees, "RADIANS": F.radians, "GCD": _gcd, "LCM": lambda a, b: F.when((a == 0) | (b == 0), L(0)).otherwise(F.abs(a * b) / _gcd(a, b)),
    "FACT": lambda n: F.factorial(n.cast("int")), "COMBIN": lambda n, k: F.round(F.exp(special.lgamma_native(n + 1.0) - special.lgamma_native(k + 1.0) - special.lgamma_native(n - k + 1.0))), "PERMUT": lambda n, k: F.round(F.exp(special.lgamma_native(n + 1.0) - special.lgamma_native(n - k + 1.0))),
    "BITAND": lambda a, b: a.bitwiseAND(b), "BITOR": lambda a, b: a.bitwiseOR(b), "BITXOR": lambda a, b: a.bitwiseXOR(b), "BITLSHIFT": lambda a, n: F.call_function("shiftleft", a, n), "BITRSHIFT": lambda a, n: F.call_function("shiftright", a, n),
    "DEC2BIN": lambda x: F.bin(x), "DEC2HEX": lambda x: F.hex(x), "DEC2OCT": lambda x: F.conv(x.cast("string"), 10, 8), "BIN2DEC": lambda s: F.conv(s, 2, 10).cast("long"), "HEX2DEC": lambda s: F.conv(s, 16, 10).cast("long"), "OCT2DEC": lambda s: F.conv(s, 8, 10).cast("long"), "BASE": lambda x, b: F.call_function("conv", x.cast("string"), L(10), b),
    "DELTA": lambda a, b: (a == b).cast("int"), "GESTEP": lambda a, b: (a >= b).cast("int"), "GAUSS": lambda x: special.column("erf")(x / math.sqrt(2)) / 2, "PHI": lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi), "FISHER": F.atanh, "FISHERINV": F.tanh, "STANDARDIZE": lambda x, m, s: (x - m) / s,
    # text
    "UPPER": F.upper, "LOWER": F.lower, "PROPER": _proper, "LEN": F.length, "LENB": F.octet_length, "LEFT": lambda s, n: F.substr(s, L(1), n), "RIGHT": lambda s, n: F.right(s, n), "MID": lambda s, a, n: F.substr(s, a, n), "TRIM": lambda s: F.regexp_replace(F.trim(s), " +", " "), "CLEAN": lambda s: F.regexp_replace(s, r"[\x00-\x1F]", ""),
    "CONCAT": F.concat, "CONCATENATE": F.concat, "TEXTJOIN": lambda d, *s: F.call_function("array_join", F.array_compact(F.array(*s)), d), "REPT": lambda s, n: F.call_function("repeat", s, n), "SUBSTITUTE": F.replace, "EXACT": lambda a, b: a == b, "FIND": lambda t, s: F.nullif(F.call_function("instr", s, t), L(0)), "SEARCH": lambda t, s: F.nullif(F.call_function("instr", F.lower(s), F.lower(t)), L(0)),
    "REPLACE": lambda s, a, n, t: F.overlay(s, t, a, n), "CHAR": F.char, "UNICHAR": lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32"), "CODE": F.ascii, "UNICODE": F.ascii, "VALUE": lambda s: s.try_cast("double"), "T": lambda s: F.when(s.cast("string").try_cast("double").isNull() & ~F.lower(s.cast("string")).isin("true", "false"), s.cast("string")).otherwise(""), "REGEXMATCH": lambda s, p: F.regexp_like(s, p), "REGEXREPLACE": lambda s, p, t: F.regexp_replace(s, p, t), "REGEXEXTRACT": lambda s, p: F.regexp_substr(s, p),
    "TEXTBEFORE": lambda s, d: F.call_function("substring_index", s, d, L(1)), "TEXTSPLIT": lambda s, d: F.call_function("split", s, F.concat(L("\\Q"), d, L("\\E"))), "ENCODEURL": F.url_encode,
    # dates
    "DATE": F.make_date, "YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DAYS": lambda b, a: F.datediff(b, a), "DAYS360": _days360, "EDATE": lambda d, n: F.add_months(d, n), "EOMONTH": lambda d, n: F.last_day(F.add_months(d, n)),
    "WEEKDAY": F.dayofweek, "ISOWEEKNUM": F.weekofyear, "NETWORKDAYS": _workdays, "TODAY": F.current_date, "NOW": F.current_timestamp, "DATEVALUE": lambda s: s.try_cast("date"), "EPOCHTODATE": lambda x: F.timestamp_seconds(x),
    "DATEDIF": _datedif, "WORKDAY": _workday,
    "YEARFRAC": lambda a, b: _days360(a, b) / 360.0, "WEEKNUM": lambda d: F.floor((F.dayofyear(d) + F.dayofweek(F.trunc(d, "year")) - 2) / 7) + 1,
    # logic
    "IFS": lambda *a: F.coalesce(*(F.when(c, v) for c, v in zip(a[::2], a[1::2]))), "SWITCH": lambda x, *a: _switch(x, a), "TEXTAFTER": lambda s, d: F.when(F.call_function("instr", s, d) > 0, F.substr(s, F.call_function("instr", s, d) + F.length(d))), "FIXED": lambda x, n: F.format_number(x, n),
    "IF": lambda c, a, b: F.when(c, a).otherwise(b), "IFNA": F.coalesce, "ISBLANK": F.isnull, "ISNUMBER": lambda s: s.cast("string").try_cast("double").isNotNull(), "ISTEXT": lambda s: s.cast("string").try_cast("double").isNull() & s.isNotNull(), "ISEVEN": lambda x: _trunc(x) % 2 == 0, "ISODD": lambda x: _trunc(x) % 2 != 0,
    "ISBETWEEN": lambda x, a, b: x.between(a, b), "NOT": lambda a: ~a, "AND": lambda *a: _fold(a, lambda x, y: x & y), "OR": lambda *a: _fold(a, lambda x, y: x | y), "XOR": lambda *a: _fold(a, lambda x, y: x != y), "CHOOSE": lambda i, *a: F.try_element_at(F.array(*a), i), "ISEMAIL": lambda s: s.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "ISURL": lambda s: s.rlike(r"^https?://\S+$"),
}


def _fold(items, op):
    out = items[0]
    for x in items[1:]:
        out = op(out, x)
    return out


def _switch(x: Column, pairs) -> Column:
    """Values by case; an odd last one is the default."""
    default = pairs[-1] if len(pairs) % 2 else L(None)
    return F.coalesce(*(F.when(x == c, v) for c, v in zip(pairs[::2], pairs[1::2])), default)


def scalar(name: str, *args) -> Column:
    """A named function over columns; plain numbers and texts become literals."""
    if name.upper() == "IFERROR":
        return _if_error(args[0] if isinstance(args[0], Column) else L(args[0]), args[1])
    f = SCALARS.get(name.upper())
    if f is None:
        raise FormulaError(f"unknown function {name}")
    return f(*(a if isinstance(a, Column) else L(a) for a in args))


def _stdev_of_fit(y: Column, x: Column) -> Column:
    n = F.regr_count(y, x)
    return F.sqrt((F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), L(2)) / F.regr_sxx(y, x)) / (n - 2))


#: Aggregates by name: one column, two columns, or a column and a condition. All but MEDIAN,
#: PERCENTILE and QUARTILE, which keep the distinct values of a group, use constant state.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "SUM": F.sum, "AVERAGE": F.avg, "COUNT": F.count, "COUNTA": F.count, "COUNTBLANK": lambda x: F.count_if(x.isNull() | (x.cast("string") == "")), "MAX": F.max, "MIN": F.min, "PRODUCT": F.product, "MEDIAN": F.median, "MODE": lambda x: F.mode(x, True),
    "VAR": F.var_samp, "VARP": F.var_pop, "STDEV": F.stddev_samp, "STDEVP": F.stddev_pop, "SKEW": lambda x: F.skewness(x) * F.sqrt(F.count(x) * (F.count(x) - 1.0)) / (F.count(x) - 2.0), "SUMSQ": lambda x: F.sum(x * x), "DEVSQ": lambda x: F.var_pop(x) * F.count(x),
    "KURT": lambda x: ((F.count(x) + 1.0) * F.kurtosis(x) + 6.0) * (F.count(x) - 1.0) / ((F.count(x) - 2.0) * (F.count(x) - 3.0)), "GEOMEAN": lambda x: F.exp(F.avg(F.ln(x))), "HARMEAN": lambda x: 1 / F.avg(1 / x),
    "PERCENTILE": lambda x, p: F.percentile(x, p), "QUARTILE": lambda x, q: F.percentile(x, q / 4), "CORREL": F.corr, "PEARSON": F.corr, "COVAR": F.covar_pop, "SLOPE": F.regr_slope, "INTERCEPT": F.regr_intercept, "RSQ": F.regr_r2, "STEYX": _stdev_of_fit,
    "SUMPRODUCT": lambda x, y: F.sum(x * y), "SUMX2MY2": lambda x, y: F.sum(x * x - y * y), "SUMX2PY2": lambda x, y: F.sum(x * x + y * y), "SUMXMY2": lambda x, y: F.sum((x - y) * (x - y)),
    "COUNTIF": F.count_if, "SUMIF": lambda x, c: F.sum(F.when(c, x)), "AVERAGEIF": lambda x, c: F.avg(F.when(c, x)), "MAXIFS": lambda x, c: F.max(F.when(c, x)), "MINIFS": lambda x, c: F.min(F.when(c, x)),
}


def _all(conditions) -> Column:
    return _fold(conditions, lambda a, b: a & b)


#: Aggregates that take several conditions, and further names.
MORE_AGGREGATES: dict[str, Callable[..., Column]] = {
    # several conditions, all of which must hold
    "COUNTIFS": lambda *c: F.count_if(_all(c)), "SUMIFS": lambda x, *c: F.sum(F.when(_all(c), x)), "AVERAGEIFS": lambda x, *c: F.avg(F.when(_all(c), x)),
    "MAXA": lambda x: F.max(_counted(x)), "MINA": lambda x: F.min(_counted(x)), "AVERAGEA": lambda x: F.avg(_counted(x)), "STDEVA": lambda x: F.stddev_samp(_counted(x)), "STDEVPA": lambda x: F.stddev_pop(_counted(x)),
    "VARA": lambda x: F.var_samp(_counted(x)), "VARPA": lambda x: F.var_pop(_counted(x)),
    "FORECAST": lambda at, y, x: F.regr_intercept(y, x) + F.regr_slope(y, x) * at,
}

# Function numbers of SUBTOTAL and AGGREGATE.
SUBTOTALS = {1: "AVERAGE", 2: "COUNT", 3: "COUNTA", 4: "MAX", 5: "MIN", 6: "PRODUCT", 7: "STDEV", 8: "STDEVP", 9: "SUM", 10: "VAR", 11: "VARP"}
MORE_NUMBERS = {12: "MEDIAN", 13: "MODE", 16: "PERCENTILE", 17: "QUARTILE"}


def subtotal(number: int, x: Column, hidden: Column | None = None) -> Column:
    """SUBTOTAL: the numbered aggregate; from 101 on (the same functions) rows that are ``hidden`` do not count."""
    if number % 100 not in SUBTOTALS or number not in (number % 100, number % 100 + 100):
        raise FormulaError(f"unknown function number {number}")
    return aggregate(SUBTOTALS[number % 100], F.when(~hidden, x) if number > 100 and hidden is not None else x)


def numbered_aggregate(number: int, x: Column, *more, skip_errors: bool = True) -> Column:
    """AGGREGATE: the numbered function; with ``skip_errors`` non-finite values do not count."""
    name = (SUBTOTALS | MORE_NUMBERS).get(number)
    if name is None:
        raise FormulaError(f"unknown function number {number}")
    d = x.cast("double")
    return aggregate(name, F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d) if skip_errors else x, *more)


#: Database functions: the aggregate behind each name, over the rows that meet the criteria.
DATABASE = {"DSUM": "SUM", "DAVERAGE": "AVERAGE", "DCOUNT": "COUNT", "DCOUNTA": "COUNTA", "DMAX": "MAX", "DMIN": "MIN", "DPRODUCT": "PRODUCT", "DSTDEV": "STDEV", "DSTDEVP": "STDEVP", "DVAR": "VAR", "DVARP": "VARP"}


def database(name: str, x: Column, criteria: list[dict[str, Column]] | Column) -> Column:
    """DSUM and its like: ``criteria`` is a condition, or rows of conditions by field, of which one row must hold whole.

    DGET gives the only value that meets them, null for none, and an error for several.
    """
    if not isinstance(criteria, Column):
        criteria = _fold([_all(list(row.values())) for row in criteria], lambda a, b: a | b)
    kept = F.when(criteria, x)
    if name.upper() == "DGET":
        return F.when(F.count(kept) <= 1, F.max(kept)).otherwise(F.raise_error(L("several rows meet the criteria")).cast("double"))
    if name.upper() not in DATABASE:
        raise FormulaError(f"unknown database function {name}")
    return aggregate(DATABASE[name.upper()], kept)


def average_deviation(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """AVEDEV by group: mean distance from the mean, by two aggregations; the means are joined back by key."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return same_keys(df, small(means), list(keys)).groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col("_m"))).alias("avedev"))


def unique(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """UNIQUE: distinct rows."""
    return df.select(*(columns or df.columns)).distinct()


def vstack(*tables: DataFrame) -> DataFrame:
    """VSTACK: tables one below another by column position, narrower ones filled with nulls; names are the widest one's."""
    names = max((t.columns for t in tables), key=len)
    grown = [t.toDF(*names[: len(t.columns)]).select("*", *(L(None).alias(n) for n in names[len(t.columns) :])) for t in tables]
    return _fold(grown, lambda a, b: a.unionByName(b))


def hstack(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """HSTACK: tables side by side by place in their orders, the shorter filled with nulls; the place is ``row``."""
    from mensura.operators.sheet import numbered

    return numbered(left, left_order).join(numbered(right, right_order), "row", "full")


def match(df: DataFrame, table: DataFrame, key: str, table_key: str, order: list[str], out: str = "position", approximate: bool = False) -> DataFrame:
    """MATCH: the place, from 1, of the first entry of ``table`` with the key, or with ``approximate`` of the largest key not above."""
    from mensura.operators.sheet import numbered

    places = numbered(table.select(*dict.fromkeys([table_key, *order])), order, "_place").select(table_key, (F.col("_place") + 1).alias("_place"))
    return lookup(df, places, key, table_key, "_place", out, approximate)


def index(table: DataFrame, order: list[str], row: int, column: int) -> DataFrame:
    """INDEX: one row with the value at a place, both counted from 1."""
    from mensura.operators.sheet import numbered

    return numbered(table, order, "_place").where(F.col("_place") == row - 1).select(F.col(f"`{table.columns[column - 1]}`").alias("value"))


def hlookup(cells: DataFrame, key, row: int) -> DataFrame:
    """HLOOKUP over cells (row, col, value): the value ``row`` rows (from 1) into the first column whose top cell is the key."""
    heads = cells.where((F.col("row") == 0) & (F.col("value") == str(key))).agg(F.min("col").alias("_c"))  # one row
    return cells.where(F.col("row") == row - 1).join(F.broadcast(heads), F.col("col") == F.col("_c")).select("value")


def aggregate(name: str, *args) -> Column:
    f = AGGREGATES.get(name.upper()) or MORE_AGGREGATES.get(name.upper())
    if f is None:
        raise FormulaError(f"unknown aggregate {name}")
    return f(*args)


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, out: str = "looked_up", approximate: bool = False) -> DataFrame:
    """VLOOKUP / XLOOKUP as a join: the value of the equal key, or with ``approximate`` of the largest key not above.

    Table keys that repeat give their smallest value. The approximate form merges both sides in key
    order, dealt by ranges and written once; each row takes the last table entry before it in its
    range, else the one carried over from the ranges before, so neither side is broadcast or sorted
    in one task. Rows with one key may go to several ranges (they are parted by a hash of the row).
    """
    one = table.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias("_k")).agg(F.min(value).alias("_v"))
    if not approximate:
        return df.join(one, F.col(key) == F.col("_k"), "left").withColumn(out, F.col("_v")).drop("_k", "_v")
    from pyspark.sql import Window

    from mensura.operators.sheet import in_order

    kind = F.struct(F.lit(None).cast(one.schema["_v"].dataType).alias("v"))
    plain = [c for c, t in df.dtypes if "map<" not in t]
    rows = df.select(F.col(key).alias("_key"), F.when(F.lit(False), kind).alias("_e"), F.xxhash64(*plain).alias("_s"), F.struct(*df.columns).alias("_row"))
    entries = one.select(F.col("_k").alias("_key"), F.struct(F.col("_v").alias("v")).alias("_e"), F.lit(0).cast("long").alias("_s"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    both = rows.unionByName(entries).withColumn("_o", F.col("_row").isNotNull().cast("int"))
    dealt = in_order(both, ["_key", "_o", "_s"])
    inside = Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumn("_f", F.last("_e", ignorenulls=True).over(inside))
    ends = dealt.groupBy("_p").agg(F.max_by("_e", F.when(F.col("_e").isNotNull(), F.col("_k"))).alias("_x"))  # one row for each range
    carried = ends.select("_p", F.last("_x", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    done = filled.join(F.broadcast(carried), "_p").where(F.col("_row").isNotNull())
    found = F.when(F.col("_key").isNotNull(), F.coalesce("_f", "_c"))
    return done.select("_row.*", found["v"].alias(out))


def ranks(df: DataFrame, value: str, keys: list[str], descending: bool = True) -> DataFrame:
    """RANK and PERCENTRANK within groups of any size: see ``selection.ranks``."""
    from mensura.operators import selection

    return selection.ranks(df, value, keys, descending)


def nth(df: DataFrame, value: str, keys: list[str], k: int, largest: bool = True) -> DataFrame:
    """LARGE and SMALL: the k-th value of each group, of any size: see ``selection.nth``."""
    from mensura.operators import selection

    return selection.nth(df, value, keys, k, largest)
