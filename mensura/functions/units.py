"""Unit conversion with dimensional analysis: a registry, a parser of compound units, literal factors for columns."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.errors import UnitError

BASES = ("M", "L", "T", "I", "Θ", "N", "J")
# SI prefixes.
PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "μ": 1e-6, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24}
#: Symbol, factor to SI, dimension, group.
UNITS = (
    ("m", 1.0, "L1", "si_base"),
    ("kg", 1.0, "M1", "si_base"),
    ("s", 1.0, "T1", "si_base"),
    ("A", 1.0, "I1", "si_base"),
    ("K", 1.0, "Θ1", "si_base"),
    ("mol", 1.0, "N1", "si_base"),
    ("Å", 1e-10, "L1", "length"),
    ("in", 0.0254, "L1", "length"),
    ("ft", 0.3048, "L1", "length"),
    ("yd", 0.9144, "L1", "length"),
    ("mi", 1609.34, "L1", "length"),
    ("mil", 2.54e-5, "L1", "length"),
    ("nmi", 1852.0, "L1", "length"),
    ("fathom", 1.8288, "L1", "length"),
    ("au", 1.495978707e11, "L1", "length"),
    ("ly", 9.4607304725808e15, "L1", "length"),
    ("pc", 3.0857e16, "L1", "length"),
    ("cubit", 0.4572, "L1", "length"),
    ("furlong", 201.168, "L1", "length"),
    ("league", 4828.032, "L1", "length"),
    ("chain", 20.1168, "L1", "length"),
    ("rod", 5.0292, "L1", "length"),
    ("link", 0.201168, "L1", "length"),
    ("point", 0.000352778, "L1", "length"),
    ("pica", 0.00423333, "L1", "length"),
    ("g", 1e-3, "M1", "mass"),
    ("lb", 0.453592, "M1", "mass"),
    ("oz", 0.0283495, "M1", "mass"),
    ("stone", 6.35029, "M1", "mass"),
    ("ton", 907.185, "M1", "mass"),
    ("metric_ton", 1000.0, "M1", "mass"),
    ("grain", 6.4799e-5, "M1", "mass"),
    ("u", 1.66054e-27, "M1", "mass"),
    ("min", 60.0, "T1", "time"),
    ("h", 3600.0, "T1", "time"),
    ("day", 86400.0, "T1", "time"),
    ("week", 604800.0, "T1", "time"),
    ("year", 31557600.0, "T1", "time"),
    ("°C", 1.0, "Θ1", "temperature"),
    ("°F", 5 / 9, "Θ1", "temperature"),
    ("°R", 5 / 9, "Θ1", "temperature"),
    ("°Ré", 1.25, "Θ1", "temperature"),
    ("rad", 1.0, "", "angle"),
    ("deg", math.pi / 180, "", "angle"),
    ("°", math.pi / 180, "", "angle"),
    ("arcmin", math.pi / 10800, "", "angle"),
    ("arcsec", math.pi / 648000, "", "angle"),
    ("grad", math.pi / 200, "", "angle"),
    ("turn", 2 * math.pi, "", "angle"),
    ("m²", 1.0, "L2", "area"),
    ("km²", 1e6, "L2", "area"),
    ("cm²", 1e-4, "L2", "area"),
    ("mm²", 1e-6, "L2", "area"),
    ("in²", 6.4516e-4, "L2", "area"),
    ("ft²", 0.092903, "L2", "area"),
    ("yd²", 0.836127, "L2", "area"),
    ("mi²", 2.59e6, "L2", "area"),
    ("ha", 10000.0, "L2", "area"),
    ("acre", 4046.86, "L2", "area"),
    ("perch", 25.2929, "L2", "area"),
    ("m³", 1.0, "L3", "volume"),
    ("L", 1e-3, "L3", "volume"),
    ("cm³", 1e-6, "L3", "volume"),
    ("in³", 1.6387e-5, "L3", "volume"),
    ("ft³", 0.0283168, "L3", "volume"),
    ("yd³", 0.764555, "L3", "volume"),
    ("gal", 0.00378541, "L3", "volume"),
    ("qt", 0.000946353, "L3", "volume"),
    ("pt", 0.000473176, "L3", "volume"),
    ("cup", 0.000236588, "L3", "volume"),
    ("fl_oz", 2.9574e-5, "L3", "volume"),
    ("tbsp", 1.4787e-5, "L3", "volume"),
    ("tsp", 4.9289e-6, "L3", "volume"),
    ("bbl", 0.158987, "L3", "volume"),
    ("bushel", 0.0352391, "L3", "volume"),
    ("imp_gal", 0.00454609, "L3", "volume"),
    ("imp_qt", 0.00113652, "L3", "volume"),
    ("imp_pt", 0.000568261, "L3", "volume"),
    ("imp_fl_oz", 2.84131e-5, "L3", "volume"),
    ("m/s", 1.0, "L1 T-1", "velocity"),
    ("km/h", 1 / 3.6, "L1 T-1", "velocity"),
    ("mph", 0.44704, "L1 T-1", "velocity"),
    ("fps", 0.3048, "L1 T-1", "velocity"),
    ("c", 299792458.0, "L1 T-1", "velocity"),
    ("kn", 0.514444, "L1 T-1", "velocity"),
    ("m/s²", 1.0, "L1 T-2", "acceleration"),
    ("ft/s²", 0.3048, "L1 T-2", "acceleration"),
    ("g₀", 9.80665, "L1 T-2", "acceleration"),
    ("g_0", 9.80665, "L1 T-2", "acceleration"),
    ("N", 1.0, "M1 L1 T-2", "force"),
    ("lbf", 4.44822, "M1 L1 T-2", "force"),
    ("kgf", 9.80665, "M1 L1 T-2", "force"),
    ("dyn", 1e-5, "M1 L1 T-2", "force"),
    ("Pa", 1.0, "M1 L-1 T-2", "pressure"),
    ("bar", 1e5, "M1 L-1 T-2", "pressure"),
    ("atm", 101325.0, "M1 L-1 T-2", "pressure"),
    ("psi", 6894.76, "M1 L-1 T-2", "pressure"),
    ("mmHg", 133.322, "M1 L-1 T-2", "pressure"),
    ("torr", 133.322, "M1 L-1 T-2", "pressure"),
    ("inHg", 3386.39, "M1 L-1 T-2", "pressure"),
    ("bar_abs", 100000.0, "M1 L-1 T-2", "pressure"),
    ("J", 1.0, "M1 L2 T-2", "energy"),
    ("cal", 4.184, "M1 L2 T-2", "energy"),
    ("kcal", 4184.0, "M1 L2 T-2", "energy"),
    ("BTU", 1055.06, "M1 L2 T-2", "energy"),
    ("kWh", 3.6e6, "M1 L2 T-2", "energy"),
    ("Wh", 3600.0, "M1 L2 T-2", "energy"),
    ("eV", 1.602176634e-19, "M1 L2 T-2", "energy"),
    ("erg", 1e-7, "M1 L2 T-2", "energy"),
    ("dyne_cm", 1e-7, "M1 L2 T-2", "energy"),
    ("W", 1.0, "M1 L2 T-3", "power"),
    ("hp", 745.7, "M1 L2 T-3", "power"),
    ("PS", 735.5, "M1 L2 T-3", "power"),
    ("erg/s", 1e-7, "M1 L2 T-3", "power"),
    ("ft.lbf/min", 0.0225969667, "M1 L2 T-3", "power"),
    ("BTU/h", 0.29307107, "M1 L2 T-3", "power"),
    ("cd", 1.0, "J1", "luminous_intensity"),
    ("cp", 0.981, "J1", "luminous_intensity"),
    ("hk", 0.903, "J1", "luminous_intensity"),
    ("Hz", 1.0, "T-1", "frequency"),
    ("V", 1.0, "M1 L2 T-3 I-1", "voltage"),
    ("Ω", 1.0, "M1 L2 T-3 I-2", "resistance"),
    ("F", 1.0, "M-1 L-2 T4 I2", "capacitance"),
    ("H", 1.0, "M1 L2 T-2 I-2", "inductance"),
    ("S", 1.0, "M-1 L-2 T3 I2", "conductance"),
    ("T", 1.0, "M1 T-2 I-1", "magnetic_flux_density"),
    ("G", 1e-4, "M1 T-2 I-1", "magnetic_flux_density"),
    ("gamma", 1e-9, "M1 T-2 I-1", "magnetic_flux_density"),
    ("Wb", 1.0, "M1 L2 T-2 I-1", "magnetic_flux"),
    ("Mx", 1e-8, "M1 L2 T-2 I-1", "magnetic_flux"),
    ("unit_pole", 1e-8, "M1 L2 T-2 I-1", "magnetic_flux"),
    ("statWb", 2.99792458e10, "M1 L2 T-2 I-1", "magnetic_flux"),
    ("C", 1.0, "T1 I1", "electric_charge"),
    ("Bq", 1.0, "T-1", "radiation_activity"),
    ("Ci", 3.7e10, "T-1", "radiation_activity"),
    ("Gy", 1.0, "L2 T-2", "radiation_dose"),
    ("Sv", 1.0, "L2 T-2", "radiation_dose"),
    ("rem", 0.01, "L2 T-2", "radiation_dose"),
    ("rd", 0.01, "L2 T-2", "radiation_dose"),
    ("lx", 1.0, "J1 L-2", "illuminance"),
    ("fc", 10.764, "J1 L-2", "illuminance"),
    ("ph", 10000.0, "J1 L-2", "illuminance"),
    ("byte", 8.0, "", "data_storage"),
    ("bit", 1.0, "", "data_storage"),
    ("Kibit", 1024.0, "", "data_storage"),
    ("Mibit", 1048576.0, "", "data_storage"),
    ("Gibit", 1073741824.0, "", "data_storage"),
    ("KiB", 8192.0, "", "data_storage"),
    ("MiB", 8388608.0, "", "data_storage"),
    ("GiB", 8589934592.0, "", "data_storage"),
    ("FLOPS", 1.0, "T-1", "computing"),
    ("MIPS", 1e6, "T-1", "computing"),
    ("tex", 1e-6, "M1 L-1", "textile"),
    ("denier", 1.111e-7, "M1 L-1", "textile"),
)
#: Units that are also registered with SI prefixes, by group; the factor of each follows from both.
PREFIXED = (
    ("m", ("m", "c", "k", "μ", "n",), "length"),
    ("g", ("m", "μ",), "mass"),
    ("s", ("n", "μ", "m",), "time"),
    ("L", ("m",), "volume"),
    ("Pa", ("k", "M", "G",), "pressure"),
    ("Pa", ("h",), "pressure"),
    ("bar", ("m",), "pressure"),
    ("J", ("k", "M", "G",), "energy"),
    ("eV", ("k", "M", "G",), "energy"),
    ("W", ("k", "M", "G", "m",), "power"),
    ("A", ("m", "μ", "k",), "current"),
    ("mol", ("m", "μ", "k",), "amount"),
    ("cd", ("m", "k", "M",), "luminous_intensity"),
    ("Hz", ("k", "M", "G",), "frequency"),
    ("V", ("m", "k", "M",), "voltage"),
    ("Ω", ("m", "k", "M",), "resistance"),
    ("F", ("μ", "n", "p",), "capacitance"),
    ("H", ("m", "μ", "n",), "inductance"),
    ("S", ("m", "μ",), "conductance"),
    ("T", ("m", "μ",), "magnetic_flux_density"),
    ("Wb", ("m",), "magnetic_flux"),
    ("C", ("m", "μ", "n", "p", "k", "M",), "electric_charge"),
    ("byte", ("k", "M", "G", "T", "P",), "data_storage"),
)
# Rounded factors that win over the registry for these pairs.
QUICK = {("cm", "in"): 0.393701, ("in", "cm"): 2.54, ("ft", "m"): 0.3048, ("m", "ft"): 3.28084, ("mi", "km"): 1.60934, ("km", "mi"): 0.621371, ("lb", "kg"): 0.453592, ("kg", "lb"): 2.20462, ("oz", "g"): 28.3495, ("g", "oz"): 0.035274}
# kelvin = scale * value + offset.
TEMPERATURES = {"K": (1.0, 0.0), "°C": (1.0, 273.15), "°F": (5 / 9, 273.15 - 32 * 5 / 9), "°R": (5 / 9, 0.0), "°Ré": (1.25, 273.15)}
#: Categories that the front page names.
SUPPORTED = ("length", "mass", "time", "temperature", "area", "volume", "velocity", "force", "pressure", "energy", "power", "angle")
_SUPERSCRIPTS = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")


@dataclass(frozen=True)
class Unit:
    symbol: str
    dimension: tuple[int, ...]
    factor: float
    group: str = "other"

    @property
    def formula(self) -> str:
        """``[M·L^2·T^-2]``, or ``[dimensionless]``."""
        parts = [b if n == 1 else f"{b}^{n}" for b, n in zip(BASES, self.dimension) if n]
        return f"[{'·'.join(parts) or 'dimensionless'}]"


def _dimension(text: str) -> tuple[int, ...]:
    of = {m[0]: int(m[1]) for m in re.findall(r"([A-ZΘ])(-?\d+)", text)}
    return tuple(of.get(b, 0) for b in BASES)


@functools.lru_cache(1)
def registry() -> dict[str, Unit]:
    out = {symbol: Unit(symbol, _dimension(dimension), factor, group) for symbol, factor, dimension, group in UNITS}
    for base, prefixes, group in PREFIXED:
        of = out[base]
        for p in prefixes:
            symbol = p + ("B" if base == "byte" else base)
            out[symbol] = Unit(symbol, of.dimension, PREFIXES[p] * of.factor, group)
    return out


#: Symbols of the units by group.
GROUPS = {group: tuple(s for s, u in registry().items() if u.group == group) for group in dict.fromkeys(u.group for u in registry().values())}


def _resolve(token: str) -> Unit:
    units = registry()
    if token in units:
        return units[token]
    for p in sorted(PREFIXES, key=len, reverse=True):
        if token.startswith(p) and token[len(p):] in units:
            u = units[token[len(p):]]
            return Unit(token, u.dimension, PREFIXES[p] * u.factor, u.group)
    raise UnitError(f"unknown unit {token!r}")


_TOKEN = re.compile(r"([^\W\d_]+(?:_[^\W\d]\w*)?|[°μΩÅ][^\W\d_]*)(?:(?:\^|\*\*)?([-+]?\d+)|(?:\^|\*\*)(\S*))?$")


@functools.lru_cache(4096)
def parse_unit(text: str) -> Unit:
    """A unit or a product of powers. Parentheses are ignored and everything after a slash divides."""
    text = text.strip()
    try:
        return _resolve(text)
    except UnitError:
        pass
    plain = text.translate(_SUPERSCRIPTS).replace("(", "").replace(")", "").replace("**", "^").replace("*", " ").replace("·", " ").replace("/", " / ")
    dim, factor, sign, seen = [0] * 7, 1.0, 1, False
    for token in plain.split():
        if token == "/":
            sign = -1
            continue
        if token == "1":
            continue
        m = _TOKEN.match(token)
        if not m:
            raise UnitError(f"unknown unit {text!r}")
        u = _resolve(m[1])
        n = sign * int(m[2] or 1)
        dim = [a + n * b for a, b in zip(dim, u.dimension)]
        factor *= u.factor**n
        seen = True
    if not seen:
        raise UnitError(f"empty unit {text!r}")
    return Unit(text, tuple(dim), factor)


def affine(source: str, target: str, exact: bool = False) -> tuple[float, float]:
    """(scale, offset) with target = scale * source + offset. ``exact`` passes over the rounded factors."""
    source, target = source.strip(), target.strip()
    if source == target:
        parse_unit(source)
        return 1.0, 0.0
    if source in TEMPERATURES and target in TEMPERATURES:
        (a, b), (c, d) = TEMPERATURES[source], TEMPERATURES[target]
        return a / c, (b - d) / c
    if not exact and (source, target) in QUICK:
        return QUICK[source, target], 0.0
    u, v = parse_unit(source), parse_unit(target)
    if u.dimension != v.dimension:
        raise UnitError(f"{source} {u.formula} and {target} {v.formula} are incompatible")
    return u.factor / v.factor, 0.0


def convert_value(value: float, source: str, target: str, exact: bool = False) -> dict:
    """Value, text and factor (converted over original, 0 for 0) of one number."""
    a, b = affine(source, target, exact)
    out = a * value + b
    return {"value": out, "formatted": format_value(out), "factor": (out / value if value else 0.0) if b else a}


def convert(value: Column, source: str, target: str, exact: bool = False) -> Column:
    """A column converted by a literal scale and offset, which generated code folds in."""
    a, b = affine(source, target, exact)
    out = value if a == 1.0 else value * F.lit(a)
    return out + F.lit(b) if b else out


def compatible(source: str, target: str) -> bool:
    try:
        return parse_unit(source).dimension == parse_unit(target).dimension
    except UnitError:
        return False


def valid(text: str) -> bool:
    try:
        parse_unit(text)
        return True
    except UnitError:
        return False


def preview(source: str, target: str) -> dict:
    return convert_value(1.0, source, target)


def format_value(x: float) -> str:
    if x == 0:
        return "0"
    if abs(x) >= 1e6 or abs(x) < 1e-6:
        return f"{x:.6e}"
    s = f"{x:.6f}" if abs(x) >= 1 else f"{x:.8f}"
    return s.rstrip("0").rstrip(".")


def format_column(x: Column) -> Column:
    """``format_value`` over a column."""
    trim = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    size = F.abs(x)
    return (
        F.when(x == 0, "0")
        .when((size >= 1e6) | (size < 1e-6), F.format_string("%.6e", x))
        .when(size >= 1, trim(F.format_string("%.6f", x)))
        .otherwise(trim(F.format_string("%.8f", x)))
    )


def unit_table(spark: SparkSession) -> DataFrame:
    """The registry as a table: symbol, category, factor, formula, and seven exponents. A few hundred rows."""
    rows = [(u.symbol, u.group, u.factor, u.formula, *u.dimension) for u in registry().values()]
    return spark.createDataFrame(rows, "symbol string, category string, factor double, formula string, m int, l int, t int, i int, th int, n int, j int")


def convert_columns(df: DataFrame, value: str, source: str, target: str, out: str = "converted") -> DataFrame:
    """Row-wise conversion where units are columns.

    Distinct pairs of units are a vocabulary: they are resolved on the driver after a check that
    there are at most 100,000, and their factors are joined by broadcast. Unknown and incompatible
    pairs give null.
    """
    pairs = df.select(source, target).where(F.col(source).isNotNull() & F.col(target).isNotNull()).distinct().limit(100_001).collect()
    if len(pairs) > 100_000:
        raise UnitError("more than 100,000 distinct unit pairs; normalise the unit columns first")
    rows = []
    for s, t in pairs:
        try:
            rows.append((s, t, *affine(s, t)))
        except UnitError:
            rows.append((s, t, None, None))
    table = df.sparkSession.createDataFrame(rows, "_s string, _t string, _a double, _b double")
    joined = df.join(F.broadcast(table), (F.col(source) == F.col("_s")) & (F.col(target) == F.col("_t")), "left")
    return joined.withColumn(out, F.col(value) * F.col("_a") + F.col("_b")).drop("_s", "_t", "_a", "_b")
