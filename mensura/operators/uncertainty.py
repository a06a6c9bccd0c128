"""First-order propagation of uncertainty, confidence levels, and the text forms of uncertain values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.errors import DataError, FormulaError
from mensura.expr import formula as X
from mensura.functions import special

CONFIDENCE = 0.95


def z_of(percent: float) -> float:
    """Half-width in standard deviations of a central interval: 0 for 0 %, infinite for 100 %."""
    if not (isinstance(percent, (int, float)) and 0 <= percent <= 100):
        raise DataError(f"confidence must be between 0 and 100 percent, not {percent}")
    return special.normal_quantile(1 - (1 - percent / 100) / 2)


def percent_of(z: float) -> float:
    if not (math.isfinite(z) and z > 0):
        raise DataError(f"coverage factor must be positive and finite, not {z}")
    return (1 - 2 * (1 - special.normal_cdf(z))) * 100


def _checked(names: Sequence[str]) -> list[str]:
    low = [n.strip().lower() for n in names]
    if len(set(low)) != len(low):
        raise FormulaError("variable names differ only by case")
    return low


def sigma_expression(formula: str, names: Sequence[str]) -> X.Expr:
    """sqrt(sum((df/dx * sigma_x)^2)) as an expression in the variables and ``sigma_<variable>``."""
    low = _checked(names)
    e = X.parse(formula, low)
    total: X.Expr = X.ZERO
    for n in low:
        d = X.diff(e, n)
        if d != X.ZERO:
            total = X.add(total, X.power(X.mul(d, X.Sym(f"sigma_{n}")), X.TWO))
    return X.ZERO if total == X.ZERO else X.call("sqrt", total)


def calculate(formula: str, variables: Sequence[tuple[str, float, float]]) -> dict:
    """One evaluation: value, sigma, finite derivatives by original name, and the texts of sigma."""
    names = _checked([v[0] for v in variables])
    e = X.parse(formula, names)
    at = {n: v for n, (_, v, _) in zip(names, variables)}
    value = float(X.to_numpy(e, at))
    slopes = {n: float(X.to_numpy(X.diff(e, n), at)) for n in names}
    sigma = math.sqrt(sum((slopes[n] * s) ** 2 for n, (_, _, s) in zip(names, variables) if s))
    if not (math.isfinite(value) and math.isfinite(sigma)):
        raise DataError("the result is not finite")
    sig = sigma_expression(formula, names)
    return {"value": value, "sigma": sigma, "confidence": CONFIDENCE, "derivatives": {v[0]: slopes[n] for n, v in zip(names, variables) if math.isfinite(slopes[n])}, "formula": X.to_text(sig), "latex": X.to_latex(sig)}


def propagate(
    df: DataFrame,
    formula: str,
    variables: Mapping[str, tuple[Column | str, Column | str | None]],
    value: str = "value",
    sigma: str = "sigma",
    in_confidence: Mapping[str, float] | None = None,
    out_confidence: float | None = None,
) -> DataFrame:
    """Adds a formula's value and its first-order uncertainty, as built-in expressions of each row.

    ``variables`` binds each name to its column and that of its uncertainty; None means exact.
    Uncertainties given at other confidence levels are scaled to ``out_confidence``. Rows with a
    null input get null, as do divisions by zero; ``finite_report`` counts what is not finite.
    """
    names = _checked(list(variables))
    col = lambda c: F.col(c) if isinstance(c, str) else c
    bound = {n: col(v) for n, (v, _) in zip(names, variables.values())}
    known = []
    for n, (key, (_, s)) in zip(names, variables.items()):
        if s is None:
            continue
        c = col(s)
        if in_confidence and out_confidence and key in in_confidence:
            k = z_of(out_confidence) / z_of(in_confidence[key])
            c = c if abs(k - 1) < 1e-10 else c * F.lit(k)
        bound[f"sigma_{n}"] = c
        known.append(n)
    e = X.parse(formula, names)
    total = None
    for n in known:
        d = X.diff(e, n)
        if d != X.ZERO:
            t = X.to_column(d, bound) * bound[f"sigma_{n}"]
            total = t * t if total is None else total + t * t
    return df.withColumns({value: X.to_column(e, bound), sigma: F.lit(0.0) if total is None else F.sqrt(total)})


def propagate_asymmetric(df, formula: str, variables: Mapping[str, tuple], value="value", upper="upper", lower="lower") -> DataFrame:
    """``variables``: name -> (value, upper, lower); a second pass uses the lower bounds (upper if absent)."""
    up = {n: (v, u) for n, (v, u, _) in variables.items()}
    down = {n: (v, lo if lo is not None else u) for n, (v, u, lo) in variables.items()}
    out = propagate(df, formula, up, value, upper)
    return propagate(out, formula, down, "_again", lower).drop("_again")


def finite_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column the number of nulls and of NaN or infinite values."""
    aggs = []
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"{c}_nonfinite")]
    return df.agg(*aggs)


def rescale(sigma: Column, source_percent: float, target_percent: float) -> Column:
    """Uncertainty moved between confidence levels, both strictly between 0 and 100."""
    for p in (source_percent, target_percent):
        if not 0 < p < 100:
            raise DataError(f"confidence must be strictly between 0 and 100 percent, not {p}")
    return sigma * F.lit(z_of(target_percent) / z_of(source_percent))


def absolute(value: Column, bound: Column, kind: Column | str) -> Column:
    """An absolute bound: relative ones are percent of the value's size."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(kind == "relative", F.abs(value) * bound * 0.01).otherwise(bound)


# ---------------------------------------------------------------- text forms

_N = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_U = r"((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*(%?)"
_PM = r"(?:±|\+/-|\+-|-\+|/\+)"
#: (pattern, groups of nominal, upper, upper %, lower, lower %), tried in this order.
_FORMS = (
    (rf"^{_N}\s*{_PM}\s*{_U}$", 1, 2, 3, None, None),
    (rf"^{_N}\s*\+\s*{_U}\s*/?\s*-\s*{_U}$", 1, 2, 3, 4, 5),
    (rf"^{_N}\s*-\s*{_U}\s*/?\s*\+\s*{_U}$", 1, 4, 5, 2, 3),
    (rf"^{_PM}\s*{_U}$", None, 1, 2, None, None),
    (rf"^\+\s*{_U}\s*/?\s*-\s*{_U}$", None, 1, 2, 3, 4),
)
_CONCISE = r"^([+-]?\d+)(?:\.(\d+))?\((\d+)\)$"


def parse_plus_minus(text: Column, fallback: Column | None = None) -> Column:
    """``value ± bound`` text to struct(nominal, upper, lower, upper_type, lower_type), null if no form fits.

    Understands ±, +-, +/-, separate bounds in either order, percent bounds, concise ``5.00(12)``,
    and bare bounds with a fallback nominal. The first form that fits wins.
    """
    t = F.trim(F.translate(text, "−–—＋％", "---+%"))

    def group(p, k):
        return F.regexp_extract(t, p, k)

    def number(p, k):
        return group(p, k).try_cast("double") if k else (fallback if fallback is not None else F.lit(None).cast("double"))

    def kind(p, k):
        return F.when(group(p, k) == "%", "relative").otherwise("absolute")

    def row(nominal, upper, lower, ut, lt):
        return F.when(nominal.isNotNull() & upper.isNotNull(), F.struct(nominal.alias("nominal"), upper.alias("upper"), lower.alias("lower"), ut.alias("upper_type"), lt.alias("lower_type")))

    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    forms = []
    for p, n, u, up, lo, lp in _FORMS:
        forms.append(F.when(t.rlike(p), row(number(p, n), number(p, u), number(p, lo) if lo else none_d, kind(p, up), kind(p, lp) if lp else none_s)))
    places = F.length(group(_CONCISE, 2))
    nominal = F.concat(group(_CONCISE, 1), F.lit("."), group(_CONCISE, 2), F.lit("0")).try_cast("double")
    bound = F.concat(group(_CONCISE, 3), F.lit("e-"), places.cast("string")).try_cast("double")
    forms.insert(3, F.when(t.rlike(_CONCISE), row(nominal, bound, none_d, F.lit("absolute"), none_s)))
    return F.coalesce(*forms)


def decimals(bound: Column) -> Column:
    """Digits after the point for a bound: two significant ones if it leads with less than 2.95, else one."""
    size = F.abs(bound)
    exponent = F.floor(F.log10(size))
    lead = size / F.pow(F.lit(10.0), exponent)
    return F.when(size > 0, F.greatest(F.lit(0), (F.when(lead < 2.95, 1).otherwise(0) - exponent)).cast("int")).otherwise(F.lit(0))


def format_uncertain(value: Column, upper: Column, lower: Column | None = None) -> Column:
    """``v ± u``, or ``v +u/-l``, with as many decimals as the larger bound calls for."""
    d = decimals(upper if lower is None else F.greatest(upper, lower))
    pattern = F.concat(F.lit("%."), d.cast("string"), F.lit("f"))
    fixed = lambda x: F.call_function("format_string", pattern, x.cast("double"))
    if lower is None:
        return F.concat(fixed(value), F.lit(" ± "), fixed(upper))
    return F.concat(fixed(value), F.lit(" +"), fixed(upper), F.lit("/-"), fixed(lower))


def edit_text(value: Column, upper: Column, lower: Column | None = None) -> Column:
    """The text that a cell editor shows: ``v ± u`` or ``v +u/-l``, unrounded."""
    s = lambda c: c.cast("string")
    both = F.concat(s(value), F.lit(" ± "), s(upper))
    return both if lower is None else F.when(lower.isNull() | (lower == upper), both).otherwise(F.concat(s(value), F.lit(" +"), s(upper), F.lit("/-"), s(lower)))


def generate(formula: str, rows: int, variables: Mapping[str, tuple[str, str | None]]) -> dict:
    """Cell formulas of a value and its uncertainty, one for each of ``rows`` rows below the first cells given.

    ``variables``: name -> (first cell of its values, of its uncertainties or None). What fails is
    told in the payload, never raised: success, error, value_formulas, sigma_formulas.
    """
    from mensura.operators import sheet

    try:
        names = _checked(list(variables))
        e, sig = X.parse(formula, names), sigma_expression(formula, names)
        refs = {n: X.Sym(v) for n, (v, _) in zip(names, variables.values())}
        refs |= {f"sigma_{n}": X.Sym(s) if s is not None else X.ZERO for n, (_, s) in zip(names, variables.values())}
        texts = ["=" + _named(x, refs) for x in (e, sig)]
        value, sigma = ([sheet.shift(t, k, 0) for k in range(rows)] for t in texts)
        return {"success": True, "error": None, "value_formulas": value, "sigma_formulas": sigma}
    except (FormulaError, DataError) as e:
        return {"success": False, "error": str(e), "value_formulas": [], "sigma_formulas": []}


def _named(e: X.Expr, refs: Mapping[str, X.Expr]) -> str:
    return X.to_text(X.substitute(e, refs))


def autofill(targets: DataFrame, source: DataFrame, index: str = "idx", columns: Sequence[str] = ("upper", "lower")) -> DataFrame:
    """Copies the source's uncertainty cyclically over target rows by index; rows with a formula keep theirs.

    ``source`` is one selection of the user's; its length is read first and is a row count only. One
    of up to 100,000 rows is broadcast, a longer one joined by its row number.
    """
    from mensura.operators.sheet import numbered

    n = source.count()
    if n == 0:
        return targets
    picked = numbered(source.select(index, *columns), [index], "_place").select("_place", *(F.col(c).alias(f"_{c}") for c in columns))
    out = targets.join(F.broadcast(picked) if n <= 100_000 else picked, F.pmod(F.col(index), F.lit(n)) == F.col("_place"), "left")
    keep = F.col("formula").isNotNull() if "formula" in targets.columns else F.lit(False)
    for c in columns:
        out = out.withColumn(c, F.when(keep, F.col(c)).otherwise(F.col(f"_{c}")) if c in targets.columns else F.when(~keep, F.col(f"_{c}")))
    return out.drop("_place", *(f"_{c}" for c in columns))
