"""Free-form formulas: parser, simplifier, exact derivatives, and emitters for Spark, numpy, SQL and LaTeX.

Names are case-insensitive. ``^`` and ``**`` bind tighter than a sign and to the right; a product
must be written. Declared symbols win over the constants ``pi`` and ``e``. ``log`` is natural.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from mensura.errors import FormulaError

CONSTANTS = {"pi": math.pi, "e": math.e}


@dataclass(frozen=True)
class Expr:
    def __add__(self, o):
        return add(self, o)

    def __sub__(self, o):
        return add(self, mul(Num(-1.0), o))

    def __mul__(self, o):
        return mul(self, o)

    def __truediv__(self, o):
        return div(self, o)

    def __neg__(self):
        return mul(Num(-1.0), self)


@dataclass(frozen=True)
class Num(Expr):
    value: float


@dataclass(frozen=True)
class Sym(Expr):
    name: str


@dataclass(frozen=True)
class Call(Expr):
    """An operation (+ * / ^) or a named function."""

    fn: str
    args: tuple[Expr, ...]


ZERO, ONE, TWO = Num(0.0), Num(1.0), Num(2.0)


def add(a: Expr, b: Expr) -> Expr:
    if isinstance(a, Num) and isinstance(b, Num):
        return Num(a.value + b.value)
    if a == ZERO:
        return b
    if b == ZERO:
        return a
    if a == b:
        return mul(TWO, a)
    return Call("+", (a, b))


def mul(a: Expr, b: Expr) -> Expr:
    if isinstance(b, Num) and not isinstance(a, Num):
        a, b = b, a
    if isinstance(a, Num):
        if isinstance(b, Num):
            return Num(a.value * b.value)
        if a == ZERO:
            return ZERO
        if a == ONE:
            return b
        if isinstance(b, Call) and b.fn == "*" and isinstance(b.args[0], Num):
            return mul(Num(a.value * b.args[0].value), b.args[1])
    return Call("*", (a, b))


def div(a: Expr, b: Expr) -> Expr:
    if a == ZERO and b != ZERO:
        return ZERO
    if b == ONE:
        return a
    if isinstance(a, Num) and isinstance(b, Num) and b.value:
        return Num(a.value / b.value)
    return Call("/", (a, b))


def power(a: Expr, b: Expr) -> Expr:
    if b == ZERO:
        return ONE
    if b == ONE:
        return a
    if isinstance(a, Num) and isinstance(b, Num):
        try:
            v = a.value**b.value
        except (OverflowError, ZeroDivisionError):
            v = None
        if isinstance(v, float):
            return Num(v)
    return Call("^", (a, b))


def call(fn: str, *args: Expr) -> Expr:
    return Call(fn, args)


# ---------------------------------------------------------------- functions

#: Other spellings of function names.
ALIASES = {"sen": "sin", "log": "ln", "arcsin": "asin", "arccos": "acos", "arctan": "atan", "sign": "signum", "ceiling": "ceil", "ynm": "spherical_harmonic", "tg": "tan"}


@dataclass(frozen=True)
class Function:
    """``column``: built-in Spark form or None; ``array``: numpy form; ``slopes``: derivative by argument."""

    arity: int
    column: Callable[..., Column] | None
    array: Callable[..., np.ndarray]
    slopes: tuple[Callable[..., Expr] | None, ...]
    sql: str | None = None


def _special(name):
    def run(*args):
        from mensura.functions import special

        return getattr(special, name)(*args)

    return run


def _through_zero(x, far, near, width: float = 1e-4):
    x = np.asarray(x, float)
    small = np.abs(x) < width
    return np.where(small, near(x), far(np.where(small, 1.0, x)))


def _registry() -> dict[str, Function]:
    c, sq = call, lambda u: mul(u, u)
    sqrt = lambda u: c("sqrt", u)
    inv = lambda u: div(ONE, u)
    one = lambda f, a, d, s=None: Function(1, f, a, (d,), s)
    n = np
    out = {
        "sin": one(F.sin, n.sin, lambda u: c("cos", u)),
        "cos": one(F.cos, n.cos, lambda u: -c("sin", u)),
        "tan": one(F.tan, n.tan, lambda u: add(ONE, sq(c("tan", u)))),
        "sec": one(F.sec, lambda x: 1 / n.cos(x), lambda u: mul(c("sec", u), c("tan", u)), "(1/cos({0}))"),
        "csc": one(F.csc, lambda x: 1 / n.sin(x), lambda u: -mul(c("csc", u), c("cot", u)), "(1/sin({0}))"),
        "cot": one(F.cot, lambda x: 1 / n.tan(x), lambda u: -add(ONE, sq(c("cot", u)))),
        "asin": one(F.asin, n.arcsin, lambda u: inv(sqrt(ONE - sq(u)))),
        "acos": one(F.acos, n.arccos, lambda u: -inv(sqrt(ONE - sq(u)))),
        "atan": one(F.atan, n.arctan, lambda u: inv(ONE + sq(u))),
        "acot": one(lambda x: F.lit(math.pi / 2) - F.atan(x), lambda x: math.pi / 2 - n.arctan(x), lambda u: -inv(ONE + sq(u)), "(pi()/2-atan({0}))"),
        "asec": one(lambda x: F.acos(1 / x), lambda x: n.arccos(1 / x), lambda u: inv(mul(c("abs", u), sqrt(sq(u) - ONE))), "acos(1/({0}))"),
        "acsc": one(lambda x: F.asin(1 / x), lambda x: n.arcsin(1 / x), lambda u: -inv(mul(c("abs", u), sqrt(sq(u) - ONE))), "asin(1/({0}))"),
        "sinh": one(F.sinh, n.sinh, lambda u: c("cosh", u)),
        "cosh": one(F.cosh, n.cosh, lambda u: c("sinh", u)),
        "tanh": one(F.tanh, n.tanh, lambda u: ONE - sq(c("tanh", u))),
        "sech": one(lambda x: 1 / F.cosh(x), lambda x: 1 / n.cosh(x), lambda u: -mul(c("sech", u), c("tanh", u)), "(1/cosh({0}))"),
        "csch": one(lambda x: 1 / F.sinh(x), lambda x: 1 / n.sinh(x), lambda u: -mul(c("csch", u), c("coth", u)), "(1/sinh({0}))"),
        "coth": one(lambda x: 1 / F.tanh(x), lambda x: 1 / n.tanh(x), lambda u: ONE - sq(c("coth", u)), "(1/tanh({0}))"),
        "asinh": one(F.asinh, n.arcsinh, lambda u: inv(sqrt(sq(u) + ONE))),
        "acosh": one(F.acosh, n.arccosh, lambda u: inv(sqrt(sq(u) - ONE))),
        "atanh": one(F.atanh, n.arctanh, lambda u: inv(ONE - sq(u))),
        "acoth": one(lambda x: F.atanh(1 / x), lambda x: n.arctanh(1 / x), lambda u: inv(ONE - sq(u)), "atanh(1/({0}))"),
        "asech": one(lambda x: F.acosh(1 / x), lambda x: n.arccosh(1 / x), lambda u: -inv(mul(u, sqrt(ONE - sq(u)))), "acosh(1/({0}))"),
        "acsch": one(lambda x: F.asinh(1 / x), lambda x: n.arcsinh(1 / x), lambda u: -inv(mul(c("abs", u), sqrt(sq(u) + ONE))), "asinh(1/({0}))"),
        "exp": one(F.exp, n.exp, lambda u: c("exp", u)),
        "exp_polar": one(F.exp, n.exp, lambda u: c("exp", u), "exp({0})"),
        "ln": one(F.ln, n.log, inv),
        "log10": one(F.log10, n.log10, lambda u: inv(mul(Num(math.log(10)), u))),
        "log2": one(F.log2, n.log2, lambda u: inv(mul(Num(math.log(2)), u))),
        "sqrt": one(F.sqrt, n.sqrt, lambda u: div(Num(0.5), sqrt(u))),
        "cbrt": one(F.cbrt, n.cbrt, lambda u: inv(mul(Num(3.0), sq(c("cbrt", u))))),
        "abs": one(F.abs, n.abs, lambda u: c("signum", u)),
        "signum": one(F.signum, n.sign, lambda u: ZERO, "sign({0})"),
        "floor": one(lambda x: F.floor(x).cast("double"), n.floor, lambda u: ZERO),
        "ceil": one(lambda x: F.ceil(x).cast("double"), n.ceil, lambda u: ZERO),
        "round": one(F.rint, n.rint, lambda u: ZERO),
        "sinc": one(lambda x: F.when(x == 0, 1.0).otherwise(F.sin(x) / F.nullif(x, F.lit(0.0))), lambda x: n.sinc(n.asarray(x) / math.pi), lambda u: c("sinc_slope", u)),
        # the derivative of sinc, and that over its argument, continued through zero
        "sinc_slope": one(
            lambda x: F.when(F.abs(x) < 1e-4, -x / 3).otherwise((F.cos(x) - F.sin(x) / F.nullif(x, F.lit(0.0))) / F.nullif(x, F.lit(0.0))), lambda x: _through_zero(x, lambda v: (n.cos(v) - n.sin(v) / v) / v, lambda v: -v / 3), lambda u: -add(c("sinc", u), mul(TWO, c("sinc_ratio", u)))
        ),
        "sinc_ratio": Function(
            1, lambda x: F.when(F.abs(x) < 1e-3, x * x / 30 - 1 / 3).otherwise((F.cos(x) - F.sin(x) / F.nullif(x, F.lit(0.0))) / F.nullif(x * x, F.lit(0.0))), lambda x: _through_zero(x, lambda v: (n.cos(v) - n.sin(v) / v) / v**2, lambda v: v * v / 30 - 1 / 3, 1e-3), (None,)
        ),
        "atan2": Function(2, F.atan2, n.arctan2, (lambda y, x: div(x, add(sq(x), sq(y))), lambda y, x: -div(y, add(sq(x), sq(y))))),
    }
    sp = lambda name, *slopes: Function(len(slopes), None, _special(name), slopes)
    half = Num(0.5)
    out |= {
        "erf": sp("erf", lambda u: mul(Num(2 / math.sqrt(math.pi)), c("exp", -sq(u)))),
        "erfc": sp("erfc", lambda u: mul(Num(-2 / math.sqrt(math.pi)), c("exp", -sq(u)))),
        "gamma": sp("gamma", lambda u: mul(c("gamma", u), c("digamma", u))),
        "lgamma": sp("lgamma", lambda u: c("digamma", u)),
        "digamma": sp("digamma", lambda u: c("trigamma", u)),
        "trigamma": sp("trigamma", lambda u: c("tetragamma", u)),
        "tetragamma": sp("tetragamma", lambda u: c("polygamma", Num(3.0), u)),
        "polygamma": sp("polygamma", None, lambda k, u: c("polygamma", add(k, ONE), u)),
        "beta": sp("beta", lambda a, b: mul(c("beta", a, b), c("digamma", a) - c("digamma", add(a, b))), lambda a, b: mul(c("beta", a, b), c("digamma", b) - c("digamma", add(a, b)))),
        "zeta": sp("zeta", lambda s: c("zeta_deriv", ONE, s)),
        "zeta_deriv": sp("zeta_deriv", None, lambda k, s: c("zeta_deriv", add(k, ONE), s)),
        "elliptic_k": sp("elliptic_k", lambda k: c("elliptic_e", k) / (k * (ONE - sq(k))) - c("elliptic_k", k) / k),
        "elliptic_e": sp("elliptic_e", lambda k: div(c("elliptic_e", k) - c("elliptic_k", k), k)),
        "hermite": sp("hermite", None, lambda k, x: mul(mul(TWO, k), c("hermite", k - ONE, x))),
        "assoc_legendre": sp("assoc_legendre", None, None, lambda l, m, x: div(mul(mul(l, x), c("assoc_legendre", l, m, x)) - mul(add(l, m), c("assoc_legendre", l - ONE, m, x)), sq(x) - ONE)),
        "spherical_harmonic": sp("spherical_harmonic", None, None, None, None),
        "lambertw": sp("lambertw", lambda u: div(c("lambertw", u), mul(u, add(ONE, c("lambertw", u))))),
        "besselj": sp("besselj", None, lambda k, x: mul(half, c("besselj", k - ONE, x) - c("besselj", add(k, ONE), x))),
        "bessely": sp("bessely", None, lambda k, x: mul(half, c("bessely", k - ONE, x) - c("bessely", add(k, ONE), x))),
        "besseli": sp("besseli", None, lambda k, x: mul(half, c("besseli", k - ONE, x) + c("besseli", add(k, ONE), x))),
        "besselk": sp("besselk", None, lambda k, x: mul(Num(-0.5), c("besselk", k - ONE, x) + c("besselk", add(k, ONE), x))),
    }
    return out


FUNCTIONS = _registry()

# ---------------------------------------------------------------- parser

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([^\W\d]\w*)|(\*\*|[-+*/^(),]))")


def _tokens(text: str) -> list[str]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at:].strip()[:1]!r} in formula {text!r}")
        out.append(m[0].strip().replace("**", "^"))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, symbols: set[str] | None):
        self.t, self.i, self.text, self.symbols = _tokens(text), 0, text, symbols

    def peek(self):
        return self.t[self.i] if self.i < len(self.t) else None

    def take(self, want=None):
        x = self.peek()
        if x is None or want and x != want:
            raise FormulaError(f"expected {want or 'a value'} in formula {self.text!r}")
        self.i += 1
        return x

    def sums(self) -> Expr:
        out = self.products()
        while self.peek() in ("+", "-"):
            out = add(out, self.products()) if self.take() == "+" else out - self.products()
        return out

    def products(self) -> Expr:
        out = self.signed()
        while self.peek() in ("*", "/"):
            out = mul(out, self.signed()) if self.take() == "*" else div(out, self.signed())
        return out

    def signed(self) -> Expr:
        if self.peek() in ("+", "-"):
            return -self.signed() if self.take() == "-" else self.signed()
        base = self.atom()
        if self.peek() == "^":
            self.take()
            return power(base, self.signed())
        return base

    def atom(self) -> Expr:
        x = self.take()
        if x == "(":
            out = self.sums()
            self.take(")")
            return out
        if x[0].isdigit() or x[0] == ".":
            return Num(float(x))
        name = x.lower()
        if not (name[0].isalpha() or name[0] == "_"):
            raise FormulaError(f"unexpected {x!r} in formula {self.text!r}")
        if self.peek() == "(" and not (self.symbols and name in self.symbols):
            fn = ALIASES.get(name, name)
            if fn not in FUNCTIONS and fn != "uncert":
                raise FormulaError(f"unknown function {name!r}")
            self.take("(")
            args = [self.sums()]
            while self.peek() == ",":
                self.take()
                args.append(self.sums())
            self.take(")")
            if fn == "uncert":  # value with attached bounds: the value
                if len(args) not in (2, 3):
                    raise FormulaError("uncert takes a value and one or two bounds")
                return args[0]
            if fn == "round" and len(args) == 1 or len(args) == FUNCTIONS[fn].arity:
                return Call(fn, tuple(args))
            raise FormulaError(f"{name} takes {FUNCTIONS[fn].arity} arguments, not {len(args)}")
        if self.symbols is None:
            return Num(CONSTANTS[name]) if name in CONSTANTS else Sym(name)
        if name in self.symbols:
            return Sym(name)
        if name in CONSTANTS:
            return Num(CONSTANTS[name])
        raise FormulaError(f"unknown symbol {name!r} in formula {self.text!r}")


@functools.lru_cache(64)
def _parsed(text: str, symbols: frozenset | None) -> Expr:
    p = _Parser(text, set(symbols) if symbols is not None else None)
    if not p.t:
        raise FormulaError("empty formula")
    out = p.sums()
    if p.peek() is not None:
        raise FormulaError(f"unexpected {p.peek()!r} in formula {text!r}")
    return out


def parse(text: str, symbols: Iterable[str] | None = None) -> Expr:
    """Formula text to an expression. With ``symbols`` any other name is an error."""
    return _parsed(text, None if symbols is None else frozenset(s.lower() for s in symbols))


def split_equation(text: str) -> tuple[str | None, str]:
    """The first line's ``y = f(x)`` as (y, f(x)); (None, text) without an equals sign."""
    left, eq, right = text.partition("\n")[0].partition("=")
    return (left.strip(), right.strip()) if eq else (None, text.strip())


def symbols(e: Expr) -> set[str]:
    if isinstance(e, Sym):
        return {e.name}
    return set().union(*map(symbols, e.args)) if isinstance(e, Call) else set()


def degree(e: Expr, names: Iterable[str]) -> float:
    """Degree of e as a polynomial in ``names`` as it is written; infinite if it is none."""
    if isinstance(e, Call):
        own = [degree(a, names) for a in e.args]
        if e.fn == "+":
            return max(own)
        if e.fn == "*":
            return sum(own)
        return own[0] if e.fn == "/" and not own[1] else math.inf if any(own) else 0
    return int(isinstance(e, Sym) and e.name in names)


def substitute(e: Expr, values: Mapping[str, Expr | float]) -> Expr:
    """Symbols replaced by expressions or numbers, simplified again."""
    if isinstance(e, Sym):
        v = values.get(e.name, e)
        return v if isinstance(v, Expr) else Num(float(v))
    if isinstance(e, Call):
        return _rebuilt(e.fn, tuple(substitute(a, values) for a in e.args))
    return e


def _rebuilt(fn: str, args: tuple[Expr, ...]) -> Expr:
    return {"+": add, "*": mul, "/": div, "^": power}[fn](*args) if fn in "+*/^" else Call(fn, args)


# ---------------------------------------------------------------- derivatives


@functools.lru_cache(4096)
def diff(e: Expr, name: str) -> Expr:
    """The exact derivative by a symbol. Constant exponents never bring in a logarithm."""
    name = name.lower()
    if isinstance(e, Num):
        return ZERO
    if isinstance(e, Sym):
        return ONE if e.name == name else ZERO
    a = e.args
    if e.fn == "+":
        return add(diff(a[0], name), diff(a[1], name))
    if e.fn == "*":
        return add(mul(diff(a[0], name), a[1]), mul(a[0], diff(a[1], name)))
    if e.fn == "/":
        top = diff(a[0], name)
        below = diff(a[1], name)
        return div(top, a[1]) - div(mul(a[0], below), mul(a[1], a[1])) if below != ZERO else div(top, a[1])
    if e.fn == "^":
        u, v = diff(a[0], name), diff(a[1], name)
        out = mul(mul(a[1], power(a[0], a[1] - ONE)), u) if u != ZERO else ZERO
        return add(out, mul(mul(e, call("ln", a[0])), v)) if v != ZERO else out
    out = ZERO
    for arg, slope in zip(a, FUNCTIONS[e.fn].slopes):
        inner = diff(arg, name)
        if inner != ZERO:
            if slope is None:
                raise FormulaError(f"{e.fn} cannot be differentiated by this argument")
            out = add(out, mul(slope(*a), inner))
    return out


def gradient(e: Expr, names: Iterable[str]) -> list[Expr]:
    return [diff(e, n) for n in names]


def hessian(e: Expr, rows: Iterable[str], columns: Iterable[str]) -> list[list[Expr]]:
    columns = list(columns)
    return [gradient(diff(e, r), columns) for r in rows]


# ---------------------------------------------------------------- emitters


def to_column(e: Expr, columns: Mapping[str, Column]) -> Column:
    """A Spark column of built-in functions (special functions by Arrow UDF). Null inputs give null.

    Division by zero gives null rather than an error; small whole powers are multiplied out.
    """
    if isinstance(e, Num):
        return F.lit(e.value)
    if isinstance(e, Sym):
        return columns[e.name]
    if e.fn == "^" and isinstance(e.args[1], Num) and e.args[1].value in (2.0, 3.0):
        u = to_column(e.args[0], columns)
        return u * u if e.args[1].value == 2 else u * u * u
    a = [to_column(x, columns) for x in e.args]
    if e.fn == "+":
        return a[0] + a[1]
    if e.fn == "*":
        return a[0] * a[1]
    if e.fn == "/":
        return F.try_divide(a[0], a[1])
    if e.fn == "^":
        return F.pow(a[0], a[1])
    f = FUNCTIONS[e.fn]
    if f.column is not None:
        return f.column(*a)
    from mensura.functions import special

    return special.column(e.fn)(*a)


def to_numpy(e: Expr, values: Mapping[str, np.ndarray]):
    """The value over arrays, silently non-finite where the formula is."""
    memo: dict[Expr, object] = {}

    def run(x: Expr):
        if isinstance(x, Num):
            return x.value
        if isinstance(x, Sym):
            return values[x.name]
        if x not in memo:
            a = [run(y) for y in x.args]
            if x.fn == "^" and isinstance(x.args[1], Num) and x.args[1].value in (2.0, 3.0):
                memo[x] = a[0] * a[0] if a[1] == 2 else a[0] * a[0] * a[0]
            elif x.fn in "+*/^":
                memo[x] = {"+": np.add, "*": np.multiply, "/": np.divide, "^": np.power}[x.fn](np.asarray(a[0], float), a[1])
            else:
                memo[x] = FUNCTIONS[x.fn].array(*a)
        return memo[x]

    with np.errstate(all="ignore"):
        return run(e)


def _text(e: Expr, sym: Callable[[str], str], fn: Callable[[str, list[str]], str], pw: Callable[[str, str], str]) -> str:
    if isinstance(e, Num):
        v = e.value
        s = str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
        return f"({s})" if v < 0 else s
    if isinstance(e, Sym):
        return sym(e.name)
    a = [_text(x, sym, fn, pw) for x in e.args]
    if e.fn == "^":
        return pw(*a)
    if e.fn in "+*/":
        return f"({a[0]} {e.fn} {a[1]})"
    return fn(e.fn, a)


def to_text(e: Expr) -> str:
    """A formula that parses to the same expression."""
    return _text(e, str, lambda f, a: f"{f}({', '.join(a)})", lambda b, x: f"({b} ^ {x})")


def to_sql(e: Expr, columns: Mapping[str, str] | None = None, divide: str = "(({0}) / ({1}))") -> str:
    """SQL text; symbols become the given column texts, whole identifiers only."""
    columns = columns or {}

    def num(x: Expr) -> str:
        if isinstance(x, Num):
            return f"CAST({x.value!r} AS DOUBLE)"
        if isinstance(x, Sym):
            return columns.get(x.name, x.name)
        a = [num(y) for y in x.args]
        if x.fn == "/":
            return divide.format(*a)
        if x.fn == "^":
            return f"power({a[0]}, {a[1]})"
        if x.fn in "+*":
            return f"({a[0]} {x.fn} {a[1]})"
        f = FUNCTIONS[x.fn]
        return f.sql.format(*a) if f.sql else f"{x.fn}({', '.join(a)})"

    return num(e)


def to_latex(e: Expr) -> str:
    def name(s: str) -> str:
        if s.startswith("sigma_"):
            return rf"\sigma_{{{s[6:]}}}"
        head, _, tail = s.partition("_")
        return f"{head}_{{{tail}}}" if tail else head

    def go(x: Expr, level: int = 0) -> str:
        if isinstance(x, Num):
            return f"{x.value:g}"
        if isinstance(x, Sym):
            return name(x.name)
        if x.fn == "/":
            return rf"\frac{{{go(x.args[0])}}}{{{go(x.args[1])}}}"
        if x.fn == "^":
            return f"{go(x.args[0], 3)}^{{{go(x.args[1])}}}"
        if x.fn == "+":
            s = f"{go(x.args[0], 1)} + {go(x.args[1], 1)}".replace("+ -", "- ")
            return rf"\left({s}\right)" if level > 1 else s
        if x.fn == "*":
            s = "-" + go(x.args[1], 2) if x.args[0] == Num(-1.0) else rf"{go(x.args[0], 2)} \cdot {go(x.args[1], 2)}"
            return rf"\left({s}\right)" if level > 2 else s
        if x.fn == "sqrt":
            return rf"\sqrt{{{go(x.args[0])}}}"
        head = rf"\{x.fn}" if x.fn in ("sin", "cos", "tan", "exp", "ln", "sinh", "cosh", "tanh", "sec", "csc", "cot") else rf"\operatorname{{{x.fn.replace('_', ' ')}}}"
        return rf"{head}\left({', '.join(map(go, x.args))}\right)"

    return go(e)
