"""Orthogonal distance regression: profiled over the true abscissas, on numpy arrays.

For a point with block b = (x, y), covariance S and W = S^-1, the corrections c to x minimise
r' W r with r = (-c, y - f(x + c)). The objective of the parameters alone has, at that minimum,
gradient -f_beta' (W r)_y and the exact Hessian H_bb - H_bc H_cc^-1 H_cb, which the solver and the
inference use. Layers of a model share the parameters; each layer corrects its own abscissas.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np

from mensura.errors import DataError, FormulaError
from mensura.expr import formula as X
from mensura.functions.special import normal_quantile, student_quantile

# Numerical thresholds of the method.
MIN_SIGMA, MIN_VARIANCE = 1e-8, 1e-16
CORRECTED_ABOVE = 2 * MIN_VARIANCE
INNER_ROUNDS, INNER_TOLERANCE = 30, 1e-12
RANK_EPS, PSD_TOLERANCE = 1e-14, 1e-10
DAMPING_RANGE, GROWTH_CAP, REJECTIONS = (1e-15, 1e15), 1e12, 25
#: Iterations at least, besides half of those allowed, after which a fit is begun anew with steps that all lead downhill.
RESTART = 50
NORMAL_K = 1.959963984540054


@dataclass(frozen=True)
class Layer:
    """``dependent = formula(independents, parameters)``."""

    formula: str
    dependent: str
    independents: tuple[str, ...]


@dataclass(frozen=True)
class FitSpec:
    """A fit request. ``sigmas`` names the column of each variable's uncertainty; ``correlation`` is a
    matrix over the variables in order of first use (independents of a layer, then its dependent)."""

    layers: tuple[Layer, ...]
    parameters: tuple[str, ...]
    guesses: tuple[float, ...] | None = None
    fixed: Mapping[str, float] = field(default_factory=dict)
    sigmas: Mapping[str, str] = field(default_factory=dict)
    poisson: bool = False
    correlation: Sequence[Sequence[float]] | None = None
    type_a: Mapping[str, float | None] = field(default_factory=dict)  # variable -> degrees of freedom, None: n - 1
    max_iterations: int = 200
    tolerance: float = 1e-9
    damping: float = 1e-3
    confidence: float = 0.95

    @classmethod
    def single(cls, formula: str, dependent: str, independents: Sequence[str], parameters: Sequence[str], **kw) -> FitSpec:
        return cls((Layer(formula, dependent, tuple(independents)),), tuple(parameters), **kw)

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(v for la in self.layers for v in (*la.independents, la.dependent)))

    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.variables, *self.sigmas.values()]))


def _name(n: str) -> str:
    n = n.strip().lower()
    if not n or not (n[0].isalpha() or n[0] == "_") or not all(c.isalnum() or c == "_" for c in n):
        raise FormulaError(f"{n!r} is not an identifier")
    return n


class Compiled:
    """A layer's model with the derivatives that profiling needs."""

    def __init__(self, formula: str, independents: tuple[str, ...], parameters: tuple[str, ...], fixed: tuple = ()):
        xs, ps = [_name(x) for x in independents], [_name(p) for p in parameters]
        if set(xs) & set(ps) or len(set(xs)) < len(xs) or len(set(ps)) < len(ps):
            raise FormulaError("variables and parameters must be distinct names")
        e = X.parse(X.split_equation(formula)[1], [*xs, *ps, *(k for k, _ in fixed)])
        e = X.substitute(e, dict(fixed))
        self.xs, self.ps = xs, ps
        self.parts = {
            "f": [e], "p": X.gradient(e, ps), "x": X.gradient(e, xs),
            "xx": sum(X.hessian(e, xs, xs), []), "xp": sum(X.hessian(e, xs, ps), []), "pp": sum(X.hessian(e, ps, ps), []),
        }

    def __call__(self, x: np.ndarray, beta: np.ndarray, what: str = "f p x xx xp pp") -> dict[str, np.ndarray]:
        """Values and derivatives at ``x``; ``beta`` is one vector, or one for each point (then non-finite values pass)."""
        n, k, q = len(x), len(self.xs), len(self.ps)
        at = {v: x[:, i] for i, v in enumerate(self.xs)} | {p: np.float64(b) if beta.ndim == 1 else b for p, b in zip(self.ps, beta.T)}
        shape = {"f": (n,), "p": (n, q), "x": (n, k), "xx": (n, k, k), "xp": (n, k, q), "pp": (n, q, q)}
        out = {}
        for w in what.split():
            cols = [np.broadcast_to(np.asarray(X.to_numpy(e, at), float), (n,)) for e in self.parts[w]]
            out[w] = np.stack(cols, -1).reshape(shape[w]) if cols else np.zeros(shape[w])
            if beta.ndim == 1 and not np.isfinite(out[w]).all():
                raise DataError("the model is not finite at some point")
        return out


@functools.lru_cache(64)
def compiled(formula: str, independents: tuple[str, ...], parameters: tuple[str, ...], fixed: tuple = ()) -> Compiled:
    return Compiled(formula, independents, parameters, fixed)


@dataclass
class Points:
    """Prepared data: values and uncertainties by variable, notes on what was done to them."""

    values: dict[str, np.ndarray]
    sigmas: dict[str, np.ndarray]
    rho: np.ndarray | None
    order: tuple[str, ...]
    clamped: int = 0
    low_counts: bool = False
    zero_counts: bool = False
    dof: dict[str, float] = field(default_factory=dict)
    inferred_dof: int = 0

    def __len__(self):
        return len(next(iter(self.values.values())))

    def block(self, names: Sequence[str]) -> np.ndarray:
        """Covariance (n, d, d) of some variables, made positive definite where needed."""
        s = np.stack([self.sigmas[v] for v in names], -1)
        out = s[:, :, None] * s[:, None, :]
        if self.rho is None:
            out = out * np.eye(len(names))
        else:
            at = [self.order.index(v) for v in names]
            out = out * self.rho[..., at, :][..., :, at]
        d = np.arange(len(names))
        out[:, d, d] = np.maximum(out[:, d, d], MIN_VARIANCE)
        return out


def prepare(spec: FitSpec, columns: Mapping[str, np.ndarray]) -> Points:
    """Checks shapes, numbers and correlations; clamps tiny uncertainties; sets Poisson ones."""
    values, sigmas = {}, {}
    dependents = {la.dependent for la in spec.layers}
    out = Points(values, sigmas, None, spec.variables)
    n = None
    for v in spec.variables:
        x = np.asarray(columns[v], float)
        n = len(x) if n is None else n
        if len(x) != n:
            raise DataError(f"{v} has {len(x)} values, expected {n}")
        if not np.isfinite(x).all():
            raise DataError(f"{v} holds nulls or non-finite values")
        values[v] = x
        if v in spec.sigmas:
            s = np.asarray(columns[spec.sigmas[v]], float)
            if len(s) != n or not np.isfinite(s).all() or (s < 0).any():
                raise DataError(f"uncertainties of {v} must be {n} finite numbers of at least 0")
        elif spec.poisson and v in dependents:
            if (x < 0).any():
                raise DataError(f"Poisson counts of {v} are negative")
            out.low_counts |= bool((x < 20).any())
            out.zero_counts |= bool((x == 0).any())
            s = np.sqrt(np.maximum(x, MIN_VARIANCE))
        else:
            s = np.zeros(n)
        small = s < MIN_SIGMA
        out.clamped += int(small.sum())
        sigmas[v] = np.where(small, MIN_SIGMA, s)
        if v in spec.type_a:
            given = spec.type_a[v]
            out.inferred_dof += given is None
            out.dof[v] = float(n - 1 if given is None else given)
    if n is None or n < 2:
        raise DataError("a fit needs at least 2 points")
    if spec.correlation is not None:
        rho = np.asarray(spec.correlation, float)
        d = len(spec.variables)
        if rho.shape not in ((d, d), (n, d, d)):
            raise DataError(f"correlation matrix has an invalid shape {rho.shape}, expected {(d, d)}")
        if not np.allclose(np.diagonal(rho, axis1=-2, axis2=-1), 1, atol=1e-9) or (np.abs(rho) > 1 + 1e-9).any() or not np.allclose(rho, np.swapaxes(rho, -1, -2), atol=1e-9):
            raise DataError("correlation matrix must be symmetric with a unit diagonal")
        if np.linalg.eigvalsh(rho).min() < -PSD_TOLERANCE:
            raise DataError("correlation matrix is not positive semidefinite")
        out.rho = rho
    return out


@dataclass
class State:
    """Sums over points at one parameter vector; those of parts of the data add up."""

    chi2: float
    chi2_obs: float
    gradient: np.ndarray
    hessian: np.ndarray
    ssr: np.ndarray
    unconverged: int = 0
    jitter: int = 0

    def __add__(self, o: State) -> State:
        return State(self.chi2 + o.chi2, self.chi2_obs + o.chi2_obs, self.gradient + o.gradient, self.hessian + o.hessian, self.ssr + o.ssr, self.unconverged + o.unconverged, self.jitter + o.jitter)


def _inverse(cov: np.ndarray) -> tuple[np.ndarray, int]:
    jitter, bad = 0, np.linalg.eigvalsh(cov)[:, 0] <= 0
    step = 1e-12
    while bad.any() and jitter < 8:
        scale = np.trace(cov[bad], axis1=1, axis2=2) / cov.shape[-1]
        cov = cov.copy()
        cov[bad] += (step * scale)[:, None, None] * np.eye(cov.shape[-1])
        bad = np.linalg.eigvalsh(cov)[:, 0] <= 0
        step, jitter = step * 10, jitter + 1
    return np.linalg.inv(cov), jitter


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^-1 b by point; of singular points among several the result is NaN."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.full_like(b, np.nan)
        return np.concatenate([_solved(a[i : i + 1], b[i : i + 1]) for i in range(len(a))])


def _by_point(spec: FitSpec, la: Layer, points: Points, beta: np.ndarray) -> tuple:
    """A layer's part of the objective by point: chi2, chi2_obs, gradient, Hessian, residual, unconverged; and the regularisations.

    ``beta`` is one vector, or one for each point: then the points may be of many fits at once.
    """
    m = compiled(la.formula, la.independents, spec.parameters, tuple(sorted((k.lower(), v) for k, v in spec.fixed.items())))
    x0 = np.stack([points.values[v] for v in la.independents], -1) if la.independents else np.zeros((len(points), 0))
    y, k = points.values[la.dependent], len(la.independents)
    sx = np.stack([points.sigmas[v] ** 2 for v in la.independents], -1) if k else x0
    live = [i for i in range(k) if (sx[:, i] > CORRECTED_ABOVE).any()]
    own = (lambda idx: beta) if beta.ndim == 1 else (lambda idx: beta[idx])
    solved = np.linalg.solve if beta.ndim == 1 else _solved
    if not live:
        d = m(x0, beta, "f p pp")
        r, w = y - d["f"], 1 / np.maximum(points.sigmas[la.dependent] ** 2, MIN_VARIANCE)
        wr = w * r
        h = w[:, None, None] * d["p"][:, :, None] * d["p"][:, None, :] - wr[:, None, None] * d["pp"]
        return wr * r, wr * r, -d["p"] * wr[:, None], h, r, np.zeros(len(y), bool), 0
    names = [la.independents[i] for i in live] + [la.dependent]
    W, jitter = _inverse(points.block(names))
    c, active = np.zeros((len(y), len(live))), np.ones(len(y), bool)

    def at(c):
        x = x0.copy()
        x[:, live] += c
        return x

    def pieces(d, c, W, y):
        r = np.concatenate([-c, (y - d["f"])[:, None]], 1)
        wr = np.einsum("nij,nj->ni", W, r)
        J = np.concatenate([np.broadcast_to(-np.eye(len(live)), (len(y), len(live), len(live))), -d["x"][:, None, live]], 1)
        g = np.einsum("nik,ni->nk", J, wr)
        H = np.einsum("nik,nij,njl->nkl", J, W, J) - wr[:, -1, None, None] * d["xx"][:, live][:, :, live]
        return r, wr, J, g, H

    for _ in range(INNER_ROUNDS):
        idx = np.flatnonzero(active)
        if not len(idx):
            break
        d = m(at(c)[idx], own(idx), "f x xx")
        *_, g, H = pieces(d, c[idx], W[idx], y[idx])
        size = np.abs(g).max(1) * np.sqrt(np.abs(np.einsum("nii->n", H)) + 1e-300) ** -1
        done = size < INNER_TOLERANCE * 1e3
        step = solved(H + 1e-300 * np.eye(len(live)), g[..., None])[..., 0]
        c[idx] -= step
        done |= (np.abs(step) <= INNER_TOLERANCE * (np.abs(c[idx]) + np.sqrt(sx[idx][:, live]))).all(1)
        active[idx] = ~done
    d = m(at(c), beta)
    r, wr, J, g_c, H_cc = pieces(d, c, W, y)
    wy, fp = wr[:, -1], d["p"]
    H_cb = np.einsum("nik,ni->nk", J, W[:, :, -1])[:, :, None] * -fp[:, None, :] - wy[:, None, None] * d["xp"][:, live]
    H_bb = W[:, -1, -1, None, None] * fp[:, :, None] * fp[:, None, :] - wy[:, None, None] * d["pp"]
    h = H_bb - np.einsum("nkp,nkq->npq", H_cb, solved(H_cc, H_cb))
    raw = r[:, -1]
    obs = raw**2 / np.maximum(points.sigmas[la.dependent] ** 2, MIN_VARIANCE)
    return (r * wr).sum(1), obs, -fp * wy[:, None], h, raw, active, jitter


def evaluate(spec: FitSpec, points: Points, beta: np.ndarray, detail: bool = False):
    """The profiled objective's sums at ``beta``; with ``detail`` also residuals and fitted values by layer."""
    q = len(spec.parameters)
    total = State(0.0, 0.0, np.zeros(q), np.zeros((q, q)), np.zeros(len(spec.layers)))
    rows = []
    for la_no, la in enumerate(spec.layers):
        chi2, obs, g, h, raw, open_, jitter = _by_point(spec, la, points, beta)
        ssr = np.zeros(len(spec.layers))
        ssr[la_no] = float(raw @ raw)
        total = total + State(float(chi2.sum()), float(obs.sum()), g.sum(0), h.sum(0), ssr, int(open_.sum()), jitter)
        rows.append((raw, points.values[la.dependent] - raw))
    total.hessian = (total.hessian + total.hessian.T) / 2
    return (total, rows) if detail else total


def flat_size(spec: FitSpec) -> int:
    """Numbers of a state written flat."""
    q = len(spec.parameters)
    return 4 + q + q * (q + 1) // 2 + len(spec.layers)


def flat_by_point(spec: FitSpec, points: Points, beta: np.ndarray) -> np.ndarray:
    """(points, flat_size): each point's part of the state at its own ``beta`` (points, parameters)."""
    tri = np.triu_indices(len(spec.parameters))
    out = np.zeros((len(points), flat_size(spec)))
    q, layers = len(spec.parameters), len(spec.layers)
    with np.errstate(all="ignore"):
        for la_no, la in enumerate(spec.layers):
            chi2, obs, g, h, raw, open_, jitter = _by_point(spec, la, points, beta)
            h = (h + np.swapaxes(h, 1, 2)) / 2
            out[:, 0] += chi2
            out[:, 1] += obs
            out[:, 2 : 2 + q] += g
            out[:, 2 + q : -2 - layers] += h[:, tri[0], tri[1]]
            out[:, -2 - layers + la_no] += raw**2
            out[:, -2] += open_
            out[0, -1] += jitter
    return out


def unflat(spec: FitSpec, v: np.ndarray) -> State:
    q, layers, h = len(spec.parameters), len(spec.layers), np.zeros((len(spec.parameters),) * 2)
    h[np.triu_indices(q)] = v[2 + q : -2 - layers]
    return State(float(v[0]), float(v[1]), np.array(v[2 : 2 + q]), h + np.triu(h, 1).T, np.array(v[-2 - layers : -2]), int(v[-2]), int(v[-1]))


def flat(s: State) -> list[float]:
    return [s.chi2, s.chi2_obs, *s.gradient, *s.hessian[np.triu_indices(len(s.gradient))], *s.ssr, s.unconverged, s.jitter]


#: What a fit waits for: its first sums, those of a step, those of the last undamped step; or nothing more.
FIRST, STEP, LAST, DONE = range(4)
REASONS = ("gradient", "step", "objective", "singular", "damping", "stagnated", "max_iterations")


@dataclass
class Progress:
    """A fit between two evaluations: it asks for the sums at ``at``. All of it can be written down as numbers."""

    at: np.ndarray
    beta: np.ndarray
    now: State | None = None
    scale: np.ndarray | None = None
    damping: float = 0.0
    growth: float = 2.0
    rejected: int = 0
    iteration: int = 0
    phase: int = FIRST
    reason: str = "max_iterations"
    guarded: bool = False

    def numbers(self) -> list[float]:
        return [*self.at, *self.beta, *self.scale, self.damping, self.growth, self.rejected, self.iteration, self.phase, REASONS.index(self.reason), int(self.guarded), *flat(self.now)]

    @classmethod
    def of(cls, spec: FitSpec, v: Sequence[float]) -> Progress:
        q, v = len(spec.parameters), np.array(v, float)
        damping, growth, rejected, iteration, phase, reason, guarded = v[3 * q : 3 * q + 7]
        return cls(v[:q], v[q : 2 * q], unflat(spec, v[3 * q + 7 :]), v[2 * q : 3 * q], damping, growth, int(rejected), int(iteration), int(phase), REASONS[int(reason)], bool(guarded))


def begin(spec: FitSpec, start: np.ndarray) -> Progress:
    return Progress(start.astype(float), start.astype(float), damping=spec.damping)


def advance(spec: FitSpec, p: Progress, s: State) -> Progress:
    """The fit after the sums it asked for: Levenberg-Marquardt on the profiled objective, then one undamped step if it does not raise it."""
    tol = spec.tolerance
    if p.phase == LAST:
        better = s.chi2 <= p.now.chi2 * (1 + 1e-12)  # sums of many points are not exact to the last digits
        return replace(p, phase=DONE, beta=p.at, now=s) if better else replace(p, phase=DONE)
    if p.phase == FIRST:
        return _propose(spec, replace(p, now=s, scale=np.zeros(len(p.beta))))
    delta = p.at - p.beta
    scale = np.where(p.scale < 1e-30, 1.0, p.scale)
    predicted = -2 * p.now.gradient @ delta - delta @ p.now.hessian @ delta
    gain = p.now.chi2 - s.chi2
    ratio = gain / predicted if predicted > 0 else -1.0
    if gain > 0 and ratio > 0:
        small = gain <= tol * tol * max(1.0, s.chi2)
        p = replace(p, beta=p.at, now=s, damping=float(np.clip(p.damping * max(1 / 3, 1 - (2 * ratio - 1) ** 3), *DAMPING_RANGE)), growth=2.0, rejected=0)
        return _stop(p, "objective") if small else _propose(spec, p)
    if abs(gain) <= 1e-15 * max(1.0, p.now.chi2) and np.linalg.norm(delta * scale) <= 1e-6 * (np.linalg.norm(p.beta * scale) + tol):
        return _stop(p, "objective")
    p = replace(p, rejected=p.rejected + 1, damping=p.damping * p.growth, growth=min(p.growth * 2, GROWTH_CAP))
    if p.damping > DAMPING_RANGE[1]:
        return _stop(p, "damping")
    return _stop(p, "stagnated") if p.rejected >= REJECTIONS else _propose(spec, p)


def _stop(p: Progress, reason: str) -> Progress:
    p = replace(p, reason=reason, phase=DONE)
    if reason in ("gradient", "step", "objective") and diagnose(p.now.hessian)[0] == len(p.beta):
        last = p.beta - np.linalg.solve(p.now.hessian, p.now.gradient)
        if np.isfinite(last).all():
            return replace(p, at=last, phase=LAST)
    return p


def _propose(spec: FitSpec, p: Progress) -> Progress:
    limit, tol = int(np.clip(spec.max_iterations, 5, 5000)), spec.tolerance
    if p.iteration >= limit:
        return _stop(p, "max_iterations")
    if not p.guarded and p.iteration >= max(RESTART, limit // 2):
        # an indefinite Hessian may have led it uphill, into a valley without an end
        first = begin(spec, np.array(spec.guesses if spec.guesses is not None else np.ones(len(p.beta)), float))
        return replace(first, now=p.now, scale=np.zeros(len(p.beta)), iteration=p.iteration, guarded=True)
    p = replace(p, iteration=p.iteration + 1, scale=np.maximum(p.scale, np.sqrt(np.abs(np.diag(p.now.hessian)))))
    s = np.where(p.scale < 1e-30, 1.0, p.scale)
    g, h = p.now.gradient / s, p.now.hessian / s[:, None] / s[None, :]
    if diagnose(p.now.hessian)[0] == 0:
        return _stop(p, "singular")
    if np.linalg.norm(g) <= tol:
        return _stop(p, "gradient")
    low, damping = float(np.linalg.eigvalsh(h)[0]) if p.guarded else 1.0, p.damping
    if low + damping <= 0:
        damping -= 2 * low
    d = -np.linalg.lstsq(h + damping * np.eye(len(p.beta)), g, rcond=RANK_EPS)[0]
    if np.linalg.norm(d) <= tol * (np.linalg.norm(p.beta * s) + tol):
        return _stop(p, "step")
    return replace(p, at=p.beta + d / s, phase=STEP)


def solve(spec: FitSpec, evaluate_at, start: np.ndarray) -> tuple[np.ndarray, State, int, str]:
    """A fit from its start to its end. ``evaluate_at(beta)`` gives the sums, so one process or a cluster may compute them."""
    p = begin(spec, start)
    while p.phase != DONE:
        p = advance(spec, p, evaluate_at(p.at))
    return p.beta, p.now, p.iteration, p.reason


def diagnose(h: np.ndarray) -> tuple[int, float]:
    """(rank, condition number) of a normal matrix."""
    s = np.linalg.svd(h, compute_uv=False)
    if not len(s) or not np.isfinite(s).all() or s[0] <= 0:
        return 0, math.inf
    scale = np.sqrt(np.abs(np.diag(h)))
    scale[scale <= 0] = 1
    t = np.linalg.svd(h / scale[:, None] / scale[None, :], compute_uv=False)
    rank = int((t > 1e-13 * max(1.0, t[0])).sum())
    return rank, float(s[0] / s[-1]) if s[-1] > 0 else math.inf


def effective_dof(inputs: float | None, fit: float | None, chi2_reduced: float) -> float | None:
    """Welch-Satterthwaite of two parts of the scaled variance: 1 from the inputs, the excess over 1 from the fit."""
    a = inputs if inputs and math.isfinite(inputs) and inputs > 0 else None
    b = fit if fit and math.isfinite(fit) and fit > 0 else None
    if a is None or b is None:
        return a or b
    excess = max(0.0, (chi2_reduced if math.isfinite(chi2_reduced) else 1.0) - 1)
    return (1 + excess) ** 2 / (1 / a + excess**2 / b) if excess else a


def _correlation(cov: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.diag(cov))
    with np.errstate(all="ignore"):
        out = np.clip(cov / s[:, None] / s[None, :], -1, 1)
    np.fill_diagonal(out, 1.0)
    return out


def respond(spec: FitSpec, beta: np.ndarray, s: State, it: int, reason: str, n: int, sums: dict, notes: dict) -> dict:
    """The result: estimates, covariance raw and scaled by chi2_obs / dof, coverage, metrics, notes.

    ``sums``: by layer the count, sum and sum of squares of the dependent (for R squared).
    """
    q, layers = len(beta), len(spec.layers)
    rank, condition = diagnose(s.hessian)
    dof = n * layers - rank
    reduced = float(s.chi2 / dof) if dof > 0 else math.nan
    obs_reduced = float(s.chi2_obs / dof) if dof > 0 else math.nan
    factor = obs_reduced if math.isfinite(obs_reduced) and obs_reduced > 0 else 1.0
    if rank < q:
        raw = np.full((q, q), math.nan)
        np.fill_diagonal(raw, math.inf)
        scaled = raw.copy()
    else:
        raw = np.linalg.inv(s.hessian)
        scaled = raw * factor
    sigma_raw, sigma = np.sqrt(np.maximum(np.diag(raw), 0)), np.sqrt(np.maximum(np.diag(scaled), 0))
    conf = float(np.clip(spec.confidence, 0.5, 0.999999))
    nu = effective_dof(notes.get("input_dof"), float(dof) if dof > 0 else None, obs_reduced)
    k = student_quantile((1 + conf) / 2, nu) if nu else NORMAL_K
    ssr, s = float(s.ssr.sum()), replace(s, chi2=float(s.chi2), chi2_obs=float(s.chi2_obs))
    count = n * layers
    sst = sum(v[2] for v in sums.values()) - sum(v[1] for v in sums.values()) ** 2 / count
    by_layer = [float(1 - s.ssr[i] / t) if (t := sums[i][2] - sums[i][1] ** 2 / sums[i][0]) > 0 else 1.0 for i in range(layers)]
    return {
        "success": reason in ("gradient", "step", "objective", "stagnated"), "termination": reason, "iterations": it,
        "parameter_names": list(spec.parameters), "parameters": beta.tolist(), "sigmas": sigma.tolist(), "sigmas_raw": sigma_raw.tolist(),
        "expanded": (sigma * k).tolist(), "coverage_factor": k, "confidence": conf, "effective_dof": nu,
        "covariance": scaled.tolist(), "covariance_raw": raw.tolist(), "correlation": (_correlation(scaled) if rank == q else raw).tolist(),
        "chi2": s.chi2, "chi2_reduced": reduced, "chi2_obs": s.chi2_obs, "chi2_obs_reduced": obs_reduced, "dof": dof,
        "rmse": math.sqrt(ssr / count), "ssr": ssr, "r_squared": 1 - ssr / sst if sst > 0 else 1.0, "r_squared_layers": by_layer,
        "rank": rank, "condition": condition, "warnings": _warnings(spec, s, reason, rank, q, condition, dof, nu, obs_reduced, notes), "assumptions": _assumptions(layers),
    }


def _warnings(spec, s, reason, rank, q, condition, dof, nu, obs_reduced, notes) -> list[str]:
    out = []
    if notes.get("clamped"):
        out.append(f"{notes['clamped']} near-zero uncertainties were clamped to {MIN_SIGMA:g}")
    if notes.get("zero_counts"):
        out.append("Poisson weights met zero counts, whose variance is understated")
    elif notes.get("low_counts"):
        out.append("Poisson weights met counts below 20, where sqrt(n) understates the uncertainty")
    if notes.get("inferred_dof"):
        out.append(f"degrees of freedom of {notes['inferred_dof']} type A variables were taken as n - 1")
    if dof <= 0:
        out.append("no degrees of freedom are left: reduced chi-squared and coverage mean little")
    if reason == "max_iterations":
        out.append("the iteration limit was reached before convergence")
    if reason == "damping":
        out.append("damping saturated before convergence")
    if rank < q:
        out.append(f"the normal matrix is rank-deficient ({rank} of {q}): uncertainties are infinite")
    used = {la.dependent for la in spec.layers}
    if any(v in used for la in spec.layers for v in la.independents):
        out.append("a dependent variable of one layer is an independent of another; each layer corrects it by itself")
    if math.isfinite(condition) and condition > 1e12:
        out.append(f"the normal matrix is ill-conditioned ({condition:.2e})")
    if s.unconverged:
        out.append(f"the inner correction did not converge at {s.unconverged} points")
    if s.jitter:
        out.append(f"covariance blocks were regularised {s.jitter} times")
    if not nu:
        out.append("the coverage factor is the normal one (1.96), for want of degrees of freedom")
    if obs_reduced > 5:
        out.append(f"poor fit: reduced chi-squared {obs_reduced:.3g}")
    if obs_reduced < 0.1 and dof > 5:
        out.append(f"suspiciously low reduced chi-squared {obs_reduced:.3g}")
    return out


def _assumptions(layers: int) -> list[str]:
    out = [
        "independent and dependent variables may both carry uncertainty",
        "parameter covariance is the inverse of the profiled Hessian, raw and scaled by chi2_obs / dof",
        "scaling uses the dependent residuals only",
        "degrees of freedom are points times layers less the rank of the normal matrix",
        "the Hessian holds all second-order terms of the profiled objective",
        "tiny uncertainties are clamped and covariance blocks regularised where needed",
        "intervals take the model as linear near the optimum",
        "effective degrees of freedom combine inputs and residuals by Welch-Satterthwaite",
        "R squared is a descriptive statistic only",
    ]
    if layers > 1:
        out += ["R squared by layer is to be preferred to the pooled one", "layers share parameters but correct their variables separately"]
    return out


def input_dof(spec: FitSpec, points: Points) -> float | None:
    """Welch-Satterthwaite over the variables of finite degrees of freedom, weighted by their mean variance."""
    if not points.dof:
        return None
    var = {v: float((points.sigmas[v] ** 2).mean()) for v in points.order}
    total = sum(var.values())
    below = sum((var[v] / total) ** 2 / points.dof[v] for v in points.dof if points.dof[v] > 0)
    return 1 / below if below > 0 else None


def fit(spec: FitSpec, columns: Mapping[str, np.ndarray]) -> dict:
    """One fit in one process."""
    points = prepare(spec, columns)
    start = np.array(spec.guesses if spec.guesses is not None else np.ones(len(spec.parameters)), float)
    if len(start) != len(spec.parameters) or not np.isfinite(start).all():
        raise DataError("guesses must be one finite number for each parameter")
    beta, s, it, reason = solve(spec, lambda b: evaluate(spec, points, b), start)
    sums = {i: (len(points), float(points.values[la.dependent].sum()), float((points.values[la.dependent] ** 2).sum())) for i, la in enumerate(spec.layers)}
    notes = {k: getattr(points, k) for k in ("clamped", "low_counts", "zero_counts", "inferred_dof")} | {"input_dof": input_dof(spec, points)}
    out = respond(spec, beta, s, it, reason, len(points), sums, notes)
    _, rows = evaluate(spec, points, beta, detail=True)
    out["residuals"] = np.concatenate([r for r, _ in rows]).tolist()
    out["fitted"] = np.concatenate([f for _, f in rows]).tolist()
    return out


def k_normal(confidence: float) -> float:
    return normal_quantile((1 + confidence) / 2)
