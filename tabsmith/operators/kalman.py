"""Exact Gaussian likelihood of ARMA models by a Kalman filter that runs as an associative scan.

In state-space form an ARMA(p, q) has a state of r = max(p, q + 1) numbers. The filter's covariances,
and with them its gains, depend on the position in the series only, never on the data, so over a
slice of consecutive rows the filter is an affine map of the state at the slice's start. An `Element`
holds that map and the sums of squared innovations as a quadratic form of (series, ones, start state).
Elements combine associatively, so slices of one long series are read by separate tasks in a single
pass and put together exactly, whatever the slices are. The mean enters linearly as a second input
(a series of ones) and the variance as a factor; both are solved for in closed form.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np

#: Rows of a block that is filtered by matrix products once the gains stand still.
BLOCK = 256
#: Relative change of the covariance below which gains stand still, and steps after which they do anyway.
STILL, MOST_STEPS = 1e-11, 20_000


def coefficients(free: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Unconstrained numbers to stationary AR and invertible MA coefficients, through partial autocorrelations."""

    def grow(u):
        out = np.zeros(0)
        for r in np.tanh(np.clip(u, -6, 6)):
            out = np.append(out - r * out[::-1], r)
        return out

    return grow(free[:p]), -grow(free[p : p + q])


def free_numbers(ar, ma, limit: float = 0.95) -> np.ndarray:
    """The inverse of `coefficients`; partial autocorrelations are kept within `limit`."""

    def shrink(c):
        c, out = np.array(c, dtype=float), []
        while len(c):
            r = float(np.clip(c[-1], -limit, limit)) if np.isfinite(c[-1]) else 0.0
            out.append(r)
            c = (c[:-1] + r * c[:-1][::-1]) / (1 - r * r)
        return np.arctanh(np.clip(out[::-1], -limit, limit))

    return np.concatenate([shrink(ar), shrink(-np.asarray(ma, dtype=float))])


@dataclass
class Filter:
    """Gains by position: innovation variance (in units of the noise variance) and gain vector."""

    ar: np.ndarray
    ma: np.ndarray
    variances: list[float] = field(default_factory=list)
    gains: list[list[float]] = field(default_factory=list)
    still: int | None = None

    def __post_init__(self):
        self.size = r = max(len(self.ar), len(self.ma) + 1)
        self.move = np.zeros((r, r))
        self.move[: len(self.ar), 0] = self.ar
        self.move[:-1, 1:] = np.eye(r - 1)
        shock = np.concatenate([[1.0], self.ma, np.zeros(r - 1 - len(self.ma))])
        noise = np.outer(shock, shock)
        lift = np.eye(r * r) - np.kron(self.move, self.move)
        self._noise, self._cover = noise.tolist(), np.linalg.solve(lift, noise.ravel()).reshape(r, r).tolist()

    def upto(self, t: int) -> int:
        """Work out the gains of positions before `t`; the number known (the last holds for all later ones)."""
        first, r, cover, noise = self.move[:, 0].tolist(), self.size, self._cover, self._noise
        places = range(r)
        while self.still is None and len(self.variances) < t:
            f = max(cover[0][0], 1e-300)
            ahead = [[first[i] * cover[0][j] + (cover[i + 1][j] if i + 1 < r else 0.0) for j in places] for i in places]
            gain = [ahead[i][0] / f for i in places]
            self.variances.append(f)
            self.gains.append(gain)
            new = [
                [ahead[i][0] * (first[j] - gain[j]) + (ahead[i][j + 1] if j + 1 < r else 0.0) + noise[i][j] for j in places]
                for i in places
            ]
            change = max(abs(new[i][j] - cover[i][j]) for i in places for j in range(i + 1))
            cover = [[(new[i][j] + new[j][i]) / 2 for j in places] for i in places]
            if change <= STILL * max(1.0, f) or len(self.variances) >= MOST_STEPS:
                self.still = len(self.variances) - 1
        self._cover = cover
        return len(self.variances)


@dataclass
class Element:
    """state: r x (2 + r), the end state from (series, ones, start state). squares: (2 + r) squared, the sum of
    squared innovations over their variances as a form of the same. logs: the sum of log variances."""

    state: np.ndarray
    squares: np.ndarray
    logs: float
    rows: int

    def then(self, later: Element) -> Element:
        full = np.vstack([np.eye(2, self.state.shape[1]), self.state])
        return Element(later.state @ full, self.squares + full.T @ later.squares @ full, self.logs + later.logs, self.rows + later.rows)

    def numbers(self) -> list[float]:
        return [*self.state.ravel(), *self.squares.ravel(), self.logs, float(self.rows)]

    @staticmethod
    def of(numbers, size: int) -> Element:
        x, w = np.asarray(numbers, dtype=float), size + 2
        return Element(x[: size * w].reshape(size, w), x[size * w : size * w + w * w].reshape(w, w), float(x[-2]), int(x[-1]))


def _blocks(f: Filter, gain: np.ndarray, m: int):
    """For m rows under a standing gain: innovations = lower @ inputs - reach @ state, and the state's move."""
    step = f.move.copy()
    step[:, 0] -= gain
    reach, push = np.empty((m, f.size)), np.empty((f.size, m))
    row, col = np.eye(1, f.size)[0], gain.copy()
    for i in range(m):
        reach[i], push[:, m - 1 - i] = row, col
        row, col = row @ step, step @ col
    first = np.concatenate([[1.0], -(reach[: m - 1] @ gain)])
    place = np.arange(m)[:, None] - np.arange(m)[None, :]
    lower = np.where(place >= 0, first[np.clip(place, 0, None)], 0.0)
    return step, reach, push, lower


def _moving(z: np.ndarray, start: int, filters: list[Filter]):
    """The rows of z during which some gains still move, for all filters in one loop: forms (rows x filters x
    (2 + r)) and end states. Once a filter's gains stand still its last ones hold."""
    r, n = filters[0].size, len(z)
    known = [f.upto(start + n) for f in filters]
    moving = max(0, min(n, max(known) - start))
    last = [np.minimum(np.arange(start, start + moving), k - 1) for k in known]
    variances = np.array([np.array(f.variances)[k] for f, k in zip(filters, last)])
    gains = np.array([np.array(f.gains)[k] for f, k in zip(filters, last)]).reshape(len(filters), moving, r).transpose(1, 0, 2)[..., None]
    moves = np.array([f.move for f in filters])
    state = np.broadcast_to(np.hstack([np.zeros((r, 2)), np.eye(r)]), (len(filters), r, r + 2))
    forms = np.empty((moving, len(filters), 1, r + 2))
    for v, value, gain in zip(forms, z.tolist(), gains):
        np.negative(state[:, :1], out=v)
        v[:, 0, 0] += value
        v[:, 0, 1] += 1.0
        state = moves @ state + gain * v
    return forms[:, :, 0], variances.reshape(len(filters), moving), state


def elements(z: np.ndarray, start: int, filters: list[Filter]) -> list[Element]:
    """The elements of consecutive rows z that begin at position `start`, for filters of one size."""
    if not filters:
        return []
    forms, variances, states = _moving(z, start, filters)
    return [_rest(z, f, forms[:, k], variances[k], states[k])[0] for k, f in enumerate(filters)]


def innovations(z: np.ndarray, start: int, f: Filter) -> np.ndarray:
    """The innovations of the rows as (rows x (2 + r)) forms of (series, ones, start state)."""
    forms, variances, states = _moving(z, start, [f])
    kept = _rest(z, f, forms[:, 0], variances[0], states[0], keep=True)[1]
    return np.vstack(kept)


def _rest(z: np.ndarray, f: Filter, forms: np.ndarray, variances: np.ndarray, state: np.ndarray, keep: bool = False):
    """Go on from the moving rows, in blocks by matrix products."""
    n, i = len(z), len(forms)
    squares, logs = forms.T @ (forms / variances[:, None]), float(np.log(variances).sum())
    kept = [forms]
    if i < n:
        variance, gain = f.variances[-1], np.array(f.gains[-1])
        m = min(BLOCK, n - i)
        step, reach, push, lower = _blocks(f, gain, m)
        leap = np.linalg.matrix_power(step, m)
        whole = (n - i) // m
        inputs = z[i : i + whole * m].reshape(whole, m)
        heads, tails = inputs @ lower.T, inputs @ push.T
        ones_head, ones_tail = lower.sum(axis=1), push.sum(axis=1)
        for head, tail in zip(heads, tails):
            v = -(reach @ state)
            v[:, 0] += head
            v[:, 1] += ones_head
            squares += v.T @ v / variance
            state = leap @ state
            state[:, 0] += tail
            state[:, 1] += ones_tail
            if keep:
                kept.append(v)
        rest = z[i + whole * m :]
        if k := len(rest):
            v = -(reach[:k] @ state)
            v[:, 0] += lower[:k, :k] @ rest
            v[:, 1] += lower[:k, :k].sum(axis=1)
            squares += v.T @ v / variance
            state = np.linalg.matrix_power(step, k) @ state
            state[:, 0] += push[:, m - k :] @ rest
            state[:, 1] += push[:, m - k :].sum(axis=1)
            if keep:
                kept.append(v)
        logs += (n - i) * np.log(variance)
    return Element(state, squares, logs, n), kept


@dataclass
class Likelihood:
    mean: float
    sigma2: float
    loglik: float


def likelihood(whole: Element, constant: bool) -> Likelihood:
    """Mean, variance and log likelihood of a series from its whole element: the start state is zero."""
    zz, z1, oo = whole.squares[0, 0], whole.squares[0, 1], whole.squares[1, 1]
    mean = z1 / oo if constant and oo > 0 else 0.0
    n = max(whole.rows, 1)
    sigma2 = max((zz - 2 * mean * z1 + mean * mean * oo) / n, 1e-300)
    return Likelihood(float(mean), float(sigma2), float(-n / 2 * (np.log(2 * np.pi * sigma2) + 1) - whole.logs / 2))


#: Step lengths tried at once along a direction, and the half width of central differences.
STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3)
WIDTH = 1e-4


def search(x: np.ndarray, gain: float = 1e-10, most: int = 60) -> Generator[list[np.ndarray], list[float], tuple[np.ndarray, float]]:
    """Quasi-Newton minimisation as a coroutine: it yields points and is sent their values.

    All points of a round can be evaluated together, by one pass over the data; several searches can
    share the pass. It ends when a round lowers the value by less than `gain`.
    """
    k = len(x)
    (best,) = yield [x]
    if not k:
        return x, best

    def slope(values):
        return np.array([(values[2 * i] - values[2 * i + 1]) / (2 * WIDTH) for i in range(k)])

    around = lambda at: [at + s * WIDTH * e for e in np.eye(k) for s in (1, -1)]
    grad, inverse, fresh = slope((yield around(x))), np.eye(k), True
    for _ in range(most):
        direction = -inverse @ grad
        longest = np.abs(direction).max()
        if not np.isfinite(longest) or longest < 1e-9:
            break
        if longest > 2:
            direction *= 2 / longest
        values = yield [x + s * direction for s in STEPS]
        values = [v if np.isfinite(v) else np.inf for v in values]
        i = int(np.argmin(values))
        if values[i] > best - gain:
            if fresh:
                break
            inverse, fresh = np.eye(k), True
            continue
        move, best = STEPS[i] * direction, values[i]
        x = x + move
        new = slope((yield around(x)))
        turn = new - grad
        along = move @ turn
        if along > 1e-14:
            left = np.eye(k) - np.outer(move, turn) / along
            inverse = left @ inverse @ left.T + np.outer(move, move) / along
            fresh = False
        grad = new
    return x, best


def solve(run: Generator, values) -> tuple[np.ndarray, float]:
    """Drive a search with a function from points to values."""
    points = next(run)
    while True:
        try:
            points = run.send(values(points))
        except StopIteration as done:
            return done.value
