"""Nelder and Mead's simplex method for many small problems at once, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nelder_mead(f: Callable[[np.ndarray], np.ndarray], simplex: np.ndarray, max_iterations: int = 1024, eps: float = 1e-12, stop_at: float | None = None) -> np.ndarray:
    """simplex: problems x (d + 1) x d; f takes ... x d. Returns each problem's best vertex. A problem ends when the variance of
    its values is below eps squared, or its best value is below stop_at. Reflection 1, contraction 1/2, expansion 2, shrinkage 1/2."""
    s = np.array(simplex, float)
    v = f(s)
    active = np.arange(len(s))
    for _ in range(max_iterations):
        t, w = s[active], v[active]
        order = np.argsort(w, axis=1, kind="stable")
        t, w = np.take_along_axis(t, order[..., None], 1), np.take_along_axis(w, order, 1)
        s[active], v[active] = t, w
        ended = w.var(axis=1) < eps * eps
        if stop_at is not None:
            ended |= w[:, 0] < stop_at
        active = active[~ended]
        if not len(active):
            break
        t, w = t[~ended], w[~ended]
        centre, worst = t[:, :-1].mean(axis=1), t[:, -1]
        reflected = 2 * centre - worst
        fr = f(reflected)
        expanded = centre + 2 * (reflected - centre)
        fe = f(expanded)
        outside = fr < w[:, -1]
        contracted = centre + 0.5 * (np.where(outside[:, None], reflected, worst) - centre)
        fc = f(contracted)
        expand = (fr < w[:, 0]) & (fe < fr)
        accept = fr < w[:, -2]
        contract = ~accept & (fc < np.minimum(fr, w[:, -1]))
        new = np.where(expand[:, None], expanded, np.where(accept[:, None], reflected, contracted))
        value = np.where(expand, fe, np.where(accept, fr, fc))
        moved = accept | contract
        t[moved, -1], w[moved, -1] = new[moved], value[moved]
        if (~moved).any():
            shrunk = t[~moved, :1] + 0.5 * (t[~moved] - t[~moved, :1])
            t[~moved], w[~moved] = shrunk, f(shrunk)
        s[active], v[active] = t, w
    best = v.argmin(axis=1)
    return s[np.arange(len(s)), best]
