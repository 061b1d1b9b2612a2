"""The non-singular isothermal ellipsoid with external shear: deflection, magnification and residual, in SQL text and numpy.

SQL columns: b, e, te, g, tg, s (te and tg in radians) and the image x, y.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def with_lens(df, x: str = "x", y: str = "y"):
    """df with ax, ay (deflection) and mu (signed magnification; null where it is infinite)."""
    from pyspark.sql import functions as F

    d = df.selectExpr("*", "cos(te) _ce", "sin(te) _se", "1D - e _q", "cos(2D * tg) _c2", "sin(2D * tg) _s2")
    d = d.selectExpr("*", f"_ce * {x} + _se * {y} _u", f"_ce * {y} - _se * {x} _v")
    d = d.selectExpr("*", "sqrt(_q * _q * (s * s + _u * _u) + _v * _v) _psi", "1D - _q * _q _f2")
    d = d.selectExpr("*", "CASE WHEN e = 0 THEN b * _u / (s + _psi) ELSE b * _q / sqrt(_f2) * atan(sqrt(_f2) * _u / (_psi + s)) END _au", "CASE WHEN e = 0 THEN b * _v / (s + _psi) ELSE b * _q / sqrt(_f2) * atanh(sqrt(_f2) * _v / (_psi + _q * _q * s)) END _av")
    # Second derivatives of the potential in the lens frame.
    d = d.selectExpr("*", "b * _q / ((_psi + s) * (_psi + s) + _f2 * _u * _u) _ku", "b * _q / ((_psi + _q * _q * s) * (_psi + _q * _q * s) - _f2 * _v * _v) _kv")
    d = d.selectExpr("*", "_ku * (_psi + s - _u * _q * _q * _u / _psi) _uu", "_ku * (0D - _u * _v / _psi) _uv", "_kv * (_psi + _q * _q * s - _v * _v / _psi) _vv")
    d = d.selectExpr("*", "1D - (_ce * _ce * _uu - 2D * _ce * _se * _uv + _se * _se * _vv + g * _c2) _j00", "1D - (_se * _se * _uu + 2D * _ce * _se * _uv + _ce * _ce * _vv - g * _c2) _j11", "_ce * _se * (_uu - _vv) + (_ce * _ce - _se * _se) * _uv + g * _s2 _j01")
    out = d.withColumns({"ax": F.expr(f"_ce * _au - _se * _av + g * (_c2 * {x} + _s2 * {y})"), "ay": F.expr(f"_se * _au + _ce * _av + g * (_s2 * {x} - _c2 * {y})"), "mu": F.expr("try_divide(1D, _j00 * _j11 - _j01 * _j01)")})
    return out.select(*df.columns, "ax", "ay", "mu")


def alpha(p, x: np.ndarray, y: np.ndarray):
    """Deflection for one model p = (b, e, te, g, tg, s) at arrays of positions."""
    b, e, te, g, tg, s = p
    ce, se, q = np.cos(te), np.sin(te), 1 - e
    u, v = ce * x + se * y, ce * y - se * x
    psi = np.sqrt(q * q * (s * s + u * u) + v * v)
    with np.errstate(invalid="ignore", divide="ignore"):
        if e == 0:
            au, av = b * u / (s + psi), b * v / (s + psi)
        else:
            f = np.sqrt(1 - q * q)
            au, av = b * q / f * np.arctan(f * u / (psi + s)), b * q / f * np.arctanh(f * v / (psi + q * q * s))
    au, av = np.nan_to_num(au), np.nan_to_num(av)
    return ce * au - se * av + g * (np.cos(2 * tg) * x + np.sin(2 * tg) * y), se * au + ce * av + g * (np.sin(2 * tg) * x - np.cos(2 * tg) * y)


@dataclass(frozen=True)
class LensModel:
    """A kind of lens for the solver: its deflection alpha(p, x, y) -> (ax, ay), p being (b, e, te, g, tg, s)."""

    alpha: Callable

    def jacobian(self, p, x: np.ndarray, y: np.ndarray, h: float = 1e-6):
        """Of the map from image to source, by central differences."""
        (ax1, ay1), (ax0, ay0) = self.alpha(p, x + h, y), self.alpha(p, x - h, y)
        (bx1, by1), (bx0, by0) = self.alpha(p, x, y + h), self.alpha(p, x, y - h)
        return 1 - (ax1 - ax0) / (2 * h), -(bx1 - bx0) / (2 * h), -(ay1 - ay0) / (2 * h), 1 - (by1 - by0) / (2 * h)


NSIEG = LensModel(alpha)


def with_potential(df, x: str = "x", y: str = "y"):
    """df with kappa (convergence of the ellipsoid), potential (of ellipsoid and shear, whose gradient is the deflection) and
    amplification (size of the magnification); e must be above 0."""
    from pyspark.sql import functions as F

    d = with_lens(df, x, y).selectExpr("*", f"cos(te) * {x} + sin(te) * {y} _u", f"cos(te) * {y} - sin(te) * {x} _v", "1D - e _q")
    d = d.selectExpr("*", "sqrt(_q * _q * (s * s + _u * _u) + _v * _v) _psi")
    shear = f"g * (cos(2D * tg) * ({x} * {x} - {y} * {y}) / 2D + sin(2D * tg) * {x} * {y})"
    rounded = "(cos(te) * _ax + sin(te) * _ay) * _u + (cos(te) * _ay - sin(te) * _ax) * _v"
    d = d.selectExpr("*", f"ax - g * (cos(2D * tg) * {x} + sin(2D * tg) * {y}) _ax", f"ay - g * (sin(2D * tg) * {x} - cos(2D * tg) * {y}) _ay")
    core = "b * _q * s * ln(sqrt((_psi + s) * (_psi + s) + (1D - _q * _q) * _u * _u) / ((1D + _q) * s))"
    out = d.withColumns({"kappa": F.expr("b * _q / (2D * _psi)"), "potential": F.expr(f"{rounded} - {core} + {shear}"), "amplification": F.abs("mu")})
    return out.select(*df.columns, "kappa", "potential", "amplification")
