"""Two-body motion in numpy, for tables as small as the trial orbits."""

from __future__ import annotations

import numpy as np

NODES = np.arange(-365.0, 365.0, 7.0)  # days from the orbit's epoch at which its motion is sampled: 105 of them


def stumpff(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """C(z) and S(z); series near zero."""
    z = np.asarray(z, float)
    small = np.abs(z) < 1e-3
    c, s = 1 / 2 - z / 24 + z * z / 720 - z * z * z / 40320, 1 / 6 - z / 120 + z * z / 5040 - z * z * z / 362880
    if small.all():
        return c, s
    zs = np.where(small, 1.0, z)
    root, pos = np.sqrt(np.abs(zs)), zs > 0
    ct, st = (1 - np.cos(root)) / zs, (root - np.sin(root)) / (root * root * root)
    if not pos.all():
        with np.errstate(over="ignore"):
            ct, st = np.where(pos, ct, (np.cosh(root) - 1) / -zs), np.where(pos, st, (np.sinh(root) - root) / (root * root * root))
    return np.where(small, c, ct), np.where(small, s, st)


def universal_anomaly(r: np.ndarray, vr: np.ndarray, alpha: np.ndarray, mu: float, dt: np.ndarray, tol: float = 1e-12, most: int = 100) -> np.ndarray:
    """chi after dt, by Newton's method on the universal Kepler equation; NaN where it does not converge."""
    k = np.sqrt(mu)
    shape = np.broadcast_shapes(*(np.shape(x) for x in (r, vr, alpha, dt)))
    r, vr, alpha, dt = (np.broadcast_to(x, shape).ravel() for x in (r, vr, alpha, dt))
    chi, out, at = k * dt / r, np.full(r.shape, np.nan), np.arange(r.size)
    tilt, bend, way = r * vr / k, 1 - alpha * r, k * dt
    for _ in range(most):
        c, s = stumpff(alpha * chi * chi)
        f = tilt * chi**2 * c + bend * chi * chi * chi * s + r * chi - way
        df = tilt * chi * (1 - alpha * chi**2 * s) + bend * chi**2 * c + r
        step = f / df
        chi = chi - step
        done = np.abs(step) < tol * np.maximum(1.0, np.abs(chi))
        out[at[done]] = chi[done]
        on = ~done & ~np.isnan(chi)  # a NaN stays one
        if not on.any():
            break
        if not on.all():
            at, r, alpha, tilt, bend, way, chi = (x[on] for x in (at, r, alpha, tilt, bend, way, chi))
    return out.reshape(shape)


def motion(r, vr, vo, mu: float, dt) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distance, radial velocity, f, g) after dt; arguments broadcast against each other."""
    r, vr, vo, dt = np.broadcast_arrays(*(np.asarray(x, float) for x in (r, vr, vo, dt)))
    alpha = 2 / r - (vr**2 + vo**2) / mu
    chi = universal_anomaly(r, vr, alpha, mu, dt)
    c, s = stumpff(alpha * chi**2)
    k = np.sqrt(mu)
    u1, u2 = chi * (1 - alpha * chi**2 * s), chi**2 * c
    u0 = 1 - alpha * u2
    sigma = r * vr / k
    now = sigma * u1 + r * u0 + u2
    return now, k / now * (sigma * u0 + (1 - alpha * r) * u1), 1 - u2 / r, dt - chi**3 * s / k


def chebyshev_matrix(x: np.ndarray, degree: int = 3) -> np.ndarray:
    """(degree + 1) x nodes: what turns samples at x into least-squares Chebyshev coefficients."""
    return np.linalg.pinv(np.polynomial.chebyshev.chebvander(x, degree))


def fit_chebyshev(x: np.ndarray, y: np.ndarray, degree: int = 3) -> np.ndarray:
    return y @ chebyshev_matrix(np.asarray(x, float), degree).T


def clenshaw(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A Chebyshev series by backward recurrence; an empty one is 0."""
    a = b = np.zeros_like(np.asarray(x, float))
    for k in range(len(c) - 1, 0, -1):
        a, b = c[k] + 2 * x * a - b, a
    return (c[0] if len(c) else 0.0) + x * a - b


def solve_kepler(m: np.ndarray, e: np.ndarray, tol: float = 1e-14, most: int = 200) -> np.ndarray:
    """Eccentric (e < 1) or hyperbolic (e > 1) anomaly from the mean anomaly; Newton steps, halved where they overshoot."""
    m, e = np.broadcast_arrays(np.asarray(m, float), np.asarray(e, float))
    hyp = e > 1
    turns = np.where(hyp, 0.0, np.floor(m / (2 * np.pi) + 0.5) * 2 * np.pi)
    mm = m - turns
    x = np.where(hyp, np.arcsinh(mm / np.maximum(e, 1e-300)), mm + np.sign(np.sin(mm)) * 0.85 * e)
    for _ in range(most):
        f = np.where(hyp, e * np.sinh(x) - x - mm, x - e * np.sin(x) - mm)
        df = np.where(hyp, e * np.cosh(x) - 1, 1 - e * np.cos(x))
        step = np.clip(f / np.where(df == 0, 1e-300, df), -1.0, 1.0)
        x = x - step
        if np.all(np.abs(step) < tol * np.maximum(1, np.abs(x))):
            break
    return x + turns


def true_anomaly(ecc_anomaly: np.ndarray, e: np.ndarray) -> np.ndarray:
    """True anomaly from the eccentric one; NaN unless 0 <= e < 1 and finite."""
    ok = (e >= 0) & (e < 1) & np.isfinite(ecc_anomaly)
    es = np.where(ok, e, 0.0)
    nu = 2 * np.arctan2(np.sqrt(1 + es) * np.sin(ecc_anomaly / 2), np.sqrt(1 - es) * np.cos(ecc_anomaly / 2))
    return np.where(ok, nu, np.nan)


def true_anomaly_from_mean(m: np.ndarray, e: np.ndarray) -> np.ndarray:
    x = solve_kepler(m, e)
    with np.errstate(invalid="ignore"):
        hyp = 2 * np.arctan(np.sqrt((e + 1) / np.maximum(e - 1, 1e-300)) * np.tanh(x / 2))
    return np.where(e < 1, true_anomaly(x, e), hyp)


def spherical_of_elements(q, e, nu, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, vr, vo) at a true anomaly; a hyperbola's anomaly beyond its asymptote is an error."""
    q, e, nu = np.broadcast_arrays(*(np.asarray(x, float) for x in (q, e, nu)))
    if np.any((e > 1) & (np.abs(nu) > np.arccos(np.clip(-1 / np.maximum(e, 1.0), -1, 1)))):
        raise ValueError("a true anomaly lies beyond the asymptote of its orbit")
    p = q * (1 + e)
    h, r = np.sqrt(p * mu), p / (1 + e * np.cos(nu))
    return r, mu / h * e * np.sin(nu), h / r
