"""Digital filters: Butterworth and Chebyshev prototypes, the bilinear transform, second-order sections, one-way and two-way runs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Ripple of a Chebyshev pass band, and depth of a Chebyshev stop band, in dB.
RIPPLE_DB, DEPTH_DB = 0.5, 20.0


def _prototype(kind: str, order: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the analogue low pass with cut-off 1."""
    angles = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    circle = -np.sin(angles) + 1j * np.cos(angles)
    if kind == "butterworth":
        return np.zeros(0, complex), circle, 1.0
    if kind == "chebyshev1":
        eps = np.sqrt(10 ** (RIPPLE_DB / 10) - 1)
        mu = np.arcsinh(1 / eps) / order
        poles = np.sinh(mu) * circle.real + 1j * np.cosh(mu) * circle.imag
        gain = np.prod(-poles).real / (np.sqrt(1 + eps * eps) if order % 2 == 0 else 1.0)
        return np.zeros(0, complex), poles, float(gain)
    if kind == "chebyshev2":
        eps = 1 / np.sqrt(10 ** (DEPTH_DB / 10) - 1)
        mu = np.arcsinh(1 / eps) / order
        poles = 1 / (np.sinh(mu) * circle.real + 1j * np.cosh(mu) * circle.imag)
        zeros = 1j / np.cos(angles[np.abs(np.cos(angles)) > 1e-12])
        return zeros, poles, float((np.prod(-poles) / np.prod(-zeros)).real)
    raise ValueError(f"unknown filter {kind!r}")


def design(kind: str, order: int, band: str, cutoffs: tuple[float, ...], fs: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a low pass, band pass or band stop with cut-offs in Hz."""
    if not all(0 < x < fs / 2 for x in cutoffs):
        raise ValueError(f"cut-offs must lie between 0 and {fs / 2}")
    z, p, k = _prototype(kind, order)
    warped = 2 * fs * np.tan(np.pi * np.array(cutoffs, dtype=float) / fs)
    degree = len(p) - len(z)
    if band == "low":
        z, p, k = z * warped[0], p * warped[0], k * warped[0] ** degree
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        if band == "band":
            spread = lambda x: np.concatenate([x * width / 2 + s * np.sqrt((x * width / 2) ** 2 - centre**2 + 0j) for s in (1, -1)])
            z, p, k = np.concatenate([spread(z), np.zeros(degree)]), spread(p), k * width**degree
        elif band == "stop":
            spread = lambda x: np.concatenate([width / 2 / x + s * np.sqrt((width / 2 / x) ** 2 - centre**2 + 0j) for s in (1, -1)]) if len(x) else x
            k = k * float((np.prod(-z) / np.prod(-p)).real)
            z, p = np.concatenate([spread(z), np.full(degree, 1j * centre), np.full(degree, -1j * centre)]), spread(p)
        else:
            raise ValueError(f"unknown band {band!r}")
    rest = len(p) - len(z)
    k = k * float((np.prod(2 * fs - z) / np.prod(2 * fs - p)).real)
    z, p = np.concatenate([(2 * fs + z) / (2 * fs - z), -np.ones(rest)]), (2 * fs + p) / (2 * fs - p)
    return _sections(z, p, k)


def _pairs(roots: np.ndarray) -> list[tuple[complex, complex]]:
    """Conjugate pairs, then pairs of real roots; a single real root is paired with 0."""
    upper = sorted((x for x in roots if x.imag > 1e-10), key=lambda x: (abs(x), x.real))
    real = sorted(x.real for x in roots if abs(x.imag) <= 1e-10)
    out = [(x, x.conjugate()) for x in upper]
    if len(real) % 2:
        real.append(0.0)
    return out + list(zip(real[::2], real[1::2]))


def _sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    poles, zeros = _pairs(p), _pairs(z)
    zeros += [(0.0, 0.0)] * (len(poles) - len(zeros))
    out = np.zeros((len(poles), 5))
    for row, (a, b) in enumerate(zip(poles, zeros)):
        out[row] = [1, -(b[0] + b[1]).real, (b[0] * b[1]).real, -(a[0] + a[1]).real, (a[0] * a[1]).real]
    out[0, :3] *= k
    return out


def response(sections: np.ndarray, freqs: np.ndarray, fs: float) -> np.ndarray:
    """Complex gain at some frequencies."""
    w = np.exp(-2j * np.pi * np.asarray(freqs, dtype=float) / fs)
    out = np.ones(len(w), complex)
    for b0, b1, b2, a1, a2 in sections:
        out *= (b0 + b1 * w + b2 * w * w) / (1 + a1 * w + a2 * w * w)
    return out


#: Rows that are filtered by one matrix product.
BLOCK = 128


def _state_space(sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """All sections as one system: state' = A state + B x, y = C state + D x."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for b0, b1, b2, a1, a2 in sections:
        own_a, own_b, own_c = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0])
        n = len(b)
        wide = np.zeros((n + 2, n + 2))
        wide[:n, :n], wide[n:, n:], wide[n:, :n] = a, own_a, np.outer(own_b, c)
        a, b, c, d = wide, np.concatenate([b, own_b * d]), np.concatenate([b0 * c, own_c]), b0 * d
    return a, b, c, d


class System:
    """A cascade of sections that runs over rows as they come and carries its state from one call to the next.

    Rows go through in blocks: what a block's own rows add is one matrix product, and the state is carried from block to block.
    """

    def __init__(self, sections: np.ndarray):
        a, b, c, d = _state_space(sections)
        self.order = len(b)
        self.powers, steps, out_of_state = [np.eye(len(b))], [b], []
        for _ in range(BLOCK):
            out_of_state.append(c @ self.powers[-1])
            self.powers.append(a @ self.powers[-1])
            steps.append(a @ steps[-1])
        impulse = np.array([d, *(c @ v for v in steps[: BLOCK - 1])])
        shift = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
        self.own = np.where(shift >= 0, impulse[np.maximum(shift, 0)], 0.0)
        self.into_state, self.out_of_state = np.stack(steps[:BLOCK][::-1], axis=1), np.array(out_of_state)

    def rest(self, channels: int) -> np.ndarray:
        """The state before anything has come."""
        return np.zeros((self.order, channels))

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and new state for some rows of all channels, none of them missing."""
        y = np.empty_like(x, dtype=float)
        for k in range(0, len(x), BLOCK):
            rows = x[k : k + BLOCK]
            m = len(rows)
            y[k : k + m] = self.own[:m, :m] @ rows + self.out_of_state[:m] @ state
            state = self.powers[m] @ state + self.into_state[:, BLOCK - m :] @ rows
        return y, state


@lru_cache(maxsize=64)
def _system(raw: bytes) -> System:
    return System(np.frombuffer(raw).reshape(-1, 5))


def system(sections: np.ndarray) -> System:
    """The system of some sections, made once."""
    return _system(np.ascontiguousarray(sections, dtype=float).tobytes())


def _columns(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by channels with 0 for what is missing, and what is."""
    x = np.asarray(x, dtype=float)
    gone = np.isnan(x)
    return np.where(gone, 0.0, x).reshape(len(x), int(np.prod(x.shape[1:]))), gone


def sosfilt(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One run from rest over a series, or over the columns of several. Missing values count as 0 and stay missing."""
    rows, gone = _columns(x)
    own = system(sections)
    return np.where(gone, np.nan, own.run(rows, own.rest(rows.shape[1]))[0].reshape(gone.shape))


def padding(sections: np.ndarray) -> int:
    """Rows by which a long series is continued at each end before it is filtered both ways."""
    return 6 * len(sections)


def before(x: np.ndarray, pad: int) -> np.ndarray:
    """What continues a series before its first row, by point reflection."""
    return 2 * x[0] - x[pad:0:-1]


def behind(x: np.ndarray, pad: int) -> np.ndarray:
    """What continues a series behind its last row, by point reflection."""
    return 2 * x[-1] - x[-2 : -pad - 2 : -1] if pad else x[:0]


def filtfilt(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, so that phases cancel; the ends are continued by point reflection and cut off again."""
    n = len(x)
    if not n:
        return x
    rows, gone = _columns(x)
    own, pad = system(sections), min(n - 1, padding(sections))
    rest = own.rest(rows.shape[1])
    y = own.run(np.concatenate([before(rows, pad), rows, behind(rows, pad)]), rest)[0]
    y = own.run(y[::-1], rest)[0][::-1]
    return np.where(gone, np.nan, y[pad : pad + n].reshape(gone.shape))
