"""Numpy helpers for one image: gray conversion, resize, structural similarity (Wang et al. 2004)."""

from __future__ import annotations

import numpy as np

# fixed values: luma weights for blue, green, red, in thousandths (whole numbers keep ties exact)
LUMA_BGR = (114, 587, 299)


def pixels(px, h: int, w: int, channels: int) -> np.ndarray:
    """Row-major values of 0-255, as numbers or as bytes (a quarter of the size)."""
    flat = np.frombuffer(px, dtype=np.uint8) if isinstance(px, (bytes, bytearray)) else np.asarray(px)
    return flat.astype(np.float64).reshape((h, w, channels) if channels > 1 else (h, w))


def to_gray(px, h: int, w: int, channels: int) -> np.ndarray:
    a = px if isinstance(px, np.ndarray) and px.ndim > 1 else pixels(px, h, w, channels)
    if channels == 1:
        return a
    b, g, r = (a[..., i] * weight for i, weight in enumerate(LUMA_BGR))
    return np.floor((b + g + r + 500) / 1000)


def _taps(n_in: int, n_out: int):
    """Neighbours and whole-number weights (out of 2 * n_out) of every output position."""
    den = 2 * n_out
    num = np.clip((2 * np.arange(n_out) + 1) * n_in - n_out, 0, (n_in - 1) * den)
    lo = num // den
    return lo, np.minimum(lo + 1, n_in - 1), num - lo * den, den


def resize_bilinear(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Pixel-centre bilinear resize of whole-number pixels, rounded half up; integer arithmetic keeps ties exact."""
    if img.shape[:2] == (h, w):
        return img
    a = img.astype(np.int64)
    y0, y1, fy, dy = _taps(a.shape[0], h)
    x0, x1, fx, dx = _taps(a.shape[1], w)
    tail = (1,) * (a.ndim - 2)
    fx, fy = fx.reshape(-1, *tail), fy.reshape(-1, 1, *tail)
    top = a[y0][:, x0] * (dx - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (dx - fx) + a[y1][:, x1] * fx
    whole = dx * dy
    return ((2 * (top * (dy - fy) + low * fy) + whole) // (2 * whole)).astype(np.float64)


def resized_gray(px, h: int, w: int, channels: int, out_h: int, out_w: int) -> np.ndarray:
    """Resize first, channel by channel, then convert to gray."""
    return to_gray(resize_bilinear(pixels(px, h, w, channels), out_h, out_w), out_h, out_w, channels)


def _box_mean(a: np.ndarray, win: int) -> np.ndarray:
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    return (s[win:, win:] - s[:-win, win:] - s[win:, :-win] + s[:-win, :-win]) / (win * win)


def ssim_score(a: np.ndarray, b: np.ndarray, win: int = 7, data_range: float = 255.0) -> float | None:
    """Mean over full windows only, sample covariance; None when the image is smaller than the window."""
    if min(a.shape) < win:
        return None
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    n = win * win
    cov = n / (n - 1)
    ux, uy = _box_mean(a, win), _box_mean(b, win)
    vx = cov * (_box_mean(a * a, win) - ux * ux)
    vy = cov * (_box_mean(b * b, win) - uy * uy)
    vxy = cov * (_box_mean(a * b, win) - ux * uy)
    s = ((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))
    return float(s.mean())
