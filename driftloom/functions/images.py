"""Perturbations of images (channels x height x width, values in [0, 1]) in NumPy, for Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Image = np.ndarray


def clipped(x: Image) -> Image:
    return np.clip(x, 0.0, 1.0)


def channel_shift(x: Image, value: float, channel: int = 0) -> Image:
    out = x.copy()
    out[channel] += value / 255.0
    return clipped(out)


def brightness(x: Image, factor: float) -> Image:
    return clipped(x * factor)


def contrast(x: Image, factor: float) -> Image:
    return clipped((x - x.mean()) * factor + x.mean())


def sample(x: Image, ys: np.ndarray, xs: np.ndarray) -> Image:
    """Bilinear values at fractional places; edges are held."""
    h, w = x.shape[1:]
    ys, xs = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = ys - y0, xs - x0
    return (x[:, y0, x0] * (1 - fx) + x[:, y0, x1] * fx) * (1 - fy) + (x[:, y1, x0] * (1 - fx) + x[:, y1, x1] * fx) * fy


def resized(x: Image, h: int, w: int) -> Image:
    """Bilinear, pixel centres aligned."""
    ys = (np.arange(h) + 0.5) * x.shape[1] / h - 0.5
    xs = (np.arange(w) + 0.5) * x.shape[2] / w - 0.5
    return sample(x, *np.meshgrid(ys, xs, indexing="ij"))


def resize_zoom(x: Image, factor: float) -> Image:
    """Enlarge by the factor and keep the middle; below 1, shrink and enlarge again."""
    h, w = x.shape[1:]
    if factor < 1:
        return resized(resized(x, max(1, round(h * factor)), max(1, round(w * factor))), h, w)
    big = resized(x, round(h * factor), round(w * factor))
    top, left = (big.shape[1] - h) // 2, (big.shape[2] - w) // 2
    return big[:, top : top + h, left : left + w]


def convolved(x: Image, kernel: np.ndarray, mode: str = "edge") -> Image:
    """Each channel with a kernel of odd sides; edges are held, or wrapped."""
    ph, pw = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(x, ((0, 0), (ph, ph), (pw, pw)), mode=mode)
    out = np.zeros_like(x, dtype=float)
    for i in range(kernel.shape[0]):
        for j in range(kernel.shape[1]):
            if kernel[i, j]:
                out += kernel[i, j] * padded[:, i : i + x.shape[1], j : j + x.shape[2]]
    return out


def gaussian_blur(x: Image, sigma: float) -> Image:
    r = max(1, int(3 * sigma + 0.5))
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    g /= g.sum()
    return convolved(convolved(x, g[None, :]), g[:, None])


def defocus(x: Image, radius: int, mode: str = "edge") -> Image:
    y, z = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    disk = (y * y + z * z <= radius * radius).astype(float)
    return convolved(x, disk / disk.sum(), mode)


def motion_blur(x: Image, size: int) -> Image:
    size += 1 - size % 2
    return convolved(x, np.full((1, size), 1 / size))


def zoom_blur(x: Image, strength: float) -> Image:
    """Mean of five enlargements from 1 to 1 + strength."""
    return np.mean([resize_zoom(x, 1 + strength * k / 4) for k in range(5)], axis=0)


def rotation(x: Image, degrees: float) -> Image:
    """About the middle; nearest pixel, zero outside."""
    h, w = x.shape[1:]
    a = np.deg2rad(degrees)
    ys, xs = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    sy = np.rint(np.cos(a) * ys - np.sin(a) * xs + (h - 1) / 2).astype(int)
    sx = np.rint(np.sin(a) * ys + np.cos(a) * xs + (w - 1) / 2).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    return np.where(inside, x[:, np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 0.0)


def pixelate(x: Image, factor: float) -> Image:
    h, w = x.shape[1:]
    sh, sw = max(1, int(h * factor)), max(1, int(w * factor))
    small = x[:, (np.arange(sh) * h // sh)][:, :, (np.arange(sw) * w // sw)]
    return small[:, (np.arange(h) * sh // h)][:, :, (np.arange(w) * sw // w)]


def gaussian_noise(x: Image, sigma: float, seed: int) -> Image:
    return clipped(x + np.random.default_rng(seed).normal(0, sigma, x.shape))


def shot_noise(x: Image, scale: float, seed: int) -> Image:
    return clipped(np.random.default_rng(seed).poisson(clipped(x) * scale) / scale)


def impulse_noise(x: Image, share: float, seed: int) -> Image:
    u = np.random.default_rng(seed).random(x.shape[1:])
    return np.where(u < share / 2, 0.0, np.where(u < share, 1.0, x))


def scratch(x: Image, count: int, seed: int) -> Image:
    """Bright straight lines from top to bottom."""
    rng, out = np.random.default_rng(seed), x.copy()
    h, w = x.shape[1:]
    for _ in range(count):
        a, b = rng.integers(0, w, 2)
        out[:, np.arange(h), np.rint(np.linspace(a, b, h)).astype(int)] = 0.9
    return out


def wiener(x: Image, radius: int, noise: float = 0.01) -> Image:
    """Inverse of a disk blur in the frequency domain, held back where the blur passes little."""
    y, z = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    disk = (y * y + z * z <= radius * radius).astype(float)
    kernel = np.zeros(x.shape[1:])
    for i, j in zip(*np.nonzero(disk), strict=True):
        kernel[(i - radius) % x.shape[1], (j - radius) % x.shape[2]] += disk[i, j] / disk.sum()
    k = np.fft.fft2(kernel)
    return clipped(np.real(np.fft.ifft2(np.fft.fft2(x, axes=(1, 2)) * np.conj(k) / (np.abs(k) ** 2 + noise), axes=(1, 2))))


def box_mean(x: np.ndarray, radius: int) -> np.ndarray:
    return convolved(x[None], np.full((2 * radius + 1, 2 * radius + 1), 1 / (2 * radius + 1) ** 2))[0]


def guided_filter(guide: np.ndarray, x: np.ndarray, radius: int = 1, eps: float = 1e-3) -> np.ndarray:
    """Edge-keeping smoothing of one plane by another, from box means."""
    mg, mx = box_mean(guide, radius), box_mean(x, radius)
    var, cov = box_mean(guide * guide, radius) - mg * mg, box_mean(guide * x, radius) - mg * mx
    a = cov / (var + eps)
    return box_mean(a, radius) * guide + box_mean(mx - a * mg, radius)


def ssim(x: Image, y: Image, radius: int = 1) -> float:
    """Mean structural similarity from box statistics, values in [0, 1]."""
    c1, c2, out = 0.01**2, 0.03**2, []
    for a, b in zip(x, y, strict=True):
        ma, mb = box_mean(a, radius), box_mean(b, radius)
        va, vb, ab = box_mean(a * a, radius) - ma * ma, box_mean(b * b, radius) - mb * mb, box_mean(a * b, radius) - ma * mb
        out.append(((2 * ma * mb + c1) * (2 * ab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())
    return float(np.mean(out))


#: The example quantisation tables of the JPEG standard (luminance, chrominance), by rows.
JPEG_LUMA = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)
JPEG_CHROMA = (
    (17, 18, 24, 47, 99, 99, 99, 99), (18, 21, 26, 66, 99, 99, 99, 99), (24, 26, 56, 99, 99, 99, 99, 99), (47, 66, 99, 99, 99, 99, 99, 99),
    (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99), (99, 99, 99, 99, 99, 99, 99, 99),
)
_K, _N = np.mgrid[:8, :8]
_DCT = np.where(_K == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _N + 1) * _K * np.pi / 16)
_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def _quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane of values about 0 through 8 x 8 transforms with rounded coefficients."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)
    back = _DCT.T @ (np.rint(_DCT @ blocks @ _DCT.T / table) * table) @ _DCT
    return back.transpose(0, 2, 1, 3).reshape(padded.shape)[:h, :w]


def jpeg(x: Image, quality: int) -> Image:
    """What recompression does to pixels: colour transform, halved chroma, rounded coefficients. Entropy coding changes nothing."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    luma, chroma = (np.clip(np.floor((np.array(t) * scale + 50) / 100), 1, 255) for t in (JPEG_LUMA, JPEG_CHROMA))
    y = np.tensordot(_YCC, np.rint(clipped(x) * 255), axes=1)
    h, w = x.shape[1:]
    out = [_quantised(y[0] - 128, luma) + 128]
    for c in y[1:]:
        even = np.pad(c, ((0, h % 2), (0, w % 2)), mode="edge")
        half = even.reshape(even.shape[0] // 2, 2, -1, 2).mean((1, 3))
        out.append(np.repeat(np.repeat(_quantised(half, chroma), 2, 0), 2, 1)[:h, :w])
    return clipped(np.rint(np.tensordot(np.linalg.inv(_YCC), np.stack(out), axes=1)) / 255)


def equalised(plane: np.ndarray, limit: float = 2.0, tiles: int = 2, bins: int = 256) -> np.ndarray:
    """Histogram equalisation by tiles with clipped histograms, blended between tile centres; values in [0, 1]."""
    h, w = plane.shape
    index = np.minimum((plane * bins).astype(int), bins - 1)
    rows, cols = np.array_split(np.arange(h), tiles), np.array_split(np.arange(w), tiles)
    maps = np.empty((tiles, tiles, bins))
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            count = np.bincount(index[np.ix_(r, c)].ravel(), minlength=bins).astype(float)
            size = count.sum()
            most = max(1.0, limit * size / bins)
            spare = np.maximum(count - most, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(count, most) + spare / bins) / size
    cy, cx = np.array([r.mean() for r in rows]), np.array([c.mean() for c in cols])

    def between(centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(np.interp(np.arange(n), centres, np.arange(len(centres))), 0, len(centres) - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, len(centres) - 1), at - low

    y0, y1, fy = between(cy, h)
    x0, x1, fx = between(cx, w)
    at = lambda a, b: maps[a[:, None], b[None, :], index]
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    return top * (1 - fy[:, None]) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy[:, None]


def illumination_corrected(x: Image) -> Image:
    """Equalise the luma plane by tiles and keep the colour differences."""
    y = np.tensordot(_YCC, clipped(x), axes=1)
    y[0] = equalised(np.clip(y[0], 0, 1))
    return clipped(np.tensordot(np.linalg.inv(_YCC), y, axes=1))


#: Steps of the compound presets.
COMPOUND = {"mild": (("gaussian_blur", 0.5), ("brightness", 0.9)), "severe": (("gaussian_blur", 1.5), ("brightness", 0.6), ("gaussian_noise", 0.05))}


def make(name: str, value: str) -> Callable[[Image, int], Image]:
    """The perturbation of a name and severity, as a function of image and seed."""
    if name == "compound":
        steps = [make(n, str(v)) for n, v in COMPOUND[value]]

        def chain(x: Image, seed: int) -> Image:
            for step in steps:
                x = step(x, seed)
            return x

        return chain
    v = float(value)
    plain: dict[str, Callable[[Image], Image]] = {
        "red_channel_shift": lambda x: channel_shift(x, v, 0), "green_channel_shift": lambda x: channel_shift(x, v, 1), "blue_channel_shift": lambda x: channel_shift(x, v, 2),
        "illumination": lambda x: brightness(x, v), "contrast": lambda x: contrast(x, v), "resize": lambda x: resize_zoom(x, v), "gaussian_blur": lambda x: gaussian_blur(x, v), "brightness": lambda x: brightness(x, v),
        "defocus_blur": lambda x: defocus(x, int(v)), "motion_blur": lambda x: motion_blur(x, int(v)), "zoom_blur": lambda x: zoom_blur(x, v), "rotation": lambda x: rotation(x, v), "jpeg": lambda x: jpeg(x, int(v)), "illumination_correction": lambda x: illumination_corrected(x), "pixelate": lambda x: pixelate(x, v),
    }
    seeded: dict[str, Callable[[Image, int], Image]] = {"gaussian_noise": lambda x, s: gaussian_noise(x, v, s), "shot_noise": lambda x, s: shot_noise(x, v, s), "impulse_noise": lambda x, s: impulse_noise(x, v, s), "scratch": lambda x, s: scratch(x, int(v), s)}
    if name in plain:
        return lambda x, seed: plain[name](x)
    return seeded[name]
