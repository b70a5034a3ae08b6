"""Image arithmetic on arrays of 8-bit pixels [row, column, channel]: resampling, JPEG coding loss, edits."""

from __future__ import annotations

import numpy as np

# The quantisation tables of the JPEG standard's annex K, in natural order.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
_TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def eight_bit(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def lanczos_weights(size: int, to: int, lobes: int = 3) -> np.ndarray:
    """[to, size]: what every input cell adds to an output cell, the window widened when shrinking."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    x = (np.arange(size)[None] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Lanczos resampling, columns first, rounded to 8 bits after each direction."""
    x = pixels.astype(float)
    if width != x.shape[1]:
        x = eight_bit(np.moveaxis(np.tensordot(lanczos_weights(x.shape[1], width), x, (1, 1)), 0, 1)).astype(float)
    if height != x.shape[0]:
        x = eight_bit(np.tensordot(lanczos_weights(x.shape[0], height), x, (1, 0))).astype(float)
    return x.astype(np.uint8)


def luminance(rgb: np.ndarray) -> np.ndarray:
    """One channel by the usual integer weights."""
    w = np.array([19595, 38470, 7471])
    return ((rgb.astype(np.int64) @ w + 0x8000) >> 16).astype(np.uint8)


def quality_table(table: list[int], quality: int) -> np.ndarray:
    """A table scaled to a quality of 1 to 100, as encoders usually do."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255).reshape(8, 8)


def _coded(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), "edge") - 128
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    m = dct_matrix(8)
    back = m.T @ (np.round(m @ blocks @ m.T / table) * table) @ m + 128
    return np.clip(back.swapaxes(1, 2).reshape(padded.shape)[:h, :w], 0, 255)


def recompressed(rgb: np.ndarray, quality: int) -> np.ndarray:
    """What JPEG coding at a quality leaves of an image: chroma at half size, all planes quantised in 8 x 8 blocks."""
    h, w = rgb.shape[:2]
    ycc = np.round(rgb.astype(float) @ _TO_YCC.T + [0, 128, 128])
    y = _coded(ycc[..., 0], quality_table(LUMA, quality))
    out = [y]
    for c in (1, 2):
        full = np.pad(ycc[..., c], ((0, h % 2), (0, w % 2)), "edge")
        half = np.round(full.reshape(full.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3)))
        out.append(np.repeat(np.repeat(_coded(half, quality_table(CHROMA, quality)), 2, 0), 2, 1)[:h, :w])
    return eight_bit((np.stack(out, -1) - [0, 128, 128]) @ np.linalg.inv(_TO_YCC).T)


def centre_crop(rgb: np.ndarray, share: float = 0.9) -> np.ndarray:
    h, w = rgb.shape[:2]
    ch, cw = int(h * share), int(w * share)
    top, left = (h - ch) // 2, (w - cw) // 2
    return rgb[top : top + ch, left : left + cw]


def rotated(rgb: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Turned about the centre, nearest cells, the size kept."""
    h, w = rgb.shape[:2]
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    dy, dx = y + 0.5 - h / 2, x + 0.5 - w / 2
    sx, sy = np.cos(a) * dx - np.sin(a) * dy + w / 2, np.sin(a) * dx + np.cos(a) * dy + h / 2
    ix, iy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    inside = (ix >= 0) & (ix < w) & (iy >= 0) & (iy < h)
    out = np.full_like(rgb, fill)
    out[inside] = rgb[iy[inside], ix[inside]]
    return out


def saturated(rgb: np.ndarray, factor: float) -> np.ndarray:
    grey = luminance(rgb)[..., None].astype(float)
    return eight_bit(grey + (rgb - grey) * factor)


def brightened(rgb: np.ndarray, factor: float) -> np.ndarray:
    return eight_bit(rgb * float(factor))


def transported(rgb: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Delivery: resized to a longer side of 384 to 640 whatever the source, and coded; ``u`` are three uniforms."""
    target = 384 + int(u[0] * 257)
    h, w = rgb.shape[:2]
    scale = target / max(h, w)
    quality = 75 + int(u[2] * 16) if u[1] < 0.7 else 85 + int(u[2] * 11)
    return recompressed(resize(rgb, max(1, round(h * scale)), max(1, round(w * scale))), quality)


def recycled(rgb: np.ndarray, u: np.ndarray) -> np.ndarray:
    """An earlier image, cropped, turned, recoloured and coded again; ``u`` are seven uniforms."""
    h, w = rgb.shape[:2]
    share = 0.85 + 0.12 * u[0]
    ch, cw = max(1, int(h * share)), max(1, int(w * share))
    top, left = int(u[1] * (h - ch + 1)), int(u[2] * (w - cw + 1))
    out = rotated(rgb[top : top + ch, left : left + cw], -8 + 16 * u[3])
    return recompressed(brightened(saturated(out, 0.8 + 0.4 * u[4]), 0.9 + 0.2 * u[5]), 80 + int(u[6] * 16))


def rephotographed(rgb: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A picture of a screen: a third of the size and back by nearest cells, under a fine grid; ``u`` are two uniforms."""
    h, w = rgb.shape[:2]
    small = resize(rgb, max(1, h // 3), max(1, w // 3))
    big = small[np.minimum(np.arange(h) * small.shape[0] // h, small.shape[0] - 1)][:, np.minimum(np.arange(w) * small.shape[1] // w, small.shape[1] - 1)]
    period = 2.5 + 1.5 * u[0]
    y, x = np.mgrid[0:h, 0:w]
    grid = 1 + 0.06 * np.sin(2 * np.pi * x / period) * np.sin(2 * np.pi * y / period)
    return recompressed(np.clip(big * grid[..., None], 0, 255).astype(np.uint8), 70 + int(u[1] * 21))


def edited(rgb: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(image, its stale thumbnail): cropped and stretched back after the thumbnail was made; ``u`` is one uniform."""
    h, w = rgb.shape[:2]
    scale = min(1.0, 160 / max(h, w))
    thumb = recompressed(resize(rgb, max(1, round(h * scale)), max(1, round(w * scale))), 90)
    out = resize(rgb[: max(1, int(h * 0.9)), : max(1, int(w * 0.9))], h, w)
    return recompressed(out, 55 + int(u[0] * 21)), thumb


def normalised(rgb: np.ndarray, longest: int = 512) -> np.ndarray:
    """A source image as pools keep it: no side over ``longest``, coded at quality 95."""
    h, w = rgb.shape[:2]
    scale = min(1.0, longest / max(h, w))
    return recompressed(rgb if scale == 1 else resize(rgb, max(1, round(h * scale)), max(1, round(w * scale))), 95)


#: Conditions of the shift matrix that change pixels; unseen generators are a matter of the split.
SHIFTS = {
    "in_distribution": lambda rgb: rgb,
    "jpeg_q60": lambda rgb: recompressed(rgb, 60),
    "jpeg_q40": lambda rgb: recompressed(rgb, 40),
    "metadata_stripped": lambda rgb: recompressed(rgb, 92),
    "centre_crop_90": lambda rgb: recompressed(centre_crop(rgb), 92),
    "screenshot_round_trip": lambda rgb: recompressed(rgb, 88),
    "colour_jitter_rotate": lambda rgb: recompressed(saturated(rotated(rgb, 2.0), 1.15), 90),
}
