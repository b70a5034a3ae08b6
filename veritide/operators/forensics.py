"""Image evidence: perceptual hashes and signal features over pixel arrays and JPEG bytes, in Arrow batches.

Decoded pixels come as a column, since no image library is assumed; what an encoder would do is computed
in ``veritide.functions.pixels``, to within the rounding of its arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.functions.pixels import LUMA, SHIFTS, dct_matrix, luminance, recompressed, resize

NAMES = [
    "has_quant_tables", "n_quant_tables", "qt_luma_mean", "qt_distance_from_standard", "estimated_quality", "has_exif", "has_thumbnail", "thumbnail_mismatch", "thumbnail_comparable",
    "ela_mean", "ela_p99", "dct_high_freq_ratio", "fft_peak_ratio", "blockiness",
]
FEATURES = ", ".join(f"{n} double" for n in NAMES)
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def perceptual_hash(grey: np.ndarray, size: int = 8) -> int:
    """64 bits, the first coefficient highest, as a signed number: low cosine coefficients of the shrunk image against their median."""
    small = resize(grey, size * 4, size * 4).astype(float)
    k = np.arange(size * 4)
    m = np.cos(np.pi * (2 * k[None] + 1) * k[:size, None] / (8 * size))  # not normalised
    low = m @ small @ m.T
    value = int("".join("1" if b else "0" for b in (low > np.median(low)).ravel()), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def quantisation_tables(jpeg: bytes) -> list[list[int]]:
    """Tables of the DQT segments in natural order, by walking the markers."""
    out, at = [], 2
    while at + 4 <= len(jpeg) and jpeg[at] == 0xFF and jpeg[at + 1] != 0xDA:
        size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
        if jpeg[at + 1] == 0xDB:
            body = jpeg[at + 4 : at + 2 + size]
            while len(body) >= 65:
                wide = 2 if body[0] >> 4 else 1
                table = [0] * 64
                for i, place in enumerate(_ZIGZAG):
                    table[place] = int.from_bytes(body[1 + i * wide : 1 + (i + 1) * wide], "big")
                out.append(table)
                body = body[1 + 64 * wide :]
        at += 2 + size
    return out


def has_exif(jpeg: bytes) -> bool:
    return b"Exif\0\0" in jpeg[:65_536]


def estimated_quality(table: list[int]) -> float:
    """The inverse of the usual quality scaling of the standard table, 1 to 100."""
    ratio = float(np.mean(np.array(table) / np.array(LUMA)))
    return 100.0 if ratio <= 0 else float(np.clip(100 - 50 * ratio if ratio < 1 else 50 / ratio, 1, 100))


def blockiness(grey: np.ndarray) -> float:
    """Mean step across the 8-pixel boundaries of columns over that in the middle of the blocks; 0 for images too small to tell."""
    g = grey.astype(float)
    if min(g.shape) < 18:
        return 0.0
    step = np.abs(np.diff(g, axis=1))  # step[:, c - 1] leads into column c
    edge = np.arange(8, g.shape[1] - 1, 8)
    middle = edge[edge + 4 < g.shape[1]] + 4
    inside = step[:, middle - 1].mean() if len(middle) else 0.0
    return float(step[:, edge - 1].mean() / inside) if inside > 0 else 0.0


def frequency_features(grey: np.ndarray, blocks: int = 64) -> tuple[float, float]:
    """Share of the absolute block coefficients outside the 3 x 3 low corner, over evenly spaced blocks, and the
    spectrum's peak over its median, the centre blanked."""
    g = grey.astype(float)
    h, w = (s // 8 for s in g.shape)
    ratio = 0.0
    if h and w:
        cells = g[: h * 8, : w * 8].reshape(h, 8, w, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        cells = cells[:: max(1, len(cells) // blocks)][:blocks]
        m = dct_matrix(8)
        size = np.abs(m @ cells @ m.T)
        if size.sum() > 0:
            ratio = float(1 - size[:, :3, :3].sum() / size.sum())
    spectrum = np.abs(np.fft.fftshift(np.fft.fft2(g - g.mean())))
    y, x = (s // 2 for s in spectrum.shape)
    spectrum[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4] = 0
    middle = float(np.median(spectrum)) if spectrum.size else 0.0
    return ratio, float(spectrum.max() / middle) if middle > 0 else 0.0


def error_levels(rgb: np.ndarray, quality: int = 90) -> tuple[float, float]:
    """Mean and 99th percentile of what coding at a fixed quality takes away: small for what was coded coarser before."""
    rest = np.abs(rgb.astype(float) - recompressed(rgb, quality))
    return float(rest.mean()), float(np.percentile(rest, 99))


def thumbnail_mismatch(rgb: np.ndarray, thumbnail: np.ndarray) -> float:
    """Mean difference of image and thumbnail, both at 32 x 32, as a share of the range."""
    a, b = (resize(x, 32, 32).astype(float) for x in (rgb, thumbnail))
    return float(np.abs(a - b).mean() / 255)


def describe(jpeg: bytes | None, rgb: np.ndarray, thumbnail: np.ndarray | None = None) -> tuple[float, ...]:
    """The features in the order of NAMES; what is absent keeps 0, which says nothing against an image."""
    tables = quantisation_tables(jpeg) if jpeg else []
    luma = np.array(tables[0], float) if tables else None
    grey = rgb.astype(float).mean(axis=2)
    ratio, peak = frequency_features(grey)
    quant = (1.0, float(len(tables)), float(luma.mean()), float(np.abs(luma - LUMA).mean()), estimated_quality(tables[0])) if tables else (0.0,) * 5
    block = blockiness(grey) if min(grey.shape) >= 8 else 0.0
    stale = (1.0, thumbnail_mismatch(rgb, thumbnail), 1.0) if thumbnail is not None else (0.0, 0.0, 0.0)
    return (*quant, float(has_exif(jpeg or b"")), *stale, *error_levels(rgb), ratio, peak, block)


def _array(raw: bytes | None, height: int, width: int) -> np.ndarray | None:
    """Pixels [row, column, 3] of bytes with one or three to a pixel."""
    if raw is None:
        return None
    x = np.frombuffer(raw, np.uint8)
    return x.reshape(height, width, 3) if x.size == 3 * height * width else np.repeat(x.reshape(height, width, 1), 3, axis=2)


def image_features(images: DataFrame, id_col: str = "claim_id", shift: str | None = None) -> DataFrame:
    """Hash and forensics of images(id, content, width, height, pixels[, thumbnail]).

    ``pixels`` is one or three bytes a pixel, ``content`` the file if known, ``thumbnail`` the pixels of an
    embedded one as a struct (width, height, pixels). With ``shift`` the pixels go through that condition of
    the shift matrix first, which leaves no file and no thumbnail unless it is ``in_distribution``.
    """
    if shift is not None and shift not in SHIFTS:
        raise KeyError(f"no condition {shift!r}; there are {sorted(SHIFTS)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                rgb = _array(r.pixels, r.height, r.width)
                thumb = None if r.thumb is None else _array(r.thumb, int(r.th), int(r.tw))
                content = r.content
                if shift not in (None, "in_distribution"):
                    rgb, thumb, content = SHIFTS[shift](rgb), None, None
                rows.append((r.id, perceptual_hash(luminance(rgb)), *describe(content, rgb, thumb)))
            yield pd.DataFrame(rows, columns=["id", "phash", *NAMES])

    thumb = [F.col(f"thumbnail.{c}") if "thumbnail" in images.columns else F.lit(None) for c in ("width", "height", "pixels")]
    slim = images.select(
        F.col(id_col).cast("string").alias("id"), F.col("content").cast("binary").alias("content"), "width", "height", F.col("pixels").cast("binary").alias("pixels"),
        thumb[0].cast("int").alias("tw"), thumb[1].cast("int").alias("th"), thumb[2].cast("binary").alias("thumb"),
    )
    return slim.mapInPandas(run, f"id string, phash long, {FEATURES}").withColumnRenamed("id", id_col)
