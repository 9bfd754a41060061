"""Pixel kernels in plain numpy, run over Arrow batches of decoded images.

Gray images are float arrays of height x width. The kernels follow the published definitions; they are not meant to
match another library bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = "laplacian double, fft double, combined double, focus double, contrast double, sharpness double, noise double, exposure double, overexposed double, resolution double, white double, edges double, phash long, dhash long, ahash long, whash long"


def planes(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """height x width x channels, blue first."""
    return np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)


def gray(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return np.rint(pixels[:, :, 0] * 0.114 + pixels[:, :, 1] * 0.587 + pixels[:, :, 2] * 0.299)


def laplacian_variance(g: np.ndarray) -> float:
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def _high_frequencies(g: np.ndarray, half: int) -> np.ndarray:
    """Magnitude of what is left without the lowest frequencies, a square of 2 * half around the centre."""
    f = np.fft.fftshift(np.fft.fft2(g))
    y, x = (n // 2 for n in g.shape)
    f[max(0, y - half) : y + half, max(0, x - half) : x + half] = 0
    return np.abs(np.fft.ifft2(np.fft.ifftshift(f)))


def fft_score(g: np.ndarray) -> float:
    """Mean of 20 ln(magnitude); -1000 where nothing is left at some pixel."""
    with np.errstate(divide="ignore"):
        score = float((20 * np.log(_high_frequencies(g, 60))).mean())
    return score if np.isfinite(score) else -1000.0


def combined_blur(laplacian: float, fft: float) -> float:
    return 0.5 * min(laplacian / 1000 * 100, 100) + 0.5 * min(fft / 20 * 100, 100)


def focus_score(g: np.ndarray, low: float = 50.0) -> float:
    value = (laplacian_variance(g) / 1000 * 0.6 + _high_frequencies(g, 30).mean() / 100 * 0.4) * 100
    return float(np.clip(value, low, 100))


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    rows, cols = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return rows[:, 2:] - rows[:, :-2], cols[2:] - cols[:-2]


def contrast(g: np.ndarray) -> float:
    h = np.bincount(np.clip(g, 0, 255).astype(int).ravel(), minlength=256) / g.size
    return float(min((np.abs(np.arange(256) - g.mean()) * np.sqrt(h)).sum() / 80, 1))


def sharpness(g: np.ndarray) -> float:
    gx, gy = sobel(g)
    return float(min(0.6 * laplacian_variance(g) / 500 + 0.4 * np.hypot(gx, gy).mean() / 100, 1))


def noise(g: np.ndarray) -> float:
    """1 - sigma / 10, sigma the median absolute finest diagonal detail over 0.6745."""
    e = g[: g.shape[0] // 2 * 2, : g.shape[1] // 2 * 2]
    detail = (e[::2, ::2] - e[1::2, ::2] - e[::2, 1::2] + e[1::2, 1::2]) / 2
    sigma = float(np.median(np.abs(detail)) / 0.6745) if detail.size else 0.0
    return max(1 - sigma / 10, 0.0)


def exposure(g: np.ndarray) -> float:
    return float(1 - abs(127.5 - g.mean()) / 127.5)


def overexposed(g: np.ndarray) -> float:
    return float((g > 240).mean())


def area_resize(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the source pixels of each target pixel, in fractions."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        covered = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
        covered = np.clip(covered, 0, None)
        return covered / covered.sum(axis=1, keepdims=True)

    return weights(g.shape[0], height) @ g @ weights(g.shape[1], width).T


def thumbnail_size(width: int, height: int, most: int = 512) -> tuple[int, int]:
    """Width and height after fitting into most x most; never enlarged."""
    scale = min(1.0, most / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def _packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel(), bitorder="little").view("<i8")[0])


def phash(g: np.ndarray) -> int:
    """Signs of the low 8 x 8 cosine coefficients of a 32 x 32 version against their median."""
    n = np.arange(32)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * n[:8, None] / 64)
    low = basis @ area_resize(g, 32, 32) @ basis.T
    return _packed(low > np.median(low))


def dhash(g: np.ndarray) -> int:
    small = area_resize(g, 8, 9)
    return _packed(small[:, 1:] > small[:, :-1])


def ahash(g: np.ndarray) -> int:
    small = area_resize(g, 8, 8)
    return _packed(small > small.mean())


def whash(g: np.ndarray) -> int:
    """Signs of the 8 x 8 low band of the Haar transform, which are block means, against their median."""
    low = area_resize(g, 8, 8)
    return _packed(low > np.median(low))


def white_share(pixels: np.ndarray, least_value: float = 180, most_saturation: float = 30) -> float:
    """Percent of bright pixels without much colour (value and saturation up to 255)."""
    colours = pixels[:, :, :3]
    value = colours.max(axis=2)
    saturation = np.divide(255 * (value - colours.min(axis=2)), value, out=np.zeros_like(value), where=value > 0)
    return float(((value >= least_value) & (saturation <= most_saturation)).mean() * 100)


def edges(g: np.ndarray, low: float = 50.0, high: float = 150.0) -> np.ndarray:
    """Edge pixels: gradients that are largest across the edge, above high, or above low and connected to such."""
    gx, gy = sobel(g)
    strength = np.abs(gx) + np.abs(gy)
    p = np.pad(strength, 1)
    at = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    ax, ay, slope = np.abs(gx), np.abs(gy), np.tan(np.pi / 8)
    across = [(ay <= slope * ax, (0, 1)), (ax <= slope * ay, (1, 0)), (gx * gy > 0, (1, 1)), (np.ones_like(g, bool), (1, -1))]
    before = np.select([c for c, _ in across], [at(-dy, -dx) for _, (dy, dx) in across])
    after = np.select([c for c, _ in across], [at(dy, dx) for _, (dy, dx) in across])
    ridge = (strength > before) & (strength >= after)
    weak, found = ridge & (strength > low), ridge & (strength > high)
    while True:
        q = np.pad(found, 1)
        grown = weak & np.logical_or.reduce([q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        if (grown == found).all():
            return found
        found = grown


def edge_share(g: np.ndarray) -> float:
    return float(edges(g).mean() * 100)


def region_focus(g: np.ndarray) -> tuple[float, float]:
    """Mean and variance of the gradient of a region, weighted .8 and 1.2."""
    gx, gy = sobel(g)
    m = np.hypot(gx, gy)
    return float(m.mean() * 0.8), float(m.var() * 1.2)


def measure(pixels: np.ndarray) -> dict:
    g = gray(pixels)
    laplacian, fft = laplacian_variance(g), fft_score(g)
    return {
        "laplacian": laplacian, "fft": fft, "combined": combined_blur(laplacian, fft), "focus": focus_score(g), "contrast": contrast(g), "sharpness": sharpness(g), "noise": noise(g),
        "exposure": exposure(g), "overexposed": overexposed(g), "resolution": min(g.size / 6e6, 1.0), "white": white_share(pixels), "edges": edge_share(g), "phash": phash(g), "dhash": dhash(g), "ahash": ahash(g), "whash": whash(g),
    }


def features(images: DataFrame, ident: str = "path") -> DataFrame:
    """(ident, FEATURES) of decoded images; pixels go no further than this step. Broken rows have null features."""
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident_, height, width, channels, data in zip(*(batch[c] for c in (ident, "height", "width", "channels", "data"))):
                try:
                    rows.append({ident: ident_} | measure(planes(data, height, width, channels)))
                except (ValueError, TypeError):
                    rows.append({ident: ident_} | dict.fromkeys(names))
            out = pd.DataFrame(rows, columns=[ident, *names])
            for hashed in ("phash", "dhash", "ahash", "whash"):
                out[hashed] = out[hashed].astype("Int64")
            yield out

    kind = images.schema[ident].dataType.simpleString()
    return images.select(ident, "height", "width", "channels", "data").mapInPandas(run, f"{ident} {kind}, {FEATURES}")


def images_from_embeddings(embeddings: DataFrame, scale: int = 16) -> DataFrame:
    """Gray images of 8 x 8 tiles, one a dimension: real pixels for the kernels from a table without image files."""
    tile = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), (x * 400 + 128).cast("int"))))
    row = lambda y: F.array_repeat(F.array_join(F.flatten(F.transform(F.slice(tile, y * 8 + 1, F.lit(8)), lambda v: F.array_repeat(F.lpad(F.hex(v), 2, "0"), scale))), ""), scale)
    pixels = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), row)), "")
    side = F.lit(8 * scale)
    return embeddings.select(F.col("vec_id").alias("path"), side.alias("height"), side.alias("width"), F.lit(1).alias("channels"), F.unhex(pixels).alias("data"))
