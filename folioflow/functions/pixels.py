"""Pixel functions of the image boundary, in NumPy: crops, degraded and filtered variants, illumination.

They run inside Arrow UDFs, next to the decoded bytes; what is decided about pixels stays in SQL. Variants are seeded by
a key, so a crop looks the same on every run and executor.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np


def grey(image: np.ndarray) -> np.ndarray:
    """Rows x columns of an image of one channel, or of the lightness of blue, green and red."""
    return image[..., 0] if image.shape[2] == 1 else np.rint(image[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A grey image as a PNG file."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = np.concatenate([np.zeros((len(image), 1), np.uint8), image], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def page_corners(image: np.ndarray, least: float = 0.2, most: float = 0.98) -> np.ndarray | None:
    """Corners of the bright page on a darker ground (x, y), or None where there is no such page.

    The page is what is brighter than Otsu's threshold of the smoothed image; its corners are its extremes along both
    diagonals. It must hold between ``least`` and ``most`` of the image, fill its quadrilateral, and be one.
    """
    step = max(1, max(image.shape) // 400)
    small = _box_blur(image[::step, ::step].astype(np.float64), 2)
    levels = np.clip(small, 0, 255).astype(np.uint8)
    page = levels > threshold(levels)
    if not least <= page.mean() <= most:
        return None
    y, x = np.nonzero(page)
    total, difference = x + y, x - y
    corners = np.array([[x[i], y[i]] for i in (total.argmin(), difference.argmax(), total.argmax(), difference.argmin())], float)
    u, v = corners, np.roll(corners, -1, axis=0)
    area = abs((u[:, 0] * v[:, 1] - v[:, 0] * u[:, 1]).sum()) / 2
    if not 0.85 <= page.sum() / max(1.0, area) <= 1.15:
        return None
    return corners * step


def threshold(image: np.ndarray) -> int:
    """Otsu's threshold: the level that separates two classes of grey best."""
    share = np.bincount(image.ravel(), minlength=256) / image.size
    weight, mean = np.cumsum(share), np.cumsum(share * np.arange(256))
    between = (mean[-1] * weight - mean) ** 2 / np.maximum(weight * (1 - weight), 1e-12)
    return int(between.argmax())


def crop(image: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    """A copy of the pixels of a rectangle."""
    return image[top:bottom, left:right].copy()


def _box_blur(plane: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square window, edges repeated; two passes of running sums."""
    if radius < 1:
        return plane
    size = 2 * radius + 1
    for axis in (0, 1):
        padded = np.pad(plane, [(radius + 1, radius) if a == axis else (0, 0) for a in range(plane.ndim)], mode="edge")
        sums = np.cumsum(padded, axis=axis, dtype=np.float64)
        plane = (np.take(sums, range(size, sums.shape[axis]), axis=axis) - np.take(sums, range(sums.shape[axis] - size), axis=axis)) / size
    return plane


def background(grey: np.ndarray) -> np.ndarray:
    """The light on the page: a wide blur of the grey image."""
    return _box_blur(grey.astype(np.float64), max(1, min(grey.shape) // 12))


def illumination_variation(grey: np.ndarray) -> float:
    """Spread of the background between its 10th and 90th percentile, over the full scale."""
    low, high = np.percentile(background(grey), [10, 90])
    return float((high - low) / 255)


def normalize_illumination(grey: np.ndarray) -> np.ndarray:
    """The page divided by its background, so that paper is evenly white."""
    lit = background(grey)
    return np.clip(grey / np.maximum(lit, 1.0) * np.percentile(lit, 95), 0, 255).astype(np.uint8)


def _stretch(grey: np.ndarray) -> np.ndarray:
    low, high = np.percentile(grey, [1, 99])
    return np.clip((grey - low) * (255 / max(1.0, high - low)), 0, 255)


def scan_filter(grey: np.ndarray, amount: float = 0.6) -> np.ndarray:
    """A mild scan: contrast stretched, edges sharpened."""
    plain = _stretch(grey.astype(np.float64))
    return np.clip(plain + amount * (plain - _box_blur(plain, 1)), 0, 255).astype(np.uint8)


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """A smaller image whose pixels are means over the area they cover, fractions of pixels included."""

    def cover(size: int, parts: int) -> np.ndarray:
        edges = np.linspace(0, size, parts + 1)
        whole = np.clip(edges[1:, None] - np.arange(size), 0, 1) - np.clip(edges[:-1, None] - np.arange(size), 0, 1)
        return whole / whole.sum(axis=1, keepdims=True)

    return cover(grey.shape[0], height) @ grey.astype(np.float64) @ cover(grey.shape[1], width).T


def equalized(grey: np.ndarray, clip: float = 1.6, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: tile histograms are clipped, what is cut off is spread over all
    levels, and pixels take the bilinear mean of the mappings of the four tiles around them."""
    h, w = grey.shape
    down, right = -h % tiles, -w % tiles
    padded = np.pad(grey, ((0, down), (0, right)), mode="reflect" if min(h, w) > max(down, right) else "edge")
    th, tw = padded.shape[0] // tiles, padded.shape[1] // tiles
    area = th * tw
    limit = max(1, int(clip * area / 256))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            counts = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            cut = np.maximum(counts - limit, 0).sum()
            counts = np.minimum(counts, limit) + cut // 256
            rest = int(cut % 256)
            if rest:
                counts[:: max(1, 256 // rest)][:rest] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(counts) * (255 / area)), 0, 255)
    y, x = (np.arange(h) / th - 0.5)[:, None], (np.arange(w) / tw - 0.5)[None, :]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    v, u = y - y0, x - x0
    at = lambda r, c: maps[np.clip(r, 0, tiles - 1), np.clip(c, 0, tiles - 1), grey]
    mixed = (at(y0, x0) * (1 - u) + at(y0, x0 + 1) * u) * (1 - v) + (at(y0 + 1, x0) * (1 - u) + at(y0 + 1, x0 + 1) * u) * v
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def binarized(grey: np.ndarray, window: int = 25, k: float = 0.2) -> np.ndarray:
    """Sauvola's local threshold: 255 for paper, 0 for ink. The window is odd and no larger than the image."""
    most = min(grey.shape)
    window = max(3, min(window, most if most % 2 else most - 1))
    plain = grey.astype(np.float64)
    mean = _box_blur(plain, window // 2)
    spread = np.sqrt(np.maximum(_box_blur(plain**2, window // 2) - mean**2, 0))
    return np.where(plain > mean * (1 + k * (spread / 127.5 - 1)), 255, 0).astype(np.uint8)


def _generator(key: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big"))


def _sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples, edges repeated."""
    h, w = image.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(0, w - 2)), np.minimum(y.astype(int), max(0, h - 2))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    u, v = x - x0, y - y0
    return (image[y0, x0] * (1 - u) + image[y0, x1] * u) * (1 - v) + (image[y1, x0] * (1 - u) + image[y1, x1] * u) * v


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that maps four points to four points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def order_corners(points: np.ndarray) -> np.ndarray:
    """Four corners as top left, top right, bottom right, bottom left, by sums and differences of coordinates."""
    total, difference = points.sum(axis=1), points[:, 0] - points[:, 1]
    return points[[total.argmin(), difference.argmax(), total.argmax(), difference.argmin()]]


def rectify(grey: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The page between four corners, seen straight on."""
    a, b, c, d = order_corners(np.asarray(corners, float))
    width = max(1, round(max(np.hypot(*(b - a)), np.hypot(*(c - d)))))
    height = max(1, round(max(np.hypot(*(d - a)), np.hypot(*(c - b)))))
    return _warp(grey, homography(np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]]), np.array([a, b, c, d])), height, width)


def _warp(grey: np.ndarray, matrix: np.ndarray, height: int, width: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    mapped = matrix @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    return _sample(grey.astype(np.float64), mapped[0] / mapped[2], mapped[1] / mapped[2]).reshape(height, width).round().astype(np.uint8)


def camera_degrade(grey: np.ndarray, key: str) -> np.ndarray:
    """A photograph of a crop: jittered corners, a ramp of light, sometimes less resolution, blur, noise; seeded by key."""
    rng = _generator(key)
    h, w = grey.shape
    square = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    jitter = rng.uniform(-0.04, 0.04, (4, 2)) * [w, h]
    image = _warp(grey, homography(square, square + jitter), h, w).astype(np.float64) if min(h, w) > 2 else grey.astype(np.float64)
    angle, strength = rng.uniform(0, 2 * np.pi), rng.uniform(0.05, 0.25)
    y, x = np.mgrid[0:h, 0:w]
    ramp = np.cos(angle) * (x / max(1, w - 1) - 0.5) + np.sin(angle) * (y / max(1, h - 1) - 0.5)
    image *= 1 + strength * ramp
    if rng.random() < 0.5 and min(h, w) > 8:
        image = np.repeat(np.repeat(image[::2, ::2], 2, axis=0), 2, axis=1)[:h, :w]
    image = _box_blur(image, int(rng.integers(0, 2)))
    return np.clip(image + rng.normal(0, rng.uniform(1, 6), image.shape), 0, 255).astype(np.uint8)


def variant(grey: np.ndarray, name: str, key: str) -> np.ndarray:
    """clean, camera, camera_filtered (a camera image behind the scan filter), scan or normalized; others are errors."""
    if name == "clean":
        return grey.copy()
    if name == "camera":
        return camera_degrade(grey, key)
    if name == "camera_filtered":
        return scan_filter(camera_degrade(grey, key))
    if name == "scan":
        return scan_filter(grey)
    if name == "normalized":
        return normalize_illumination(grey)
    raise ValueError(f"unknown variant {name}")
