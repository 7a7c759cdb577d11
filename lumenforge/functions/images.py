"""Dense image operations in numpy, for use in pandas functions over arrays (height x width x channel, 0 to 255)."""

from __future__ import annotations

import numpy as np


def identity(a: np.ndarray) -> np.ndarray:
    return a


def solarize(a: np.ndarray, threshold: int = 128) -> np.ndarray:
    return np.where(a < threshold, a, 255 - a).astype(np.uint8)


def posterize(a: np.ndarray, bits: int) -> np.ndarray:
    return (a & (0xFF << (8 - bits) & 0xFF)).astype(np.uint8)


def brightness(a: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(a.astype(np.float64) * factor, 0, 255).astype(np.uint8)


#: What the channels weigh in a pixel's grey.
GREY = (0.114, 0.587, 0.299)


def contrast(a: np.ndarray, factor: float) -> np.ndarray:
    """Away from the mean grey of the image, or towards it."""
    mean = float((a.reshape(-1, a.shape[2]).mean(axis=0) * _grey(a)).sum())
    return np.clip((np.arange(256) - mean) * factor + mean, 0, 255).astype(np.uint8)[a]


def _grey(a: np.ndarray) -> np.ndarray:
    return np.asarray(GREY) if a.shape[2] == 3 else np.full(a.shape[2], 1 / a.shape[2])


def colour(a: np.ndarray, factor: float) -> np.ndarray:
    """Away from each pixel's own grey, or towards it."""
    grey = (a * _grey(a)).sum(axis=2, keepdims=True)
    return np.clip(grey + factor * (a - grey), 0, 255).astype(np.uint8)


def sharpness(a: np.ndarray, factor: float) -> np.ndarray:
    """Away from the image smoothed over 3 x 3 (its middle weighs 5 of 13), or towards it; the rim stays."""
    h, w = a.shape[:2]
    if h < 3 or w < 3:
        return a
    f = a.astype(np.float64)
    around = sum(f[y : y + h - 2, x : x + w - 2] for y in range(3) for x in range(3))
    smooth = np.round((around + 4 * f[1:-1, 1:-1]) / 13)
    out = f.copy()
    out[1:-1, 1:-1] = smooth + factor * (f[1:-1, 1:-1] - smooth)
    return np.clip(out, 0, 255).astype(np.uint8)


def warp(a: np.ndarray, matrix, fill: int = 128) -> np.ndarray:
    """The image moved by an affine map of (x, y), 2 x 3; places between pixels are interpolated, what comes from outside is `fill`."""
    h, w = a.shape[:2]
    m = np.vstack([np.asarray(matrix, dtype=np.float64), [0, 0, 1]])
    inverse = np.linalg.inv(m)
    y, x = np.mgrid[0:h, 0:w]
    sx, sy = (inverse[i, 0] * x + inverse[i, 1] * y + inverse[i, 2] for i in (0, 1))
    x0, y0 = np.floor(sx + 1e-9).astype(int), np.floor(sy + 1e-9).astype(int)
    fx, fy = np.clip(sx - x0, 0, 1)[..., None], np.clip(sy - y0, 0, 1)[..., None]
    padded = np.pad(a.astype(np.float64), ((1, 1), (1, 1), (0, 0)), constant_values=fill)

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        return padded[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)]

    out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def rotate(a: np.ndarray, degrees: float, fill: int = 128) -> np.ndarray:
    """Turned about the middle, against the clock."""
    h, w = a.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    x, y = w / 2, h / 2
    return warp(a, [[c, s, (1 - c) * x - s * y], [-s, c, s * x + (1 - c) * y]], fill)


def shear(a: np.ndarray, along_x: float = 0.0, along_y: float = 0.0, fill: int = 128) -> np.ndarray:
    return warp(a, [[1, along_x, 0], [along_y, 1, 0]], fill)


def cutout(a: np.ndarray, size: int, x: int, y: int, fill: int = 128) -> np.ndarray:
    """A square of about `size` around (x, y) filled."""
    out, half = a.copy(), size // 2
    out[max(0, y - half) : y + half, max(0, x - half) : x + half] = fill
    return out


def equalise(a: np.ndarray) -> np.ndarray:
    out = np.empty_like(a)
    for c in range(a.shape[2]):
        counts = np.bincount(a[..., c].ravel(), minlength=256)
        last = counts[counts > 0][-1] if counts.any() else 0
        step = (counts.sum() - last) // 255
        table = np.arange(256) if step == 0 else np.clip((np.concatenate([[step // 2], np.cumsum(counts)[:-1] + step // 2])) // step, 0, 255)
        out[..., c] = table[a[..., c]]
    return out


def auto_contrast(a: np.ndarray) -> np.ndarray:
    out = a.astype(np.float64)
    for c in range(a.shape[2]):
        lo, hi = out[..., c].min(), out[..., c].max()
        if hi > lo:
            out[..., c] = (out[..., c] - lo) * 255 / (hi - lo)
    return np.clip(out, 0, 255).astype(np.uint8)


def invert(a: np.ndarray) -> np.ndarray:
    return (255 - a).astype(np.uint8)


def centre_crop(a: np.ndarray, height: int, width: int) -> np.ndarray:
    y, x = (a.shape[0] - height) // 2, (a.shape[1] - width) // 2
    return a[y : y + height, x : x + width]


def flip(a: np.ndarray) -> np.ndarray:
    return a[:, ::-1]


def resize_nearest(a: np.ndarray, height: int, width: int) -> np.ndarray:
    return a[(np.arange(height) * a.shape[0] // height)[:, None], (np.arange(width) * a.shape[1] // width)[None, :]]


def normalise(a: np.ndarray, mean, std) -> np.ndarray:
    return (a.astype(np.float64) / 255 - np.asarray(mean)) / np.asarray(std)


#: An operation at a strength of 0 to 1 (its level over the highest) and a sign.
OPERATIONS = {
    "Identity": lambda a, _, __: identity(a),
    "AutoContrast": lambda a, _, __: auto_contrast(a),
    "Equalize": lambda a, _, __: equalise(a),
    "Rotate": lambda a, m, s: rotate(a, s * m * 30),
    "Solarize": lambda a, m, _: solarize(a, int(m * 256)),
    "Color": lambda a, m, _: colour(a, m * 1.8 + 0.1),
    "Contrast": lambda a, m, _: contrast(a, m * 1.8 + 0.1),
    "Brightness": lambda a, m, _: brightness(a, m * 1.8 + 0.1),
    "Sharpness": lambda a, m, _: sharpness(a, m * 1.8 + 0.1),
    "ShearX": lambda a, m, s: shear(a, along_x=s * m * 0.3),
    "TranslateX": lambda a, m, s: warp(a, [[1, 0, -s * m * 10], [0, 1, 0]]),
    "TranslateY": lambda a, m, s: warp(a, [[1, 0, 0], [0, 1, -s * m * 10]]),
    "Posterize": lambda a, m, _: posterize(a, int(m * 4)),
    "ShearY": lambda a, m, s: shear(a, along_y=s * m * 0.3),
}


def polygon_mask(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cells whose centre lies inside a polygon of (x, y) points, by the crossing rule."""
    x, y = np.arange(width) + 0.5, np.arange(height) + 0.5
    inside = np.zeros((height, width), dtype=bool)
    p = np.asarray(points, dtype=np.float64).reshape(-1, 2)
    for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0), strict=True):
        rows = (y0 > y) != (y1 > y)
        if rows.any():
            cross = (x1 - x0) * (y[rows] - y0) / (y1 - y0) + x0
            inside[rows] ^= x[None, :] < cross[:, None]
    return inside


def class_masks(labels: np.ndarray, ignore: int = 255) -> tuple[list[int], np.ndarray]:
    """(classes in the label map but the ignored one, a mask for each)."""
    classes = [int(c) for c in np.unique(labels) if c != ignore]
    return classes, np.stack([labels == c for c in classes]) if classes else np.zeros((0, *labels.shape), dtype=bool)


def pad_to(a: np.ndarray, divisor: int, fill: int = 0) -> np.ndarray:
    """Height and width filled up behind to multiples of the divisor."""
    more = [(0, -n % divisor) for n in a.shape[:2]] + [(0, 0)] * (a.ndim - 2)
    return np.pad(a, more, constant_values=fill)


def batch(images: list[np.ndarray], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(images of different sizes in one array, a mask that is true where there is padding)."""
    h, w = (max(x.shape[i] for x in images) for i in (0, 1))
    out = np.full((len(images), h, w, *images[0].shape[2:]), fill, dtype=images[0].dtype)
    mask = np.ones((len(images), h, w), dtype=bool)
    for k, x in enumerate(images):
        out[k, : x.shape[0], : x.shape[1]] = x
        mask[k, : x.shape[0], : x.shape[1]] = False
    return out, mask
