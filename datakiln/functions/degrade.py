"""Defects for clean frames: degradations of graded strength, edit variations and long-tail kinds.

Each kernel takes (image, generator, strength) and gives (image, parameters). Ranges are by strength: mild, moderate, severe.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from datakiln.functions import constants as C
from datakiln.functions.image import blurred, clipped, convolved, disc, gray, recompressed, resized, streak

Kernel = Callable[[np.ndarray, np.random.Generator, str], tuple[np.ndarray, dict]]
STRENGTHS = ("mild", "moderate", "severe")


def _pick(strength: str, *by_strength):
    return by_strength[STRENGTHS.index(strength)]


def _between(rng: np.random.Generator, bounds: tuple[float, float]) -> float:
    return float(rng.uniform(*bounds))


def _blend(img: np.ndarray, layer, alpha) -> np.ndarray:
    return clipped(img * (1 - alpha) + np.asarray(layer, dtype=float) * alpha)


def low_res(img, rng, strength):
    scale = _between(rng, _pick(strength, (1.5, 2.2), (2.5, 3.5), (4, 6)))
    h, w = img.shape[:2]
    small = resized(img, max(1, int(h / scale)), max(1, int(w / scale)))
    return resized(small, h, w), {"scale": scale}


def blur(img, rng, strength):
    size = int(rng.integers(*_pick(strength, (3, 6), (7, 12), (15, 26)))) | 1
    if rng.random() < 0.5:
        angle = _between(rng, (0, 180))
        return clipped(convolved(img, streak(size, angle))), {"kind": "motion", "size": size, "angle": angle}
    sigma = _between(rng, _pick(strength, (0.6, 1.2), (1.5, 2.5), (3, 5)))
    return clipped(blurred(img, size, sigma)), {"kind": "gaussian", "size": size, "sigma": sigma}


def _gamma(img: np.ndarray, gamma: float) -> np.ndarray:
    return clipped(255 * (img / 255.0) ** gamma)


def over_expo(img, rng, strength):
    gamma = _between(rng, _pick(strength, (0.75, 0.88), (0.55, 0.72), (0.32, 0.5)))
    out = _gamma(img, gamma)
    if strength == "severe":
        g = gray(img)
        out[g >= np.percentile(g, 88)] = 255
    return out, {"gamma": gamma}


def dark(img, rng, strength):
    gamma = _between(rng, _pick(strength, (1.4, 1.8), (1.9, 2.6), (3, 4.5)))
    out, params = _gamma(img, gamma), {"gamma": gamma}
    if strength == "severe":
        params["alpha"] = _between(rng, (0.25, 0.5))
        out = clipped(out * params["alpha"])
    return out, params


def occlusion(img, rng, strength):
    out, (h, w) = img.copy(), img.shape[:2]
    n, share, modes = int(
        rng.integers(*_pick(strength, (1, 2), (1, 3), (2, 4)))
    ), _pick(strength, (0.05, 0.12), (0.12, 0.24), (0.24, 0.42)), []
    for _ in range(n):
        ph, pw = (min(side, max(8, int(side * _between(rng, share)))) for side in (h, w))
        y, x = int(rng.integers(0, h - ph + 1)), int(rng.integers(0, w - pw + 1))
        patch, mode = out[y : y + ph, x : x + pw], ("solid", "noise", "dark", "smudge")[int(rng.integers(4))]
        modes.append(mode)
        if mode == "noise":
            patch[:] = rng.integers(0, 256, patch.shape)
        elif mode == "smudge":
            patch[:] = _blend(patch, rng.integers(0, 256, 3), _between(rng, (0.45, 0.75)))
        else:
            patch[:] = rng.integers(0, 46 if mode == "dark" else 256, 3)
    return out, {"count": n, "modes": modes}


def noise(img, rng, strength):
    q = int(rng.integers(*_pick(strength, (45, 69), (20, 43), (5, 17))))
    out, params = recompressed(img, q), {"quality": q}
    if strength == "severe":
        params["sigma"] = _between(rng, (6, 16))
        out = clipped(out + rng.normal(0, params["sigma"], img.shape))
    return out, params


DEGRADE: dict[str, Kernel] = {
    "low_res": low_res, "blur": blur, "over_expo": over_expo, "dark": dark, "occlusion": occlusion, "noise": noise
}


def sensor_noise(img, rng, strength):
    shot, read = _between(rng, _pick(strength, (0.004, 0.012), (0.015, 0.035), (0.04, 0.09))), _pick(strength, 0.004, 0.012, 0.03)
    light = img / 255.0
    return clipped(255 * (rng.poisson(light / shot) * shot + rng.normal(0, read, img.shape))), {"shot": shot, "read": read}


def fog(img, rng, strength):
    density = _pick(strength, 0.15, 0.35, 0.6) * _between(rng, (0.8, 1.2))
    h, w = img.shape[:2]
    cloud = resized(clipped(128 + rng.normal(0, 12, (max(2, h // 16), max(2, w // 16)))), h, w).astype(float) - 128
    return _blend(img, (_between(rng, (200, 245)) + cloud)[:, :, None], min(0.95, density)), {"density": density}


def rain(img, rng, strength):
    n, alpha = int(_pick(strength, 40, 120, 260) * _between(rng, (0.7, 1.3))), _pick(strength, 0.25, 0.45, 0.7)
    h, w = img.shape[:2]
    layer, length, lean = np.zeros((h, w)), max(4, h // 12), _between(rng, (-0.4, 0.4))
    for _ in range(n):
        y, x = int(rng.integers(0, h)), int(rng.integers(0, w))
        t = np.arange(length)
        yy, xx = y + t, np.rint(x + lean * t).astype(int)
        inside = (yy < h) & (xx >= 0) & (xx < w)
        layer[yy[inside], xx[inside]] = 1
    return _blend(img, 220.0, (layer * alpha)[:, :, None]), {"drops": n}


def chromatic(img, rng, strength):
    shift = max(1, int(round(_pick(strength, 1, 2, 4) * _between(rng, (0.8, 1.2)))))
    out = img.copy()
    out[:, :, 2], out[:, :, 0] = np.roll(img[:, :, 2], shift, axis=1), np.roll(img[:, :, 0], -shift, axis=1)
    return out, {"shift": shift}


def mud(img, rng, strength):
    h, w = img.shape[:2]
    y, x = np.ogrid[:h, :w]
    mask, n = np.zeros((h, w)), _pick(strength, 1, 3, 6)
    for _ in range(n):
        r = max(2.0, _pick(strength, 0.05, 0.12, 0.22) * min(h, w) * _between(rng, (0.7, 1.3)))
        cy, cx = _between(rng, (0, h)), _between(rng, (0, w))
        spots = [(cy, cx, r)] + [
            (cy + rng.normal(0, r), cx + rng.normal(0, r), r * _between(rng, (0.1, 0.4))) for _ in range(int(rng.integers(3, 9)))
        ]
        for sy, sx, sr in spots:
            mask[(y - sy) ** 2 + (x - sx) ** 2 <= sr * sr] = 1
    return _blend(img, np.array([30, 50, 70]), (mask * _pick(strength, 0.35, 0.6, 0.85))[:, :, None]), {"splashes": n}


def vignette(img, rng, strength):
    h, w = img.shape[:2]
    y, x = np.linspace(-1, 1, h)[:, None], np.linspace(-1, 1, w)[None, :]
    k = _pick(strength, 0.55, 0.85, 1.25)
    return clipped(img * np.clip(1 - k * (x * x + y * y) / 2, 0, 1)[:, :, None]), {"k": k}


def bloom(img, rng, strength):
    limit, size, amount = _pick(strength, (225, 15, 0.25), (205, 31, 0.45), (180, 61, 0.7))
    glow = blurred(np.where(gray(img)[:, :, None] >= limit, img, 0), size, size / 4)
    return clipped(img + glow * amount), {"limit": limit, "amount": amount}


def resampled(img, rng, strength):
    scale, (h, w) = _between(rng, _pick(strength, (1.4, 1.9), (2, 3), (3.2, 5))), img.shape[:2]
    out, passes = img, _pick(strength, 2, 3, 4)
    for _ in range(passes):
        out = resized(resized(out, max(1, int(h / scale)), max(1, int(w / scale)), "nearest"), h, w, "linear")
    if strength == "mild":
        out = clipped(1.6 * out.astype(float) - 0.6 * blurred(out, 5, 1.0))
    return out, {"scale": scale, "passes": passes}


def defocus(img, rng, strength):
    if rng.random() < 0.5:
        r = max(1, int(round(_pick(strength, 2, 4, 7) * _between(rng, (0.8, 1.2)))))
        return clipped(convolved(img, disc(r))), {"kind": "disc", "radius": r}
    size = _pick(strength, 3, 5, 9)
    p = np.pad(img, ((size // 2,) * 2, (size // 2,) * 2, (0, 0)), mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(p, (size, size), axis=(0, 1))
    return np.median(windows, axis=(3, 4)).astype(np.uint8), {"kind": "median", "size": size}


def clean_edit(img, rng, strength="mild"):
    """A change that is no defect."""
    kind, x = ("white_balance", "contrast", "sharpen", "saturation")[int(rng.integers(4))], img.astype(float)
    if kind == "white_balance":
        return clipped(x * rng.uniform(0.95, 1.05, 3)), {"edit": "clean_negative", "kind": kind}
    if kind == "sharpen":
        return clipped(1.3 * x - 0.3 * blurred(img, 5, 1.0)), {"edit": "clean_negative", "kind": kind}
    base = x.mean() if kind == "contrast" else gray(img)[:, :, None].astype(float)
    return clipped(
        base + (x - base) * _between(rng, (0.92, 1.10) if kind == "contrast" else (0.85, 1.18))
    ), {"edit": "clean_negative", "kind": kind}


def _weather(img, rng, strength):
    u = rng.random()
    return (rain if u < 0.5 else fog if u < 0.75 else mud)(img, rng, strength)


EDITS: dict[str, Kernel] = {
    "low_res": resampled, "blur": defocus, "over_expo": bloom, "dark": vignette, "occlusion": _weather, "noise": sensor_noise
}


def backlit(img, rng, strength):
    h, w = img.shape[:2]
    y, x = np.ogrid[:h, :w]
    cy, cx = _between(rng, (0, h / 2)), _between(rng, (0, w))
    glow = np.exp(-(((y - cy) / (h / 3)) ** 2 + ((x - cx) / (w / 3)) ** 2))
    return clipped(img * (0.35 + 0.3 * glow[:, :, None]) + 255 * (glow**2)[:, :, None]), {"centre": [cy, cx]}


def smear(img, rng, strength):
    size = int(rng.integers(35, 56)) | 1
    return clipped(convolved(img, streak(size, _between(rng, (0, 180))))), {"size": size}


def harsh_combo(img, rng, strength):
    gamma, q = _between(rng, (2.4, 3.4)), int(rng.integers(6, 15))
    return recompressed(_gamma(img, gamma), q), {"gamma": gamma, "quality": q}


def _smudge(img, rng, strength):
    return mud(img, rng, "severe" if rng.random() < 0.5 else "moderate")


def _rain_fog(img, rng, strength):
    s = "severe" if rng.random() < 0.5 else "moderate"
    first, a = rain(img, rng, s)
    out, b = fog(first, rng, s)
    return out, a | b


#: kind: labels and kernel, in the order in which variants take turns.
LONGTAIL: dict[str, tuple[tuple[str, ...], Kernel]] = {
    "backlit": (("over_expo", "dark"), backlit),
    "rain_fog": (("occlusion",), _rain_fog),
    "smudge": (("occlusion",), _smudge),
    "smear": (("blur",), smear),
    "harsh_combo": (("dark", "noise"), harsh_combo),
}


def applied(
    img: np.ndarray, rng: np.random.Generator, classes: list[str], strengths: list[str], kernels: dict[str, Kernel]
) -> tuple[np.ndarray, dict]:
    """The image after one kernel per class in turn, with the parameters, the order and the difficulty of the mildest."""
    params: dict = {}
    for c, s in zip(classes, strengths):
        img, p = kernels[c](img, rng, s)
        params[c] = p | {"strength": s}
    levels = {C.STRENGTH_DIFFICULTY[s] for s in strengths}
    params["_order"] = classes
    params["_difficulty"] = next((d for d in ("hard", "mid", "easy") if d in levels), "none")
    return img, params
