"""Pixel conversions and multi-channel composition: per-pixel expressions and a saturating sum over channels."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _byte(x: Column) -> Column:
    """x + .5 in FLOAT, truncated."""
    return F.floor((x.cast("float") + F.lit(0.5).cast("float")).cast("float")).cast("int")


def converted(v: Column, source: str, target: str) -> Column:
    """An array of samples (one, or B, G, R) from one pixel type to another; a pair without a rule is an error. 8-bit samples widen to 48-bit colour as they are."""
    at = lambda k: F.get(v, F.lit(k))
    total = at(0) + at(1) + at(2)
    high = lambda x: F.shiftright(x, 8)
    real = lambda x: x.cast("double")
    grey = lambda f: F.array(f(at(0)))
    three = lambda f: F.array(f(at(0)), f(at(0)), f(at(0)))
    same = lambda x: x
    whole = lambda x: F.array(F.floor(x / 3).cast("int"))
    rules = {
        ("Gray8", "Gray8"): grey(same), ("Gray8", "Gray16"): grey(same), ("Gray8", "Gray32Float"): grey(real), ("Gray8", "Bgr24"): three(same), ("Gray8", "Bgr48"): three(same),
        ("Gray16", "Gray8"): grey(high), ("Gray16", "Gray16"): grey(same), ("Gray16", "Gray32Float"): grey(real), ("Gray16", "Bgr24"): three(high), ("Gray16", "Bgr48"): three(same),
        ("Bgr24", "Gray8"): whole(total + 1), ("Bgr24", "Gray16"): whole(total + 1), ("Bgr24", "Gray32Float"): F.array(total / 3), ("Bgr24", "Bgr24"): v, ("Bgr24", "Bgr48"): v,
        ("Bgr48", "Gray8"): F.transform(whole(total), high), ("Bgr48", "Gray16"): whole(total), ("Bgr48", "Gray32Float"): F.array(total / 3),
        ("Bgr48", "Bgr24"): F.transform(v, high), ("Bgr48", "Bgr48"): v,
        ("Gray32Float", "Gray32Float"): v, ("Bgra32", "Bgra32"): v,
    }
    if (source, target) not in rules:
        raise ValueError(f"no conversion from {source} to {target}")
    return rules[source, target]


@dataclass(frozen=True)
class Channel:
    """How a channel is shown; a look-up table goes before black and white points."""

    index: int
    weight: float = 1.0
    tint: tuple[int, int, int] | None = None
    black: float = 0.0
    white: float = 1.0
    lut: tuple[int, ...] = field(default=())
    enabled: bool = True


def thresholds(black: float, white: float, most: int) -> tuple[int, int]:
    return math.ceil(np.float32(black) * np.float32(most)), math.floor(np.float32(white) * np.float32(most))


def shown(channel: Channel, v: Column | list[Column], most: int = 255) -> dict[str, Column]:
    """b, g, r as INT 0 to 255 of a grey sample, or of the three samples of a colour (most: 255 or 65535).

    Without a tint each sample of a colour is shown by itself; a tint takes the colour as one grey value.
    """
    f32 = lambda x: F.lit(float(x)).cast("float")
    samples = v if isinstance(v, list) else [v]
    total = samples[0] if len(samples) == 1 else samples[0] + samples[1] + samples[2]
    n = len(samples)
    if channel.lut:
        if len(channel.lut) != most + 1:
            raise ValueError(f"a look-up table has {most + 1} entries")
        plain = [F.element_at(F.lit(list(channel.lut)), x + 1).cast("int") for x in samples]
        share = ((plain[0] if n == 1 else plain[0] + plain[1] + plain[2]).cast("float") / f32(n * 255)).cast("float")
    elif channel.black > 0 or channel.white < 1:
        low, high = thresholds(channel.black, channel.white, most)
        part = lambda x: F.when(x <= low, f32(0)).when(x >= high, f32(1)).otherwise(((x - low).cast("float") / f32(high - low)).cast("float"))
        plain = [F.when(x <= low, 0).when(x >= high, 255).otherwise(F.floor((part(x) * f32(255)).cast("double") + 0.5).cast("int")) for x in samples]
        share = part(total if n == 1 else F.floor((total + 1) / 3).cast("int"))
    else:
        plain = [x if most == 255 else F.shiftright(x, 8) for x in samples]
        share = (total.cast("float") / f32(n * most)).cast("float")
    if channel.tint is None:
        return {c: plain[k if n == 3 else 0] for k, c in enumerate("bgr")}
    return {c: _byte((share * f32(t)).cast("float")) for c, t in zip("rgb", channel.tint, strict=True)}


def effective_weights(channels: list[Channel]) -> dict[int, float] | None:
    """Weight over mean weight of each channel; None where weights do not count: all equal, none positive, or one not a number."""
    weights = [np.float32(c.weight) for c in channels]
    eps = np.finfo(np.float32).eps
    if any(not np.isfinite(w) or w < 0 for w in weights):
        return None
    total = np.float32(0)
    for w in weights:
        total = np.float32(total + w)
    mean = np.float32(total / np.float32(len(weights)))
    if abs(total) <= eps or all(abs(mean - w) <= eps for w in weights):
        return None
    return {c.index: float(np.float32(w / mean)) for c, w in zip(channels, weights, strict=True)}


def composed(pixels: DataFrame, channels: list[Channel], most: int = 255, alpha: int | None = None, kinds: dict[int, str] | None = None) -> DataFrame:
    """(px, py, b, g, r[, a]) from the composites of channels (channel, px, py, v): each shown, weighted, rounded and added, up to 255.

    v is a grey sample up to most; with kinds, which names each channel's pixel type, it is an array of one sample or
    three.

    Channels are rows, not joined images: the sum combines on the map side, whatever their number.
    """
    active = [c for c in channels if c.enabled]
    if not active:
        raise ValueError("no channel is active")
    weights = effective_weights(active)
    chosen = {c: F.lit(None).cast("int") for c in "bgr"}
    for channel in active:
        kind = kinds[channel.index] if kinds else None
        v = F.col("v") if kind is None else [F.get("v", F.lit(k)) for k in range(3)] if kind.startswith("Bgr") else F.get("v", F.lit(0))
        values = shown(channel, v, most if kind is None else 65535 if kind in ("Gray16", "Bgr48") else 255)
        for c in "bgr":
            x = values[c]
            if weights:
                x = F.least(_byte((x.cast("float") * F.lit(weights[channel.index]).cast("float")).cast("float")), F.lit(255))
            chosen[c] = F.when(F.col("channel") == channel.index, x).otherwise(chosen[c])
    each = pixels.where(F.col("channel").isin([c.index for c in active])).select("px", "py", *[v.alias(c) for c, v in chosen.items()])
    out = each.groupBy("px", "py").agg(*[F.least(F.sum(c), F.lit(255)).cast("int").alias(c) for c in "bgr"])
    return out if alpha is None else out.withColumn("a", F.lit(alpha))
