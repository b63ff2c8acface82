"""Noise against plain integers, one step after the other."""

import numpy as np
import pytest

from tessera.operators import noise as N

M64 = (1 << 64) - 1


def scramble(z):
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & M64
    z = (z ^ z >> 27) * 0x94D049BB133111EB & M64
    return z ^ z >> 31


def plain_group(seed0, seed1, height, width):
    a, b = [scramble(seed0 + 0x9E3779B97F4A7C15 & M64)], [scramble(seed1 + 0x9E3779B97F4A7C15 & M64)]
    for _ in range(7):
        a.append(scramble(a[-1]))
        b.append(scramble(b[-1]))
    out = np.zeros((3, height, width))
    for c in range(3):
        for y in range(height):
            row = []
            while len(row) < width:
                for i in range(8):
                    s1, s0 = a[i], b[i]
                    total = s1 + s0 & M64
                    a[i] = s0
                    s1 ^= s1 << 23 & M64
                    b[i] = s1 ^ s0 ^ s1 >> 18 ^ s0 >> 5
                    row += [total & 0xFFFFFFFF, total >> 32]
            out[c, y] = [1 + (v >> 9) / (1 << 23) for v in row[:width]]
    return out


def plain_field(height, width, visible, invisible, group):
    out = np.zeros((3, height, width))
    for y in range(0, height, group):
        for x in range(0, width, group):
            h, w = min(group, height - y), min(group, width - x)
            out[:, y : y + h, x : x + w] = plain_group((visible << 32) + invisible, (x << 32) + y, h, w)
    return out


def plain_sharpened(f):
    def mirror(k, n):
        while not 0 <= k < n:
            k = -k - 1 if k < 0 else 2 * n - 1 - k
        return k

    c, height, width = f.shape
    return np.array([[[sum(0.16 * f[k, mirror(y + dy, height), mirror(x + dx, width)] for dy in range(-2, 3) for dx in range(-2, 3)) - 4 * f[k, y, x] for x in range(width)] for y in range(height)] for k in range(c)])


FRAMES = [("a", 1, 5, 7, 0, 0), ("a", 2, 20, 33, 3, 1), ("b", 1, 1, 1, 0, 9), ("b", 2, 17, 2, 1 << 20, 0), ("c", 1, 0, 4, 0, 0)]


@pytest.mark.parametrize("group", [256, 16])
def test_field_and_convolution(spark, group):
    frames = spark.createDataFrame(FRAMES, "image string, frame int, height int, width int, visible long, invisible long")
    keys = ("image", "frame")
    raw, sharp = ({(r.image, r.frame, r.y, r.x): (r.n0, r.n1, r.n2) for r in d.collect()} for d in (N.field(frames, keys, group), N.sharpened(N.field(frames, keys, group), keys)))
    assert len(raw) == len(sharp) == sum(h * w for _, _, h, w, _, _ in FRAMES)
    for image, frame, height, width, visible, invisible in FRAMES:
        if height:
            own = plain_field(height, width, visible, invisible, group)
            soft = plain_sharpened(own)
            for y in range(height):
                for x in range(width):
                    assert raw[image, frame, y, x] == tuple(own[:, y, x])
                    assert np.allclose(sharp[image, frame, y, x], soft[:, y, x])


def test_modulation(spark):
    rng, lut = np.random.default_rng(0), [0.0, 0.1, 0.3, 0.2, 0.5, 0.9, 0.4, 1.0]
    v = rng.uniform(-0.5, 3.0, (3, 6, 5))
    frames = spark.createDataFrame([("a", 6, 5, 2, 1, lut)], "image string, height int, width int, visible int, invisible int, lut array<double>")
    grid = spark.createDataFrame([("a", y, x, *map(float, v[:, y, x])) for y in range(6) for x in range(5)] + [("z", 0, 0, 0.0, 0.0, 0.0)], "image string, y long, x long, x_ double, y_ double, b_ double")
    n = plain_sharpened(plain_field(6, 5, 2, 1, 256))
    table = [*lut, lut[-1]]

    def brightness(s):
        s = max(0.0, 3 * s)
        k = min(int(s), 7)
        return (table[k + 1] - table[k]) * (s - k) + table[k]

    got = {(r.y, r.x): (r.x_, r.y_, r.b_) for r in N.with_noise(grid, frames, correlation=(0.25, 0.9)).collect()}
    assert len(got) == 30
    for (y, x), found in got.items():
        gx, gy, gb = v[:, y, x]
        p = 0.22 * brightness(gx + gy) * (0.0078125 * n[0, y, x] + 0.9921875 * n[2, y, x])
        q = 0.22 * brightness(gy - gx) * (0.0078125 * n[1, y, x] + 0.9921875 * n[2, y, x])
        assert np.allclose(found, (gx + 0.25 * (p + q) + p - q, gy + p + q, gb + 0.9 * (p + q)))
    assert N.with_noise(grid.where("false"), frames).count() == 0
