"""Plain models to check the distributed results against; small inputs only."""

from __future__ import annotations

import math


def normalized(values):
    n, total, squares = len(values), sum(values), sum(v * v for v in values)
    deviation = math.sqrt((n * squares - total * total) / (n * n))
    if deviation < 1:
        return [128] * n
    return [max(0, min(255, round(128 + (v - total / n) * 42 / deviation))) for v in values]


def hashes(lum, side):
    step, bits = side // 8, {"h": 0, "v": 0, "a": 0}
    cells = [lum[(i // 8) * step * side + (i % 8) * step] for i in range(64)]
    for i in range(64):
        y, x = (i // 8) * step, (i % 8) * step
        bits["h"] |= (cells[i] >= lum[y * side + min(side - 1, x + step)]) << i
        bits["v"] |= (cells[i] >= lum[min(side - 1, y + step) * side + x]) << i
        bits["a"] |= (cells[i] * 64 >= sum(cells)) << i
    return bits["h"], bits["v"], bits["a"]


def sampled(pixels, width, height, channels):
    """Luminance of the whole and of the centre, and the color histogram."""
    def window(left, top, w, h):
        for i in range(256):
            x = min(width - 1, left + (2 * (i % 16) + 1) * w // 32)
            y = min(height - 1, top + (2 * (i // 16) + 1) * h // 32)
            at = (y * width + x) * channels
            yield pixels[at], pixels[at + 1], pixels[at + 2]

    grey = lambda b, g, r: (54 * r + 183 * g + 19 * b) >> 8
    whole = list(window(0, 0, width, height))
    ix, iy = max(1, width // 16), max(1, height // 16)
    center = list(window(ix, iy, max(1, width - 2 * ix), max(1, height - 2 * iy)))
    histogram = [0] * 12
    for b, g, r in whole:
        for at, level in ((0, r), (4, g), (8, b)):
            histogram[at + level // 64] += 1
    return [grey(*s) for s in whole], [grey(*s) for s in center], histogram


def unsigned(value):
    return value & (2**64 - 1)


def segments(row):
    return [(unsigned(row[name]) >> shift) & 0xFFFF for name in ("difference_h", "difference_v", "average") for shift in (0, 16, 32, 48)]


def segment_candidates(rows, bucket_size=64, best=64):
    """Pairs found by going through the images one by one."""
    stored, pairs = {}, set()
    parts = [segments(row) for row in rows]
    classes = [round(math.log2(row["aspect"]) * 8) for row in rows]
    for now, mine in enumerate(parts):
        seen = {p for delta in (-1, 0, 1) for n, v in enumerate(mine) for p in stored.get((classes[now] + delta, n, v), [])}
        ranked = sorted(seen, key=lambda p: (-sum(a == b for a, b in zip(parts[p], mine)), p))
        pairs |= {(p, now) for p in ranked[:best]}
        for n, v in enumerate(mine):
            bucket = stored.setdefault((classes[now], n, v), [])
            bucket.append(now)
            del bucket[:-bucket_size]
    return pairs


def identical_candidates(rows):
    first, pairs = {}, set()
    for now, row in enumerate(rows):
        key = (row["difference_h"], row["difference_v"], row["average"])
        if first.setdefault(key, now) != now:
            pairs.add((first[key], now))
    return pairs


def greedy_groups(count, edges, compatible):
    """Anchors by degree, then position; each takes the free neighbours that fit everything taken."""
    around = {n: set() for n in range(count)}
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    free, groups = set(range(count)), {}
    for anchor in sorted(range(count), key=lambda n: (-len(around[n]), n)):
        if anchor not in free:
            continue
        members = [anchor]
        for other in sorted(around[anchor] & free):
            if all(compatible(member, other) for member in members):
                members.append(other)
        if len(members) > 1:
            free -= set(members)
            groups[anchor] = members
    return groups
