"""Plane geometry on columns: boxes, homographies, polygons, run-length masks, decoded maps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def project(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The point under a 3 x 3 matrix (array of three rows, one per frame); null where it isn't finite or goes to infinity."""
    row = lambda i: matrix[i][0] * x + matrix[i][1] * y + matrix[i][2]
    w = F.when(F.abs(row(2)) > 1e-9, row(2))
    clean = lambda v: F.when(~F.isnan(v) & (F.abs(v) < F.lit(math.inf)), v)
    return clean(row(0) / w), clean(row(1) / w)


def inverse(matrix: Column) -> Column:
    """The inverse of a 3 x 3 matrix by cofactors; null where the determinant is under 1e-15 of the largest entry cubed."""
    m = [[matrix[i][j] for j in range(3)] for i in range(3)]

    def cofactor(i: int, j: int) -> Column:
        (a, b), (c, d) = ([m[p][q] for q in range(3) if q != j] for p in range(3) if p != i)
        minor = a * d - b * c
        return minor if (i + j) % 2 == 0 else -minor

    det = m[0][0] * cofactor(0, 0) + m[0][1] * cofactor(0, 1) + m[0][2] * cofactor(0, 2)
    scale = F.greatest(*[F.abs(x) for row in m for x in row])
    usable = (scale > 0) & (F.abs(det) >= 1e-15 * scale * scale * scale)
    return F.when(usable, F.array(*[F.array(*[cofactor(j, i) / det for j in range(3)]) for i in range(3)]))


def letterbox(width: Column, height: Column, out_width: int, out_height: int) -> dict[str, Column]:
    """Scales and offsets that fit an image into a frame, keeping its shape: content size rounded half to even and centred."""
    scale = F.least(F.lit(out_width) / width, F.lit(out_height) / height)
    content = lambda size, most: F.greatest(F.lit(1), F.least(F.lit(most), F.bround(size * scale, 0).cast("int")))
    w, h = content(width, out_width), content(height, out_height)
    return {
        "scale_x": w / width, "scale_y": h / height,
        "left": F.floor((F.lit(out_width) - w) / 2).cast("int"), "top": F.floor((F.lit(out_height) - h) / 2).cast("int"),
    }


def place(box: list[Column], fit: dict[str, Column]) -> list[Column]:
    """A source box in the fitted image."""
    return [v * fit["scale_x" if i % 2 == 0 else "scale_y"] + fit["left" if i % 2 == 0 else "top"] for i, v in enumerate(box)]


def unplace(box: list[Column], fit: dict[str, Column]) -> list[Column]:
    """A box of the fitted image in the source."""
    return [(v - fit["left" if i % 2 == 0 else "top"]) / fit["scale_x" if i % 2 == 0 else "scale_y"] for i, v in enumerate(box)]


def torso(box: Column, keypoints: Column, valid: Column) -> Column:
    """The torso as four rounded pixels: inside shoulders (5, 6) and hips (11, 12) where all four are valid, else a part of the box."""
    corners = [keypoints[i] for i in (5, 6, 11, 12)]
    xs, ys = ([c[k] for c in corners] for k in (0, 1))
    inside = lambda l, t, r, b, cut: F.array(*[F.bround(v, 0).cast("int") for v in (l + cut[0] * (r - l), t + cut[1] * (b - t), r - cut[2] * (r - l), cut[3](t, b))])
    posed = inside(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys), (0.10, 0.12, 0.10, lambda t, b: b - 0.08 * (b - t)))
    boxed = inside(box[0], box[1], box[2], box[3], (0.22, 0.20, 0.22, lambda t, b: t + 0.56 * (b - t)))
    usable = F.coalesce((F.size(valid) >= 13) & valid[5] & valid[6] & valid[11] & valid[12], F.lit(False))
    return F.when(usable, posed).otherwise(boxed)


def foot_distance(a: list[Column], b: list[Column]) -> Column:
    """Between the feet (middle of the lower edge) of two boxes, in heights of the taller; null where a box has no height."""
    heights = [box[3] - box[1] for box in (a, b)]
    d = distance((a[0] + a[2]) / 2, a[3], (b[0] + b[2]) / 2, b[3])
    return F.when((heights[0] > 0) & (heights[1] > 0), d / F.greatest(*heights))


def polygon_area(points: Column) -> Column:
    """Area inside a closed polygon, an array of (x, y) arrays in order."""
    ring = F.sequence(F.lit(0), F.size(points) - 1)
    at = lambda i: F.element_at(points, (F.pmod(i, F.size(points)) + 1).cast("int"))
    cross = lambda i: at(i)[0] * at(i + 1)[1] - at(i + 1)[0] * at(i)[1]
    return F.when(F.size(points) >= 3, F.abs(F.aggregate(ring, F.lit(0.0), lambda s, i: s + cross(i))) / 2)


def polygon_distance(points: Column, x: Column, y: Column) -> Column:
    """Distance to the edge of a polygon, positive inside, negative outside."""
    ring = F.sequence(F.lit(0), F.size(points) - 1)
    at = lambda i: F.element_at(points, (F.pmod(i, F.size(points)) + 1).cast("int"))

    def to_edge(i: Column) -> Column:
        (ax, ay), (bx, by) = ((at(k)[0], at(k)[1]) for k in (i, i + 1))
        length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length))).otherwise(0.0)
        return distance(x, y, ax + t * (bx - ax), ay + t * (by - ay))

    def crosses(i: Column) -> Column:
        (ax, ay), (bx, by) = ((at(k)[0], at(k)[1]) for k in (i, i + 1))
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax)

    inside = F.size(F.filter(ring, crosses)) % 2 == 1
    near = F.array_min(F.transform(ring, to_edge))
    return F.when(inside, near).otherwise(-near)


def convex_hull(points: Column) -> Column:
    """The corners of the convex hull of an array of (x, y) arrays, counterclockwise from the leftmost; points on an edge are no corners.

    A chain is a fold over points from left to right: of the corners so far those stay
    that turn left towards the new point. On a convex chain these are its beginning, so
    how many there are says where it is cut.
    """
    ordered = F.array_sort(F.array_distinct(F.filter(points, lambda p: p[0].isNotNull() & p[1].isNotNull())))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def extended(chain: Column, p: Column) -> Column:
        left = F.size(F.filter(F.sequence(F.lit(2), F.size(chain)), lambda j: turn(F.element_at(chain, j - 1), F.element_at(chain, j), p) > 0))
        return F.concat(F.when(F.size(chain) < 2, chain).otherwise(F.slice(chain, F.lit(1), left + 1)), F.array(p))

    def chain(ps: Column) -> Column:
        whole = F.aggregate(ps, F.array().cast("array<array<double>>"), extended)
        return F.slice(whole, F.lit(1), F.size(whole) - 1)  # the last corner is the other chain's first

    return F.when(F.size(ordered) < 3, ordered).otherwise(F.concat(chain(ordered), chain(F.reverse(ordered))))


def mask_valid(encoding: Column, roi: Column, counts: Column, width: Column, height: Column) -> Column:
    """Whether runs fill a region inside the image: alternating lengths from background on, none negative."""
    area = (roi[2] - roi[0]) * (roi[3] - roi[1])
    region = (F.size(roi) == 4) & (roi[0] >= 0) & (roi[0] < roi[2]) & (roi[2] <= width) & (roi[1] >= 0) & (roi[1] < roi[3]) & (roi[3] <= height)
    runs = (F.size(counts) > 0) & F.forall(counts, lambda c: c >= 0) & (F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c) == area)
    return F.coalesce((encoding == "roi_rle_c") & region & runs, F.lit(False))


def mask_area(counts: Column) -> Column:
    """Pixels of the object: every second run."""
    return F.aggregate(F.transform(counts, lambda c, i: F.when(i % 2 == 1, c).otherwise(0)), F.lit(0).cast("long"), lambda s, c: s + c)


def mask_runs(roi: Column, counts: Column) -> Column:
    """The object's pixels as (row, first column, end column) of the image, one struct for each stretch of a row."""
    wide = (roi[2] - roi[0]).cast("long")
    ends = F.transform(F.sequence(F.lit(1), F.size(counts)), lambda n: F.aggregate(F.slice(counts, F.lit(1), n), F.lit(0).cast("long"), lambda s, c: s + c))
    spans = F.filter(F.transform(ends, lambda e, i: F.struct((e - counts[i]).alias("a"), e.alias("z"), i.alias("i"))), lambda s: (s["i"] % 2 == 1) & (s["z"] > s["a"]))

    def rows(s: Column) -> Column:
        first, last = F.floor(s["a"] / wide), F.floor((s["z"] - 1) / wide)
        start = lambda r: F.greatest(s["a"], r * wide) - r * wide
        end = lambda r: F.least(s["z"], (r + 1) * wide) - r * wide
        return F.transform(F.sequence(first, last), lambda r: F.struct((r + roi[1]).alias("row"), (start(r) + roi[0]).alias("first"), (end(r) + roi[0]).alias("end")))

    return F.flatten(F.transform(spans, rows))


def _once(value: Column, then) -> Column:
    """``then(value)``, where ``value`` is used within lambdas: as a variable it is computed once a row, not once for each element."""
    return F.transform(F.array(value), then)[0]


def mask_encode(roi: Column, spans: Column) -> Column:
    """Runs of a region from stretches (row, first, end) of its object in any order, none overlapping: background and object in turn, row by row; what ``mask_runs`` reads."""
    wide = (roi[2] - roi[0]).cast("long")
    area = wide * (roi[3] - roi[1])
    place = lambda s, c: (s["row"] - roi[1]) * wide + s[c] - roi[0]
    sorted_pieces = F.array_sort(F.transform(F.filter(spans, lambda s: s["end"] > s["first"]), lambda s: F.struct(place(s, "first").cast("long").alias("a"), place(s, "end").cast("long").alias("z"))))

    def joined(pieces: Column) -> Column:
        starts = F.filter(pieces, lambda s, i: (i == 0) | (F.get(pieces, i - 1)["z"] != s["a"]))
        ends = F.filter(pieces, lambda s, i: (i == F.size(pieces) - 1) | (F.get(pieces, i + 1)["a"] != s["z"]))
        return F.transform(F.arrays_zip(F.transform(starts, lambda s: s["a"]).alias("a"), F.transform(ends, lambda s: s["z"]).alias("z")), lambda s: F.struct(s["a"].alias("a"), s["z"].alias("z")))

    def counted(runs: Column) -> Column:
        alternating = F.flatten(F.transform(runs, lambda s, i: F.array(s["a"] - F.when(i > 0, F.get(runs, i - 1)["z"]).otherwise(0), s["z"] - s["a"])))
        return F.concat(alternating, F.array(area - F.coalesce(F.element_at(runs, F.when(F.size(runs) > 0, -1))["z"], F.lit(0))))

    return _once(_once(sorted_pieces, joined), counted)


def mask_crop(roi: Column, counts: Column, inner: Column) -> Column:
    """The runs of a mask within another region of the image: what lies outside goes, what the mask doesn't cover is background."""
    cut = F.transform(mask_runs(roi, counts), lambda s: F.struct(s["row"].alias("row"), F.greatest(s["first"], inner[0]).alias("first"), F.least(s["end"], inner[2]).alias("end")))
    return mask_encode(inner, F.filter(cut, lambda s: (s["row"] >= inner[1]) & (s["row"] < inner[3]) & (s["end"] > s["first"])))


def simcc(xs: Column, ys: Column, split: float = 2.0) -> tuple[Column, Column, Column]:
    """A keypoint from its two marginal scores: the first largest bins over ``split``, and the mean of both peaks; -1 / split each where that isn't above 0."""
    score = (F.array_max(xs) + F.array_max(ys)) / 2
    at = lambda v: F.when(score > 0, F.array_position(v, F.array_max(v)) - 1).otherwise(-1) / F.lit(split)
    return at(xs), at(ys), score


def uncrop(x: Column, y: Column, box: Column, width: int = 192, height: int = 256, margin: float = 1.25) -> tuple[Column, Column]:
    """A point of a person's crop in the source: the crop is the box grown by ``margin`` and to the crop's shape, around the same centre."""
    shape = width / height
    w, h = (box[2] - box[0]) * margin, (box[3] - box[1]) * margin
    wide, high = F.greatest(w, h * shape), F.greatest(h, w / shape)
    return x / width * wide + (box[0] + box[2]) / 2 - wide / 2, y / height * high + (box[1] + box[3]) / 2 - high / 2


def target_map(x: Column, y: Column, width: int, height: int, radius: int, variance: float) -> Column:
    """A target of 0 and 255, row by row: set within ``radius`` of the rounded, clipped point where the Gaussian times 255 reaches 1; zeros without a point."""
    cx, cy = (F.greatest(F.lit(0), F.least(F.lit(n - 1), F.bround(v, 0).cast("int"))) for v, n in ((x, width), (y, height)))
    reach = 2 * variance * math.log(255)

    def value(i: Column) -> Column:
        dx, dy = i % width - cx, F.floor(i / width) - cy
        near = (F.abs(dx) <= radius) & (F.abs(dy) <= radius) & (dx * dx + dy * dy <= reach)
        return F.coalesce(F.when(near, 255), F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), value)


def digits_of(symbols: Column, probabilities: Column, end: str = "") -> Column:
    """A number read symbol by symbol: struct ``text``, ``number`` (null unless the end mark comes and one or two digits before it) and ``confidence``, the product up to and with the end mark."""
    at = F.array_position(symbols, end).cast("int")
    text = F.array_join(F.slice(symbols, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(symbols))), "")
    sure = F.aggregate(F.slice(probabilities, F.lit(1), F.when(at > 0, at).otherwise(F.size(symbols))), F.lit(1.0), lambda s, p: s * p)
    return F.struct(text.alias("text"), F.when((at > 0) & text.rlike(r"^[0-9]{1,2}\z"), text).alias("number"), sure.alias("confidence"))
