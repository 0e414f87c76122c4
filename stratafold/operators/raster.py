"""Raster operators on long pixel tables (img, y, x, v).

Input comes partitioned by image. All windows below partition by the image or a line of it,
so they need sorts but no further exchange. One image is a bounded raster; no operator ever
gathers more than one line, block or image into a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranks import null_safe_join
from ..functions.scalar import add_all, clip, col
from .metrics import safe_corr, safe_div

def row_line():
    return W.partitionBy("img", "y").orderBy("x")


def col_line():
    return W.partitionBy("img", "x").orderBy("y")


def axis_line(axis: str):
    return row_line() if axis == "x" else col_line()


def neighbours(px: DataFrame, c: str, offsets: dict[str, tuple[int, int]], row=None, column=None) -> DataFrame:
    """Adds the value at (y + dy, x + dx) per named offset; NULL outside. Shift along rows, then columns."""
    row, column = row or row_line(), column or col_line()
    dxs = sorted({dx for _, dx in offsets.values()})
    h = {dx: f"_h{i}" for i, dx in enumerate(dxs)}
    out = px.withColumns({h[dx]: F.lead(c, dx).over(row) if dx else F.col(c) for dx in dxs})
    out = out.withColumns({n: F.lead(h[dx], dy).over(column) if dy else F.col(h[dx]) for n, (dy, dx) in offsets.items()})
    return out.drop(*h.values())


# ---------------------------------------------------------------- smoothing
def gaussian_kernel(sigma: float, radius: int) -> list[float]:
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _smooth_line(px: DataFrame, along: str, across: str, kernel: Sequence[float], c: str) -> DataFrame:
    """One axis of a separable filter: a line becomes one small array, filtered in place with a mirrored border."""
    r = len(kernel) // 2
    line = px.groupBy("img", across).agg(F.array_sort(F.collect_list(F.struct(F.col(along).alias("p"), F.col(c).alias("v")))).alias("_l"))
    n = F.size("_l")

    def mirrored(i, k):
        j = i + k
        return F.when(j < 0, -j - 1).when(j >= n, 2 * n - 1 - j).otherwise(j)

    vals = F.transform("_l", lambda s: s["v"])
    line = line.withColumn("_v", vals)
    out = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        i.alias("p"), add_all([F.get("_v", mirrored(i, k - r)) * float(w) for k, w in enumerate(kernel)]).alias("v")))
    return line.select("img", across, F.inline(out)).withColumnsRenamed({"p": along, "v": c})


def smooth(px: DataFrame, kernel: Sequence[float], c: str = "v") -> DataFrame:
    """Separable smoothing (Gaussian, box) with mirrored border."""
    rows = _smooth_line(px, "x", "y", kernel, c)
    return _smooth_line(rows, "y", "x", kernel, c).select("img", "y", "x", c)


# ---------------------------------------------------------------- gradients
def gradient(px: DataFrame, c: str = "v") -> DataFrame:
    """Central differences inside, one-sided at the border."""

    def diff(w):
        a, b = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(a.isNull(), b - F.col(c)).when(b.isNull(), F.col(c) - a).otherwise((b - a) / 2)

    g = px.withColumns({"gx": diff(row_line()), "gy": diff(col_line())})
    return g.withColumn("gm", F.hypot("gx", "gy"))


def structure_tensor(px: DataFrame) -> DataFrame:
    """Coherence, axis angle and eigenvalue ratio of the mean gradient tensor."""
    g = gradient(px).groupBy("img").agg(F.avg(F.col("gx") * F.col("gx")).alias("jxx"), F.avg(F.col("gy") * F.col("gy")).alias("jyy"),
                                        F.avg(F.col("gx") * F.col("gy")).alias("jxy"))
    tr = F.col("jxx") + F.col("jyy")
    disc = F.sqrt(F.pow(F.col("jxx") - F.col("jyy"), 2) + 4 * F.col("jxy") * F.col("jxy"))
    return g.select("img", (disc / (tr + 1e-9)).alias("coh"), ((tr - disc) / 2 / ((tr + disc) / 2 + 1e-9)).alias("ratio"),
                    (0.5 * F.atan2(2 * F.col("jxy"), F.col("jxx") - F.col("jyy"))).alias("angle"))


# ---------------------------------------------------------------- autocorrelation
def first_crossing(profile: Sequence[Column], level: float, start: int, default: float) -> Column:
    """First lag from ``start`` where the profile falls below the level, interpolated with the lag before."""
    out = F.lit(float(default))
    for r in range(len(profile) - 1, start - 1, -1):
        p0, p1 = profile[r - 1], profile[r]
        at = F.when(p0 >= level, (r - 1) + (p0 - level) / F.greatest(p0 - p1, F.lit(1e-9))).otherwise(float(r))
        out = F.when(p1 < level, at).otherwise(out)
    return out


def centred(px: DataFrame, c: str = "v", keys: Sequence[str] = ("img",)) -> DataFrame:
    return px.withColumn("z", F.col(c) - F.avg(c).over(W.partitionBy(*keys)))


def lag_autocorrelation(px: DataFrame, lags: int, level: float) -> DataFrame:
    """Autocorrelation along both axes at lags 1..n (overlap-normalised) and the level crossing length."""
    z = centred(px)
    cols = {}
    for k in range(1, lags + 1):
        cols[f"x{k}"], cols[f"y{k}"] = F.lead("z", k).over(row_line()), F.lead("z", k).over(col_line())
    z = z.withColumns(cols)
    g = z.groupBy("img").agg(F.avg(F.col("z") * F.col("z")).alias("v0"), *[F.avg(F.col("z") * F.col(c)).alias(c) for c in cols])
    prof = {a: [F.lit(1.0)] + [safe_div(f"{a}{k}", "v0") for k in range(1, lags + 1)] for a in "xy"}
    lag1 = (prof["x"][1] + prof["y"][1]) / 2
    return g.select("img", lag1.alias("lag1"), *[prof[a][k].alias(f"ac_{a}{k}") for a in "xy" for k in range(1, lags + 1)],
                    *[first_crossing(prof[a], level, 1, lags).alias(f"len_{a}") for a in "xy"])


def radial_block_autocorrelation(px: DataFrame, valid: Column, blk: Column, reach: int, level: float = 0.5) -> DataFrame:
    """Masked, overlap-normalised radial autocorrelation of each block and its crossing length.

    Every offset of the half plane is a pair of line shifts inside the block; the block is bounded.
    """
    d = px.withColumns({"blk": blk, "w": valid.cast("double")})
    per = W.partitionBy("img", "blk")
    mu = F.sum(F.col("v") * F.col("w")).over(per) / F.greatest(F.sum("w").over(per), F.lit(1.0))
    d = d.withColumn("z", (F.col("v") - mu) * F.col("w"))
    offs = {}
    for dy in range(0, reach + 1):
        for dx in range(-reach, reach + 1):
            r = int(round(math.hypot(dy, dx)))
            if (dy > 0 or dx > 0) and r <= reach:
                offs[(dy, dx)] = r
    row, column = W.partitionBy("img", "blk", "y").orderBy("x"), W.partitionBy("img", "blk", "x").orderBy("y")
    names = {o: i for i, o in enumerate(offs)}
    d = d.withColumn("s", F.struct("z", "w"))
    d = neighbours(d, "s", {f"n{i}": o for o, i in names.items()}, row, column)
    aggs = []
    for o, i in names.items():
        num = F.coalesce(F.sum(F.col("z") * F.col(f"n{i}.z")), F.lit(0.0))
        cnt = F.coalesce(F.sum(F.col("w") * F.col(f"n{i}.w")), F.lit(0.0))
        aggs.append((num / F.greatest(cnt, F.lit(1.0))).alias(f"a{i}"))
    g = d.groupBy("img", "blk").agg((F.sum(F.col("z") * F.col("z")) / F.greatest(F.sum(F.col("w") * F.col("w")), F.lit(1.0))).alias("p0"), *aggs)
    prof = [F.lit(1.0)]
    for r in range(1, reach + 1):
        same = [F.col(f"a{names[o]}") for o in offs if offs[o] == r]
        prof.append(safe_div(add_all(same) / len(same), "p0"))
    return g.select("img", "blk", *[prof[r].alias(f"p{r}") for r in range(1, reach + 1)], first_crossing(prof, level, 2, reach).alias("len"))


# ---------------------------------------------------------------- spectrum
def radial_profile(px: DataFrame, centre: float) -> DataFrame:
    r = F.floor(F.hypot(F.col("y") - centre, F.col("x") - centre)).cast("int")
    return px.groupBy("img", r.alias("r")).agg(F.avg("v").alias("v"))


def power_spectrum(px: DataFrame, size: int, top: int) -> DataFrame:
    """Power at wave numbers -top..top-1 on both axes by two one-axis transforms: (img, ky, kx, p)."""
    ks = F.array(*[F.lit(k) for k in range(-top, top)])
    a = 2 * math.pi / size
    z = centred(px).select("img", "y", "x", "z")
    ax = F.col("kx") * F.col("x") * a
    r = z.withColumn("kx", F.explode(ks)).groupBy("img", "y", "kx").agg(F.sum(F.col("z") * F.cos(ax)).alias("c"), F.sum(-F.col("z") * F.sin(ax)).alias("s"))
    ay = F.col("ky") * F.col("y") * a
    re = F.sum(F.col("c") * F.cos(ay) + F.col("s") * F.sin(ay))
    im = F.sum(F.col("s") * F.cos(ay) - F.col("c") * F.sin(ay))
    return r.withColumn("ky", F.explode(ks)).groupBy("img", "ky", "kx").agg((re * re + im * im).alias("p"))


def spectrum_bands(px: DataFrame, size: int, top: int, edges: Sequence[int]) -> DataFrame:
    """Share of the radial power profile in each band, and its centroid."""
    p = power_spectrum(px, size, top)
    r = F.floor(F.hypot("ky", "kx")).cast("int")
    prof = p.groupBy("img", r.alias("r")).agg(F.avg("p").alias("p")).where((F.col("r") >= 1) & (F.col("r") < top))
    tot = F.sum("p") + 1e-12
    bands = [(F.sum(F.when((F.col("r") >= a) & (F.col("r") < b), F.col("p")).otherwise(0.0)) / tot).alias(f"fft_{a}_{b}") for a, b in zip(edges, edges[1:])]
    return prof.groupBy("img").agg(*bands, (F.sum(F.col("p") * F.col("r")) / tot).alias("fft_centroid"))


# ---------------------------------------------------------------- texture
ANGLES = {"a0": (0, 1), "a45": (-1, 1), "a90": (1, 0), "a135": (1, 1)}


def cooccurrence(px: DataFrame, level: Column) -> DataFrame:
    """Contrast, homogeneity, correlation and energy per image: mean and spread over four angles."""
    q = neighbours(px.withColumn("q", level), "q", ANGLES)
    pairs = q.select("img", "q", F.inline(F.array(*[F.struct(F.lit(a).alias("angle"), F.col(a).alias("o")) for a in ANGLES]))).where("o is not null")
    sym = pairs.select("img", "angle", F.inline(F.array(F.struct(F.col("q").alias("i"), F.col("o").alias("j")), F.struct(F.col("o").alias("i"), F.col("q").alias("j")))))
    n = sym.groupBy("img", "angle", "i", "j").agg(F.count(F.lit(1)).cast("double").alias("n"))
    d2 = F.pow(F.col("i") - F.col("j"), 2)
    tot = F.sum("n")
    mu = F.sum(F.col("n") * F.col("i")) / tot
    var = F.sum(F.col("n") * F.col("i") * F.col("i")) / tot - mu * mu
    cov = F.sum(F.col("n") * F.col("i") * F.col("j")) / tot - mu * mu
    per = n.groupBy("img", "angle").agg(
        (F.sum(F.col("n") * d2) / tot).alias("contrast"), (F.sum(F.col("n") / (1 + d2)) / tot).alias("homogeneity"),
        F.when(var > 1e-12, cov / var).otherwise(1.0).alias("correlation"), F.sqrt(F.sum(F.col("n") * F.col("n")) / (tot * tot)).alias("energy"))
    names = ("contrast", "homogeneity", "correlation", "energy")
    return per.groupBy("img").agg(*[F.avg(c).alias(c) for c in names], *[(F.max(c) - F.min(c)).alias(f"{c}_aniso") for c in names])


RING8 = {f"r{i}": o for i, o in enumerate([(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)])}


def binary_pattern_histogram(px: DataFrame) -> DataFrame:
    """Histogram of the uniform 8-neighbour patterns (0..8 set bits, 9 = not uniform); outside counts as 0."""
    q = neighbours(px, "v", RING8)
    bits = [(F.coalesce(F.col(n), F.lit(0.0)) >= F.col("v")).cast("int") for n in RING8]
    changes = add_all([F.abs(bits[i] - bits[(i + 1) % 8]) for i in range(8)])
    code = F.when(changes <= 2, add_all(bits)).otherwise(9)
    q = q.select("img", code.alias("code"))
    return q.groupBy("img").agg(*[F.avg((F.col("code") == k).cast("double")).alias(f"lbp{k}") for k in range(10)])


# ---------------------------------------------------------------- levels and thresholds
def level_fractions(px: DataFrame, valid: Column, steps: Sequence[float], ref: float = 0.7) -> DataFrame:
    """Fractions below several depths under the image's reference level, deficit, excess and percentiles."""
    q = px.groupBy("img").agg(F.percentile("v", F.array(*[F.lit(p) for p in (ref, 0.05, 0.25, 0.5, 0.75, 0.95)])).alias("_q"))
    d = px.where(valid).join(q, "img").withColumn("_m", F.col("_q")[0])
    below = [F.avg((F.col("v") < F.col("_m") - t).cast("double")).alias(f"px{int(round(t * 100))}") for t in steps]
    g = d.groupBy("img").agg(*below, F.avg(F.greatest(F.lit(0.0), F.col("_m") - F.col("v"))).alias("deficit"),
                             F.avg(F.greatest(F.lit(0.0), F.col("v") - F.col("_m"))).alias("excess"),
                             F.avg(clip((F.col("_m") - F.col("v")) / 0.2, 0.0, 1.0)).alias("soft"), F.any_value("_q").alias("_q"))
    return g.select(*[c for c in g.columns if c != "_q"], *[F.col("_q")[i + 1].alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))])


def histograms(px: DataFrame, bin_: Column, n: int) -> DataFrame:
    """Dense histogram array per image."""
    h = px.groupBy("img", bin_.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = h.groupBy("img").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("_m"))
    return m.select("img", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0))).alias("h"))


def histogram_thresholds(px: DataFrame, bin_: Column, n: int) -> DataFrame:
    """Mode bin, two-class and three-class thresholds (bin index of the last bin of a class) that maximise the
    between-class variance; ties go to the lower bins."""
    h = histograms(px, bin_, n)
    ids = F.sequence(F.lit(0), F.lit(n - 1))
    cum = lambda f: F.transform(ids, lambda i: F.aggregate(F.slice(f, 1, i + 1), F.lit(0.0), lambda s, v: s + v))
    h = h.withColumn("_hm", F.transform("h", lambda v, i: v * i)).withColumn("_w", cum("h")).withColumn("_s", cum("_hm"))

    def part(lo, hi):  # class over bins lo+1..hi: s^2 / w
        w = F.get("_w", hi) - F.when(lo >= 0, F.get("_w", lo)).otherwise(0.0)
        s = F.get("_s", hi) - F.when(lo >= 0, F.get("_s", lo)).otherwise(0.0)
        return F.when(w > 0, s * s / w).otherwise(0.0)

    last = F.lit(n - 1)
    key = lambda v: F.round(v, 9)
    two = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda t: F.struct(
        key(part(F.lit(-1), t) + part(t, last)).alias("v"), (-t).alias("t"))))
    three = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 3)), lambda a: F.array_max(F.transform(
        F.sequence(a + 1, F.lit(n - 2)), lambda b: F.struct(
            key(part(F.lit(-1), a) + part(a, b) + part(b, last)).alias("v"), (-a).alias("a"), (-b).alias("b"))))))
    mode = F.array_position("h", F.array_max("h")).cast("int") - 1
    return h.select("img", mode.alias("mode"), (-two["t"]).alias("otsu"), (-three["a"]).alias("t1"), (-three["b"]).alias("t2"))


# ---------------------------------------------------------------- morphology
def _disk_rows(radius: int) -> dict[int, int]:
    return {dy: math.isqrt(radius * radius - dy * dy) for dy in range(-radius, radius + 1)}


def disk_filter(px: DataFrame, c: str, radius: int, how: str, out: str) -> DataFrame:
    """Dilation ("max") or erosion ("min") with a disk; pixels outside the image are ignored.

    Each row of the disk is a centred window on the raster row; the rows are then combined along the column.
    """
    agg, pick = (F.max, F.greatest) if how == "max" else (F.min, F.least)
    rows = _disk_rows(radius)
    widths = sorted(set(rows.values()))
    d = px.withColumns({f"_w{w}": agg(c).over(row_line().rowsBetween(-w, w)) for w in widths})
    d = d.withColumns({f"_d{i}": F.lead(f"_w{rows[dy]}", dy).over(col_line()) if dy else F.col(f"_w{rows[0]}") for i, dy in enumerate(rows)})
    d = d.withColumn(out, pick(*[F.col(f"_d{i}") for i, _ in enumerate(rows)]))
    return d.drop(*[f"_w{w}" for w in widths], *[f"_d{i}" for i, _ in enumerate(rows)])


def opening(px: DataFrame, c: str, radius: int, out: str) -> DataFrame:
    return disk_filter(disk_filter(px, c, radius, "min", "_e"), "_e", radius, "max", out).drop("_e")


# ---------------------------------------------------------------- runs on raster lines
def runs(px: DataFrame, m: Column, axis: str = "x") -> DataFrame:
    """Runs of equal mask value along each line: (img, line, m, len, open) where open = touches the image edge."""
    line = "y" if axis == "x" else "x"
    w = W.partitionBy("img", line).orderBy(axis)
    d = px.withColumn("m", m)
    d = d.withColumn("_c", F.when(F.col("m") == F.lag("m").over(w), 0).otherwise(1))
    d = d.withColumn("_r", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    both = W.partitionBy("img", line)
    d = d.withColumns({"_a": F.min(axis).over(both), "_b": F.max(axis).over(both)})
    g = d.groupBy("img", F.col(line).alias("line"), "_r").agg(
        F.first("m").alias("m"), F.count(F.lit(1)).alias("len"),
        ((F.min(axis) == F.min("_a")) | (F.max(axis) == F.max("_b"))).alias("open"))
    return g.drop("_r")


def chord_stats(px: DataFrame, m: Column) -> DataFrame:
    """Mean length of closed runs inside and outside the mask along both axes, and their ratio."""
    out = None
    for tag, axis in (("par", "x"), ("perp", "y")):
        r = runs(px, m, axis)
        closed = r.groupBy("img").agg(
            F.avg(F.when(F.col("m") & ~F.col("open"), F.col("len"))).alias(f"chord_{tag}"), F.avg(F.when(~F.col("m") & ~F.col("open"), F.col("len"))).alias(f"gap_{tag}"))
        out = closed if out is None else out.join(closed, "img")
    return out.withColumn("chord_aspect", safe_div("chord_par", "chord_perp"))


def rotated(px: DataFrame, angle: float) -> DataFrame:
    """The raster on lines along any axis: ``y`` becomes the number of the line, ``x`` the place on it.

    Every place of the turned grid takes the nearest pixel (as ``m`` and all other columns). A pixel looks for the places that read
    it among the nine around its own turned position, so no join and no second raster is needed, and lines have no holes.
    """
    c, s = math.cos(angle), math.sin(angle)
    t, line = F.round(F.col("x") * c + F.col("y") * s), F.round(F.col("y") * c - F.col("x") * s)
    near = F.array(*[F.struct((t + i).alias("t"), (line + j).alias("l")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d = px.select("*", F.inline(near))
    x, y = F.floor(F.col("t") * c - F.col("l") * s + 0.5), F.floor(F.col("t") * s + F.col("l") * c + 0.5)
    d = d.where((x == F.col("x")) & (y == F.col("y")))
    return d.drop("x", "y").withColumns({"x": F.col("t").cast("int"), "y": F.col("l").cast("int")}).drop("t", "l")


def chords(px: DataFrame, m: Column, angle: float = 0.0) -> DataFrame:
    """Closed runs of a mask along an axis and across it: mean and median chord, mean gap, chords per 1000 places, and the aspect."""
    out = None
    for tag, at in (("par", angle), ("perp", angle + math.pi / 2)):
        r = rotated(px.select("img", "y", "x", m.alias("m")), at)
        r = runs(r, F.col("m"), "x")
        inside, outside = F.col("m") & ~F.col("open"), ~F.col("m") & ~F.col("open")
        g = r.groupBy("img").agg(
            F.avg(F.when(inside, F.col("len"))).alias(f"chord_{tag}"), F.percentile(F.when(inside, F.col("len")), 0.5).alias(f"chord_{tag}_med"),
            F.avg(F.when(outside, F.col("len"))).alias(f"gap_{tag}"), (F.sum(inside.cast("bigint")) * 1000 / F.sum("len")).alias(f"nchord_{tag}"))
        out = g if out is None else out.join(g, "img")
    return out.withColumn("chord_aspect", safe_div("chord_par", "chord_perp"))


def lineal_path(px: DataFrame, m: Column, lengths: Sequence[int], size: int) -> DataFrame:
    """Share of length-r segments that lie fully inside the mask, per axis."""
    out = None
    for axis in "xy":
        r = runs(px, m, axis).groupBy("img").agg(*[
            (F.sum(F.when(F.col("m"), F.greatest(F.col("len") - k + 1, F.lit(0))).otherwise(0)) / float(size * (size - k + 1))).alias(f"lp_{axis}{k}") for k in lengths])
        out = r if out is None else out.join(r, "img")
    return out


def intercepts(px: DataFrame, m: Column, size: int) -> DataFrame:
    """Mean spacing of boundary entries along four directions."""
    d = neighbours(px.withColumn("m", m), "m", {"l": (0, -1), "u": (-1, 0), "ul": (-1, -1), "ur": (-1, 1)})
    n = lambda c: F.greatest(F.sum((F.col("m") & ~F.col(c)).cast("int")), F.lit(1))
    area, diag = float(size * size), float((size - 1) ** 2) * math.sqrt(2)
    g = d.groupBy("img").agg((area / n("l")).alias("a"), (diag / n("ur")).alias("b"), (area / n("u")).alias("c"), (diag / n("ul")).alias("d"))
    mean, hi, lo = add_all([F.col(c) for c in "abcd"]) / 4, F.greatest(*"abcd"), F.least(*"abcd")
    return g.select("img", mean.alias("L_mean"), hi.alias("L_max"), lo.alias("L_min"), (hi / lo).alias("L_aniso"), (1 / F.sqrt(mean)).alias("L_inv_sqrt"))


def pieces_per_line(px: DataFrame, label: str, axis: str) -> DataFrame:
    """Label pieces on each raster line (changes + 1)."""
    line = "y" if axis == "x" else "x"
    w = W.partitionBy("img", line).orderBy(axis)
    d = px.withColumn("_c", (F.col(label) != F.lag(label).over(w)).cast("int"))
    return d.groupBy("img", F.col(line).alias("line")).agg((F.coalesce(F.sum("_c"), F.lit(0)) + 1).cast("bigint").alias("pieces")).withColumn("axis", F.lit(axis))


def edge_ring_profile(px: DataFrame, label: str, depth: int, size: int) -> DataFrame:
    """Pieces on the k-th line from each side relative to the mean of all lines."""
    lines = pieces_per_line(px, label, "x").unionByName(pieces_per_line(px, label, "y"))
    k = F.least(F.col("line"), size - 1 - F.col("line"))
    return lines.groupBy("img").agg(*[(F.avg(F.when(k == i, F.col("pieces"))) / F.avg("pieces")).alias(f"ring{i}") for i in range(depth)])


# ---------------------------------------------------------------- mask geometry
def euler_density(px: DataFrame, m: Column, size: int) -> DataFrame:
    """Vertices - edges + faces of the union of mask pixels, per unit area."""
    s = px.where(m).select("img", "y", "x")
    y, x = F.col("y"), F.col("x")
    part = lambda kind, cells: [F.struct(F.lit(kind).alias("k"), (2 * y + a).alias("a"), (2 * x + b).alias("b")) for a, b in cells]
    cells = part(1, [(-1, -1), (-1, 1), (1, -1), (1, 1)]) + part(-1, [(-1, 0), (1, 0), (0, -1), (0, 1)]) + part(1, [(0, 0)])
    distinct = s.select("img", F.inline(F.array(*cells))).distinct()
    return distinct.groupBy("img").agg((F.sum("k") / float(size * size)).alias("euler"))


def two_point(px: DataFrame, m: Column, radii: Sequence[int]) -> DataFrame:
    """Normalised two-point correlation of the mask along both axes."""
    d = px.withColumn("m", m.cast("double"))
    cols = {f"{a}{r}": F.lead("m", r).over(axis_line(a)) for a in "xy" for r in radii}
    d = d.withColumns(cols)
    g = d.groupBy("img").agg(F.avg("m").alias("p"), *[F.avg(F.col("m") * F.col(c)).alias(c) for c in cols])
    p = F.col("p")
    return g.select("img", "p", *[((F.col(c) - p * p) / F.greatest(p - p * p, F.lit(1e-6))).alias(f"s2_{c}") for c in cols])


# ---------------------------------------------------------------- coarse fields
def block_mean(px: DataFrame, step: int) -> DataFrame:
    return px.groupBy("img", F.floor(F.col("y") / step).cast("int").alias("cy"), F.floor(F.col("x") / step).cast("int").alias("cx")).agg(F.avg("v").alias("v"))


def local_minus_global(px: DataFrame, step: int) -> DataFrame:
    b = block_mean(px, step)
    return b.withColumn("d", F.col("v") - F.avg("v").over(W.partitionBy("img")))


def background_ratio(px: DataFrame, step: int, reach: int, p: float) -> DataFrame:
    """Pixel over the local background: percentile of the coarse cells around it."""
    b = block_mean(px, step)
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a in range(-reach, reach + 1) for c in range(-reach, reach + 1)])
    near = b.withColumn("o", F.explode(offs)).select("img", (F.col("cy") + F.col("o.a")).alias("cy"), (F.col("cx") + F.col("o.c")).alias("cx"), "v")
    level = near.groupBy("img", "cy", "cx").agg(F.percentile("v", p).alias("bg"))
    d = px.withColumns({"cy": F.floor(F.col("y") / step).cast("int"), "cx": F.floor(F.col("x") / step).cast("int")})
    return d.join(level, ["img", "cy", "cx"]).select("img", "y", "x", "bg", (F.col("v") / F.col("bg")).alias("ratio"))


def location_correlation(cells: DataFrame, value: str, target: str) -> DataFrame:
    """Correlation over images of every cell with a per-image target."""
    return cells.groupBy("cy", "cx").agg(safe_corr(value, target).alias("r"), F.count(F.lit(1)).alias("n"))


def strongest_location(cm: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("cy", "cx", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("cy"), -F.col("cx")))
    return cm.agg(best.alias("b")).select("b.*")


def local_size_spread(lengths: DataFrame, dark: DataFrame) -> DataFrame:
    """Spread of block lengths: CV, max/min, area-weighted ratio, correlation with the block's dark share."""
    j = lengths.join(dark, ["img", "blk"])
    g = F.col("len")
    return j.groupBy("img").agg(
        F.avg(g).alias("gm_mean"), (F.stddev_pop(g) / F.greatest(F.avg(g), F.lit(1e-6))).alias("gm_cv"),
        (F.max(g) / F.greatest(F.min(g), F.lit(0.5))).alias("gm_maxmin"),
        (F.avg(F.pow(g, 4)) / F.greatest(F.pow(F.avg(g * g), 2), F.lit(1e-9))).alias("w_over_n"), F.stddev_pop("dk").alias("dk_sd"),
        F.when((F.stddev_pop(g) > 1e-9) & (F.stddev_pop("dk") > 1e-9), safe_corr(g, F.col("dk"))).otherwise(0.0).alias("corr_size_dk"))


def plane_fit(df: DataFrame, key: str, y: str, x: str, v: str) -> DataFrame:
    """Least-squares plane per entity in closed form, and the residual sd."""
    g = df.groupBy(key).agg(F.var_pop(y).alias("yy"), F.var_pop(x).alias("xx"), F.covar_pop(y, x).alias("xy"), F.covar_pop(y, v).alias("yv"),
                            F.covar_pop(x, v).alias("xv"), F.var_pop(v).alias("vv"))
    det = F.col("yy") * F.col("xx") - F.col("xy") * F.col("xy")
    by = safe_div(F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy"), det)
    bx = safe_div(F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy"), det)
    res = F.sqrt(F.greatest(F.lit(0.0), F.col("vv") - by * F.col("yv") - bx * F.col("xv")))
    return g.select(key, by.alias("slope_y"), bx.alias("slope_x"), res.alias("resid_sd"))


def block_raster_stats(px: DataFrame, cells: int, size: int) -> DataFrame:
    """Level, spread, percentiles, noise and edge strength of each block, then their sd and range per image."""
    from .blocks import grid_index

    lap = F.col("v") - F.col("b")
    d = gradient(px).join(smooth(px, [1 / 3] * 3).withColumnRenamed("v", "b"), ["img", "y", "x"]).withColumn("lap", lap)
    d = d.withColumn("blk", grid_index(size, cells))
    g = d.groupBy("img", "blk").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"),
                                    F.percentile("lap", 0.5).alias("m"), F.collect_list("lap").alias("l"), F.avg("gm").alias("edge"))
    dev = F.array_sort(F.transform("l", lambda v: F.abs(v - F.col("m"))))
    n = F.size("l")
    mid = (F.get(dev, F.floor((n - 1) / 2).cast("int")) + F.get(dev, F.ceil((n - 1) / 2).cast("int"))) / 2
    g = g.select("img", "mean", "std", F.col("q")[0].alias("p5"), F.col("q")[1].alias("p95"), (1.4826 * mid).alias("noise"), "edge")
    names = ("mean", "std", "p5", "p95", "noise", "edge")
    return g.groupBy("img").agg(*[F.stddev_pop(c).alias(f"{c}_sd") for c in names], *[(F.max(c) - F.min(c)).alias(f"{c}_rng") for c in names])


def quality_descriptors(px: DataFrame) -> DataFrame:
    """Dark and bright level over the image's reference level, noise MAD, range of a heavy blur."""
    b = smooth(px, [1 / 3] * 3).withColumnRenamed("v", "b")
    h = smooth(px, [1 / 7] * 7).withColumnRenamed("v", "h")
    d = px.join(b, ["img", "y", "x"]).join(h, ["img", "y", "x"]).withColumn("lap", F.col("v") - F.col("b"))
    p = lambda c, *q: F.percentile(c, F.array(*[F.lit(x) for x in q]))
    s = d.groupBy("img").agg(p("v", 0.05, 0.7, 0.95).alias("v"), p("h", 0.05, 0.95).alias("h"), F.percentile("lap", 0.5).alias("m"))
    mad = d.select("img", "lap").join(s.select("img", "m"), "img").groupBy("img").agg((1.4826 * F.percentile(F.abs(F.col("lap") - F.col("m")), 0.5)).alias("noise"))
    m = F.col("v")[1]
    return s.join(mad, "img").select("img", (F.col("v")[0] / m).alias("dark_ratio"), (F.col("v")[2] / m).alias("bright_ratio"), "noise",
                                     ((F.col("h")[1] - F.col("h")[0]) / m).alias("illum_range"))


def fidelity(a: DataFrame, b: DataFrame, m: Column) -> DataFrame:
    """PSNR, masked PSNR, correlation and contrast ratio of two rasters of the same images."""
    j = a.join(b.withColumnRenamed("v", "w"), ["img", "y", "x"]).withColumn("m", m)
    sq = F.pow(F.col("v") - F.col("w"), 2)
    psnr = lambda e: -10 * F.log10(F.greatest(e, F.lit(1e-12)))
    side = lambda c, f: F.avg(F.when(f, F.col(c)))
    dk, mx = F.col("m"), ~F.col("m")
    return j.groupBy("img").agg(psnr(F.avg(sq)).alias("psnr"), psnr(F.avg(F.when(dk, sq))).alias("psnr_mask"), safe_corr("v", "w").alias("corr"),
                                ((side("w", mx) - side("w", dk)) / F.greatest(side("v", mx) - side("v", dk), F.lit(1e-3))).alias("contrast"))


def consensus_area(px: DataFrame, areas: Sequence[str]) -> DataFrame:
    """Pixelwise median over segmentation variants (a fixed number of columns)."""
    s = F.array_sort(F.array(*[F.col(a) for a in areas]))
    n = len(areas)
    return px.withColumn("a", (s[(n - 1) // 2] + s[n // 2]) / 2)


def phase_contiguity(adj: DataFrame, dark1: Column, dark2: Column) -> DataFrame:
    e = adj.where("l1 <> l2")
    dd, dm = F.sum((dark1 & dark2).cast("int")), F.sum((dark1 != dark2).cast("int"))
    return e.groupBy("img").agg((2 * dd / F.greatest(2 * dd + dm, F.lit(1))).alias("contiguity_dd"), (dd / F.count(F.lit(1))).alias("dd_line_frac"))


def boundary_depth(px: DataFrame, label: str, floor: float, least: int) -> DataFrame:
    """Depth of boundary pixels below the local maximum, and the share of darker pixels near boundaries."""
    d = disk_filter(px.withColumn("line", (F.coalesce(F.col(label) != F.lead(label).over(row_line()), F.lit(False))
                                           | F.coalesce(F.col(label) != F.lead(label).over(col_line()), F.lit(False))).cast("int")), "v", 2, "max", "hi")
    d = disk_filter(d, "line", 1, "max", "near")
    ok = F.col("hi") > floor
    ratio = F.col("v") / F.greatest(F.col("hi"), F.lit(floor))
    bd, nr = ok & (F.col("line") == 1), ok & (F.col("near") == 1)
    g = d.groupBy("img").agg(F.sum(bd.cast("int")).alias("nb"), F.percentile(F.when(bd, ratio), 0.5).alias("med"),
                             F.sum(nr.cast("int")).alias("nn"), F.avg(F.when(nr, (ratio < 0.97).cast("double"))).alias("w"), F.avg("line").alias("bd_line_frac"))
    return g.select("img", F.when(F.col("nb") > least, 1 - F.col("med")).alias("bd_depth"), F.when(F.col("nn") > least, F.col("w")).alias("bd_width"), "bd_line_frac")


def region_texture(px: DataFrame, label: str, dark_below: float) -> DataFrame:
    """Texture of each region of two pixels or more: sd, MAD of the local residual, band energy, level, size and dark flag."""
    b = smooth(px, gaussian_kernel(0.7, 2)).withColumnRenamed("v", "b1")
    c = smooth(px, gaussian_kernel(2.0, 3)).withColumnRenamed("v", "b2")
    box = smooth(px, [1 / 3] * 3).withColumnRenamed("v", "bx")
    d = px.join(b, ["img", "y", "x"]).join(c, ["img", "y", "x"]).join(box, ["img", "y", "x"])
    d = d.withColumns({"lap": F.col("v") - F.col("bx"), "band": F.col("b1") - F.col("b2")})
    r = d.groupBy("img", label).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("lvl"), F.stddev_pop("v").alias("std"),
                                    F.sqrt(F.avg(F.col("band") * F.col("band"))).alias("band"), F.percentile("lap", 0.5).alias("m"), F.collect_list("lap").alias("l"))
    dev = F.array_sort(F.transform("l", lambda v: F.abs(v - F.col("m"))))
    n = F.size("l")
    mad = 1.4826 * (F.get(dev, F.floor((n - 1) / 2).cast("int")) + F.get(dev, F.ceil((n - 1) / 2).cast("int"))) / 2
    return r.where("n >= 2").withColumns({"lap": mad, "dk": F.col("lvl") < dark_below}).drop("l", "m")


def interior_texture(px: DataFrame, label: str, dark_below: float) -> DataFrame:
    """The texture of the regions summarised by phase."""
    r = region_texture(px, label, dark_below)
    out = []
    for name in ("lap", "std", "band"):
        lm = F.log(F.greatest(F.col(name), F.lit(1e-6)))
        for ph, m in (("dk", F.col("dk")), ("mx", ~F.col("dk"))):
            out += [F.percentile(F.when(m, lm), 0.5).alias(f"tx_{name}_{ph}_med"), F.stddev_pop(F.when(m, lm)).alias(f"tx_{name}_{ph}_sd")]
    return r.groupBy("img").agg(*out)


def grouped_rank_correlation(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str, least: int = 3) -> DataFrame:
    """Spearman correlation of two columns inside each group; NULL below ``least`` rows or without spread."""
    from ..functions.ranks import average_ranks

    d = average_ranks(average_ranks(df.select(*keys, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), keys, a, "_ra"), keys, b, "_rb")
    return d.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= least, safe_corr("_ra", "_rb")).alias(name))


def _spread(values: DataFrame, terms: Sequence[str], by: str = "measure") -> DataFrame:
    """Rows (img, measure, dk, value, size and more) as one row per image: interquartile range, rank correlation with each term."""
    keys = ["img", by, "dk"]
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    g = values.groupBy(*keys).agg(F.percentile("value", 0.5).alias("med"), F.stddev_pop("value").alias("sd"), (q[1] - q[0]).alias("iqr"))
    for t in terms:
        g = null_safe_join(g, grouped_rank_correlation(values, keys, "value", t, f"rho_{t}"), keys, "left")
    return g


def texture_spread(px: DataFrame, label: str, dark_below: float) -> DataFrame:
    """Per image: spread of the regions' log textures inside each phase, their rank correlation with size and level, and the gap of
    the phases' medians."""
    names = ("lap", "std", "band")
    r = region_texture(px, label, dark_below)
    long = r.select("img", "dk", F.col("n").cast("double").alias("size"), F.round("lvl", 9).alias("lvl"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.round(F.log(F.greatest(F.col(c), F.lit(1e-6))), 9).alias("value")) for c in names])))
    g = _spread(long, ("size", "lvl"))
    pick = lambda c, n, dk: F.max(F.when((F.col("measure") == n) & (F.col("dk") == dk), F.col(c)))
    out = [pick(c, n, dk).alias(f"tx_{n}_{'dk' if dk else 'mx'}_{c}") for n in names for dk in (True, False) for c in ("iqr", "rho_size", "rho_lvl")]
    return g.groupBy("img").agg(*out, *[(pick("med", n, True) - pick("med", n, False)).alias(f"tx_{n}_dkmx") for n in names])


def border_bands(px: DataFrame, label: str, widest: int = 2) -> DataFrame:
    """Adds ``band``: 0 on pixels beside another label, then the steps of a disk away from those, up to ``widest``."""
    other = [F.coalesce(F.col(label) != f(label).over(w), F.lit(False)) for w in (row_line(), col_line()) for f in (F.lead, F.lag)]
    d = px.withColumn("_b0", (other[0] | other[1] | other[2] | other[3]).cast("int"))
    for k in range(1, widest):
        d = disk_filter(d, "_b0", k, "max", f"_b{k}")
    band = F.lit(widest)
    for k in reversed(range(widest)):
        band = F.when(F.col(f"_b{k}") == 1, k).otherwise(band)
    return d.withColumn("band", band).drop(*[f"_b{k}" for k in range(widest)])


def boundary_contrast(px: DataFrame, label: str, dark_below: float) -> DataFrame:
    """Per image: how far the border band of a region lies below its inside (median, sd, interquartile range, rank correlation with
    size, by phase), and the step across the borders between two labels (mean over a border, median and range over borders)."""
    from .joins import adjacency

    d = px.join(smooth(px, gaussian_kernel(1.0, 2)).withColumnRenamed("v", "g1"), ["img", "y", "x"])
    d = border_bands(d, label)
    r = d.groupBy("img", label).agg(F.avg("v").alias("lvl"), F.count(F.lit(1)).cast("double").alias("size"), F.avg(F.when(F.col("band") == 0, F.col("g1"))).alias("edge"),
                                    F.percentile(F.when(F.col("band") > 0, F.col("g1")), 0.5).alias("inside"))
    r = r.select("img", (F.col("lvl") < dark_below).alias("dk"), "size", F.lit("bc").alias("measure"), F.round(F.col("inside") - F.col("edge"), 9).alias("value")).where("value is not null")
    g = _spread(r, ("size",))
    pick = lambda c, dk: F.max(F.when(F.col("dk") == dk, F.col(c)))
    own = g.groupBy("img").agg(*[pick(c, dk).alias(f"bc_{'dk' if dk else 'mx'}_{c}") for dk in (True, False) for c in ("med", "sd", "iqr", "rho_size")])
    pair = adjacency(px.withColumn("_s", F.struct(label, "v")), "_s").where(F.col(f"l1.{label}") != F.col(f"l2.{label}"))
    ends = [F.least(F.col(f"l1.{label}"), F.col(f"l2.{label}")).alias("a"), F.greatest(F.col(f"l1.{label}"), F.col(f"l2.{label}")).alias("b")]
    step = pair.select("img", *ends, F.abs(F.col("l1.v") - F.col("l2.v")).alias("s")).groupBy("img", "a", "b").agg(F.avg("s").alias("s"))
    q = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    step = step.groupBy("img").agg(F.count(F.lit(1)).alias("n_borders"), q[1].alias("step_med"), (q[2] - q[0]).alias("step_iqr"))
    return px.select("img").distinct().join(own, "img", "left").join(step, "img", "left")
