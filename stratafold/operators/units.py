"""Statistics of region tables (one row per region of an entity)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import quantile_terms, quantiles, running_sums, value_ranks
from ..functions.scalar import col, digitize
from .joins import grid_field, radius_pair_sums
from .metrics import safe_div, wmean, wsd
from .ranking import top_per_group


def region_areas(px: DataFrame, label: str = "lab") -> DataFrame:
    return px.groupBy("img", label).agg(F.count(F.lit(1)).alias("area"), F.avg("v").alias("grey"))


def neighbour_means(px: DataFrame, adj: DataFrame, dark_below: float) -> DataFrame:
    """Per region: number of touching regions, their mean log area and dark share."""
    reg = region_areas(px)
    e = adj.where("l1 <> l2").select("img", F.explode(F.array(F.struct(F.col("l1").alias("a"), F.col("l2").alias("b")),
                                                             F.struct(F.col("l2").alias("a"), F.col("l1").alias("b")))).alias("e"))
    e = e.select("img", "e.a", "e.b").distinct()
    nb = e.join(reg.select("img", F.col("lab").alias("b"), "area", "grey"), ["img", "b"])
    nb = nb.groupBy("img", F.col("a").alias("lab")).agg(
        F.count(F.lit(1)).alias("nb_n"), F.avg(F.log("area")).alias("nb_la"),
        F.avg((F.col("grey") < dark_below).cast("double")).alias("nb_dk"))
    return reg.select("img", "lab").join(nb, ["img", "lab"], "left").fillna({"nb_n": 0})


# ---------------------------------------------------------------- region tables
def region_table(px: DataFrame, label: str = "lab", size: int = 8) -> DataFrame:
    """Region table of a label map: area, centroid, mean, bounding box and border flag."""
    g = px.groupBy("img", label).agg(
        F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.avg("v").alias("mean"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    edge = (F.col("y0") == 0) | (F.col("x0") == 0) | (F.col("y1") == size - 1) | (F.col("x1") == size - 1)
    return g.withColumn("border", edge)


def region_moments(px: DataFrame, label: str = "lab") -> DataFrame:
    """Axes, aspect and orientation of each region from the covariance of its pixel coordinates."""
    g = px.groupBy("img", label).agg(
        F.count(F.lit(1)).alias("area"), F.var_pop("y").alias("cyy"), F.var_pop("x").alias("cxx"), F.covar_pop("y", "x").alias("cxy"))
    half = (F.col("cyy") + F.col("cxx")) / 2
    disc = F.sqrt(F.greatest(F.lit(0.0), half * half - (F.col("cyy") * F.col("cxx") - F.col("cxy") * F.col("cxy"))))
    major = 4 * F.sqrt(half + disc)
    minor = 4 * F.sqrt(F.greatest(F.lit(0.0), half - disc))
    return g.select("img", label, "area", major.alias("maj"), minor.alias("min"),
                    (major / F.greatest(minor, F.lit(1.0))).alias("asp"),
                    (0.5 * F.atan2(2 * F.col("cxy"), F.col("cyy") - F.col("cxx"))).alias("ori"))


def order_parameter(theta, w) -> Column:
    """|sum w exp(2 i theta)| / sum w as one aggregate."""
    t, w = col(theta), col(w)
    c, s = F.sum(w * F.cos(2 * t)), F.sum(w * F.sin(2 * t))
    return safe_div(F.sqrt(c * c + s * s), F.sum(w))


def shape_stats(df: DataFrame, entity: str = "img") -> DataFrame:
    eqd = F.sqrt(4 * F.col("area") / F.pi())
    g = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), F.avg("area").alias("area_mean"), (F.stddev_pop("area") / F.avg("area")).alias("area_cv"),
        F.avg(eqd).alias("eqd_mean"), wmean(eqd, "area").alias("eqd_wmean"), F.avg("asp").alias("asp_mean"),
        wmean("asp", "area").alias("asp_wmean"), order_parameter("theta", "area").alias("ori_R"),
        F.coalesce(order_parameter("theta", F.col("area") * (F.col("asp") - 1)), F.lit(0.0)).alias("ori_Rel"))
    g = g.withColumn("elong_align", F.col("ori_R") * (F.col("asp_wmean") - 1))
    both = df.select(entity, F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in ("area", "asp")])))
    med = quantiles(both, [entity, "c"], "v", {"m": 0.5}).groupBy(entity).agg(*[F.max(F.when(F.col("c") == c, F.col("m"))).alias(f"{c}_med") for c in ("area", "asp")])
    return g.join(med, entity)


def alignment(df: DataFrame, dark: Column, entity: str = "img") -> DataFrame:
    """Order parameter with number, area and elongation weights, for all units and each phase."""
    el = 1 - 1 / F.col("asp")
    out = []
    for ph, m in (("all", F.lit(True)), ("dk", dark), ("mx", ~dark)):
        i = m.cast("double")
        enough = F.sum(i) >= 3
        out += [F.when(enough, order_parameter("theta", i)).alias(f"S_n_{ph}"),
                F.when(enough, order_parameter("theta", i * F.col("area"))).alias(f"S_a_{ph}"),
                F.when(enough, F.coalesce(order_parameter("theta", i * el), F.lit(0.0))).alias(f"S_e_{ph}")]
    return df.groupBy(entity).agg(*out)


def size_phase_fractions(df: DataFrame, dark: Column, log_edges: Sequence[float], entity: str = "img") -> DataFrame:
    """Area and number shares of each size bin x phase."""
    b = digitize(F.log("area"), log_edges)
    out = []
    for ph, m in (("dk", dark), ("mx", ~dark)):
        for k in range(len(log_edges) + 1):
            hit = m & (b == k)
            out += [(F.sum(F.when(hit, F.col("area")).otherwise(0.0)) / F.sum("area")).alias(f"a_{ph}_{k}"),
                    F.avg(hit.cast("double")).alias(f"n_{ph}_{k}")]
    return df.groupBy(entity).agg(*out)


def power_moments(df: DataFrame, dark: Column, centre: float, top: int = 3, entity: str = "img") -> DataFrame:
    z = F.log("area") - centre
    out = []
    for ph, m in (("dk", dark), ("mx", ~dark)):
        for p in range(top + 1):
            out.append((F.sum(F.when(m, F.col("area") * F.pow(z, F.lit(float(p)))).otherwise(0.0)) / F.sum("area")).alias(f"s_{ph}_{p}"))
    return df.groupBy(entity).agg(*out)


def effective_numbers(df: DataFrame, dark: Column, entity: str = "img") -> DataFrame:
    def neff(m):
        a = F.when(m, F.col("area")).otherwise(0.0)
        return F.when(F.sum(m.cast("int")) >= 2, F.sum(a) * F.sum(a) / F.sum(a * a)).otherwise(0.0)

    all_ = F.sum("area") * F.sum("area") / F.sum(F.col("area") * F.col("area"))
    return df.groupBy(entity).agg(all_.alias("neff"), F.log(all_ / F.count(F.lit(1))).alias("log_neff_over_n"),
                                  neff(dark).alias("neff_dk"), neff(~dark).alias("neff_mx"))


def interior_or_all(df: DataFrame, least: int = 5, entity: str = "img") -> DataFrame:
    """Interior units, or all units of entities with fewer than ``least`` interior ones."""
    n = df.groupBy(entity).agg(F.sum((~F.col("border")).cast("int")).alias("_ni"))
    return df.join(n, entity).where(~F.col("border") | (F.col("_ni") < least)).drop("_ni")


def jeffries(border="border") -> Column:
    """Interior units plus half of the border units."""
    return F.sum(F.when(col(border), 0.5).otherwise(1.0))


def size_estimators(df: DataFrame, entity: str = "img") -> DataFrame:
    """Several estimators of the unit size, all as 0.5 x log area; every cut comes from one ranking."""
    half = lambda c: 0.5 * F.log(c)
    whole = df.groupBy(entity).agg(
        half(F.sum("area") / jeffries()).alias("cnt_jeff"), half(F.sum("area") / F.count(F.lit(1))).alias("cnt_raw"),
        half(F.sum(F.col("area") * F.col("area")) / F.sum("area")).alias("area_w"))
    inner = interior_or_all(df, entity=entity).withColumn("la", F.log("area"))
    of_log, log_q = quantile_terms(F.log("area"), {"q10": 0.1, "q20": 0.2, "q50": 0.5, "q80": 0.8, "q90": 0.9})
    of_area, area_q = quantile_terms(F.col("area"), {"a10": 0.1, "a90": 0.9})
    cuts = value_ranks(inner, [entity], "area").groupBy(entity).agg(*of_log, *of_area).select(entity, *log_q, *area_q)
    la, a = F.col("la"), F.col("area")
    trimmed = inner.join(cuts, entity).groupBy(entity).agg(
        (0.5 * F.max("q50")).alias("med"),
        (0.5 * F.avg(F.when((la >= F.col("q10")) & (la <= F.col("q90")), la))).alias("trim10"),
        (0.5 * F.avg(F.when((la >= F.col("q20")) & (la <= F.col("q80")), la))).alias("trim20"),
        half(F.avg(F.when((a >= F.col("a10")) & (a <= F.col("a90")), a))).alias("trimA10"),
        half(F.avg("area")).alias("num_mean"))
    return whole.join(trimmed, entity)


def density_without_largest(df: DataFrame, share: float, order: Sequence, entity: str = "img") -> DataFrame:
    """Size from counts after dropping the largest units that hold the top ``share`` of the area (at least one)."""
    r = running_sums(df, [entity], [-F.col("area"), *order], {"_a": F.col("area"), "_i": F.lit(1).cast("bigint")})
    first = F.col("_i_before") == 0
    drop = first | ((F.col("_a_before") + F.col("area")) / F.col("_a_total") <= share)
    kept = r.where(~drop)
    g = kept.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), (0.5 * F.log(F.sum("area") / jeffries())).alias("cnt_ex"))
    return df.select(entity).distinct().join(g.where("n >= 5").drop("n"), entity, "left")


def width_stats(df: DataFrame, entity: str = "img") -> DataFrame:
    """Spread of the size distribution: log sd / IQR / skew, CV, Gini, share of the top 10 %, shares above the median."""
    inner = interior_or_all(df, entity=entity).withColumn("la", F.log("area"))
    base = inner.groupBy(entity).agg(
        F.stddev_pop("la").alias("sd"), F.skewness("la").alias("skew"), (F.stddev_pop("area") / F.avg("area")).alias("cv"))
    v = value_ranks(inner, [entity], "area")
    a, n, nb, nt = F.col("area"), F.col("n"), F.col("n_before"), F.col("n_total")
    n10 = F.greatest(F.lit(1), F.rint(0.1 * nt)).cast("bigint")
    top = F.least(n, F.greatest(F.lit(0), nb + n - (nt - n10)))
    of_log, log_q = quantile_terms(F.log("area"), {"q25": 0.25, "q75": 0.75})
    of_area, area_q = quantile_terms(a, {"med_a": 0.5})
    ranked = v.groupBy(entity).agg(
        (F.sum(a * n * (2 * nb + n - nt)) / (F.max(nt) * F.sum(a * n))).alias("gini"), (F.sum(a * top) / F.sum(a * n)).alias("top10_share"), *of_log, *of_area)
    ranked = ranked.select(entity, "gini", "top10_share", *log_q, *area_q).withColumn("iqr", F.col("q75") - F.col("q25"))
    med = ranked.select(entity, "med_a")
    big = df.join(med, entity).groupBy(entity).agg(
        wsd(F.log("area"), "area").alias("sd_aw"),
        (F.sum(F.when(a > 2 * F.col("med_a"), a).otherwise(0.0)) / F.sum(a)).alias("share_gt2med"),
        (F.sum(F.when(a > 4 * F.col("med_a"), a).otherwise(0.0)) / F.sum(a)).alias("share_gt4med"))
    return base.join(ranked.drop("q25", "q75", "med_a"), entity).join(big, entity)


def bimodality(df: DataFrame, c: str, entity: str = "img") -> DataFrame:
    """Sarle's coefficient with population skew and excess kurtosis."""
    n = F.col("n").cast("double")
    g = df.groupBy(entity).agg(F.count(c).alias("n"), F.skewness(c).alias("g"), F.kurtosis(c).alias("k"))
    b = safe_div(F.col("g") * F.col("g") + 1, F.col("k") + safe_div(3 * (n - 1) * (n - 1), (n - 2) * (n - 3)))
    return g.select(entity, F.when(n > 3, b).alias("bimod"))


def inverse_root_stats(df: DataFrame, dark: Column, entity: str = "img") -> DataFrame:
    """Means of d^-1/2 (d = sqrt area), small and large shares, size ratio of the phases."""
    a = F.col("area")
    hp = F.pow(a, F.lit(-0.25))
    med = quantiles(df, [entity], "area", {"_m": 0.5}).drop("n_total")
    g = df.join(med, entity).groupBy(entity).agg(
        wmean(hp, "area").alias("hp_area"), F.avg(hp).alias("hp_num"), F.pow(F.avg(a), F.lit(-0.25)).alias("hp_of_mean"),
        (F.sum(F.when(a < 0.25 * F.col("_m"), a).otherwise(0.0)) / F.sum(a)).alias("small_frac"),
        (F.sum(F.when(a > 4 * F.col("_m"), a).otherwise(0.0)) / F.sum(a)).alias("big_frac"),
        F.when((F.sum(dark.cast("int")) >= 2) & (F.sum((~dark).cast("int")) >= 2),
               F.log(F.avg(F.when(dark, a)) / F.avg(F.when(~dark, a)))).alias("size_ratio"))
    return g.withColumn("hp_excess", F.col("hp_area") / F.col("hp_of_mean"))


def phase_split_stats(df: DataFrame, dark: Column, entity: str = "img") -> DataFrame:
    """Count, area and diameter terms by phase and border flag, one conditional aggregate."""
    inner = ~F.col("border")
    a, d = F.col("area"), F.sqrt(4 * F.col("area") / F.pi())
    cnt = lambda m: F.sum(m.cast("bigint"))
    av = lambda m, v: F.avg(F.when(m, v))
    w = F.col("area") * (F.col("asp") - 1)
    return df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("N_all"), cnt(inner).alias("N_in"), cnt(~inner).alias("N_bd"), jeffries().alias("N_eff"),
        (F.sum(F.when(dark, a).otherwise(0.0)) / F.sum(a)).alias("fd_area"), F.avg(dark.cast("double")).alias("fd_num"),
        av(inner, dark.cast("double")).alias("fd_num_in"), F.avg(a).alias("amean_all"), av(inner, a).alias("amean_in"),
        F.avg(d).alias("d_num_all"), av(inner, d).alias("d_num_in"),
        safe_div(F.sum(F.when(inner, d * a)), F.sum(F.when(inner, a))).alias("d_aw_in"),
        cnt(dark & inner).alias("N_dark_in"), cnt(~dark & inner).alias("N_mat_in"),
        av(dark & inner, d).alias("d_dark"), av(~dark & inner, d).alias("d_mat"),
        F.coalesce(order_parameter("theta", w), F.lit(0.0)).alias("S_align"))


def flagged_fractions(df: DataFrame, value: str, levels: Sequence[float], entity: str = "img") -> DataFrame:
    """Area and number share below each level; mean area and level of the flagged and other units at the first level."""
    a, v = F.col("area"), F.col(value)
    out = []
    for t in levels:
        tag = str(int(round(t * 100)))
        out += [(F.sum(F.when(v < t, a).otherwise(0.0)) / F.sum(a)).alias(f"fd{tag}"), F.avg((v < t).cast("double")).alias(f"nd{tag}")]
    m = v < levels[0]
    return df.groupBy(entity).agg(*out, F.coalesce(F.avg(F.when(m, a)), F.lit(0.0)).alias("dk_area_mean"),
                                  F.coalesce(F.avg(F.when(~m, a)), F.lit(0.0)).alias("mx_area_mean"),
                                  F.when(F.sum(m.cast("int")) >= 2, F.sum(F.when(m, a * v)) / F.sum(F.when(m, a))).alias("dk_level"))


def shape_tensor(df: DataFrame, entity: str = "img") -> DataFrame:
    """Mean normalised shape tensor, its log axis ratio, and alignment to the dominant axis."""
    th = F.col("theta")
    axis = df.groupBy(entity).agg((0.5 * F.atan2(F.sum(F.col("area") * F.sin(2 * th)), F.sum(F.col("area") * F.cos(2 * th)))).alias("th0"),
                                  order_parameter("theta", "area").alias("align_R"))
    la = F.log(F.least(F.greatest(F.col("asp"), F.lit(1.0)), F.lit(50.0)))
    d = df.join(axis, entity)
    c2, s2 = F.cos(2 * (th - F.col("th0"))), F.sin(2 * (th - F.col("th0")))
    g = d.groupBy(entity).agg(
        F.avg(F.cosh(la) + F.sinh(la) * c2).alias("txx"), F.avg(F.cosh(la) - F.sinh(la) * c2).alias("tyy"),
        F.avg(F.sinh(la) * s2).alias("txy"), F.max("align_R").alias("align_R"), wmean(c2, "area").alias("align_wmean"),
        F.avg(la).alias("logasp_mean"), wmean(la, "area").alias("logasp_wmean"))
    half = (F.col("txx") + F.col("tyy")) / 2
    disc = F.sqrt(F.pow((F.col("txx") - F.col("tyy")) / 2, 2) + F.col("txy") * F.col("txy"))
    strain = 0.5 * F.log((half + disc) / F.greatest(half - disc, F.lit(1e-6)))
    return g.select(entity, strain.alias("strain"), "align_R", "align_wmean", "logasp_mean", "logasp_wmean")


def largest_units(df: DataFrame, dark: Column, order: Sequence, n: int = 3, entity: str = "img") -> DataFrame:
    """Share, phase, border flag and aspect of the n largest units, one row per entity.

    The row limit is applied in every partition before the shuffle, so a huge entity sends few rows.
    """
    tot = df.groupBy(entity).agg(F.sum("area").alias("_t"))
    top = top_per_group(df.withColumn("_dk", dark), [entity], [F.desc("area"), *order], n).join(tot, entity)
    out = []
    for j in range(n):
        m = F.col("rn") == j + 1
        out += [F.max(F.when(m, F.col("area") / F.col("_t"))).alias(f"big{j}_share"), F.max(F.when(m, F.col("_dk").cast("int"))).alias(f"big{j}_dark"),
                F.max(F.when(m, F.col("border").cast("int"))).alias(f"big{j}_border"), F.max(F.when(m, F.col("asp"))).alias(f"big{j}_asp")]
    return top.groupBy(entity).agg(*out)


def morans_i(df: DataFrame, value: str, radius: float, least: int = 15, entity: str = "img", y: str = "cy", x: str = "cx") -> DataFrame:
    """Moran's I of a unit attribute over pairs within the radius."""
    m = df.groupBy(entity).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"), F.var_pop(value).alias("_v"))
    z = df.join(m.where((F.col("_n") >= least) & (F.col("_v") > 0)), entity).withColumn("z", F.col(value) - F.col("_m"))
    p = radius_pair_sums(z, entity, y, x, radius, ["z"])
    s = m.join(p, entity, "left")
    i = safe_div(F.col("prod_z"), F.col("pairs")) / F.col("_v")
    return s.select(entity, F.when(F.col("pairs") > 0, i).alias("moran"))


def local_field_stats(df: DataFrame, centres, sigma: float, entity: str = "img") -> DataFrame:
    """Spread of the locally weighted mean log area over fixed centres."""
    d = df.withColumn("la", F.log("area"))
    loc = grid_field(d, entity, "cy", "cx", "area", ["la"], centres, sigma)
    g = loc.groupBy(entity).agg(F.stddev_pop("la").alias("sd"), F.max("la").alias("hi"), F.min("la").alias("lo"))
    own = d.groupBy(entity).agg(F.stddev_pop("la").alias("own"), wmean("la", "area").alias("w"))
    j = g.join(own, entity)
    return j.select(entity, F.col("sd").alias("lf_sd"), (F.col("hi") - F.col("lo")).alias("lf_rng"), F.col("hi").alias("lf_max"),
                    F.col("lo").alias("lf_min"), (F.col("sd") / F.greatest(F.col("own"), F.lit(1e-6))).alias("lf_sd_rel"),
                    (F.col("hi") - F.col("w")).alias("lf_max_minus_w"))


def count_cv(df: DataFrame, cells: int, size: float, entity: str = "img", y: str = "cy", x: str = "cx") -> DataFrame:
    """CV of the unit counts over a cells x cells grid, empty cells included."""
    step = size / cells
    c = df.groupBy(entity, F.floor(F.col(y) / step).alias("a"), F.floor(F.col(x) / step).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    g = c.groupBy(entity).agg(F.sum(n).alias("s"), F.sum(n * n).alias("q"))
    m = F.col("s") / (cells * cells)
    return g.select(entity, (F.sqrt(F.greatest(F.lit(0.0), F.col("q") / (cells * cells) - m * m)) / m).alias("cnt_cv"))


def contact_stats(px: DataFrame, adj: DataFrame, dark_below: float) -> DataFrame:
    """Degree and phase contact shares over touching region pairs."""
    reg = region_areas(px)
    e = adj.where("l1 <> l2").select("img", F.least("l1", "l2").alias("a"), F.greatest("l1", "l2").alias("b")).distinct()
    dk = reg.select("img", "lab", (F.col("grey") < dark_below).alias("dk"))
    e = e.join(dk.select("img", F.col("lab").alias("a"), F.col("dk").alias("da")), ["img", "a"]).join(
        dk.select("img", F.col("lab").alias("b"), F.col("dk").alias("db")), ["img", "b"])
    pe = e.groupBy("img").agg(F.count(F.lit(1)).alias("edges"), F.avg((F.col("da") & F.col("db")).cast("double")).alias("both"),
                              F.avg((F.col("da") != F.col("db")).cast("double")).alias("one"))
    pr = dk.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dk").cast("double")).alias("p"))
    j = pr.join(pe, "img", "left").fillna(0.0, ["both", "one"]).fillna(0, ["edges"])
    return j.select("img", (2 * F.col("edges") / F.col("n")).alias("nb_mean"), F.col("both").alias("dd_contact"),
                    F.col("one").alias("dm_contact"), (F.col("both") - F.col("p") * F.col("p")).alias("dd_excess"))
