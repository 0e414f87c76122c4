"""The valley of a smoothed histogram against its definition, and an expression that stays small."""

import numpy as np
from pyspark.sql import functions as F

from stratafold.operators import mixtures as MX


def test_valley_threshold_by_definition(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), float(r), float(w)) for i in range(40) for r, w in zip(rng.normal(0.9, 0.3, 60), rng.integers(1, 50, 60))]
    rows += [(100, 5.0, 2.0), (101, 0.9, 1.0)]
    df = spark.createDataFrame([*rows, (1, None, 3.0), (102, None, 1.0)], "img long, ratio double, area double")
    lo, hi, cells, window = 0.4, 1.6, 48, (0.8, 0.98)
    step = (hi - lo) / cells
    want = {}
    for img in {r[0] for r in rows}:
        h = np.zeros(cells + 4)
        for _, r, w in (r for r in rows if r[0] == img):
            h[2 + min(max(int(np.floor((r - lo) / step)), 0), cells - 1)] += w
        s = [h[i] + 2 * h[i + 1] + 3 * h[i + 2] + 2 * h[i + 3] + h[i + 4] for i in range(cells)]
        near = range(int((window[0] - lo) / step), int((window[1] - lo) / step) + 1)
        want[img] = lo + step * (min(near, key=lambda i: (s[i], i)) + 0.5)
    got = MX.valley_threshold(df, "ratio", "area", lo, hi, cells, window)
    assert {r["img"]: r["thr"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # nested functions over the cells were worked out again for every cell of the window


def test_rows_are_not_written_by_the_rounds(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i % 3), float(x), float(y), float(g), 10.0) for i, (x, y, g) in enumerate(zip(rng.uniform(0, 256, 300), rng.uniform(0, 256, 300), rng.uniform(0.5, 1.5, 300)))]
    d = MX.surface_and_phase(spark.createDataFrame(rows, "img long, cx double, cy double, grey double, area double"), rounds=2)
    got = d.agg(F.count("*"), F.countDistinct("img"), F.sum((F.col("keep") != (F.col("ratio") > F.col("thr"))).cast("int"))).first()
    assert tuple(got) == (300, 3, 0)
    assert "phase" in d.inputFiles()[0]  # what passes between rounds is the small table of the images
