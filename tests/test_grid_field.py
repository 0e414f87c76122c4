"""Fields at fixed centres against plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from stratafold.operators import joins as J


def test_field_equals_a_loop_and_makes_no_row_a_centre(spark):
    rows = [(i % 3, float(i * 7 % 5), float(i * 3 % 4), 1.0 + i % 6, float(i % 9), None if i % 8 == 0 else float(i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "img long, cy double, cx double, area double, a double, b double").repartition(3)
    centres = [(0.0, 1.0), (3.0, 2.0)]
    d = J.grid_field(df, "img", "cy", "cx", "area", ["a", "b"], centres, 2.0)
    got = {(r.img, r.c): (r.a, r.b) for r in d.collect()}
    for img in range(3):
        for c, (yc, xc) in enumerate(centres):
            own = [(math.exp(-((y - yc) ** 2 + (x - xc) ** 2) / 8) * w, a, b) for g, y, x, w, a, b in rows if g == img]
            whole = sum(w for w, _, _ in own)
            assert got[img, c] == (pytest.approx(sum(w * a for w, a, _ in own) / whole), pytest.approx(sum(w * b for w, _, b in own if b is not None) / whole))
    assert len(got) == 6
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # exploded after the sums, not before
