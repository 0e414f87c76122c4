"""Boosted trees: splits against an exhaustive search, monotone signs, folds that stay unseen."""

import numpy as np
import pytest

from stratafold.operators import boosting as B


def table(spark, n=400, seed=0):
    r = np.random.default_rng(seed)
    a, b, c = r.uniform(0, 10, n), r.uniform(0, 10, n), r.normal(size=n)
    y = 2 * a + 6 * np.sin(b) + r.normal(size=n) * 4
    rows = [(i, i % 4, None if i % 37 == 0 else float(a[i]), float(b[i]), float(c[i]), float(y[i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, fold int, a double, b double, c double, y double").repartition(5)


FULL = dict(rows=1.0, columns=1.0, rate=1.0, l2=0.0, bins=16)


def test_a_stump_is_the_best_of_all_splits(spark):
    rows, df = table(spark)
    _, _, b = B.crossfit_boosting(df, "y", ["a", "b", "c"], B.Settings(rounds=1, depth=1, least=5, **FULL))
    for m, (f, _) in enumerate(b.models):
        own = [r for r in rows if r[1] != f]
        y = np.array([r[5] for r in own]) - np.mean([r[5] for r in own])
        best = []
        for c in range(3):
            x = np.array([np.nan if r[2 + c] is None else r[2 + c] for r in own])
            bins = np.where(np.isnan(x), 0, 1 + np.searchsorted(b.edges[c], x, side="right"))
            for k in range(16):
                left = bins <= k
                if 5 <= left.sum() <= len(y) - 5:
                    best.append((y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum(), c, k, y[left].mean(), y[~left].mean()))
        _, c, k, left, right = max(best)
        t = b.trees[m][0]
        assert t.column[1] == c and t.value[2] == pytest.approx(left) and t.value[3] == pytest.approx(right)


@pytest.mark.parametrize("sign", [1, -1])
def test_signs_are_kept(spark, monkeypatch, sign):
    monkeypatch.setattr(B, "KEEP", 3)
    rows, df = table(spark)
    s = B.Settings(rounds=8, depth=3, rate=0.3, l2=1.0, least=3, rows=0.8, columns=1.0, bins=16, signs=(0, sign, 0))
    d, share, b = B.crossfit_boosting(df, "y", ["a", "b", "c"], s, (1, 2))
    r = np.random.default_rng(1)
    free = False
    for trees in b.trees:
        for _ in range(60):
            x = np.repeat(r.integers(0, 17, (1, 3)), 17, axis=0)
            x[:, 1] = np.arange(17)
            p = sum(t(x) for t in trees)
            assert (sign * np.diff(p) >= -1e-12).all()
            x[:, 1], x[:, 0] = 8, np.arange(17)
            free |= bool((np.diff(sum(t(x) for t in trees)) < 0).any())
    assert free and share[0][0] == "a" and sum(v for _, v in share) == pytest.approx(1)
    # predictions are the trees of the models that have not seen the row
    got = {x.id: x.pred for x in d.collect()}
    for row in rows[::29]:
        v = [np.nan if x is None else x for x in row[2:5]]
        x = np.array([[0 if np.isnan(v[c]) else 1 + np.searchsorted(b.edges[c], v[c], side="right") for c in range(3)]])
        want = np.mean([b.base[m] + sum(t(x)[0] for t in b.trees[m]) for m, (f, _) in enumerate(b.models) if f == row[1]])
        assert got[row[0]] == pytest.approx(want)


def test_a_held_out_target_changes_nothing_of_its_own_model(spark):
    rows, df = table(spark)
    s = B.Settings(rounds=2, depth=2, rate=0.5, bins=16, rows=0.7)
    changed = spark.createDataFrame([(*r[:5], r[5] + 1000.0 if r[1] == 2 else r[5]) for r in rows], df.schema)
    one, two = (B.crossfit_boosting(d, "y", ["a", "b", "c"], s)[2] for d in (df, changed))
    for m, (f, _) in enumerate(one.models):
        same = all(np.array_equal(a.column, b.column) and np.allclose(a.value, b.value) for a, b in zip(one.trees[m], two.trees[m]))
        assert same == (f == 2)


def test_fit_beats_the_mean_and_empty_targets_are_predicted(spark):
    rows, df = table(spark)
    df = df.selectExpr("id", "fold", "a", "b", "c", "if(id % 11 = 0, null, y) as y")
    d, _, _ = B.crossfit_boosting(df, "y", ["a", "b", "c"], B.Settings(rounds=12, depth=3, rate=0.3, bins=32))
    p = {r.id: r.pred for r in d.collect()}
    y = np.array([r[5] for r in rows])
    e = y - np.array([p[i] for i in range(len(y))])
    assert len(p) == len(y) and e.std() < 0.75 * y.std()


def test_look_ups_give_the_leaves_of_a_walk_down_the_tree():
    r = np.random.default_rng(3)
    for depth in (1, 2, 4):
        for _ in range(30):
            t = B.Tree(depth)
            for k in range(1, 1 << depth):
                if k == 1 or (t.column[k // 2] >= 0 and r.random() < 0.8):
                    t.column[k], t.cut[k] = r.integers(0, 3), r.integers(0, 20)
            t.value = r.normal(size=len(t.value))
            x = r.integers(0, 22, (500, 3)).astype(np.uint8)
            nodes, values = B._applied(t)
            assert np.array_equal(nodes(x.T.astype(np.intp)), t.nodes(x)) and np.array_equal(values(x.T.astype(np.intp)), t(x))


def test_blocks_of_any_length_keep_their_rows(spark, monkeypatch):
    """Rows of many short files, in blocks that do not fill up, keep keys and predictions together over written rounds."""
    monkeypatch.setattr(B, "KEEP", 1)
    monkeypatch.setattr(B, "BLOCK", 7)
    monkeypatch.setattr(B, "SLICE", 16)
    rows, df = table(spark)
    d, _, b = B.crossfit_boosting(df, "y", ["a", "b", "c"], B.Settings(rounds=3, depth=2, rate=0.5, bins=16))
    assert b.table.count() < len(rows) / 5
    got = {x.id: x.pred for x in d.collect()}
    for row in rows:
        x = np.array([[0 if row[2 + c] is None else 1 + np.searchsorted(b.edges[c], row[2 + c], side="right") for c in range(3)]])
        assert got[row[0]] == pytest.approx(np.mean([b.base[m] + sum(t(x)[0] for t in b.trees[m]) for m, (f, _) in enumerate(b.models) if f == row[1]]))
