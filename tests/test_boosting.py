"""Boosting from histograms against growing each tree by loops over rows, bins and sides."""

import numpy as np
import pandas as pd
import pytest
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.models import boosting

FEATURES = ["a", "b", "c", "d"]


def table(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 1] = rng.integers(0, 4, n)
    x[:, 3] = 7.0
    chance = 1 / (1 + np.exp(-(2 * x[:, 0] + (x[:, 1] == 2) - 1)))
    y = (rng.random(n) < chance).astype(int)
    gaps = rng.random(n) < 0.15
    x[gaps, 0] = np.nan
    y[gaps] = rng.random(gaps.sum()) < 0.8
    return pd.DataFrame(x, columns=FEATURES).assign(key=np.arange(n) * 7, target=y, members=np.where(np.arange(n) % 3 == 0, 1, 3))


def frame(spark, data, parts):
    rows = [tuple(None if v != v else v for v in r) for r in data.astype(object).to_numpy().tolist()]
    return spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, key BIGINT, target INT, members INT").repartition(parts)


def grow_plainly(bins, g, h, rows, columns, params, node=0, level=0, out=None):
    """The nodes of one tree as {node: (feature, bin, missing_left, value, gain)}."""
    out = {} if out is None else out
    G, H = g[rows].sum(), h[rows].sum()
    value = -params.step * G / (H + params.ridge)
    best = None
    if level < params.depth:
        for missing_left in (False, True):
            for f in columns:
                for b in range(params.bins):
                    own = bins[rows, f]
                    left = np.where(own == boosting.MISSING_BIN, missing_left, own <= b)
                    l, r = rows[left], rows[~left]
                    if h[l].sum() < params.least or h[r].sum() < params.least:
                        continue
                    gain = g[l].sum() ** 2 / (h[l].sum() + params.ridge) + g[r].sum() ** 2 / (h[r].sum() + params.ridge) - G**2 / (H + params.ridge)
                    if best is None or gain > best[0]:
                        best = (gain, f, b, missing_left, l, r)
    if best is None or best[0] <= 1e-6:
        out[node] = (-1, 0, False, value, 0.0)
        return out
    gain, f, b, missing_left, l, r = best
    out[node] = (int(f), b, missing_left, value, gain)
    grow_plainly(bins, g, h, l, columns, params, 2 * node + 1, level + 1, out)
    grow_plainly(bins, g, h, r, columns, params, 2 * node + 2, level + 1, out)
    return out


def hashes(spark, data):
    rows = spark.createDataFrame([(int(k),) for k in data["key"]], "key BIGINT").select("key", F.xxhash64("key").alias("h")).collect()
    by = {r.key: r.h for r in rows}
    return np.array([by[int(k)] for k in data["key"]], np.int64).view(np.uint64)


PARAMS = boosting.BoostingParams(trees=7, depth=3, step=0.3, bins=8, block=64, restart=3)


def test_trees_equal_plain_growth(spark):
    data = table(400)
    fitted = boosting.fit(frame(spark, data, 3), FEATURES, 2, 1.7, PARAMS)
    bins = boosting._bins_of([data[f].to_numpy(float) for f in FEATURES], fitted.edges)
    draw, y = hashes(spark, data), data["target"].to_numpy()
    for m in (0, 1):
        margin = np.zeros(len(data))
        for t, trees in enumerate(fitted.rounds):
            g, h = (x / 2.0**20 for x in boosting.gradients(margin, y, 1.7))
            rows = np.flatnonzero(boosting.drawn(draw, t, PARAMS) & (data["members"].to_numpy() >> m & 1 == 1))
            want = grow_plainly(bins, g, h, rows, boosting.columns_of(t, 4, PARAMS), PARAMS)
            got = {i: (trees.feature[m, i], trees.bin[m, i], trees.missing_left[m, i]) for i in want}
            for i, (f, b, left, value, gain) in want.items():
                assert trees.feature[m, i] == f and trees.value[m, i] == pytest.approx(value, abs=1e-9)
                assert trees.gain[m, i] == pytest.approx(gain, abs=1e-6)
                if f >= 0:
                    assert got[i] == (f, b, left)
            margin = margin + trees.value[m][trees.walk(m, bins, PARAMS.depth)]
        assert np.allclose(fitted.margin([data[f].to_numpy(float) for f in FEATURES], m), margin)


def test_dealing_and_merging_do_not_matter(spark):
    data = table(500, seed=4)
    one = boosting.fit(frame(spark, data, 1), FEATURES, 2, 1.0, PARAMS).nodes(spark).collect()
    other_params = boosting.BoostingParams(**{**PARAMS.__dict__, "block": 11, "parts": 0, "restart": 2})
    other = boosting.fit(frame(spark, data, 5), FEATURES, 2, 1.0, other_params).nodes(spark).collect()
    assert one == other and len({r.tree for r in one}) == PARAMS.trees
    # a table of one partition and one of a few blocks in it, which merge nothing
    for block in (1 << 16, 130):
        alone = boosting.BoostingParams(**{**PARAMS.__dict__, "block": block})
        assert boosting.fit(frame(spark, data, 3), FEATURES, 2, 1.0, alone).nodes(spark).collect() == one


def test_models_grown_together_equal_models_grown_alone(spark):
    data = table(300, seed=5)
    rows = frame(spark, data, 2)
    both = boosting.fit(rows, FEATURES, 2, 1.0, PARAMS)
    alone = boosting.fit(rows.withColumn("members", F.col("members").bitwiseAND(2) / 2), FEATURES, 1, 1.0, PARAMS)
    columns = [data[f].to_numpy(float) for f in FEATURES]
    assert np.allclose(both.margin(columns, 1), alone.margin(columns, 0), atol=1e-12)
    assert not np.allclose(both.margin(columns, 0), both.margin(columns, 1))


def test_missing_values_get_a_learned_side(spark):
    data = table(400)
    fitted = boosting.fit(frame(spark, data, 2), FEATURES, 1, 1.0, PARAMS)
    probes = [np.array([v, v]) for v in (np.nan, 2.0, 0.0, 7.0)]
    low = [np.array([-2.0, -2.0]), *probes[1:]]
    # rows without the feature leave mostly, rows with a small value do not
    assert fitted.margin(probes, 0)[0] > fitted.margin(low, 0)[0] + 0.5
    shares = fitted.importance()
    assert shares.sum() == pytest.approx(1) and shares.argmax() == 0 and shares[3] == 0


def test_saved_nodes_predict_alike_and_score_in_spark(spark, tmp_path):
    data = table(300, seed=6)
    rows = frame(spark, data, 2)
    fitted = boosting.fit(rows, FEATURES, 2, 1.0, PARAMS)
    fitted.nodes(spark).write.parquet(str(tmp_path / "nodes"))
    again = boosting.Boosted.from_nodes(spark.read.parquet(str(tmp_path / "nodes")), FEATURES)
    fresh = table(200, seed=9)
    columns = [fresh[f].to_numpy(float) for f in FEATURES]
    for m in (0, 1):
        assert np.allclose(fitted.margin(columns, m), again.margin(columns, m), atol=1e-12)
    scored = frame(spark, fresh, 3).select("key", fitted.probability([F.col(f) for f in FEATURES], 1).alias("p")).toPandas()
    want = dict(zip(fresh["key"], 1 / (1 + np.exp(-fitted.margin(columns, 1))), strict=True))
    assert all(abs(want[k] - p) < 1e-12 for k, p in zip(scored["key"], scored["p"], strict=True))


def test_empty_and_one_sided_tables(spark):
    data = table(20)
    empty = boosting.fit(frame(spark, data, 1).limit(0), FEATURES, 1, 1.0, PARAMS)
    assert np.allclose(empty.margin([np.zeros(3)] * 4, 0), 0)
    sure = boosting.fit(frame(spark, data.assign(target=1), 1), FEATURES, 1, 1.0, PARAMS)
    assert (sure.margin([np.zeros(3)] * 4, 0) > 0).all()


def test_what_reaches_the_driver_does_not_grow_with_the_parts(spark, monkeypatch):
    data = table(700, seed=8)
    sizes = []

    def seen(kind, name, size):
        plain = getattr(kind, name)

        def run(self, *args):
            found = plain(self, *args)
            sizes.append(size(found))
            return found

        monkeypatch.setattr(kind, name, run)

    seen(RDD, "collect", lambda found: sum(np.size(x) for row in found for x in row[1:]))
    seen(DataFrame, "toArrow", lambda found: found.num_rows)
    told = []
    for block in (400, 20):
        sizes.clear()
        params = boosting.BoostingParams(**{**PARAMS.__dict__, "block": block})
        boosting.fit(frame(spark, data, 3), FEATURES, 2, 1.0, params)
        told.append(sum(sizes))
    assert told[0] == told[1] > 0


def test_what_reaches_the_driver_does_not_grow_with_the_bins(spark, monkeypatch):
    rows, plain, told = frame(spark, table(700, seed=8), 3), RDD.collect, []

    def run(self, *args):
        found = plain(self, *args)
        told[-1] += sum(np.size(x) for row in found for x in row[1:])
        return found

    monkeypatch.setattr(RDD, "collect", run)
    for bins in (8, 40):
        told.append(0)
        boosting.fit(rows, FEATURES, 2, 1.0, boosting.BoostingParams(**{**PARAMS.__dict__, "bins": bins}))
    assert told[0] == told[1] > 0


def test_best_of_the_columns_is_the_best_of_all():
    rng, params = np.random.default_rng(7), boosting.BoostingParams(bins=5)
    sums = rng.integers(1, 4, (3, 2, 4, 5, 6)) << 20
    sums[:, :, :, 3:], sums[0, :, 1] = sums[:, :, :, :2], 0  # equal columns, and a node without rows
    # all columns of a node hold the same rows
    sums[..., -1] += sums.sum(axis=-1).max(axis=-1, keepdims=True) - sums.sum(axis=-1)
    each = [boosting.best_splits(sums[..., c : c + 1, :], params) for c in range(5)]
    whole, picked = boosting.best_splits(sums, params), boosting.best_columns(each)
    assert whole.keys() == picked.keys() and all((whole[k] == picked[k]).all() for k in whole)
    assert whole["missing_left"].any() and len(np.unique(whole["column"])) > 1


def test_blocks_are_spread_over_the_slots():
    params = boosting.BoostingParams()
    assert [boosting.parts_of(n, 12, params) for n in (0, 15_000, 65_536, 90_000, 900_000, 5_400_000, 54_000_000)] == [1, 1, 1, 2, 12, 12, 60]


def test_columns_counted_together_give_each_column_its_sums():
    rng = np.random.default_rng(3)
    widths, params = [9, 3, 5, 9], boosting.BoostingParams(bins=8, depth=2)
    bins = np.stack([rng.integers(0, w - 1, 500) for w in widths], axis=1).astype(np.uint8)
    bins[rng.random(bins.shape) < 0.1] = boosting.MISSING_BIN
    target, members = rng.integers(0, 2, 500).astype(np.uint8), np.full(500, 1)
    block = boosting._Block(
        500, bins.tobytes(), target.tobytes(), members.tobytes(), np.arange(500, dtype=np.uint64).tobytes(), rng.normal(size=500).tobytes(), 1
    )
    columns = np.arange(4)
    assert sorted(len(b) for b in boosting.bundles(columns, widths, 60)) == [2, 2]
    sums = boosting.level_sums([block], 1, boosting.Trees.empty(1, 2), 0, 0, columns, widths, 1.5, params)
    use = boosting.drawn(block.draw, 0, params)
    for s, values in enumerate(boosting.gradients(block.margin[0], target, 1.5)):
        for c in columns:
            want = np.bincount(np.minimum(bins[use, c], params.bins), values[use], params.bins + 1)
            assert (sums[0, s, 0, c] == want).all()
