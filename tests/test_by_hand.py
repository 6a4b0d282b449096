"""Greedy steps and models without SQL, against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest

from trackspark.operators import models, tracker
from trackspark.plans import models as plans
from trackspark.sources.fixtures import read

DATA = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_boxes_within_a_gap_are_united():
    box = lambda *r: pd.DataFrame([(1, 5, *x) for x in r], columns=["clip_id", "frame_number", "x", "y", "width", "height", "mass"])
    got = tracker.merge_boxes(box((0, 0, 5, 5, 10), (12, 0, 5, 5, 20), (40, 40, 5, 5, 7), (25, 0, 5, 5, 1)), 10.0)
    # the first two unite, then the fourth is near enough to them; the third stays
    assert sorted(got.itertuples(index=False, name=None)) == [(1, 5, 0, 0, 30, 5, 31), (1, 5, 40, 40, 5, 5, 7)]


def test_heaviest_windows_drop_their_neighbours(spark):
    rows = [(1, f, t) for f, t in [(0, 5), (3, 9), (6, 8), (9, 9), (16, 1), (30, 0)]] + [(2, 4, 4)]
    got = tracker.heaviest_windows(spark.createDataFrame(rows, "track_id long, frame_number long, total long"), 9)
    assert rows_of(got, "track_id", "frame_number") == [(1, 3), (1, 9), (1, 16), (1, 30), (2, 4)]


def test_expected_tracks_take_the_best_left(spark):
    rows = [(1, 1, 7, 0.0, 3.0), (1, 1, 8, 0.0, 1.0), (1, 2, 8, 1.0, 0.5), (1, 2, 7, 1.0, 2.0), (1, 3, 8, 2.0, 0.1), (2, 9, 5, 0.0, 9.0)]
    got = tracker.match_expected(spark.createDataFrame(rows, "clip_id long, expected_id long, track_id long, start_s double, score double"))
    assert rows_of(got, "clip_id", "expected_id", "track_id") == [(1, 1, 8), (1, 2, 7), (2, 9, 5)]


def test_masked_segments_cover_each_frame_once(spark):
    frames = spark.createDataFrame([(t, f) for t, n in ((1, 60), (2, 12), (3, 3)) for f in range(n)], "track_id long, frame_number long")
    got = tracker.masked_segments(frames, 10, 2).toPandas()
    assert not got.duplicated(["track_id", "frame_number"]).any()
    size = got.groupby(["track_id", "segment"]).size()
    assert size.max() == 10 and (size[1].iloc[:-1] >= 5).all() and len(got[got.track_id == 3]) == 3
    assert len(got[got.track_id == 1]) >= 55 and rows_of(tracker.masked_segments(frames, 10, 2), "track_id", "segment", "frame_number") == sorted(got.itertuples(index=False, name=None))


def test_centroid_scores_against_numpy(spark):
    e = read(spark, DATA, "embeddings")
    rows = e.toPandas()
    x, label = np.stack(rows["embedding"]).astype(float), rows["label"].to_numpy()
    train = rows["vec_id"].to_numpy() % 4 != 0
    labels = sorted(set(label[train]), key=int)
    means = np.stack([x[train & (label == k)].mean(0) for k in labels])
    near = -((x[:, None] - means[None]) ** 2).sum(2)
    p = np.exp(near - near.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    got = {r.vec_id: r.scores for r in plans.m01(e).collect()}
    for i, v in enumerate(rows["vec_id"]):
        assert got[v] == pytest.approx(p[i].tolist(), abs=1e-6)
    # end to end: samples weighed by mass, best label of each track
    mass = 1 + rows["vec_id"].to_numpy() % 97
    tracks = rows["vec_id"].to_numpy() % 50
    want = {}
    for t in set(tracks):
        at = tracks == t
        s = (p[at] * mass[at, None]).sum(0) / mass[at].sum()
        want[int(t)] = round(float(s.max()), 6)
    assert {r.track_id: r.score for r in plans.m03(e).collect()} == pytest.approx(want, abs=2e-6)
    pred = p_all(x, label, rows)
    assert {(r.label, r.pred): r.n for r in plans.m04(e).collect()} == pred


def test_every_recording_gets_one_final_event(spark):
    v = read(spark, DATA, "v_pixels")
    final = plans.t16(v).collect()
    assert sorted(r.track_id for r in final) == sorted(r.clip_id for r in v.select("clip_id").distinct().collect()) and all(r.final for r in final)


def p_all(x, label, rows):
    labels = sorted(set(label), key=int)
    means = np.stack([x[label == k].mean(0) for k in labels])
    best = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
    out = {}
    for k, b in zip(label, best, strict=True):
        out[k, int(b)] = out.get((k, int(b)), 0) + 1
    return out


def test_forest_by_a_walk_of_its_trees(spark):
    e = plans.features(read(spark, DATA, "embeddings"))
    model = models.forest(e)
    rows = {r.vec_id: list(map(float, r.features)) for r in e.collect()}

    def leaf(node, x):
        while node.numDescendants():
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return [node.impurityStats().stats()[i] for i in range(model.numClasses)]

    got = {r.vec_id: (r.pred, r.confidence) for r in models.forest_scores(model, e, "vec_id").collect()}
    roots = [t._java_obj.rootNode() for t in model.trees]
    for i in sorted(rows)[:25]:
        votes = np.zeros(model.numClasses)
        for root in roots:
            s = np.array(leaf(root, rows[i]))
            votes += s / s.sum()
        votes /= votes.sum()
        assert got[i][1] == pytest.approx(votes.max(), abs=1e-6) and votes[got[i][0]] == pytest.approx(votes.max(), abs=1e-9)
    acc = plans.m06(read(spark, DATA, "embeddings")).collect()
    assert acc and all(0 <= r.accuracy <= 1 for r in acc)
    found = plans.m07(read(spark, DATA, "embeddings")).collect()
    assert {(r.trees, r.depth) for r in found} == {(5, 3), (5, 5), (10, 3), (10, 5)} and all(0 <= r.accuracy <= 1 and not math.isnan(r.accuracy) for r in found)


def test_motion_against_the_matrix_form(spark):
    """The scalar filter gives what the same filter gives in matrices."""
    m = tracker.Motion(3, 4)
    state, cov = np.array([3.0, 4.0, 0.0, 0.0]), np.eye(4)
    step, noise = np.eye(4) + np.diag([1.0, 1.0], 2), np.eye(4) * 0.03
    rng = np.random.default_rng(5)
    for x, y in rng.normal(10, 5, (30, 2)):
        gain = cov[:, :2] @ np.linalg.inv(cov[:2, :2] + np.eye(2))
        state = state + gain @ (np.array([x, y]) - state[:2])
        cov = cov - gain @ cov[:2]
        m.correct(x, y)
        state = step @ state
        cov = step @ cov @ step.T + noise
        assert m.predict() == pytest.approx(tuple(state[:2]))
