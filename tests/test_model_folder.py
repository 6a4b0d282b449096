"""Model folders, and tracks scored end to end, against numpy by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import models as m
from trackspark.plans import models as plans
from trackspark.sources.fixtures import read

DATA = "/root/testdata/sf0.001"


def test_versions_of_a_folder(spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        m.load_model(spark, path)
    one = m.Model(["a", "b"], "linear", {"weights": np.arange(6.0).reshape(2, 3), "bias": np.array([0.5, -1.0])}, {"a": 0.9}, {"square_width": 1})
    assert m.save_model(spark, path, one) == 1 and m.save_model(spark, path, m.Model(["c"], "centroid", {"means": np.zeros((1, 2))})) == 2
    first, last = m.load_model(spark, path, 1), m.load_model(spark, path)
    assert (first.labels, first.version, first.thresholds, first.frames, first.shape) == (["a", "b"], 1, {"a": 0.9}, 1, 3) and (last.labels, last.version, last.frames) == (["c"], 2, 4)
    assert (first.arrays["weights"] == one.arrays["weights"]).all() and last.arrays["means"].shape == (1, 2)
    x = np.array([[1.0, 2.0, 3.0]])
    z = np.exp(np.array([8.5, 25.0]) - 25.0)
    assert first.predict(x)[0] == pytest.approx(z / z.sum())
    (tmp_path / "model" / "v3" / "arrays").mkdir(parents=True)  # a writer that died
    assert m.model_versions(spark, path) == [1, 2]


def test_a_model_of_too_many_numbers_is_refused(spark, tmp_path, monkeypatch):
    m.save_model(spark, str(tmp_path / "m"), m.Model(["a"], "centroid", {"means": np.zeros((1, 50))}))
    monkeypatch.setattr(m, "MOST_CELLS", 49)
    with pytest.raises(ValueError, match="50 numbers"):
        m.load_model(spark, str(tmp_path / "m"))


def plain_patches(pictures):
    """track -> frame -> (patch, mass) of {track: {frame: 8 x 8}}."""
    out = {}
    for track, frames in pictures.items():
        cut = {f: (p[1:7, 1:7] - np.median(p)) for f, p in frames.items()}
        clip = min(np.median(d) for d in cut.values()) > 0
        c = {f: np.maximum(d, 0) if clip else d for f, d in cut.items()}
        low, high = min(x.min() for x in c.values()), max(x.max() for x in c.values())
        out[track] = {f: (((x - low) / (high - low) if high > low else 0 * x).ravel(), int((cut[f] > 0).sum())) for f, x in c.items()}
    return out


def plain_scores(patches, model):
    out = {}
    for track, frames in patches.items():
        order = sorted(sorted(frames)[-int(model.param("from_last")) :], key=lambda f: (hashlib.md5(f"{int(model.param('seed'))}|{track}|{f}".encode()).hexdigest(), f))
        total, mass, n = 0, 0, 0
        groups = [sorted(order[k : k + model.frames]) for k in range(0, len(order), model.frames)]
        for g in groups:
            x = np.concatenate([frames[g[i % len(g)]][0] for i in range(model.frames)])
            e = np.exp(-((x - model.arrays["means"]) ** 2).sum(1))
            w = sum(frames[f][1] for f in g)
            total, mass, n = total + w * e / e.sum(), mass + w, n + 1
        s = total / mass
        if n == 1 and len(order) < model.frames / 4 and model.labels[int(np.argmax(s))] != "false-positive" and s.sum() > 0.5:
            s = s * 0.5 / s.sum()
        k = int(np.argmax(np.round(s, 9)))
        out[track] = (model.labels[k], s[k], s[k] - np.sort(s)[-2], model.labels[k] if s[k] >= model.thresholds.get(model.labels[k], 0) else None, n)
    return out


def pictures_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.clip_id, {}).setdefault(r.frame_number, np.zeros((8, 8)))[r.y, r.x] = r.v
    return out


def same(got, want):
    assert set(got) == set(want)
    for t, (label, score, clarity, tag, n) in want.items():
        r = got[t]
        assert (r.label, r.tag, r.samples) == (label, tag, n) and (r.score, r.clarity) == pytest.approx((score, clarity), abs=2e-6)


def test_tracks_end_to_end_against_numpy(spark):
    v = read(spark, DATA, "v_pixels")
    model = plans.clip_model(v)
    all_ = plain_patches(pictures_of(v))
    means = [np.tile(np.mean([p for f, (p, _) in all_[int(x[5:])].items() if f % 4 == 0], axis=0), 4) for x in model.labels]
    assert model.arrays["means"] == pytest.approx(np.array(means)) and model.version == 1
    want = plain_scores({t: {f: x for f, x in fs.items() if f % 4} for t, fs in all_.items()}, model)
    same({r.track_id: r for r in plans.m03_tracks(v).collect()}, want)
    assert {w[3] for w in want.values()} - {None}


def test_warm_short_flat_and_last_frames(spark):
    """Clipping where a whole track is warm, the cap of short tracks, flat tracks, from_last."""
    rng = np.random.default_rng(1)
    pictures = {t: {f: rng.integers(0, 50, (8, 8)).astype(float) for f in range(n)} for t, n in ((1, 9), (2, 1), (3, 20))}
    for p in pictures[3].values():
        p[1:7, 1:7] += 1000  # warmer than the border
        p[0, :] = p[7, :] = p[:, 0] = p[:, 7] = 0
        p[1:5, 1:5] = 900
    pictures[2] = {0: pictures[2][0]}
    rows = [(t, f, y, x, float(p[y, x]), 1 <= x <= 6 and 1 <= y <= 6) for t, fs in pictures.items() for f, p in fs.items() for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "track_id long, frame_number long, y long, x long, v double, inside boolean")
    found = m.patches(df)
    want = plain_patches(pictures)
    for r in found.collect():
        assert r.patch == pytest.approx(want[r.track_id][r.frame_number][0]) and r.mass == want[r.track_id][r.frame_number][1]
    means = rng.random((3, 36 * 9))
    for labels in (["a", "b", "c"], ["false-positive"] * 1 + ["b", "c"]):
        model = m.Model(labels, "centroid", {"means": means}, {"b": 0.99}, {"square_width": 3, "from_last": 12, "seed": 4}, 7)
        same({r.track_id: r for r in m.classify_tracks(found, model).collect()}, plain_scores(want, model))
    flat = m.patches(df.withColumn("v", F.lit(5.0)))
    assert flat.where("mass <> 0 or exists(patch, x -> x <> 0)").count() == 0
    got = {r.track_id: r.score for r in m.classify_tracks(flat, m.Model(["a", "b"], "centroid", {"means": means[:2, :36]}, {}, {"square_width": 1})).collect()}
    e = np.exp(-(means[:2, :36] ** 2).sum(1))
    assert got == pytest.approx({t: (e / e.sum()).max() for t in pictures})
    assert m.classify_tracks(m.patches(df.limit(0)), m.Model(["a"], "centroid", {"means": means[:1]})).count() == 0
