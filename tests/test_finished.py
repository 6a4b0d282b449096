"""Recordings whose files arrive in any order are told once, also when a query stops and starts again."""

import json
import os

import numpy as np
import pytest

from trackspark.operators import models as m
from trackspark.streaming import finished

MODEL = m.Model(["rat", "false-positive"], "centroid", {"means": np.array([[0.9] * 16, [0.1] * 16])}, {"rat": 0.6}, {"square_width": 2}, 3)


def put(folder, name, tracks=None):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        if tracks is None:
            f.write(json.dumps({"id": name}))
        for t, seed in (tracks or {}).items():
            rng = np.random.default_rng(seed)
            for k in range(6):
                f.write(json.dumps({"track_id": t, "frame_number": k, "width": 4, "pixels": [float(x) for x in rng.integers(0, 99, 16)], "border": 1}) + "\n")
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def once(spark, folder, batch=None):
    stream = finished.complete(finished.arrivals(spark, folder, "*.cptv"), finished.arrivals(spark, folder, "*.txt"))
    query = finished.reprocess(stream, MODEL, f"{folder}-events", f"{folder}-checkpoint")
    assert query.awaitTermination(120) and query.exception() is None
    return sorted((r.stem, r.track_id) for r in finished.events(spark, f"{folder}-events").collect())


def test_files_in_two_orders_give_one_event_each(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    put(a, "one.cptv", {1: 1, 2: 2})
    put(a, "two.txt")
    put(b, "one.txt")
    put(b, "two.cptv", {1: 3})
    assert once(spark, a) == once(spark, b) == [], "nothing is complete"
    put(a, "one.txt")
    put(b, "one.cptv", {1: 1, 2: 2})
    want = [("one", 1), ("one", 2)]
    assert once(spark, a) == once(spark, b) == want
    assert once(spark, a) == want, "a restart tells nothing twice"
    put(a, "two.cptv", {1: 3})
    put(a, "three-track.cptv", {1: 4})
    put(a, "four.cptv", {1: 5})
    put(b, "two.txt")
    want += [("two", 1)]
    assert once(spark, b) == want and once(spark, a) == sorted([*want, ("three-track", 1)])
    left, right = ({(r.stem, r.track_id): (r.label, r.score, r.tag, r.version, r.final) for r in finished.events(spark, f"{x}-events").collect()} for x in (a, b))
    assert {k: left[k] for k in right} == right and all(r[3:] == (3, True) for r in left.values())


def test_a_batch_that_runs_again_takes_its_own_place(spark, tmp_path):
    """A failure after a batch was written, before it was recorded: the checkpoint loses its last commit."""
    a = str(tmp_path / "a")
    put(a, "one.cptv", {1: 1, 2: 2})
    put(a, "one.txt")
    want = once(spark, a)
    commits = f"{a}-checkpoint/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{commits}/{f}"):
            os.remove(f"{commits}/{f}")
    assert once(spark, a) == want == [("one", 1), ("one", 2)]


def test_events_are_what_the_scorer_gives(spark, tmp_path):
    a = str(tmp_path / "a")
    put(a, "one.cptv", {7: 1})
    put(a, "one.txt")
    once(spark, a)
    rng = np.random.default_rng(1)
    pictures = [rng.integers(0, 99, 16).astype(float).reshape(4, 4) for _ in range(6)]
    cells = spark.createDataFrame([(7, f, y, x, float(p[y, x]), 0 < x < 3 and 0 < y < 3) for f, p in enumerate(pictures) for y in range(4) for x in range(4)], "track_id long, frame_number long, y long, x long, v double, inside boolean")
    # sampling orders frames by the key of the track, which in a recording holds its name
    keyed = m.patches(cells).selectExpr("""to_json(struct('one' as stem, track_id)) as track_id""", "frame_number", "patch", "mass")
    want, got = m.classify_tracks(keyed, MODEL).first(), finished.events(spark, f"{a}-events").first()
    assert (got.label, got.tag) == (want.label, want.tag) and got.score == pytest.approx(want.score)
