"""Questions to models and events of tracks: traces by hand, tables, and streams."""

import random

import pytest

from trackspark.operators import follower as f
from trackspark.plans import models as plans
from trackspark.sources.fixtures import read
from trackspark.streaming import processors

from .test_recorder import at, stream
from .test_steps import run

FP, RAT, CAT = [0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]


def seen(frame, *tracks, offer=None):
    """Rows of a frame with these tracks active."""
    rows = [(frame, k, k, frame, 5, 5, 10 * k, False, (offer or {}).get(k), None, None) for k in tracks]
    return rows or [(frame, *[None] * 10)]


def answer(frame, track, model, scores):
    return [(frame, track, *[None] * 7, model, scores)]


def trace(rows, cadence=f.Cadence()):
    one, out = f.Follower(cadence), []
    for r in rows:
        out += one.row(*r)
    return [*out, *one.gone()]


def requests(rows, **kw):
    return [(r[0], r[1], r[3]) for r in trace(rows, **kw) if r[2] == "request"]


def events(rows, **kw):
    return [(r[0], r[1], r[2]) for r in trace(rows, **kw) if r[2] != "request"]


def test_cadence_without_answers():
    """The cheap model every 10 frames, of a track once in 30; the full one every 25, of a track once in 20 until it has answered twice."""
    rows = [r for k in range(1, 101) for r in seen(k, 1)]
    assert requests(rows) == [(1, 1, "cheap"), (1, 1, "full"), (26, 1, "full"), (41, 1, "cheap"), (51, 1, "full"), (71, 1, "cheap"), (76, 1, "full")]


def test_full_answers_stop_the_cheap_model_and_slow_the_full_one():
    offer = {1: RAT}
    got = requests([r for k in range(1, 161) for r in seen(k, 1, offer=offer)])
    assert [x for x in got if x[2] == "cheap"] == [(1, 1, "cheap")]
    assert [k for k, _, m in got if m == "full"] == [1, 26, 76, 126]  # after two answers 40 frames must pass, so every second turn is left out


def test_one_track_a_turn_the_least_likely_false_positive_first():
    offers = {1: [0.6, 0.4, 0.0], 2: RAT, 3: FP}
    got = requests([r for k in range(1, 52) for r in seen(k, 1, 2, 3, offer=offers)])
    assert got[:4] == [(1, 1, "cheap"), (1, 2, "cheap"), (1, 3, "cheap"), (1, 2, "full")]
    full = [(k, t) for k, t, m in got if m == "full"]
    assert full[1] == (26, 2) and full[2][1] == 1, "track 2 has been answered on twice: now the other that is not sure to be nothing"
    sure = requests([r for k in range(1, 60) for r in seen(k, 3, 4, offer={3: FP, 4: [0.75, 0.25, 0.0]})])
    assert {t for _, t, m in sure if m == "full"} == {4}, "if all are false-positives, the least sure"


def test_answers_fed_back_as_rows():
    rows = [r for k in range(1, 30) for r in seen(k, 1)]
    rows = rows[:5] + answer(5, 1, "cheap", FP) + rows[5:12] + answer(3, 1, "full", CAT) + answer(12, 1, "cheap", FP) + rows[12:]
    out = trace(rows)
    told = [(r[0], r[2], r[4], r[-1]) for r in out if r[2] in ("start", "end")]
    assert told == [(12, "start", 2, 3), (29, "end", 2, 3)], "the late answer of the full model counts, the cheap one after it does not"


def test_events_of_tracks():
    offer = {1: CAT, 2: FP}
    rows = [r for k in range(1, 6) for r in seen(k, 1, 2, offer=offer)]
    rows += seen(6, 2) + seen(7, 2, 3) + seen(8) + [r for k in range(9, 12) for r in seen(k, 4, offer={4: RAT})]
    assert events(rows) == [(1, 1, "start"), (2, 1, "ongoing"), (3, 1, "ongoing"), (4, 1, "ongoing"), (5, 1, "ongoing"), (6, 1, "end"), (8, 3, "filtered"), (11, 4, "start"), (11, 4, "end")]
    start = next(r for r in trace(rows) if r[2] == "start")
    assert start[4:] == (2, pytest.approx(0.6), [pytest.approx(x) for x in CAT], 1, 1, 5, 5, 10, False, 1)


def test_a_track_that_turns_out_to_be_nothing_ends():
    rows = [r for k in range(1, 8) for r in seen(k, 1)]
    rows = rows[:2] + answer(2, 1, "full", CAT) + rows[2:4] + answer(4, 1, "full", FP) + rows[4:6] + answer(6, 1, "full", RAT) + rows[6:]
    assert events(rows) == [(3, 1, "start"), (4, 1, "ongoing"), (5, 1, "end"), (7, 1, "start"), (7, 1, "end")]


def test_rows_of_a_frame_in_any_order():
    rng, rows = random.Random(2), []
    for k in range(1, 90):
        rows.append([*seen(k, *[t for t in range(4) if (k // 7 + t) % 3], offer=None), *(answer(k, k % 4, ("cheap", "full")[k % 2], (FP, RAT, CAT)[k % 3]) if k % 5 == 0 else [])])
    want = trace([r for g in rows for r in g])
    for g in rows:
        rng.shuffle(g)
    assert trace([r for g in rows for r in g]) == want and len(want) > 60


ROWS = f"camera long, ts timestamp, {f.ROWS_DDL}"


def plain(rows):
    return sorted(((r.camera, r.frame_number, r.track_id, r.event, r.model, r.label, r.confidence, tuple(r.scores or ()), r.x, r.y, r.mass, r.blank, r.last_prediction) for r in rows), key=repr)


@pytest.mark.parametrize("cuts", [(20,), (3, 4, 30.5, 31)])
def test_stream_equals_table_and_trace(spark, cuts):
    """Cut between frames and within them; a clip that goes silent is closed by its timer."""
    rows = []
    for c in (1, 2):
        for k in range(1, 60 if c == 1 else 40):
            group = seen(k, *[t for t in range(4) if (k // 9 + t) % 3])
            group += answer(k, k % 4, ("cheap", "full")[k % 2], (FP, RAT, CAT)[k % 3]) if k % 4 == 0 else []
            rows += [(c, at(k + i / 10), *g) for i, g in enumerate(group)]
    df = spark.createDataFrame(rows, ROWS)
    want = plain(f.followed(df).collect())
    by_hand = sorted((r[0], r[1], r[2]) for r in trace([r[2:] for r in rows if r[0] == 1]))
    assert sorted((r[1], r[2], r[3]) for r in want if r[0] == 1) == by_hand
    ticks = spark.createDataFrame([(9, at(s), *seen(int(s))[0]) for s in (1000, 1100, 1200)], ROWS)
    out = run(spark, processors.followed(stream(spark, df.unionByName(ticks), [at(c) for c in (*cuts, 900, 1050, 1150)])), f"followed_{len(cuts)}")
    assert plain(r for r in out.collect() if r.camera != 9) == want


def test_queries_of_the_fixture(spark):
    v = read(spark, "/root/testdata/sf0.001", "v_regions")
    asked = plans.t10_tracks(v).collect()
    rows = plans.offered(v).orderBy("camera", "frame_number").collect()
    want = []
    for c in sorted({r.camera for r in rows}):
        own = [(r.frame_number, r.track_id, *(r[b] for b in f.BOX), r.offer, None, None) for r in rows if r.camera == c]
        want += [(c, *x) for x in requests(own, cadence=plans.CADENCE)]
    assert sorted((r.clip_id, r.frame_number, r.track_id, r.model) for r in asked) == sorted(want) and want
    told = plans.t11(v)
    assert {r.event for r in told.select("event").distinct().collect()} >= {"start", "ongoing", "end"}
    assert told.where("event = 'ongoing' and last_prediction is null").count() == 0
