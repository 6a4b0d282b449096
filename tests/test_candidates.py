"""Which regions a track may go on with, by hand."""

from trackspark.functions import geometry as g
from trackspark.operators import tracks as t
from pyspark.sql import functions as F


def test_gates_of_candidates(spark):
    box = lambda track, frame, x, y=50, size=10, mass=100, blank=False: (1, track, frame, x, y, size, size, mass, blank)
    rows = [box(1, f, 50) for f in range(14)] + [box(1, 14, 50)]
    rows += [
        box(2, 15, 55),  # five to the right: 25
        box(3, 15, 72),  # too far: 484 > 450
        box(4, 15, 50, mass=156),  # too heavy for an old track: 56 > 55
        box(5, 15, 50, size=19),  # too large: 261 / 150 > 1.5
        box(6, 15, 50, blank=True),  # nothing seen
        box(7, 1, 50, mass=500),  # a young track has no gate for mass
    ]
    regions = spark.createDataFrame(rows, "clip_id long, track_id long, frame_number int, x int, y int, width int, height int, mass int, blank boolean")
    inner = g.Box(F.lit(1), F.lit(1), F.lit(157), F.lit(117))
    found = t.match_candidates(t.match_gates(t.with_border(t.with_velocity(t.recent_means(regions)), inner)))
    got = {(r.frame_number, r.region_track): r.score for r in found.where("track_id = 1").collect()}
    assert {k: v for k, v in got.items() if k[0] == 15} == {(15, 2): 25.0}
    assert got[1, 7] == 0.0 and all(got[f, 1] == 0.0 for f in range(1, 15)) and len(got) == 16
    assert t.match_candidates(t.match_gates(t.with_border(t.with_velocity(t.recent_means(regions.limit(0))), inner))).count() == 0
