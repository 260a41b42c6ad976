"""The batch radius join against every pair: the 180th meridian, poles, small and large radii."""

import math
import random

import pytest

from chronoplace.functions import geo


def far(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * geo.EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("radius", [20.0, 300.0, 7000.0])
def test_radius_join_is_whole_round_the_earth(spark, radius):
    draw = random.Random(5)
    step = radius / 60
    points = [(-80.0, 178.0), (-80.0, -179.9), (0.0, 180.0), (0.0, -180.0), (89.95, 0.0), (89.95, 179.0), (-90.0, 10.0), (-89.99, -170.0)]
    points += [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(100)]
    points += [(draw.uniform(-60, 60), lon) for _ in range(60) for lon in (180 - draw.uniform(0, step), draw.uniform(0, step) - 180)]
    points += [(max(-90.0, lat - draw.uniform(0, step)), (lon + draw.uniform(0, step) + 180) % 360 - 180) for lat, lon in points]
    rows = [(i, *p) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "page_id long, lat double, lon double")
    got = geo.radius_join(df.selectExpr("page_id AS query_id", "lat AS q_lat", "lon AS q_lon"), df, radius).select("query_id", "page_id").collect()
    expected = sorted((a[0], b[0]) for a in rows for b in rows if far(a, b) <= radius)
    assert len(expected) > len(rows) and sorted(map(tuple, got)) == expected
