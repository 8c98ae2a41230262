"""Ellipsoidal measures and grid coordinates against published values and closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from tidewake.functions import geodesy
from tidewake.operators import raster


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def ring(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])


@pytest.mark.parametrize("legs, km", [((0, 0, 0, 1), 111.31949), ((0, 0, 1, 0), 110.57439), ((0, 0, 90, 0), 10001.96573), ((15, 73, 15, 73), 0.0)])
def test_lengths(spark, legs, km):
    assert abs(value(spark, geodesy.geodesic_km(*[F.lit(float(x)) for x in legs])) - km) <= 1e-5 * km + 1e-9


def test_an_octant_is_an_eighth_of_the_ellipsoid(spark):
    area = value(spark, geodesy.ring_geodesic_km2(ring([(0, 0), (90, 0), (90, 90), (0, 90), (0, 0)])))
    assert abs(area - 510_065_621.724 / 8) < 1


def test_a_known_tower_on_the_grid(spark):
    east, north = geodesy.to_utm(F.lit(43.642567), F.lit(-79.387139), F.lit(17))
    assert abs(value(spark, east) - 630_084) < 8 and abs(value(spark, north) - 4_833_439) < 8


@pytest.mark.parametrize("lat, lon, zone", [(-33.9, 18.4, 34), (0.0, 3.0, 31), (79.5, 14.2, 33)])
def test_there_and_back(spark, lat, lon, zone):
    east, north = geodesy.to_utm(F.lit(lat), F.lit(lon), F.lit(zone))
    back = value(spark, F.array(*geodesy.from_utm(east, north, F.lit(zone), F.lit(lat < 0))))
    assert math.dist(back, (lat, lon)) < 1e-8


def test_reprojection_keeps_a_plane(spark):
    """Bilinear weights give a linear field back; the field is the easting."""
    cells = [(0, y, x, 500_050.0 + 100 * x) for y in range(40) for x in range(40)]
    px = spark.createDataFrame(cells, "scene_id long, y long, x long, v double")
    out = raster.reprojected(px, (100.0, 0.0, 500_000.0, 0.0, -100.0, 1_662_000.0), 43, (0.0005, 0.0, 75.005, 0.0, -0.0005, 15.02), 20, 20)
    lon, lat = 0.0005 * (F.col("x") + 0.5) + 75.005, -0.0005 * (F.col("y") + 0.5) + 15.02
    got = out.select((F.col("v") - geodesy.to_utm(lat, lon, F.lit(43))[0]).alias("off")).collect()
    assert len(got) == 400 and max(abs(r.off) for r in got) < 1e-6


def test_no_pixel_no_value(spark):
    px = spark.createDataFrame([], "scene_id long, y long, x long, v double")
    assert raster.reprojected(px, (100.0, 0.0, 0.0, 0.0, -100.0, 0.0), 43, (0.001, 0.0, 75.0, 0.0, -0.001, 15.0), 3, 3).isEmpty()


def test_components_in_degrees_measure_like_their_ring(spark):
    cells = [(0, y, x) for y in range(3, 7) for x in range(2, 12)]
    got = raster.polygons(spark.createDataFrame(cells, "scene_id long, y long, x long"), 20, (0.001, 0.0, 73.0, 0.0, -0.001, 15.2), degrees=True).first()
    box = ring([(73.002, 15.193), (73.012, 15.193), (73.012, 15.197), (73.002, 15.197), (73.002, 15.193)])
    assert abs(got.area_km2 / value(spark, geodesy.ring_geodesic_km2(box)) - 1) < 1e-5
    assert abs(got.perimeter_km / value(spark, geodesy.ring_geodesic_km(box)) - 1) < 1e-6


def test_projections_by_code(spark):
    import math

    import pytest
    from pyspark.sql import functions as F

    from tidewake.functions import geodesy

    def at(epsg, lat, lon):
        x, y = geodesy.projection(epsg)(F.lit(float(lat)), F.lit(float(lon)))
        return tuple(spark.range(1).select(x.alias("x"), y.alias("y")).first())

    assert at(4326, 3, 4) == (4, 3)
    assert at(3857, 45, 90) == pytest.approx((10018754.171394622, 5621521.486192066), abs=1e-3)
    # on the latitude where a polar map is true, its circle is as long as the parallel
    e2 = geodesy.E2
    radius = lambda lat: 6378137 * math.cos(math.radians(lat)) / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
    assert at(3413, 70, -45) == pytest.approx((0, -radius(70)), abs=1e-3) and at(3413, 70, 45) == pytest.approx((radius(70), 0), abs=1e-3)
    assert at(3031, -71, 0) == pytest.approx((0, radius(71)), abs=1e-3) and at(3031, -71, 90) == pytest.approx((radius(71), 0), abs=1e-3)
    assert at(3413, 90, 0) == pytest.approx((0, 0), abs=1e-6)
    east, north = at(32643, 15.5, 75.5)
    assert at(32743, -15.5, 75.5) == pytest.approx((east, 10_000_000 - north)) and at(32643, -15.5, 75.5) == pytest.approx((east, -north))
    with pytest.raises(ValueError):
        geodesy.projection(27700)


def test_a_reprojection_does_not_grow_its_grid_with_the_scenes(spark, monkeypatch):
    """Weights are a table of the new grid alone, broadcast or, above FEW, shuffled: both give the same, scene by scene."""
    cells = [(s, y, x, s + 10.0 * y + x) for s in range(3) for y in range(40) for x in range(40) if s or (x + y) % 3]
    px = spark.createDataFrame(cells, "scene_id long, y long, x long, v double")

    def run():
        out = raster.reprojected(px, (100.0, 0.0, 500_000.0, 0.0, -100.0, 1_662_000.0), 43, (0.0009, 0.0, 75.0, 0.0, -0.0009, 15.03), 45, 45)
        got = {(r.scene_id, r.y, r.x): r.v for r in out.collect()}
        return got, out._jdf.queryExecution().executedPlan().toString()

    few, plan = run()
    assert "BroadcastHashJoin [y" in plan
    monkeypatch.setattr(raster, "FEW", 0)
    many, plan = run()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert few.keys() == many.keys() and max(abs(few[k] - many[k]) for k in few) < 1e-9
    one = {k[1:]: v for k, v in few.items() if k[0] == 1}
    assert len(one) > 1000 and one == pytest.approx({k[1:]: v - 1 for k, v in few.items() if k[0] == 2})
