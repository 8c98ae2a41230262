"""The engine's column functions for SQL: temporary functions whose bodies Spark puts into the plan in place of their calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import geo, geodesy
from tidewake.operators import raster

#: Name in SQL → (its arguments, all DOUBLE, and the function of columns).
FUNCTIONS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "tw_haversine_km": (("lat1", "lon1", "lat2", "lon2"), geo.haversine_km),
    "tw_bearing": (("lat1", "lon1", "lat2", "lon2"), geo.great_circle_bearing),
    "tw_flat_km": (("lat1", "lon1", "lat2", "lon2"), geo.flat_km),
    "tw_flat_bearing": (("lat1", "lon1", "lat2", "lon2"), geo.flat_bearing),
    "tw_turn": (("a", "b"), geo.wrap_degrees),
    "tw_lerp_bearing": (("a", "b", "share"), geo.lerp_bearing),
    "tw_geodesic_km": (("lat1", "lon1", "lat2", "lon2"), geodesy.geodesic_km),
    "tw_to_db": (("v",), raster.to_db),
}


def _text(spark: SparkSession, arguments: tuple[str, ...], body: Callable[..., Column]) -> str:
    """The SQL of a function of columns, as Spark writes the expression that it has analysed."""
    frame = spark.createDataFrame([], ", ".join(f"{a} double" for a in arguments)).select(body(*map(F.col, arguments)).alias("r"))
    expression = frame._jdf.queryExecution().analyzed().expressions().head()
    return expression.child().sql()


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in this session, and returns their names.  They are no UDFs: the optimizer sees through them."""
    for name, (arguments, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} DOUBLE' for a in arguments)}) RETURNS DOUBLE RETURN {_text(spark, arguments, body)}")
    return list(FUNCTIONS)
