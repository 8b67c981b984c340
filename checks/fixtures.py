"""Pipeline inputs derived from the given tables, once as Spark and once as SQL.

Sizes follow the tables: ``P`` pixels (five per scene) from ``orders`` and a
square grid of side ``M`` from ``lineitem``.  See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_FRAMES = 481  # frame t is day0 + 5t, t = 0..480
DAY0 = "1995-01-01"
BANDS = ("s2_B08", "s2_B04", "s2_B03")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_count(spark: SparkSession, sf_dir: str) -> int:
    return max(20, table(spark, sf_dir, "orders").count() // 750)


def grid_side(spark: SparkSession, sf_dir: str) -> int:
    return max(24, int((table(spark, sf_dir, "lineitem").count() // 6) ** 0.5))


def day_of(ts: str):
    return F.datediff(F.col(ts).cast("date"), F.lit(DAY0).cast("date"))


def frame_date(t):
    return F.date_add(F.lit(DAY0).cast("date"), (F.col(t) * 5).cast("int"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloudy, gappy satellite frames: one row per pixel and observed frame."""
    p = pixel_count(spark, sf_dir)
    price, key = F.col("o_totalprice") / 700_019.37, F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .groupBy((F.col("o_custkey") % p).alias("pixel_id"), F.floor(day_of("o_orderdate") / 5).cast("int").alias("t"))
        .agg(
            F.avg(price).alias("s2_B08"),
            F.avg(0.02 + price * (1 + key % 7) / 10).alias("s2_B04"),
            F.avg(0.03 + price * (1 + key % 5) / 10).alias("s2_B03"),
            F.when(F.min(key) % 11 == 0, 1).otherwise(0).alias("s2_mask"),
        )
        .select(
            F.floor(F.col("pixel_id") / 5).alias("scene_id"),
            "pixel_id",
            (F.col("pixel_id") % 5).alias("x"),
            F.floor(F.col("pixel_id") / 5).alias("y"),
            "t",
            frame_date("t").alias("ts"),
            *BANDS,
            "s2_mask",
        )
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather readings per pixel and day."""
    p = pixel_count(spark, sf_dir)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.floor((F.col("l_partkey") % p) / 5).alias("scene_id"), (F.col("l_partkey") % p).alias("pixel_id"), F.col("l_shipdate").cast("date").alias("day"))
        .agg(
            F.sum("l_quantity").alias("era5_tp"),
            (F.max("l_extendedprice") / 3517.31931).alias("era5_maxt"),
            (F.min("l_extendedprice") / 3517.31931).alias("era5_mint"),
            (F.avg("l_extendedprice") / 3517.31931).alias("era5_t"),
            F.avg(F.col("l_tax") * 7.31937).alias("era5_sp"),
            F.sum("l_discount").alias("era5_sr"),
            F.avg(F.col("l_discount") * 3.71319).alias("era5_ap"),
            F.avg(F.col("l_tax") * 11.09171).alias("era5_dp"),
        )
    )


def static_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static layer values per pixel and band, one row per part, nodata as -9999."""
    p = pixel_count(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    hole = F.col("p_size") % 10 == 0
    pixel = (F.col("p_partkey") % p).alias("pixel_id")
    return part.select(
        F.floor(pixel / 5).alias("scene_id"),
        pixel,
        F.col("p_partkey").alias("cell_id"),
        F.when(hole, F.lit(-9999.0)).otherwise(F.col("p_retailprice")).alias("DEM"),
        F.when(hole, F.lit(-9999.0)).otherwise(F.col("p_size").cast("double")).alias("CLAY0_5"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation cells; at the side chosen a few cells stay empty."""
    m = grid_side(spark, sf_dir)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % m).cast("int").alias("row"), (F.col("l_partkey") % m).cast("int").alias("col"))
        .agg((F.avg("l_extendedprice") / 733.71937).alias("z"))
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven overlapping tiles with holes."""
    m = grid_side(spark, sf_dir)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_linenumber").alias("tile_id"),
            (F.col("l_orderkey") % m).cast("int").alias("row"),
            (F.col("l_partkey") % m).cast("int").alias("col"),
        )
        .agg((F.avg("l_extendedprice") / 733.71937).alias("z"))
        .withColumn("z", F.when((31 * F.col("row") + 17 * F.col("col") + F.col("tile_id")) % 4 != 0, F.col("z")))
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed quadrilateral with a hole and a closed triangle per supplier, vertices off the cell centres, numbered in tens."""
    k = F.col("s_suppkey")
    m = grid_side(spark, sf_dir)
    side = 3 + k % 5
    ox, oy = (7 * k) % (m - 8) + F.lit(0.25), (11 * k) % (m - 8) + F.lit(0.25)
    corners = {
        (0, 0): [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)],
        (0, 1): [(0.3, 0.3), (0.7, 0.3), (0.7, 0.7), (0.3, 0.7), (0.3, 0.3)],
        (1, 0): [(0, 0), (1, 0.3), (0.4, 1), (0, 0)],
    }

    def vertices(shape: int, ring: int):
        return F.array(
            *[
                F.struct(F.lit(10 * i).alias("seq"), (ox + shape * 2 + side * dx).alias("px"), (oy + shape + side * dy).alias("py"))
                for i, (dx, dy) in enumerate(corners[shape, ring])
            ]
        )

    both = F.array(*[F.struct((k * 2 + s).alias("poly_id"), F.lit(r).alias("ring_id"), vertices(s, r).alias("v")) for s, r in corners])
    return (
        table(spark, sf_dir, "supplier")
        .select(F.inline(both))
        .select("poly_id", "ring_id", F.inline("v"))
    )


class Sql:
    """The same inputs as SQL common table expressions."""

    P = "(SELECT greatest(20, count(*) // 750) FROM orders)"
    M = "(SELECT greatest(24, CAST(floor(sqrt(count(*) // 6)) AS BIGINT)) FROM lineitem)"

    FRAMES = f"""frames AS (
      SELECT pixel_id // 5 AS scene_id, pixel_id, pixel_id % 5 AS x, pixel_id // 5 AS y, t,
             DATE '{DAY0}' + CAST(5 * t AS INTEGER) AS ts, s2_B08, s2_B04, s2_B03, s2_mask
      FROM (SELECT o_custkey % {P} AS pixel_id,
                   datediff('day', DATE '{DAY0}', CAST(o_orderdate AS DATE)) // 5 AS t,
                   avg(o_totalprice / 700019.37::DOUBLE) AS s2_B08,
                   avg(0.02::DOUBLE + o_totalprice / 700019.37::DOUBLE * (1 + o_orderkey % 7) / 10) AS s2_B04,
                   avg(0.03::DOUBLE + o_totalprice / 700019.37::DOUBLE * (1 + o_orderkey % 5) / 10) AS s2_B03,
                   CASE WHEN min(o_orderkey) % 11 = 0 THEN 1 ELSE 0 END AS s2_mask
            FROM orders GROUP BY 1, 2))"""

    DENSE = FRAMES + f""",
    dense AS (
      SELECT p.scene_id, p.pixel_id, p.x, p.y, c.t, DATE '{DAY0}' + CAST(5 * c.t AS INTEGER) AS ts,
             f.s2_B08, f.s2_B04, f.s2_B03, f.s2_mask,
             CASE WHEN f.s2_B08 + f.s2_B04 <> 0 THEN (f.s2_B08 - f.s2_B04) / (f.s2_B08 + f.s2_B04) END AS s2_ndvi
      FROM (SELECT DISTINCT scene_id, pixel_id, x, y FROM frames) p
      CROSS JOIN (SELECT unnest(range({N_FRAMES})) AS t) c
      LEFT JOIN frames f ON f.pixel_id = p.pixel_id AND f.t = c.t)"""

    WEATHER = f"""weather AS (
      SELECT (l_partkey % {P}) // 5 AS scene_id, l_partkey % {P} AS pixel_id, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS era5_tp,
             max(l_extendedprice) / 3517.31931::DOUBLE AS era5_maxt, min(l_extendedprice) / 3517.31931::DOUBLE AS era5_mint, avg(l_extendedprice) / 3517.31931::DOUBLE AS era5_t,
             avg(l_tax * 7.31937::DOUBLE) AS era5_sp, sum(l_discount) AS era5_sr, avg(l_discount * 3.71319::DOUBLE) AS era5_ap, avg(l_tax * 11.09171::DOUBLE) AS era5_dp
      FROM lineitem GROUP BY 1, 2, 3)"""

    STATIC_RAW = f"""static_raw AS (
      SELECT (p_partkey % {P}) // 5 AS scene_id, p_partkey % {P} AS pixel_id, p_partkey AS cell_id,
             CASE WHEN p_size % 10 = 0 THEN -9999.0 ELSE p_retailprice END AS "DEM",
             CASE WHEN p_size % 10 = 0 THEN -9999.0 ELSE CAST(p_size AS DOUBLE) END AS "CLAY0_5"
      FROM part)"""

    GRID = f"""grid AS (
      SELECT l_orderkey % {M} AS "row", l_partkey % {M} AS col, avg(l_extendedprice) / 733.71937::DOUBLE AS z
      FROM lineitem GROUP BY 1, 2)"""

    TILES = f"""tiles AS (
      SELECT tile_id, "row", col, CASE WHEN (31 * "row" + 17 * col + tile_id) % 4 <> 0 THEN z END AS z
      FROM (SELECT l_linenumber AS tile_id, l_orderkey % {M} AS "row", l_partkey % {M} AS col,
                   avg(l_extendedprice) / 733.71937::DOUBLE AS z
            FROM lineitem GROUP BY 1, 2, 3))"""

    POLYGONS = f"""polygons AS (
      SELECT s_suppkey * 2 + s.shape AS poly_id, s.ring AS ring_id, 10 * s.seq AS seq,
             (7 * s_suppkey) % ({M} - 8) + 0.25::DOUBLE + s.shape * 2 + (3 + s_suppkey % 5) * s.dx AS px,
             (11 * s_suppkey) % ({M} - 8) + 0.25::DOUBLE + s.shape + (3 + s_suppkey % 5) * s.dy AS py
      FROM supplier CROSS JOIN (VALUES (0, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE), (0, 0, 1, 1, 0), (0, 0, 2, 1, 1), (0, 0, 3, 0, 1), (0, 0, 4, 0, 0),
        (0, 1, 0, 0.3, 0.3), (0, 1, 1, 0.7, 0.3), (0, 1, 2, 0.7, 0.7), (0, 1, 3, 0.3, 0.7), (0, 1, 4, 0.3, 0.3),
        (1, 0, 0, 0, 0), (1, 0, 1, 1, 0.3), (1, 0, 2, 0.4, 1), (1, 0, 3, 0, 0)) s(shape, ring, seq, dx, dy))"""


def sql(*parts: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
