"""Binds the given tables to the logical tables of :mod:`channelspark.schemas`.

Each binding exists twice: as a DataFrame and as an equivalent SQL view for the checks. Keys are
derived so that the number of scenes, links and channels grows with the tables while the size of
one scene stays constant (105 users and 7 stations).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the test layout.
UE_PER_SCENE = 105
BS_PER_SCENE = 7
SUBCARRIERS = 32
SPACING_HZ = 1.0e6
CENTER_HZ = 3.5e9


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    ue = table(spark, sf, "customer").select(
        F.expr(f"c_custkey div {UE_PER_SCENE}").alias("scene_id"),
        F.lit("ue").alias("role"),
        F.col("c_custkey").alias("idx"),
        (F.col("c_custkey") * 7 % 11 * F.lit(0.5)).alias("x"),
        (F.col("c_custkey") % 9 * F.lit(0.5)).alias("y"),
        F.lit(1.5).alias("z"),
        F.col("c_name").alias("label"),
    )
    bs = table(spark, sf, "supplier").select(
        F.expr(f"s_suppkey div {BS_PER_SCENE}").alias("scene_id"),
        F.lit("bs").alias("role"),
        F.col("s_suppkey").alias("idx"),
        (F.col("s_suppkey") % BS_PER_SCENE * F.lit(2.5)).alias("x"),
        (F.col("s_suppkey") % 3 * F.lit(5.0)).alias("y"),
        F.lit(3.0).alias("z"),
        F.col("s_name").alias("label"),
    )
    return ue.unionByName(bs)


def paths(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    codes = (
        F.when(flag == "A", F.array().cast("array<int>"))
        .when(flag == "N", F.array(F.lit(1)))
        .otherwise(F.array(F.lit(1), F.lit(2)))
    )
    return table(spark, sf, "lineitem").select(
        F.expr("l_orderkey div 10").alias("tx"),
        (F.col("l_suppkey") % 3).alias("rx"),
        (F.col("l_linenumber") % 2).cast("int").alias("rx_ant"),
        (F.col("l_partkey") % 2).cast("int").alias("tx_ant"),
        (F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10 + F.col("l_linenumber"))
        .alias("path"),
        (F.col("l_quantity") * F.lit(1e-9)).alias("tau_s"),
        (F.col("l_discount") - F.lit(0.05)).alias("a_re"),
        (F.col("l_tax") - F.lit(0.04)).alias("a_im"),
        (F.col("l_quantity") - F.lit(25.0)).alias("doppler_hz"),
        (F.col("l_linenumber") * F.lit(0.25)).alias("theta_t"),
        (F.col("l_orderkey") % 628 * F.lit(0.01) - F.lit(3.14)).alias("phi_t"),
        (F.col("l_suppkey") % 314 * F.lit(0.01)).alias("theta_r"),
        (F.col("l_partkey") % 628 * F.lit(0.01) - F.lit(3.14)).alias("phi_r"),
        codes.alias("interactions"),
    )


def rss(spark: SparkSession, sf: str) -> DataFrame:
    """First measurement of every link, picked by a map-side combined aggregate."""
    link_bs = F.expr(f"user_id div {UE_PER_SCENE} * {BS_PER_SCENE} + event_id % {BS_PER_SCENE}")
    first = F.min_by(
        F.struct((F.lit(-40.0) - F.col("value") / 5.0).alias("rssi_dbm"),
                 (F.col("event_type") != "error").alias("valid")),
        F.struct("ts", "event_id"),
    )
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("ue"), link_bs.alias("bs"))
        .agg(first.alias("m"))
        .select("ue", "bs", "m.rssi_dbm", "m.valid")
    )


def ranging(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("l_discount") > 0.01
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "pdp_peak").otherwise("phase_slope")
        .alias("estimator"),
        ok.alias("success"),
        F.col("l_quantity").alias("truth_m"),
        F.when(ok, F.col("l_quantity") * (1 + F.col("l_tax"))).alias("range_m"),
    )


def perf(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("worker"), F.col("event_type").alias("stage"),
        F.col("value").alias("duration_s"), (F.col("event_id") * 10).alias("raw_bytes"),
        F.when(F.col("event_id") % 10 == 0, F.lit(-1).cast("bigint"))
        .otherwise(F.col("event_id") * 4).alias("storage_bytes"),
    )


def queue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "planned").otherwise("failed").alias("status"),
    )


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    bs = (1 + F.col("p_size") % 8).cast("bigint")
    ue = (F.col("p_size") * 10).cast("bigint")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("source_scene_index"), F.col("p_brand").alias("scene_class"),
        F.concat(F.lit("scene_"), F.col("p_partkey").cast("string")).alias("scene_key"),
        bs.alias("bs_count"), ue.alias("ue_count"), (bs * ue).alias("link_count"),
    )


def cfr(spark: SparkSession, sf: str) -> DataFrame:
    """One row per antenna pair; the 64 floats are 32 interleaved complex samples."""
    sample = "transform(sequence(0, size(embedding) div 2 - 1), k -> named_struct(" \
             "'re', cast(embedding[2 * k] as double), 'im', cast(embedding[2 * k + 1] as double)))"
    return table(spark, sf, "embeddings").select(
        "vec_id", "label",
        F.expr("vec_id div 20").alias("tx"),
        F.expr("vec_id div 4 % 5").alias("rx"),
        (F.col("vec_id") % 4).alias("rx_ant"),
        F.expr(sample).alias("h"),
    )


def cfr_axes(spark: SparkSession, sf: str) -> DataFrame:
    """The same vectors laid out with two snapshots and two transmit antennas per link."""
    return cfr(spark, sf).withColumns({
        "tx_ant": F.expr("vec_id div 4 % 2"), "snapshot": F.expr("vec_id div 8 % 2"),
        "rx": F.expr("vec_id div 16 % 5"), "tx": F.expr("vec_id div 80"),
    })


def samples(cfr_rows: DataFrame, column: str = "h") -> DataFrame:
    """Array rows to one row per subcarrier (k, re, im)."""
    keys = [c for c in cfr_rows.columns if c != column]
    return cfr_rows.select(*keys, F.posexplode(column).alias("k", "s")).select(
        *keys, "k", "s.re", "s.im"
    )


def previous(h: DataFrame) -> Column:
    """Identifier of the vector before each one; the first vector follows the last."""
    count = h.agg(F.max("vec_id") + 1).scalar()
    return F.pmod(F.col("vec_id") - 1, count)


def cfr_est(spark: SparkSession, sf: str) -> DataFrame:
    """Truth and estimate side by side: est = h + 0.1 * h(next vector); the first follows the last."""
    h = cfr(spark, sf)
    noise = h.select(previous(h).alias("vec_id"), F.col("h").alias("n"))
    est = F.zip_with(
        "h", "n",
        lambda a, b: F.struct((a["re"] + F.lit(0.1) * b["re"]).alias("re"),
                              (a["im"] + F.lit(0.1) * b["im"]).alias("im")),
    )
    return h.join(noise, "vec_id").withColumn("est", est).drop("n")


VIEWS: dict[str, str] = {
    "fx_points": f"""SELECT c_custkey // {UE_PER_SCENE} AS scene_id, 'ue' AS role, c_custkey AS idx,
  CAST(c_custkey * 7 % 11 AS DOUBLE) * 0.5::DOUBLE AS x, CAST(c_custkey % 9 AS DOUBLE) * 0.5::DOUBLE AS y,
  1.5::DOUBLE AS z, c_name AS label FROM customer
  UNION ALL SELECT s_suppkey // {BS_PER_SCENE}, 'bs', s_suppkey,
  CAST(s_suppkey % {BS_PER_SCENE} AS DOUBLE) * 2.5::DOUBLE, CAST(s_suppkey % 3 AS DOUBLE) * 5.0::DOUBLE,
  3.0::DOUBLE, s_name FROM supplier""",
    "fx_paths": """SELECT l_orderkey // 10 AS tx, l_suppkey % 3 AS rx, CAST(l_linenumber % 2 AS INTEGER) AS rx_ant,
  CAST(l_partkey % 2 AS INTEGER) AS tx_ant,
  CAST(ROUND(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS path,
  l_quantity * 1e-9::DOUBLE AS tau_s, l_discount - 0.05::DOUBLE AS a_re, l_tax - 0.04::DOUBLE AS a_im,
  l_quantity - 25.0::DOUBLE AS doppler_hz, l_linenumber * 0.25::DOUBLE AS theta_t,
  CAST(l_orderkey % 628 AS DOUBLE) * 0.01::DOUBLE - 3.14::DOUBLE AS phi_t,
  CAST(l_suppkey % 314 AS DOUBLE) * 0.01::DOUBLE AS theta_r,
  CAST(l_partkey % 628 AS DOUBLE) * 0.01::DOUBLE - 3.14::DOUBLE AS phi_r,
  CASE l_returnflag WHEN 'A' THEN []::INTEGER[] WHEN 'N' THEN [1] ELSE [1, 2] END AS interactions,
  l_returnflag AS flag FROM lineitem""",
    "fx_rss": f"""SELECT ue, bs, rssi_dbm, valid FROM (
  SELECT user_id AS ue, user_id // {UE_PER_SCENE} * {BS_PER_SCENE} + event_id % {BS_PER_SCENE} AS bs,
  -40.0::DOUBLE - value / 5.0::DOUBLE AS rssi_dbm, event_type <> 'error' AS valid,
  ROW_NUMBER() OVER (PARTITION BY user_id, event_id % {BS_PER_SCENE} ORDER BY ts, event_id) AS rn
  FROM events) t WHERE rn = 1""",
    "fx_ranging": """SELECT CASE WHEN l_linestatus = 'O' THEN 'pdp_peak' ELSE 'phase_slope' END AS estimator,
  l_discount > 0.01::DOUBLE AS success, l_quantity AS truth_m,
  CASE WHEN l_discount > 0.01::DOUBLE THEN l_quantity * (1.0::DOUBLE + l_tax) END AS range_m FROM lineitem""",
    "fx_perf": """SELECT event_id, ts, user_id AS worker, event_type AS stage, value AS duration_s,
  event_id * 10 AS raw_bytes, CASE WHEN event_id % 10 = 0 THEN -1 ELSE event_id * 4 END AS storage_bytes
  FROM events""",
    "fx_queue": """SELECT o_custkey AS entity, o_orderkey AS seq, o_orderdate AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'planned' ELSE 'failed' END AS status FROM orders""",
    "fx_scenes": """SELECT p_partkey AS source_scene_index, p_brand AS scene_class, 'scene_' || p_partkey AS scene_key,
  CAST(1 + p_size % 8 AS BIGINT) AS bs_count, CAST(p_size * 10 AS BIGINT) AS ue_count,
  CAST((1 + p_size % 8) * p_size * 10 AS BIGINT) AS link_count FROM part""",
    "fx_cfr": """SELECT vec_id, label, vec_id // 20 AS tx, vec_id // 4 % 5 AS rx, vec_id % 4 AS rx_ant, k,
  CAST(embedding[2 * k + 1] AS DOUBLE) AS re, CAST(embedding[2 * k + 2] AS DOUBLE) AS im
  FROM embeddings, (SELECT UNNEST(RANGE(32)) AS k) ks""",
    "fx_est": """SELECT a.vec_id, a.label, a.tx, a.rx, a.rx_ant, a.k, a.re, a.im, a.re + 0.1::DOUBLE * b.re AS ere,
  a.im + 0.1::DOUBLE * b.im AS eim FROM fx_cfr a JOIN fx_cfr b ON b.vec_id = (a.vec_id + 1) % (SELECT MAX(vec_id) + 1 FROM embeddings) AND b.k = a.k""",
}
VIEWS["fx_axes"] = """SELECT vec_id // 80 AS tx, vec_id // 16 % 5 AS rx, vec_id // 8 % 2 AS snapshot, vec_id // 4 % 2 AS tx_ant, rx_ant, k, re, im FROM fx_cfr"""
_DEPENDS = {"fx_est": ("fx_cfr",), "fx_axes": ("fx_cfr",)}


def with_views(sql: str, *views: str) -> str:
    """Prefix a SELECT (or further ``name AS (...)`` items) with the views it reads."""
    needed: list[str] = []
    for view in views:
        for name in (*_DEPENDS.get(view, ()), view):
            if name not in needed:
                needed.append(name)
    prelude = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE"):] if recursive else body[len("WITH"):]
        joined = f"{prelude}, {body.strip()}" if prelude else body.strip()
    else:
        joined = f"{prelude} {body}"
        if not prelude:
            return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}"
