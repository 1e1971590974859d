"""The four layouts: what an equality index saves, what was predicted, and what it weighs. Bytes and files don't depend on the machine."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import operators as ops
from tessera.cost import Spread
from tessera.session import Session
from tessera.sources.tablelog import Table
from tessera.workload import Policy

FILES, TENANTS = 20, 5000


def rows_of(spark: SparkSession, rows: int) -> DataFrame:
    """n, ts, message, and a pseudo-random number for each row."""
    r = F.pmod(F.xxhash64("id"), F.lit(2**31))
    return spark.range(0, rows, 1, 1).select("id", r.alias("r"), (F.lit(1_700_000_000) + F.col("id")).alias("ts"), F.concat(F.lit("message "), F.sha2(F.col("id").cast("string"), 224)).alias("message"))


def layout(spark: SparkSession, name: str, rows: int) -> DataFrame:
    """clustered: tenants by range of files; scattered: every tenant in every file; selective: a tenant a row; partial: each in three files."""
    d, file = rows_of(spark, rows), F.pmod(F.col("id"), F.lit(FILES))
    match name:
        case "clustered":
            d = d.withColumn("tenant_id", F.pmod("r", F.lit(TENANTS))).withColumn("file", F.floor(F.col("tenant_id") * FILES / TENANTS).cast("int"))
        case "scattered":
            d = d.withColumn("tenant_id", F.pmod("r", F.lit(TENANTS))).withColumn("file", file.cast("int"))
        case "selective":
            d = d.withColumn("tenant_id", F.col("r")).withColumn("file", file.cast("int"))
        case "partial":
            d = d.withColumn("tenant_id", F.pmod("r", F.lit(TENANTS)))
            d = d.withColumn("file", F.pmod(F.xxhash64("tenant_id", F.pmod("id", F.lit(3))), F.lit(FILES)).cast("int"))
    return d.select("tenant_id", "ts", "message", "file").repartitionById(FILES, F.col("file")).drop("file")


@dataclass
class Measured:
    layout: str
    files: int
    table_mb: float
    index_mb: float
    index_share: float
    build_s: float
    overlap: float
    files_per_value_estimated: float
    files_per_value: float
    predicted_saving: float
    realized_saving: float
    bounds_saving: float
    decision: str
    plan_s: float
    query_s: float
    query_unaided_s: float
    same_rows: bool


def measure(spark: SparkSession, root: str, name: str, rows: int = 1_000_000) -> Measured:
    t = Table.create(layout(spark, name, rows), f"m_{name}", f"{root}/{name}")
    s = Session(spark)
    s.attach(t)
    overlap = ops.estimate_overlap(t, "tenant_id") or 0.0
    spread = Spread.from_bounds([f.bounds.get("tenant_id") for f in t.live()], overlap)
    started = time.time()
    piece = ops.build_index(t, "tenant_id")
    build_s = time.time() - started
    per_value = spark.read.parquet(piece.kind.path).groupBy("value").count().agg(F.avg("count")).first()[0]
    values = [r[0] for r in t.read().select("tenant_id").orderBy(F.xxhash64("tenant_id")).limit(12).collect()]
    s.registry.register(piece)
    planned = unaided = by_bounds = 0
    times: dict[str, list[float]] = {"plan": [], "aided": [], "plain": []}
    same = True
    for v in values:
        sql = f"SELECT ts, message FROM m_{name} WHERE tenant_id = {v}"
        started = time.time()
        df = s.sql(sql)
        times["plan"].append(time.time() - started)
        got = df.collect()
        times["aided"].append(time.time() - started)
        planned += sum(t.files[f].bytes for f in piece.kind.probe(frozenset((f"{v}L",))))
        started = time.time()
        plain = s.unaided(sql).collect()
        times["plain"].append(time.time() - started)
        same &= sorted(got) == sorted(plain)
        unaided += t.bytes
        by_bounds += sum(f.bytes for f in t.live() if f.bounds["tenant_id"][0] <= v <= f.bounds["tenant_id"][1])
    # the first questions compile
    plan_s, aided_s, plain_s = (round(median(x[2:]), 3) for x in times.values())
    predicted = spread.index_advantage()
    return Measured(
        name, len(t.live()), round(t.bytes / 1e6, 2), round(piece.kind.bytes / 1e6, 3), round(piece.kind.bytes / t.bytes, 4), round(build_s, 2), round(overlap, 3), round(spread.per_value, 2), round(per_value, 2), round(predicted, 3),
        round((by_bounds - planned) / unaided, 3), round(1 - by_bounds / unaided, 3), "build" if predicted >= Policy().min_advantage else "refuse", plan_s, aided_s, plain_s, same,
    )


def all_layouts(spark: SparkSession, root: str, rows: int = 1_000_000) -> list[dict]:
    return [asdict(measure(spark, root, name, rows)) for name in ("clustered", "scattered", "selective", "partial")]
