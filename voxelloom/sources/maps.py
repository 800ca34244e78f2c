"""Which map files there are, and which of them a probe uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def catalog(files: DataFrame) -> DataFrame:
    """File names to ``(file, probe, atype)``; raw maps are left out, untyped ones are ``total``."""
    name = F.regexp_replace("file", "^.*/", "")
    typed = F.regexp_extract(name, r"^map_agfe_(.+)_([^_]+)\.dx$", 1)
    probe = F.regexp_extract(name, r"^map_agfe_(?:.+_)?([^_]+)\.dx$", 1)
    return (files.filter(name.rlike(r"^map_agfe_.+\.dx$") & ~name.contains("_raw_"))
            .select("file", probe.alias("probe"),
                    F.when(typed == "", F.lit("total")).otherwise(typed).alias("atype")))


def choose(maps: DataFrame) -> DataFrame:
    """Typed maps of a probe if it has any, else its single map.  A probe has few files."""
    typed = F.max((F.col("atype") != "total").cast("int")).over(Window.partitionBy("probe"))
    return (maps.withColumn("_t", typed)
            .filter((F.col("_t") == 0) | (F.col("atype") != "total"))
            .withColumn("kind", F.when(F.col("_t") == 1, "typed").otherwise("single")).drop("_t"))


def require(maps: DataFrame, probes: list[str]) -> None:
    """Raise for probes without a map, naming what is there."""
    have = {r["probe"] for r in maps.select("probe").distinct().collect()}
    missing = sorted(set(probes) - have)
    if missing:
        raise FileNotFoundError(f"no free-energy maps for {missing}; found maps for {sorted(have)}")
