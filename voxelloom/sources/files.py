"""Tables in and out: zones, statistics, probe lists, hotspot and site exports, checkpoints."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxelloom.functions.export import joined, rounded


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """``(x, y, z)`` from a CSV with those columns in any case; other columns are ignored."""
    df = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in df.columns}
    missing = [a for a in "xyz" if a not in names]
    if missing:
        raise ValueError(f"{path}: zones need x, y, z columns; missing {missing} (found {df.columns})")
    return df.select(*[F.col(f"`{names[a]}`").cast("double").alias(a) for a in "xyz"])


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Energy, temperature and volume of a simulation log."""
    df = spark.read.csv(path, header=True)
    wanted = {"Potential Energy (kJ/mole)": "energy", "Temperature (K)": "temperature", "Box Volume (nm^3)": "volume"}
    return df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in wanted.items()])


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Probe list ``(resname, name, smiles, concentration)`` from a JSON array."""
    return spark.read.schema("resname string, name string, smiles string, concentration double, copies int").json(
        path, multiLine=True)


def read_atom_types(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Atom type rules in priority order from ``{set: [{atype, smarts}]}``."""
    df = spark.read.json(path, multiLine=True)
    names = [key] if key else df.columns[:1]
    return df.select(F.posexplode(names[0]).alias("priority", "rule")).select("priority", "rule.atype", "rule.smarts")


def assign_types(atoms: DataFrame, matches: DataFrame, atom: str = "atom_id") -> DataFrame:
    """First matching type per atom by priority; atoms without a match are left out.

    *matches* is ``(atom_id, priority, atype)``, the rule matches of a chemistry toolkit.
    """
    first = matches.groupBy(atom).agg(F.min_by("atype", "priority").alias("atype"))
    return atoms.join(first, atom)


def hotspot_table(rows: DataFrame) -> DataFrame:
    """Hotspot rows as exported: rounded, lists joined by commas."""
    cols = ["rank", F.col("label").alias("site_id"), F.col("probe").alias("cosolvent"), "n_voxels",
            *[rounded(f"centroid_{c}", 3).alias(f"centroid_{c}") for c in "xyz"],
            rounded("agfe_min").alias("agfe_min"), rounded("agfe_mean_top_pct").alias("agfe_mean_top_pct")]
    if "favorable_atomtypes" in rows.columns:
        cols.append(joined("favorable_atomtypes").alias("favorable_atomtypes"))
    known = {"rank", "label", "probe", "n_voxels", "agfe_min", "agfe_mean_top_pct", "favorable_atomtypes",
             "centroid_x", "centroid_y", "centroid_z", "per_type_agfe"}
    return rows.select(*cols, *[c for c in rows.columns if c not in known])


def write_hotspots(table: DataFrame, path: str) -> None:
    """Per-probe CSV and JSON, a geometry sidecar, and one TSV over all, deepest first.

    Probes are folders of one partitioned write, not a loop over probes.
    """
    plain = table.select(*[c for c in table.columns if not c.startswith("geom_")])
    plain.write.mode("overwrite").partitionBy("cosolvent").csv(os.path.join(path, "hotspot_sites"), header=True)
    table.write.mode("overwrite").partitionBy("cosolvent").json(os.path.join(path, "hotspot_sites_json"))
    geom = [c for c in table.columns if c.startswith("geom_")]
    if geom:
        (table.select("cosolvent", "site_id", *geom).write.mode("overwrite").partitionBy("cosolvent")
         .csv(os.path.join(path, "hotspot_sites_geom"), header=True))
    plain.orderBy("agfe_min", "cosolvent", "site_id").write.mode("overwrite").csv(
        os.path.join(path, "hotspot_sites_all"), header=True, sep="\t")


def read_hotspots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The per-probe tables as one; an empty one when there are none."""
    full = os.path.join(path, "hotspot_sites")
    return (spark.read.schema(schema).csv(full, header=True) if exists(spark, full)
            else spark.createDataFrame([], schema))


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """CSV tables with differing columns as one; missing columns read NULL."""
    out = None
    for p in paths:
        part = spark.read.csv(p, header=True)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def site_rows(sites: DataFrame) -> DataFrame:
    """Binding-site rows as exported."""
    have = set(sites.columns)

    def num(name, digits=4) -> Column:
        c = rounded(name, digits) if name in have else F.lit(None).cast("double")
        return c.alias(name)

    def text(name) -> Column:
        return (joined(name) if name in have else F.lit(None).cast("string")).alias(name)

    def plain(name) -> Column:
        return (F.col(name) if name in have else F.lit(None).cast("int")).alias(name)

    return sites.select(
        "site_id", plain("rank"), num("combined"), text("cosolvents"), plain("n_cosolvents"), num("probe_coverage"),
        text("probe_chemotypes"), plain("n_probe_chemotypes"), num("probe_chemotype_coverage"), plain("n_hotspots"),
        text("member_hotspot_ids"), *[num(f"centroid_{c}", 3) for c in "xyz"], num("agfe_min"),
        num("agfe_mean_top_pct"), num("volume", 3), num("solidity"), num("extent"), num("axis_major_length"),
        num("axis_minor_length"), text("favorable_atomtypes"),
        (F.size("favorable_atomtypes") if "favorable_atomtypes" in have else F.lit(0)).alias("n_chemotypes"),
        num("residence"), F.lit("sp_half_life").alias("residence_metric"), num("accessible_fraction"))


def write_sites(sites: DataFrame, pharmacophore: DataFrame, labels: DataFrame, path: str) -> None:
    """Site table as CSV and JSON, pharmacophore as JSON, rank per voxel as Parquet."""
    rows = site_rows(sites)
    rows.orderBy("rank").write.mode("overwrite").csv(os.path.join(path, "binding_sites"), header=True)
    rows.write.mode("overwrite").json(os.path.join(path, "binding_sites_json"))
    pharmacophore.write.mode("overwrite").json(os.path.join(path, "binding_sites_pharmacophore"))
    labels.write.mode("overwrite").parquet(os.path.join(path, "binding_site_labels"))


def save_checkpoint(rows: DataFrame, voxels: DataFrame, path: str) -> None:
    """Hotspot rows and voxels by probe; a probe without hotspots has no folder."""
    rows.write.mode("overwrite").partitionBy("probe").parquet(os.path.join(path, "hotspots"))
    voxels.write.mode("overwrite").partitionBy("probe").parquet(os.path.join(path, "hotspot_voxels"))


def load_checkpoint(spark: SparkSession, path: str, probes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and voxels back; a probe that was asked for and is not there is an error."""
    if not exists(spark, os.path.join(path, "hotspots")):
        raise FileNotFoundError(f"no hotspot checkpoint under {path}")
    rows = spark.read.parquet(os.path.join(path, "hotspots"))
    voxels = spark.read.parquet(os.path.join(path, "hotspot_voxels"))
    if probes is not None:
        missing = [p for p in probes if not exists(spark, os.path.join(path, "hotspots", f"probe={p}"))]
        if missing:
            raise FileNotFoundError(f"no hotspot checkpoint for {missing} under {path}")
        rows, voxels = rows.filter(F.col("probe").isin(probes)), voxels.filter(F.col("probe").isin(probes))
    return rows, voxels


def residue_json(residues: DataFrame, by: list[str]) -> DataFrame:
    """Pocket residues as one JSON text each, with absent values left out."""
    cols = [c for c in residues.columns if c not in by]
    return residues.select(*by, F.to_json(F.struct(*cols)).alias("residue"))


def residue_rows(texts: DataFrame, by: list[str], schema: str) -> DataFrame:
    return texts.select(*by, F.from_json("residue", schema).alias("r")).select(*by, "r.*")
