"""Binding sites: hotspots of all probes grouped where their masks touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxelloom.functions import chemotypes
from voxelloom.lattice import IJK, ball_offsets
from voxelloom.operators import components, regions, stencil
from voxelloom.spark import cut, ranked

# The survival metric that feeds the kinetics feature.
KINETICS_METRIC = "sp_half_life"


def group(members: DataFrame, gridsize: float, connectivity: int = 6, tolerance: float = 0.0,
          keys=("probe", "label")) -> DataFrame:
    """``(keys, site_id)``: the site each hotspot belongs to.

    The union of all masks is grown by half the tolerance for the grouping only, then
    labelled; a hotspot goes where most of its own voxels lie, the lower label on a tie.
    Site numbers follow the raster order of the labels that got a hotspot.
    """
    union = members.select(*IJK).distinct()
    reach = max(0, round((tolerance / 2.0) / gridsize))
    grown = stencil.dilate(union, [], ball_offsets(reach)) if reach else union
    found = components.components(grown, [], connectivity)
    votes = (members.select(*keys, *IJK).join(found.select(*IJK, "root"), list(IJK))
             .groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("_n")))
    chosen = votes.groupBy(*keys).agg(F.max_by("root", F.struct("_n", -F.col("root"))).alias("root"))
    chosen = cut(chosen)
    ids = ranked(chosen.select("root").distinct(), [], ["root"], name="site_id")
    return chosen.join(ids, "root").select(*keys, "site_id")


def site_voxels(members: DataFrame, membership: DataFrame, keys=("probe", "label")) -> DataFrame:
    """The union mask of each site, undilated."""
    return members.select(*keys, *IJK).join(membership, list(keys)).select("site_id", *IJK).distinct()


def roll_up(rows: DataFrame, membership: DataFrame, voxels: DataFrame, gridsize: float,
            panel: DataFrame, keys=("probe", "label"), overrides: dict | None = None) -> DataFrame:
    """One row per site from its hotspot rows; *overrides* are own classes of probes.

    The centroid weighs members by their depth, unless one has none.  Optional columns of
    the rows (residence, accessible_fraction, agfe_mean_top_pct) are used where present.
    """
    have = set(rows.columns)
    m = cut(rows.join(membership, list(keys)))
    w = F.abs("agfe_min")
    weighted = (F.count("agfe_min") == F.count(F.lit(1))) & (F.sum(w) > 0)
    aggs = [F.min("agfe_min").alias("agfe_min"), F.count(F.lit(1)).alias("n_hotspots"),
            F.sort_array(F.collect_set("probe")).alias("cosolvents"),
            F.sort_array(F.collect_list(F.concat_ws("_", *keys))).alias("member_hotspot_ids")]
    for c in "xyz":
        p = F.col(f"centroid_{c}")
        aggs.append(F.when(weighted, F.try_divide(F.sum(w * p), F.sum(w))).otherwise(F.avg(p)).alias(f"centroid_{c}"))
    for name, fn in (("agfe_mean_top_pct", F.min), (KINETICS_METRIC, F.max), ("accessible_fraction", F.avg),
                     ("field_contrast", F.min), ("field_sharpness", F.max)):
        if name in have:
            aggs.append(fn(name).alias("residence" if name == KINETICS_METRIC else name))
    out = m.groupBy("site_id").agg(*aggs)
    size = voxels.groupBy("site_id").agg((F.count(F.lit(1)) * F.lit(gridsize ** 3)).alias("volume"))
    classes = chemotypes.of_groups(m, ["site_id"], overrides=overrides)
    n_panel = panel.agg(F.count_distinct("probe")).scalar()
    out = out.join(size, "site_id").join(classes, "site_id")
    return out.withColumns({
        "n_cosolvents": F.size("cosolvents"),
        "probe_coverage": F.try_divide(F.size("cosolvents").cast("double"), n_panel),
        "n_probe_chemotypes": F.size("probe_chemotypes"),
        "probe_chemotype_coverage": F.size("probe_chemotypes") / chemotypes.available(panel, overrides=overrides)})


def shape(voxels: DataFrame) -> DataFrame:
    """Solidity, extent and axis lengths of each site; 0 where the shape is degenerate."""
    key = ["site_id"]
    second = [p for p in regions.POWERS if sum(p) <= 2]
    central = regions.central_moments(voxels, key, powers=second)
    out = (regions.boxes(voxels, key).select("site_id", "extent")
           .join(regions.axes(regions.inertia(central, key), key), key)
           .join(regions.hulls(voxels, key).select("site_id", "solidity"), key, "left"))
    names = ("solidity", "extent", "axis_major_length", "axis_minor_length")
    return out.select("site_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def atom_types(typed: DataFrame, membership: DataFrame, keys=("probe", "label")) -> DataFrame:
    """Sorted union of the members' favourable types."""
    return (typed.join(membership, list(keys)).groupBy("site_id")
            .agg(F.sort_array(F.collect_set("atype")).alias("favorable_atomtypes")))


def pharmacophore(typed: DataFrame, membership: DataFrame, keys=("probe", "label")) -> DataFrame:
    """Deepest energy per site, probe and type."""
    return (typed.join(membership, list(keys)).groupBy("site_id", "probe", "atype")
            .agg(F.round(F.min("agfe_type"), 4).alias("agfe")))


def pharmacophore_map(long: DataFrame) -> DataFrame:
    """The same as probe -> type -> energy, one map per site."""
    inner = long.groupBy("site_id", "probe").agg(
        F.map_from_entries(F.collect_list(F.struct("atype", "agfe"))).alias("types"))
    return inner.groupBy("site_id").agg(
        F.map_from_entries(F.collect_list(F.struct("probe", "types"))).alias("pharmacophore"))


def label_map(voxels: DataFrame, ranks: DataFrame) -> DataFrame:
    """Site rank per voxel; where sites overlap the better rank shows."""
    return (voxels.join(ranks.select("site_id", "rank"), "site_id").groupBy(*IJK)
            .agg(F.min("rank").alias("rank")))
