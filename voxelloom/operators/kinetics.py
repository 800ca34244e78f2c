"""Residence of molecules in zones: occupancy, survival curves, metrics and fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelloom.functions.export import element
from voxelloom.functions.thermo import AKMA_PS
from voxelloom.operators import pairs
from voxelloom.spark import cut, ranked


def zone_kind(zone) -> str:
    """``resid`` for a residue number or a list of them, ``point`` for three floats."""
    if isinstance(zone, int):
        return "resid"
    parts = list(zone)
    return "point" if len(parts) == 3 and all(isinstance(v, float) for v in parts) else "resid"


def cells(df: DataFrame, edge: float) -> DataFrame:
    return df.withColumns({f"g{c}": F.floor(F.col(c) / F.lit(edge)).cast("int") for c in "xyz"})


def reach(df: DataFrame, edge: float, radius: Column) -> DataFrame:
    """Each row once per cell its sphere touches the box of."""
    out = df
    for c in "xyz":
        out = out.withColumn(f"g{c}", F.explode(F.sequence(
            F.floor((F.col(c) - radius) / F.lit(edge)).cast("int"),
            F.floor((F.col(c) + radius) / F.lit(edge)).cast("int"))))
    return out


def occupancy(positions: DataFrame, zones: DataFrame, edge: float = 6.0, keys=()) -> DataFrame:
    """Atoms inside zones ``(zone_id, x, y, z, radius)``, for all zones and frames at once.

    An atom meets the zones that agree with it in *keys*.

    Zones are put into the lattice cells they touch and met by cell equality.  An atom only
    meets the zones of its own cell, and Spark broadcasts the zones when they are small.
    """
    z = reach(zones, edge, F.col("radius")).select(
        *keys, "zone_id", "radius", "gx", "gy", "gz", *[F.col(c).alias(f"z{c}") for c in "xyz"])
    gap = sum((F.col(c) - F.col(f"z{c}")) * (F.col(c) - F.col(f"z{c}")) for c in "xyz")
    return (cells(positions, edge).join(z, [*keys, "gx", "gy", "gz"])
            .filter(gap <= F.col("radius") * F.col("radius"))
            .drop("gx", "gy", "gz", "zx", "zy", "zz", "radius"))


#: Points of a bucket of molecules, cells of a dense table of visits, and visits taken in before they are added up.
BUCKET_POINTS, DENSE_VISITS, HELD_VISITS = 1 << 22, 1 << 24, 1 << 21


def _numbered(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """The different values of *cols*, numbered from 1."""
    return cut(ranked(df.select(*cols).distinct(), [], cols, name).select(*cols, F.col(name).cast("bigint").alias(name)))


#: Packs of zones from which one bucket makes enough tasks, and lags of a curve that is ended where its visits are.
ENOUGH_PACKS, SHORT_CURVE = 64, 64


def _folded(positions: DataFrame, zones: DataFrame, by: list[str], mol: str, frame: str, fold, schema: str, end=None,
            end_schema: str = "") -> tuple[DataFrame, bool]:
    """*fold* over the visits ``(zone, by, mol, frame, n)`` of each pack of near zones, with *by* as columns of the result.

    Zones and atoms are packed by cells and meet pack by pack, in array arithmetic.  The pack pairs of a pack of zones
    lie together and are added up one after the other, so the atoms inside a zone, of which there are far more than visits, never
    become rows.  Many molecules are dealt into buckets, which bounds what a pack of zones holds at a time; *fold* sees one
    bucket, all frames of a molecule in it.  Where a table of all visits is small enough however many points there are, and there are
    packs of zones enough to share out, one bucket does, and *end* (if given) makes the end result of what *fold* gives, so
    that a zone's sums do not become rows either.  The flag says if it did.  *zones* has a row per zone, with ``copies`` equal ones.
    """
    atoms = positions.select(*by, mol, frame, "x", "y", "z")
    size = atoms.agg(F.count(F.lit(1)).alias("n"), F.min(frame).alias("low"), F.max(frame).alias("high"))
    groups, mols = _numbered(atoms, by, "_grp"), _numbered(atoms.where(F.col(mol).isNotNull()), [mol], "_mol")
    head = size.crossJoin(zones.agg(F.max(F.abs("radius")).alias("r"))).crossJoin(groups.agg(F.count(F.lit(1)).alias("g"))) \
        .crossJoin(mols.agg(F.count(F.lit(1)).alias("m"))).first()
    # number 0 is a missing molecule or frame
    low, n_grp, n_mol, n_frame = head["low"] or 0, head["g"] + 1, head["m"] + 1, (head["high"] or 0) - (head["low"] or 0) + 2
    slots = n_grp * n_mol * n_frame
    if slots * pairs.PACK >= 1 << 62:
        raise ValueError(f"{head['g']} groups, {head['m']} molecules and {n_frame} frames are too many to number")
    edge = float(head["r"]) if head["r"] and head["r"] > 0 else 1.0
    near = pairs.packs(zones, [], ["zone_id", "radius", "copies"], edge)
    buckets = 1 + head["n"] // BUCKET_POINTS
    if slots * pairs.PACK <= DENSE_VISITS:
        buckets = min(buckets, -(-ENOUGH_PACKS // max(1, near.count())))
    ends = end is not None and buckets == 1
    schema = end_schema if ends else schema
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    names = groups.withColumnsRenamed({c: f"_b_{c}" for c in by})
    slot = (F.col("_grp") * n_mol + F.coalesce("_mol", F.lit(0))) * n_frame + F.coalesce(F.col(frame) - F.lit(low) + 1, F.lit(0))
    atoms = (atoms.join(names, same).join(mols, mol, "left")
             .select(F.pmod(F.coalesce("_mol", F.lit(0).cast("bigint")), F.lit(buckets)).cast("int").alias("_bucket"),
                     slot.cast("bigint").alias("slot"), "x", "y", "z"))
    atoms = cut(atoms)      # packing reads them three times
    near = near.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(int(buckets) - 1))))
    both = pairs.neighbours(near, pairs.packs(atoms, ["_bucket"], ["slot"], edge), ["_bucket"], edge)
    keep = [f"l_{c}" for c in ("x", "y", "z", "zone_id", "radius", "copies")] + [f"r_{c}" for c in ("x", "y", "z", "slot")]
    whose = F.concat_ws(",", "_bucket", "l_pack.*")

    def run(batches):
        held, many, table, last, ids = [], 0, None, None, None

        def add():
            nonlocal held, many, table
            code = np.concatenate([h[0] for h in held]) if held else np.empty(0, np.int64)
            times = np.concatenate([h[1] for h in held]) if held else np.empty(0, np.int64)
            held, many = [], 0
            if len(ids) * slots <= DENSE_VISITS:
                got = np.bincount(code, weights=times, minlength=len(ids) * slots).astype(np.int64)
                table = got if table is None else table + got
            else:
                old = (np.empty(0, np.int64),) * 2 if table is None else table
                code, at = np.unique(np.concatenate([old[0], code]), return_inverse=True)
                n = np.zeros(len(code), np.int64)
                np.add.at(n, at, np.concatenate([old[1], times]))
                table = code, n

        def done():
            nonlocal table
            if last is None:
                return
            add()
            code, n = table if isinstance(table, tuple) else (np.flatnonzero(table), table[table > 0])
            table = None
            zone, rest = np.divmod(code, slots)
            grp, rest = np.divmod(rest, n_mol * n_frame)
            who, f = np.divmod(rest, n_frame)
            zone, *out = end(*fold(zone, grp, who, f, n, low)) if ends else fold(zone, grp, who, f, n, low)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(zone)), *map(pa.array, out)], names_out)

        for batch in batches:
            group = np.asarray(batch.column(batch.schema.get_field_index("whose")).to_pylist())
            turn = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
            for a0, a1 in zip(turn, [*turn[1:], len(group)]):
                if group[a0] != last:
                    yield from done()
                    last = group[a0]
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a0, a1 - a0)]) for c in batch.columns], batch.schema.names)
                zone_ids, starts = pairs.flat(part, "l_zone_id")
                ids = zone_ids.slice(starts[0], starts[1] - starts[0])
                radius, copies = (pairs.flat(part, f"l_{c}")[0].to_numpy(zero_copy_only=False) for c in ("radius", "copies"))
                slot_of = pairs.flat(part, "r_slot")[0].to_numpy(zero_copy_only=False)
                for row, a, b, sq in pairs.near(part):
                    if sq.ndim == 2:
                        i, j = np.nonzero(sq <= radius[a] * radius[a])
                        i, j = a[i, 0], b[0, j]
                        place = i - starts[row]
                    else:
                        ok = np.flatnonzero(sq <= radius[a] * radius[a])
                        i, j = a[ok], b[ok]
                        place = i - starts[row[ok]]
                    held.append((place * slots + slot_of[j], copies[i]))
                    many += len(i)
                    if many > HELD_VISITS:
                        add()
        yield from done()

    names_out = [f.split()[0] for f in schema.split(", ")]
    kind = dict(zones.dtypes)["zone_id"]
    found = (both.select(whose.alias("whose"), *keep).repartition("whose").sortWithinPartitions("whose")
             .mapInArrow(run, ", ".join([f"zone_id {kind}", *schema.split(", ")[1:]])))
    return found.join(groups, "_grp"), ends


def zone_counts(positions: DataFrame, zones: DataFrame, by: list[str], mol: str = "mol", frame: str = "frame") -> DataFrame:
    """Atoms inside each zone by *by*: rows, and how many frames and molecules they are of.

    As counting the rows of :func:`occupancy` would, without making them.
    """
    def fold(zone, grp, who, f, n, low):
        wide, frames, mols = (int(v.max(initial=0)) + 1 for v in (grp, f, who))
        head = zone * wide + grp
        code, at = np.unique(head * frames + f, return_inverse=True)
        rows = np.bincount(at, weights=n, minlength=len(code)).astype(np.int64)
        seen = np.unique((head * mols + who)[who > 0])
        zone, grp = np.divmod(np.r_[code // frames, seen // mols], wide)
        none = np.zeros(len(seen), np.int64), np.zeros(len(code), np.int64)
        return zone, grp, np.r_[code % frames, none[0]], np.r_[none[1], seen % mols], np.r_[rows, none[0]]

    def end(zone, grp, f, who, n):
        wide = int(grp.max(initial=0)) + 1
        code, at = np.unique(zone * wide + grp, return_inverse=True)
        rows, frames, mols = (np.bincount(at, weights=v, minlength=len(code)).astype(np.int64) for v in (n, f > 0, who > 0))
        return *np.divmod(code, wide), rows, frames, mols

    spheres, single = _spheres(zones)
    if not single:
        inside = occupancy(positions.select(*by, mol, frame, "x", "y", "z"), zones).groupBy("zone_id", *by, mol, frame)
        inside = inside.agg(F.count(F.lit(1)).alias("n"))
        mols, frames = F.col(mol), F.col(frame)
    else:
        inside, ended = _folded(positions, spheres, by, mol, frame, fold, "zone_id x, _grp bigint, f bigint, who bigint, n bigint",
                                end, "zone_id x, _grp bigint, n_rows bigint, n_frames bigint, n_mols bigint")
        if ended:
            return inside.select("zone_id", *by, "n_rows", "n_frames", "n_mols")
        mols, frames = F.nullif("who", F.lit(0)), F.nullif("f", F.lit(0))
    return inside.groupBy("zone_id", *by).agg(F.sum("n").alias("n_rows"), F.count_distinct(frames).alias("n_frames"),
                                              F.count_distinct(mols).alias("n_mols"))


def zone_survival(positions: DataFrame, zones: DataFrame, by: list[str], max_tau: int, last_frame, dt_ps: float = 1.0,
                  mol: str = "mol", frame: str = "frame", intermittency: int = 0) -> DataFrame:
    """:func:`survival` of the stays in zones, for zones and atoms that meet too often for a row each.

    The visits of a molecule are put together into stays and counted by start frame where they are found.
    """
    def fold(zone, grp, who, f, n, low):
        at = np.flatnonzero(f > 0)
        zone, grp, who, f = zone[at], grp[at], who[at], f[at] - 1 + low
        new = np.ones(len(f), bool)
        new[1:] = ((zone[1:] != zone[:-1]) | (grp[1:] != grp[:-1]) | (who[1:] != who[:-1]) | (f[1:] - f[:-1] > intermittency + 1))
        first = np.flatnonzero(new)
        start, end = f[first], f[np.r_[first[1:], len(f)] - 1] if len(f) else f[first]
        size = end - start + 1
        stay = np.repeat(np.arange(len(first)), size)
        t = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[stay]
        left = np.minimum(end[stay] - t, max_tau)
        span = int(t.max()) - int(t.min()) + 1 if len(t) else 1
        base = int(t.min()) if len(t) else 0
        code = ((zone[first][stay] * (int(grp.max(initial=0)) + 1) + grp[first][stay]) * span + t - base) * (max_tau + 1) + left
        code, c = np.unique(code, return_counts=True)
        rest, left = np.divmod(code, max_tau + 1)
        rest, t = np.divmod(rest, span)
        zone, grp = np.divmod(rest, int(grp.max(initial=0)) + 1)
        return zone, grp, (t + base).astype(np.int32), left.astype(np.int32), c

    def end(zone, grp, t, left, c):
        wide, base = int(grp.max(initial=0)) + 1, int(t.min(initial=0))
        span = int(t.max(initial=0)) - base + 1
        code, at = np.unique((zone * wide + grp) * span + t - base, return_inverse=True)
        alive = np.zeros((len(code), max_tau + 1))
        np.add.at(alive, (at, left), c)
        alive = alive[:, ::-1].cumsum(1)[:, ::-1]
        whose, t = np.divmod(code, span)
        counts = t[:, None] + base + np.arange(max_tau + 1) <= last_frame
        whose, at = np.unique(whose, return_inverse=True)
        share = np.where(counts, alive / alive[:, :1], 0.0)
        n, total = (np.stack([np.bincount(at, weights=v[:, k], minlength=len(whose)) for k in range(max_tau + 1)], axis=1)
                    for v in (counts, share))
        i, tau = np.nonzero(n)
        return *np.divmod(whose[i], wide), tau.astype(np.int32), total[i, tau] / n[i, tau]

    spheres, single = _spheres(zones)
    if not single:
        inside = occupancy(positions.select(*by, mol, frame, "x", "y", "z"), zones)
        return survival(runs(inside, ["zone_id", *by], mol, frame, intermittency), ["zone_id", *by], max_tau, last_frame, dt_ps)
    short = not isinstance(last_frame, Column) and max_tau <= SHORT_CURVE
    starts, ended = _folded(positions, spheres, by, mol, frame, fold, "zone_id x, _grp bigint, t int, left int, c bigint",
                            end if short else None, "zone_id x, _grp bigint, tau int, sp double")
    if ended:
        known = F.lit(True)
        for c in by:        # as in the joins of survival_of, which no missing name meets
            known = known & F.col(c).isNotNull()
        return starts.select("zone_id", *by, "tau", F.when(known, F.col("sp")).otherwise(F.lit(0.0)).alias("sp"),
                             (F.col("tau") * F.lit(float(dt_ps))).alias("time_ps"))
    return survival_of(starts, ["zone_id", *by], max_tau, last_frame, dt_ps)


def _spheres(zones: DataFrame) -> tuple[DataFrame, bool]:
    """Different zones with the number of equal rows ``copies``, and whether every name has one sphere."""
    zones = cut(zones.groupBy("zone_id", "x", "y", "z", "radius").agg(F.count(F.lit(1)).alias("copies")))
    return zones, zones.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR zone_id IS NULL").isEmpty()


def residue_zones(atoms: DataFrame, members: DataFrame, radius: float) -> DataFrame:
    """Zones at the centre of the atoms of listed residues ``(zone_id, resid)``."""
    return (atoms.join(members, "resid").groupBy("zone_id")
            .agg(*[F.avg(c).alias(c) for c in "xyz"]).withColumn("radius", F.lit(float(radius))))


def probe_radius(atoms: DataFrame, probe: str = "probe", resid: str = "resid",
                 tolerance: float = 1.7) -> DataFrame:
    """Zone radius per probe: spread of its first residue's atoms about their middle, and a margin.

    *atoms* are the heavy atoms of one frame.
    """
    first = atoms.groupBy(probe).agg(F.min(resid).alias(resid))
    rg = F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z"))
    return (atoms.join(first, [probe, resid], "left_semi").groupBy(probe)
            .agg((rg + F.lit(float(tolerance))).alias("radius")))


def heavy(atoms: DataFrame, element_col="element", type_col="type", name_col="name") -> DataFrame:
    return atoms.filter(element(element_col, type_col, name_col) != "H")


def resolve_radius(radius, atoms: DataFrame, probes: list[str], tolerance: float = 1.7) -> dict[str, float]:
    """Radius per probe from a number or ``"adaptive"`` (a row per probe reaches the driver)."""
    if not isinstance(radius, str):
        return {p: float(radius) for p in probes}
    if radius.strip().lower() != "adaptive":
        raise ValueError(f"radius must be a number or 'adaptive', got {radius!r}")
    got = {r["probe"]: r["radius"] for r in probe_radius(atoms, tolerance=tolerance)
           .filter(F.col("probe").isin(probes)).collect()}
    missing = sorted(set(probes) - set(got))
    if missing:
        raise ValueError(f"cannot size a zone: {missing} not found among the atoms")
    return got


def frame_step(dts: list[float], dt_ps: float | None = None) -> tuple[float, list[str]]:
    """Picoseconds per frame and what is doubtful about it."""
    if dt_ps is not None:
        return float(dt_ps), []
    dt = dts[0] if dts else 0.0
    if dt <= 0:
        return 1.0, ["frame spacing is unknown or zero; lags are in frames, not ps"]
    notes = []
    if abs(dt - AKMA_PS) < 1e-6:
        notes.append(f"frame spacing {dt} ps is one AKMA time unit, so it was likely never set; pass dt_ps")
    elif len({round(d, 6) for d in dts}) > 1:
        notes.append(f"runs disagree on the frame spacing ({sorted(set(dts))} ps); using {dt} ps")
    return dt, notes


def runs(presence: DataFrame, by: list[str], mol: str = "mol", frame: str = "frame",
         intermittency: int = 0) -> DataFrame:
    """Unbroken stays ``(by, mol, start, end)``; absences of up to *intermittency* frames are bridged.

    A window holds the distinct frames of one molecule in one zone, no more.
    """
    seen = presence.select(*by, mol, frame).distinct()
    own = Window.partitionBy(*by, mol).orderBy(frame)
    jump = F.col(frame) - F.lag(frame).over(own) > F.lit(int(intermittency) + 1)
    marked = seen.withColumn("_n", F.coalesce(jump.cast("int"), F.lit(1)))
    stays = marked.withColumn("_run", F.sum("_n").over(own))
    return (stays.groupBy(*by, mol, "_run").agg(F.min(frame).alias("start"), F.max(frame).alias("end"))
            .drop("_run"))


def survival(stays: DataFrame, by: list[str], max_tau: int, last_frame, dt_ps: float = 1.0) -> DataFrame:
    """Survival curve: the mean, over start frames, of the share still there after each lag.

    Stays are folded into counts per start frame and remaining length before any lag is
    spelled out, so the lags multiply frames and not molecules.  Start frames too late for a
    lag do not count for it; frames nobody occupies do not count at all.
    """
    return survival_of(starts_of(stays, by, max_tau), by, max_tau, last_frame, dt_ps)


def starts_of(stays: DataFrame, by: list[str], max_tau: int) -> DataFrame:
    """``by, t, left, c``: how many stays go on for *left* more frames (at most *max_tau*) at frame *t*.  Such counts add up."""
    left = F.least(F.col("end") - F.col("t"), F.lit(int(max_tau)))
    return (stays.select(*by, "end", F.explode(F.sequence("start", "end")).alias("t"))
            .groupBy(*by, "t", left.alias("left")).agg(F.count(F.lit(1)).alias("c")))


def survival_of(starts: DataFrame, by: list[str], max_tau: int, last_frame, dt_ps: float = 1.0) -> DataFrame:
    """The survival curve from :func:`starts_of`, or from sums of such counts."""
    last = last_frame if isinstance(last_frame, Column) else F.lit(int(last_frame))
    alive = (starts.select(*by, "t", "c", F.explode(F.sequence(F.lit(0), "left")).alias("tau"))
             .groupBy(*by, "t", "tau").agg(F.sum("c").alias("n")))
    occupied = (alive.filter("tau = 0").select(*by, "t", F.col("n").alias("n0"))
                .filter(F.col("t") <= last)
                .withColumn("tau", F.explode(F.sequence(F.lit(0), F.least(F.lit(int(max_tau)), last - F.col("t"))))))
    share = F.coalesce("n", F.lit(0)) / F.col("n0")
    return (occupied.join(alive, [*by, "t", "tau"], "left").groupBy(*by, F.col("tau").cast("int").alias("tau"))
            .agg(F.avg(share).alias("sp"))
            .withColumn("time_ps", F.col("tau") * F.lit(float(dt_ps))))


def replica_mean(curves: DataFrame, by: list[str]) -> DataFrame:
    """Mean, sample deviation and number of runs per lag; a run without the zone is left out."""
    return curves.groupBy(*by, "tau", "time_ps").agg(
        F.avg("sp").alias("sp_mean"), F.stddev_samp("sp").alias("sp_sd"), F.count("sp").alias("n_replicas"))


def metrics(curves: DataFrame, by: list[str], sp: str = "sp", min_points: int = 3) -> DataFrame:
    """Mean residence time, half-life and plateau per curve; curves that are too short give none.

    A curve has at most one point per lag, so it fits in an array.
    """
    p = F.struct(F.col("time_ps").alias("t"), F.col(sp).alias("s"))
    above, below = F.col(sp) >= 0.5, F.col(sp) < 0.5
    rows = curves.groupBy(*by).agg(
        F.array_sort(F.collect_list(p)).alias("c"),
        F.min(F.when(above, F.struct(F.col(sp).alias("s"), (-F.col("time_ps")).alias("nt")))).alias("hi"),
        F.max(F.when(below, F.struct(F.col(sp).alias("s"), (-F.col("time_ps")).alias("nt")))).alias("lo"))
    rows = rows.filter(F.size("c") >= F.lit(int(min_points)))
    area = F.aggregate(F.sequence(F.lit(1), F.size("c") - 1), F.lit(0.0), lambda acc, i: acc + (
        F.element_at("c", i)["s"] + F.element_at("c", i + 1)["s"]) / F.lit(2.0)
        * (F.element_at("c", i + 1)["t"] - F.element_at("c", i)["t"]))
    tail = F.greatest(F.lit(1), F.floor(F.size("c") / F.lit(10)).cast("int"))
    plateau = F.aggregate(F.slice("c", -tail, tail), F.lit(0.0), lambda acc, e: acc + e["s"]) / tail
    t_hi, t_lo = -F.col("hi.nt"), -F.col("lo.nt")
    half = (F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(),
                   t_lo + (t_hi - t_lo) * (F.lit(0.5) - F.col("lo.s")) / (F.col("hi.s") - F.col("lo.s")))
            .when(F.col("hi.s") == 0.5, t_hi))
    return rows.select(*by, F.size("c").alias("n_points"), F.round(area, 4).alias("sp_mrt"),
                       F.round(half, 4).alias("sp_half_life"), F.round(plateau, 4).alias("sp_plateau"))


def _fit(model, t, y, p0, low, high, steps=400):
    """Damped Gauss-Newton within bounds; NaN-safe, None unless it converged."""
    p = np.clip(np.asarray(p0, float), low, high)
    damp, cost = 1e-3, float(((y - model(t, *p)) ** 2).sum())
    for _ in range(steps):
        base = model(t, *p)
        width = np.maximum(np.abs(p), 1e-3) * 1e-6
        jac = np.stack([(model(t, *(p + np.eye(len(p))[n] * width[n])) - base) / width[n]
                        for n in range(len(p))], axis=1)
        grad, hess = jac.T @ (y - base), jac.T @ jac
        step = np.linalg.lstsq(hess + damp * np.diag(np.diag(hess) + 1e-12), grad, rcond=None)[0]
        new = np.clip(p + step, low, high)
        now = float(((y - model(t, *new)) ** 2).sum())
        if np.isfinite(now) and now <= cost:
            small = np.abs(new - p).max() <= 1e-10 * (1 + np.abs(p).max())
            p, damp = new, max(damp / 5, 1e-12)
            done = small or cost - now <= 1e-16 * (1 + cost) and small
            cost = now
            if done:
                return p
        else:
            damp *= 4
            if damp > 1e12:        # no step is downhill any more
                return p
    return None


def _share_explained(y, fit) -> float:
    total = float(((y - y.mean()) ** 2).sum())
    return 1.0 - float(((y - fit) ** 2).sum()) / total if total > 1e-20 else 0.0


FIT_COLUMNS = ("sp_tau_single", "sp_r2_single", "sp_amplitude_fast", "sp_tau_fast", "sp_tau_slow", "sp_r2_biexp")


def fits(curves: DataFrame, by: list[str], sp: str = "sp") -> DataFrame:
    """Single and double exponential decay per curve, fitted in one Arrow group per curve.

    A group holds at most one row per lag.  The double decay needs six points.  A fit that did not
    converge is NULL.
    """
    def one(t, tau):
        return np.exp(-t / max(tau, 1e-12))

    def two(t, share, fast, slow):
        return share * one(t, fast) + (1 - share) * one(t, slow)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["s"]).sort_values("t")
        t, y = pdf["t"].to_numpy(float), pdf["s"].to_numpy(float)
        row = {c: [pdf[c].iloc[0]] for c in by} if len(pdf) else None
        if row is None or len(t) < 3:
            return pd.DataFrame({c: [] for c in [*by, *FIT_COLUMNS]})
        mrt = float(((y[1:] + y[:-1]) / 2 * np.diff(t)).sum())
        single = _fit(one, t, y, [max(mrt, 1.0)], [1e-9], [np.inf])
        got = dict.fromkeys(FIT_COLUMNS, None)
        if single is not None:
            tau = float(single[0])
            got["sp_tau_single"], got["sp_r2_single"] = round(tau, 4), round(_share_explained(y, one(t, tau)), 4)
        double = None if len(t) < 6 else _fit(
            two, t, y, [0.5, max(mrt * 0.1, 1.0), max(mrt, 1.0)], [0, 1e-9, 1e-9], [1, np.inf, np.inf])
        if double is not None:
            a, f, s = double
            if f > s:
                a, f, s = 1 - a, s, f
            got.update(sp_amplitude_fast=round(float(a), 4), sp_tau_fast=round(float(f), 4),
                       sp_tau_slow=round(float(s), 4), sp_r2_biexp=round(_share_explained(y, two(t, a, f, s)), 4))
        return pd.DataFrame({**row, **{k: [v] for k, v in got.items()}})

    types = dict(curves.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + [f"{c} double" for c in FIT_COLUMNS])
    return (curves.select(*by, F.col("time_ps").alias("t"), F.col(sp).alias("s"))
            .groupBy(*by).applyInPandas(run, schema))


def fitted_curve(fit_rows: DataFrame, by: list[str], t_max: float, points: int = 300) -> DataFrame:
    """The fitted single decay sampled for a figure."""
    step = float(t_max) / (points - 1)
    return (fit_rows.select(*by, "sp_tau_single", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("n"))
            .select(*by, (F.col("n") * F.lit(step)).alias("time_ps"),
                    F.exp(-F.col("n") * F.lit(step) / F.col("sp_tau_single")).alias("sp_fit")))


def zone_to_site(zones: DataFrame, rows: DataFrame, max_distance: float, site_keys=("rank",), within=()) -> DataFrame:
    """Nearest hotspot within *max_distance* of each zone; the lower rank wins a tie.

    A zone only meets hotspots that agree with it in *within*.  Both sides meet by cells of that size, so no zone is paired with far hotspots.
    """
    z = reach(zones.select(*within, "zone_id", "x", "y", "z"), max_distance, F.lit(float(max_distance)))
    keys = list(dict.fromkeys([*within, *site_keys]))
    h = cells(rows.select(*keys, *[F.col(f"centroid_{c}").alias(c) for c in "xyz"]), max_distance)
    h = h.select(*keys, "gx", "gy", "gz", *[F.col(c).alias(f"h{c}") for c in "xyz"])
    d = F.sqrt(sum((F.col(c) - F.col(f"h{c}")) * (F.col(c) - F.col(f"h{c}")) for c in "xyz"))
    near = z.join(h, [*within, "gx", "gy", "gz"]).withColumn("distance", d).filter(F.col("distance") <= F.lit(float(max_distance)))
    best = near.groupBy("zone_id").agg(F.min(F.struct("distance", *site_keys)).alias("b"))
    return best.select("zone_id", *[F.col(f"b.{k}").alias(k) for k in site_keys], F.col("b.distance").alias("distance"))


def candidate_zones(rows: DataFrame, top_n: int, radius: float, zones: list | None = None) -> DataFrame:
    """Zones to follow: the given points, or the best *top_n* hotspots of each probe."""
    spark = rows.sparkSession
    if zones is not None:
        data = [(n, float(x), float(y), float(z), float(radius)) for n, (x, y, z) in enumerate(zones)]
        return spark.createDataFrame(data, "zone_id int, x double, y double, z double, radius double")
    return rows.filter(F.col("rank") <= F.lit(int(top_n))).select(
        "probe", (F.col("rank") - 1).alias("zone_id"), *[F.col(f"centroid_{c}").alias(c) for c in "xyz"],
        F.lit(float(radius)).alias("radius"))
