"""Atoms of PDB text, and the bonds a backbone drawing needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxelloom.spark import ranked

# Residue names of water and the amino acids.
WATER = ["HOH", "WAT"]
AMINO_ACIDS = ["ALA", "ARG", "ASN", "ASP", "ASH", "CYS", "CYX", "CYM", "GLN", "GLU", "GLH", "GLY", "HIS", "HID", "HIE", "HIP",
               "ILE", "LEU", "LYS", "LYN", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL"]


def _field(first: int, last: int) -> Column:
    return F.trim(F.substring("value", first, last - first + 1))


def _number(n: Column, width: int) -> Column:
    """*n* in a field of *width*: decimal, then hybrid-36 (first in capitals, then in small letters), then stars.

    Hybrid-36 counts on from the last decimal number with a letter in front.  What it cannot hold stands in full behind column 80.
    """
    dec, lead = 10 ** width, 36 ** (width - 1)
    base36 = lambda skip: F.conv((n - F.lit(dec + skip * lead) + F.lit(10 * lead)).cast("string"), 10, 36)
    return (F.when(n.between(1 - dec // 10, dec - 1), n.cast("string"))
            .when(n.between(dec, dec + 26 * lead - 1), base36(0))
            .when(n.between(dec, dec + 52 * lead - 1), F.lower(base36(26)))
            .when(n.isNotNull(), F.lit("*" * width)))


def _number_of(field: Column, width: int, place: int) -> Column:
    """The number that :func:`_number` wrote; *place* says which of the full numbers behind column 80 is its own."""
    dec, lead = 10 ** width, 36 ** (width - 1)
    value = lambda skip: F.conv(F.upper(field), 36, 10).cast("bigint") + F.lit(dec + skip * lead - 10 * lead)
    return (F.when(field.rlike("^[A-Z][0-9A-Z]+$"), value(0)).when(field.rlike("^[a-z][0-9a-z]+$"), value(26))
            .when(field == "*" * width, F.split(F.substring("value", 81, 41), " ")[place].cast("bigint"))
            .otherwise(field.cast("bigint")))


def atoms(lines: DataFrame) -> DataFrame:
    """Atom records of PDB lines by their fixed columns; numbers too long for them as :func:`_number` writes them."""
    chain = _field(22, 22)
    elem = _field(77, 78)
    name = _field(13, 16)
    return (lines.filter(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
            .select(_number_of(_field(7, 11), 5, 0).alias("atom_id"), name.alias("name"), _field(18, 20).alias("resname"),
                    F.when(chain == "", F.lit("A")).otherwise(chain).alias("chain"),
                    _number_of(_field(23, 26), 4, 1).alias("resid"),
                    *[_field(s, s + 7).cast("double").alias(c) for s, c in ((31, "x"), (39, "y"), (47, "z"))],
                    F.coalesce(_field(61, 66).try_cast("double"), F.lit(0.0)).alias("bfactor"),
                    F.when(elem == "", F.substring(name, 1, 1)).otherwise(elem).alias("element")))


def read(spark: SparkSession, path: str) -> DataFrame:
    return atoms(spark.read.text(path))


def protein(df: DataFrame) -> DataFrame:
    return df.filter(F.col("resname").isin(AMINO_ACIDS))


def to_lines(df: DataFrame) -> DataFrame:
    """Atom records as PDB text lines, with ``bfactor`` where there is one."""
    b = F.col("bfactor") if "bfactor" in df.columns else F.lit(0.0)
    atom, res = _number(F.col("atom_id").cast("bigint"), 5), _number(F.col("resid").cast("bigint"), 4)
    line = F.format_string(
        "ATOM  %5s %-4s %3s %1s%4s    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", atom, "name", "resname",
        "chain", res, "x", "y", "z", F.lit(1.0), b, F.substring("name", 1, 1))
    return df.select("atom_id", F.when(atom.startswith("*") | res.startswith("*"), F.concat(
        F.rpad(line, 80, " "), F.concat_ws(" ", "atom_id", "resid"))).otherwise(line).alias("value"))


def bonds(df: DataFrame) -> DataFrame:
    """Backbone and CA-CB bonds, and the link from the previous residue's C in each chain.

    Residues are numbered along the chain and meet their predecessor by that number.
    """
    at = lambda n: F.min(F.when(F.col("name") == n, F.col("atom_id"))).alias(n)
    res = df.groupBy("chain", "resid").agg(F.min("atom_id").alias("first"), *[at(n) for n in ("N", "CA", "C", "O", "CB")])
    res = ranked(res, ["chain"], ["first"], "place")
    inner = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
                      for a, b in (("N", "CA"), ("CA", "C"), ("C", "O"), ("CA", "CB"))])
    within = res.select(F.explode(inner).alias("e")).select("e.a", "e.b")
    before = res.select("chain", (F.col("place") + 1).alias("place"), F.col("C").alias("a"))
    links = res.join(before, ["chain", "place"]).select("a", F.col("N").alias("b"))
    return within.unionByName(links).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
