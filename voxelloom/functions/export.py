"""Export boundary: rounding, text of lists and labels, element names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def finite(v) -> Column:
    """NULL for NaN and infinities."""
    c = _c(v).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def rounded(v, digits: int = 4) -> Column:
    """Rounded and finite, without a negative zero; NULL stays NULL."""
    return F.round(finite(v), digits) + F.lit(0.0)


def joined(v) -> Column:
    return F.array_join(_c(v), ",")


def split_list(v) -> Column:
    return F.filter(F.split(F.coalesce(_c(v), F.lit("")), ","), lambda x: x != "")


def type_columns_to_map(df, prefix: str = "agfe_", skip=("agfe_min", "agfe_mean_top_pct")) -> Column:
    """``agfe_<type>`` columns back to a map of type to value, without the missing ones."""
    names = [c for c in df.columns if c.startswith(prefix) and c not in skip]
    if not names:
        return F.create_map().cast("map<string,double>")
    pairs = []
    for n in names:
        pairs += [F.lit(n[len(prefix):]), F.col(n).cast("double")]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def point_label(x="x", y="y", z="z") -> Column:
    return F.format_string("(%.2f, %.2f, %.2f)", _c(x), _c(y), _c(z))


def three_digits(v) -> Column:
    """Three significant digits without trailing zeros; powers of ten beyond 1e-4..1e3."""
    c = _c(v).cast("double")
    step = F.pow(F.lit(10.0), F.lit(2.0) - F.floor(F.log10(F.abs(c))))
    near = F.round(c * step) / step
    mag = F.floor(F.log10(F.abs(near)) + F.lit(1e-12)).cast("int")

    def trimmed(text):
        return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")

    plain = trimmed(F.format_string("%.7f", near))
    power = F.concat(trimmed(F.format_string("%.2f", near / F.pow(F.lit(10.0), mag))),
                     F.when(mag < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(mag).cast("string"), 2, "0"))
    return (F.when(c == 0, F.lit("0")).when(c.isNotNull() & mag.between(-4, 2), plain)
            .when(c.isNotNull(), power))


def property_label(pairs) -> Column:
    """``name=value`` texts joined by blanks; missing and non-finite values are left out."""
    parts = []
    for name, col, kind in pairs:
        text = three_digits(finite(col)) if kind == "float" else _c(col).cast("string")
        parts.append(F.concat(F.lit(f"{name}="), text))
    return F.concat_ws(" ", *parts)


# Van der Waals radii in A by element.
VDW_RADII = {"C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "S": 1.80, "P": 1.80,
             "CL": 1.75, "BR": 1.85, "I": 1.98, "H": 1.20}


def element(element_col, type_col, name_col) -> Column:
    """Element from the element field, the atom type or the atom name, in that order; else C."""
    known = list(VDW_RADII)

    def whole_or_first(c):
        up = F.upper(F.trim(_c(c)))
        return (F.when(up.isin(known), up)
                .when(F.substring(up, 1, 1).isin(known), F.substring(up, 1, 1)))

    first = F.substring(F.upper(F.trim(_c(name_col))), 1, 1)
    return F.coalesce(whole_or_first(element_col), whole_or_first(type_col),
                      F.when(first.isin(known), first), F.lit("C"))


def marker_radius(n) -> Column:
    return F.greatest(F.lit(2.0), F.cbrt(_c(n)) * F.lit(0.4))


def marker_size(n) -> Column:
    return F.least(F.greatest(F.cbrt(_c(n)) * F.lit(1.8), F.lit(12.0)), F.lit(40.0))


def sphere_radius(n) -> Column:
    return F.least(_c(n) / F.lit(50.0), F.lit(4.0))
