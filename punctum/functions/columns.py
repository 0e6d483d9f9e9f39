"""Column expressions for labels, thresholds and rows of numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def merged_label(name: Column, members: Sequence[str], label: str = "merged") -> Column:
    """``label`` for the names in ``members``, other names as they are."""
    return F.when(name.isin(*members), F.lit(label)).otherwise(name)


def mapped(name: Column, to: Mapping[str, str], default: Column | None = None) -> Column:
    """``name`` by a value map; names that it lacks become ``default`` or stay."""
    pairs = F.create_map(*(F.lit(x) for pair in to.items() for x in pair))
    return F.coalesce(F.element_at(pairs, name), name if default is None else default)


def ruled(rules: Sequence[tuple[Column, str]], otherwise: Column) -> Column:
    """The label of the first rule that holds."""
    out = otherwise
    for rule, label in reversed(rules):
        out = F.when(rule, F.lit(label)).otherwise(out)
    return out


def simplified(label: Column) -> Column:
    """"mixed" for a label of several parts joined by " & "."""
    return F.when(label.contains(" & "), "mixed").otherwise(label)


def kept(size: Column, in_soma: Column, size_thr: float, in_soma_thr: float, strict: bool = True) -> Column:
    """Size and in-soma thresholds, strict or including the thresholds themselves."""
    return (size < size_thr) & (in_soma < in_soma_thr) if strict else (size <= size_thr) & (in_soma <= in_soma_thr)


def passes(in_soma: Column, nc_ratio: Column, in_soma_thr: float, nc_thr: float) -> Column:
    """Post-hoc thresholds; one of 1 or more is off; a ratio of 0 always passes."""
    soma = F.lit(True) if in_soma_thr >= 1 else in_soma < in_soma_thr
    return soma if nc_thr >= 1 else soma & ((nc_ratio == 0) | (nc_ratio < nc_thr))


def proportion(v: Column, by: Sequence[str]) -> Column:
    """Share of ``v`` in the sum within ``by``, 0 where that is 0."""
    total = F.sum(v).over(Window.partitionBy(*by))
    return F.when(total > 0, v / total).otherwise(0.0)


def log_normalised(n: Column, by: Sequence[str], target: float = 1e4) -> Column:
    """log1p of counts scaled to ``target`` within ``by``; 0 where the sum is 0."""
    total = F.sum(n).over(Window.partitionBy(*by))
    return F.log1p(F.when(total > 0, n * target / total).otherwise(0.0))


def stars(p: Column) -> Column:
    """Significance stars of a p-value; a NULL or NaN has none."""
    return F.when(p.isNull() | F.isnan(p), "").when(p > 0.05, "ns").when(p > 0.01, "*").when(p > 0.001, "**").otherwise("***")


def first_closest(values: Column, to: Column) -> Column:
    """Position, from 0, of the first value of an array with the least distance to ``to``."""
    at = F.transform(values, lambda v, i: F.struct(F.abs(v - to).alias("d"), i.alias("i")))
    return F.array_min(at)["i"]


def first_argmax(values: Column) -> Column:
    """Position, from 0, of the first largest value of an array."""
    return F.array_position(values, F.array_max(values)) - 1


def top_until(values: Column, threshold: float) -> Column:
    """Names of the (name, value) structs of an array, greatest first, until their sum exceeds ``threshold``.

    If it never does, the first name alone. Ties go by name.
    """
    ordered = F.array_sort(values, lambda a, b: F.when(a["value"] != b["value"], F.signum(b["value"] - a["value"]).cast("int")).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("names"))
    step = lambda a, v: F.when(a["sum"] > threshold, a).otherwise(F.struct((a["sum"] + v["value"]).alias("sum"), F.concat(a["names"], F.array(v["name"])).alias("names")))
    run = F.aggregate(ordered, zero, step)
    return F.when(run["sum"] > threshold, run["names"]).otherwise(F.slice(run["names"], 1, 1))
