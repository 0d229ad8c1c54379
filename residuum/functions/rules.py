"""Null rules and scalar transforms. NaN turns into NULL at every boundary; features use 0 for "absent", labels NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def power(c: Column, p: int) -> Column:
    """c to the power p; a negative power of anything but a positive number is 0."""
    return F.pow(c, F.lit(float(p))) if p >= 0 else F.when(c > 0, F.pow(c, F.lit(float(p)))).otherwise(0.0)


def less_baselines(label: Column, filled: Sequence[Column] = (), required: Sequence[Column] = ()) -> Column:
    """Label less baselines: those of ``filled`` count 0 where missing, a missing one of ``required`` makes the result missing."""
    for b in filled:
        label = label - F.coalesce(b, F.lit(0.0))
    for b in required:
        label = label - b
    return label


def one_hot(c: Column, codes: Sequence[str], prefix: str) -> list[Column]:
    return [F.coalesce((c == k).cast("int"), F.lit(0)).alias(f"{prefix}{k}") for k in codes]


def merge_alternates(a: Column, b: Column, fallback: Column) -> Column:
    """Mean of both alternates, else the one that is there, else the fallback."""
    return F.coalesce((a + b) / 2, a, b, fallback)


def null_below(c: Column, least: float) -> Column:
    return F.when(c >= least, c)


def null_above(c: Column, most: float) -> Column:
    return F.when(c <= most, c)


def null_if_all_zero(c: Column, flags: Sequence[Column]) -> Column:
    """c unless every flag is 0 (an unset one-hot group)."""
    return F.when(F.greatest(*flags, F.lit(0)) != 0, c)


def null_if_angles_differ(c: Column, cos: Column, sin: Column, cos_ref: Column, tolerance: float = 0.001) -> Column:
    """c where an angle's cosine agrees with its reference, or one of the two angles does not exist: cos = sin = 0 here, a cosine of 1 less one of 0 there."""
    off = F.abs(cos - cos_ref)
    return F.when(F.coalesce(((cos == 0) & (sin == 0)) | (off == 1) | (off <= tolerance), F.lit(False)), c)


def clip(c: Column, cap: float | Column) -> Column:
    cap = F.lit(cap) if isinstance(cap, (int, float)) else cap
    return F.when(c.isNotNull(), F.greatest(-cap, F.least(cap, c)))


def zero_to(c: Column, constant: Column) -> Column:
    """A zero baseline stands for "not tabulated": it becomes the constant, null where there is none."""
    return F.when(c == 0, constant).otherwise(c)


def outside(c: Column, low: float, high: float) -> Column:
    """Whether a value lies outside the range that predictions hold for (null counts as inside)."""
    return F.coalesce((c < low) | (c > high), F.lit(False))


def bond_angle_ok(cos: Column, tolerance: float) -> Column:
    """Bonds (cosine of the donor angle) within ``tolerance`` degrees of straight, or absent (0)."""
    return (cos == 0) | (cos < F.cos(F.radians(F.lit(180.0 - tolerance))))


def observed(value: Column, coil: Column, secondary: bool) -> Column:
    """The secondary part as it is, or with the random-coil value added."""
    return value if secondary else value + coil


def sequence_one_hot(text: Column, letters: str) -> Column:
    """Array of 0/1 arrays, one a letter of the text; a letter that is not listed is all zero."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.transform(F.array(*[F.lit(x) for x in letters]), lambda x: (x == c).cast("int")))


def softmax_weight(score: Column, similarity: Column, sharpness: float = 5.0) -> Column:
    return F.exp(sharpness * score) * F.exp(similarity)


def hbond_energy(r_on: Column, r_ch: Column, r_oh: Column, r_cn: Column) -> Column:
    """Electrostatic hydrogen-bond energy in kcal/mol (0.084 * 332 scales unit charges)."""
    return 0.084 * 332 * (1 / r_on + 1 / r_ch - 1 / r_oh - 1 / r_cn)


def contact_order(near_sum: Column, slope: float = 0.8, shift: float = -0.1) -> Column:
    return F.tanh(slope * near_sum) + shift


def coverage(matches: Column, total: Column, length: Column) -> Column:
    return matches / F.greatest(total, length)


def two_tier(evalue: Column, score: Column, matches: Column, total: Column) -> Column:
    """Significant hits: long ones at a low identity, short ones at a higher one."""
    share = matches / total
    return (score >= 0) & (evalue <= 1e-10) & (((total >= 40) & (share >= 0.15)) | ((total >= 20) & (share >= 0.4)))


def structure_hit(tmscore: Column, rmsd: Column, cover: Column) -> Column:
    return (tmscore > 0.8) & (rmsd < 1.75) & (cover > 0.3)


def random_fourier(x: Column, weights: Sequence[Sequence[float]], phases: Sequence[float]) -> list[Column]:
    """cos(w . x + b) for each row of weights; ``x`` is an array column."""
    return [F.cos(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v) + b) for w, b in zip(weights, phases)]
