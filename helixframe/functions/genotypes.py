"""Imputed genotypes as columns: probabilities are an array of (P(aa), P(ab), P(bb)) for each sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dosage(probabilities: Column, prob_threshold: float = 0.0) -> Column:
    """2 P(bb) + P(ab); null for a sample with no probability over a positive threshold."""
    one = lambda p: F.get(p, 2) * 2.0 + F.get(p, 1)
    if prob_threshold > 0:
        return F.transform(probabilities, lambda p: F.when(F.array_max(p) > prob_threshold, one(p)))
    return F.transform(probabilities, one)


def allele_sum(d: Column) -> Column:
    """Over samples that are not null."""
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)


def called(d: Column) -> Column:
    return F.size(F.filter(d, lambda x: x.isNotNull()))


def dosage_record(probabilities: Column, a1: Column, a2: Column, prob_threshold: float = 0.0, is_chr23: bool = False) -> Column:
    """dosage of the minor allele, major, minor, maf (null without calls), minor_allele_count."""
    if is_chr23:
        raise NotImplementedError("dosage on chromosome 23 depends on sex and is not supported")
    d = dosage(probabilities, prob_threshold)
    total, n = allele_sum(d), called(d)
    share = F.try_divide(total, 2.0 * n)
    flip = F.coalesce(share > 0.5, F.lit(False))
    return F.struct(
        F.when(flip, F.transform(d, lambda x: 2.0 - x)).otherwise(d).alias("dosage"),
        F.when(flip, a2).otherwise(a1).alias("major"),
        F.when(flip, a1).otherwise(a2).alias("minor"),
        F.when(flip, 1.0 - share).otherwise(share).alias("maf"),
        F.when(flip, 2.0 * n - total).otherwise(total).alias("minor_allele_count"),
    )


def hard_calls(probabilities: Column, a1: Column, a2: Column, prob_threshold: float = 0.0) -> Column:
    """`A A`, `A B` or `B B` by the first largest probability; `0 0` if that is under the threshold."""
    names = F.array(F.concat_ws(" ", a1, a1), F.concat_ws(" ", a1, a2), F.concat_ws(" ", a2, a2))

    def one(p: Column) -> Column:
        best = F.array_max(p)
        return F.when(best < prob_threshold, "0 0").otherwise(F.element_at(names, F.array_position(p, best).cast("int")))

    return F.transform(probabilities, one)
