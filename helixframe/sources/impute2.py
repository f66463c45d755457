"""Imputed genotype files: `chrom name pos a1 a2`, then three probabilities a sample, one space apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.genotypes import dosage_record, hard_calls
from helixframe.schemas import checked, settled

#: Modes and the options that each takes.
OPTIONS = {"line": set(), "dosage": {"prob_threshold", "is_chr23", "sex_vector"}, "hard_call": {"prob_threshold"}}


def parse(lines: DataFrame, line: str = "value", mode: str = "PERMISSIVE") -> DataFrame:
    """name, chrom, pos, a1, a2, probabilities of text lines, batch or stream; empty lines go."""
    parts = F.split("_line", " ")
    rows = settled(lines.select(F.col(line).alias("_line"))).where(F.length("_line") > 0)
    rows = settled(rows.select("_line", parts.alias("r")))
    n = F.size("r")
    triple = lambda i: F.array(*(F.get("r", i + j - 1).try_cast("double") for j in range(3)))
    each = F.transform(F.sequence(F.lit(6), F.greatest(n - 2, F.lit(6)), F.lit(3)), triple)
    probabilities = F.when(n < 8, F.array().cast("array<array<double>>")).otherwise(each)
    rows = rows.select("_line", "r", F.get("r", 1).alias("name"), F.get("r", 0).alias("chrom"), F.get("r", 2).try_cast("long").alias("pos"), F.get("r", 3).alias("a1"), F.get("r", 4).alias("a2"), probabilities.alias("probabilities"))
    error = (
        F.when((n < 5) | ((n - 5) % 3 != 0), F.concat(F.lit("not three probabilities a sample: "), F.left("_line", F.lit(60))))
        .when(F.col("pos").isNull(), "position is not a number")
        .when(F.exists(F.flatten("probabilities"), lambda p: p.isNull()), "probability is not a number")
    )
    return checked(settled(rows), error, mode).drop("_line", "r")


def read(spark: SparkSession, path: str, mode: str = "line", *, errors: str = "FAILFAST", **options) -> DataFrame:
    """A file as lines, dosages, or hard calls.  Compressed files are read by their codec; spread them by repartition()."""
    if mode not in OPTIONS:
        raise TypeError(f"mode is one of {', '.join(OPTIONS)}, not {mode!r}")
    if unknown := set(options) - OPTIONS[mode]:
        raise TypeError(f"mode {mode!r} takes no {', '.join(sorted(unknown))}")
    rows = parse(spark.read.text(path), mode=errors)
    return rows if mode == "line" else dosages(rows, **options) if mode == "dosage" else calls(rows, **options)


def dosages(rows: DataFrame, prob_threshold: float = 0.0, is_chr23: bool = False, sex_vector: Column | None = None) -> DataFrame:
    record = dosage_record(F.col("probabilities"), F.col("a1"), F.col("a2"), prob_threshold, is_chr23)
    return rows.select("name", "chrom", "pos", record.alias("d")).select("d.dosage", "d.major", "d.minor", "d.maf", "d.minor_allele_count", "name", "chrom", "pos")


def calls(rows: DataFrame, prob_threshold: float = 0.0) -> DataFrame:
    return rows.select(hard_calls(F.col("probabilities"), F.col("a1"), F.col("a2"), prob_threshold).alias("calls"), "name", "chrom", "pos")
