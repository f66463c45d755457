"""Sinks: FASTA, VCF, locus tables, and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequences import fasta
from helixframe.functions.variants import VCF_HEADER, vcf_line


def write_fasta(seqs: DataFrame, path: str, *, line_len: int = 80, full_header: bool = False) -> None:
    record = fasta(F.col("uid"), F.col("seq"), F.col("info") if full_header else None, line_len)
    seqs.select(F.regexp_replace(record, "\n$", "").alias("value")).write.text(path)


def write_vcf(variants: DataFrame, path: str) -> None:
    """Sorted by locus; every file of the folder begins with the header."""
    rows = variants.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    line = vcf_line(*(F.col(c) for c in ("chrom", "pos", "rs", "ref", "alt")))
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # the id's lower 33 bits count a partition's rows
    rows.select(F.concat(F.when(first, VCF_HEADER + "\n").otherwise(""), line).alias("value")).write.text(path)


def write_by_locus(df: DataFrame, path: str, *, chrom: str = "chrom", pos: str = "pos") -> None:
    """Parquet by ranges of (chrom, pos), sorted: a locus is found by file and row-group statistics."""
    df.repartitionByRange(chrom, pos).sortWithinPartitions(chrom, pos).write.parquet(path)


def long_matrix(dosages: DataFrame) -> DataFrame:
    """name, sample (from 0), dosage."""
    return dosages.select("name", F.posexplode("dosage").alias("sample", "dosage"))


def wide_matrix(dosages: DataFrame, names: list[str]) -> DataFrame:
    """A row for each sample and a column for each of the named variants."""
    return long_matrix(dosages).where(F.col("name").isin(names)).groupBy("sample").pivot("name", names).agg(F.first("dosage"))


def variant_table(variants: DataFrame, info_keys: list[str], info: str = "info", strict: bool = True) -> DataFrame:
    """chrom, pos, rs, ref, alt and a column for each key of the info map, in order; strict: every row has just these keys."""
    keys = sorted(info_keys)
    rows = variants
    if strict:
        same = F.array_sort(F.map_keys(info)) == F.array(*(F.lit(k) for k in keys)).cast("array<string>")
        rows = rows.where(F.when(same, True).otherwise(F.raise_error(F.lit("info keys differ between variants")).cast("boolean")))
    return rows.select("chrom", "pos", "rs", "ref", "alt", *(F.try_element_at(info, F.lit(k)).alias(k) for k in keys))
