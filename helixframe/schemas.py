"""Row types of the genomic tables, and chromosome names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a chromosome's name begins so (a prefix match: `30` passes).
CHROM = "^([0-9]{1,2}|MT|X|Y)"

SEGMENT = "chrom string, start bigint, end bigint"
VARIANT = "chrom string, pos bigint, rs string, ref string, alt string, vclass string"
SEQUENCE = "uid string, seq string, seq_type string, info map<string,string>"
GENE = "build string, chrom string, start bigint, end bigint, strand int, symbol string, desc string, biotype string, xrefs map<string,string>, exons array<struct<start:bigint,end:bigint>>"
TRANSCRIPT = "build string, chrom string, start bigint, end bigint, enst string, appris_cat string, parent string, biotype string"
PRINCIPAL = "symbol string, ensembl_gene string, ensembl_transcript string, ccds string, category string"

BUILDS = ("GRCh37", "GRCh38")
MODES = ("PERMISSIVE", "FAILFAST", "DROPMALFORMED")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body's own lambdas use it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_chrom(chrom: Column) -> Column:
    """Without one leading `chr`."""
    return F.regexp_replace(chrom, "^chr", "")


def chrom_ok(chrom: Column) -> Column:
    return F.coalesce(chrom.rlike(CHROM), F.lit(False))


def checked(df, error: Column, mode: str = "PERMISSIVE"):
    """Rows with what is wrong in `_error` (PERMISSIVE), without the wrong ones (DROPMALFORMED), or none if one is wrong (FAILFAST)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    marked = df.withColumn("_error", error)
    if mode == "PERMISSIVE":
        return marked
    if mode == "DROPMALFORMED":
        return marked.where("_error is null").drop("_error")
    fail = F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")).cast("boolean")).otherwise(True)
    return marked.where(fail).drop("_error")


def settled(df):
    """df, each row's columns worked out once.

    A filter on columns moves below the projection that makes them and takes copies of their expressions along, even into a function that is called
    for each element; it does not move below a generator.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def valid_gene() -> Column:
    """What is wrong with a gene row, or null."""
    return (
        F.when(~F.coalesce(F.col("build").isin(*BUILDS), F.lit(False)), "unknown build")
        .when(~chrom_ok(F.col("chrom")), "invalid chromosome")
        .when(~F.coalesce(F.col("start") < F.col("end"), F.lit(False)), "start is not before end")
        .when(F.col("strand").isNull() | F.col("xrefs").isNull(), "strand and xrefs are required")
    )


def valid_variant() -> Column:
    """What is wrong with a variant row, or null."""
    missing = F.col("chrom").isNull() | F.col("pos").isNull() | F.col("ref").isNull() | F.col("alt").isNull()
    return (
        F.when(missing, "chrom, pos, ref and alt are required")
        .when(~chrom_ok(F.col("chrom")), "invalid chromosome")
        .when(~F.coalesce(F.col("rs").rlike("^rs[0-9]+$"), F.lit(True)), "rs is not an rs number")
        .when((F.col("vclass") == "INDEL") & (F.col("ref").contains("-") | F.col("alt").contains("-")), "an indel is written with the base before it, not with a gap")
    )


def valid_transcript() -> Column:
    """What is wrong with a transcript row, or null."""
    return (
        F.when(~F.coalesce(F.col("build").isin(*BUILDS), F.lit(False)), "unknown build")
        .when(~chrom_ok(F.col("chrom")), "invalid chromosome")
        .when(~F.coalesce(F.col("start") < F.col("end"), F.lit(False)), "start is not before end")
        .when(F.col("enst").isNull(), "enst is required")
    )


def valid_sequence() -> Column:
    """What is wrong with a sequence row, or null."""
    return F.when(F.col("uid").isNull() | F.col("seq").isNull(), "uid and seq are required").when(~F.coalesce(F.col("seq_type").isin("DNA", "RNA", "AA"), F.lit(False)), "seq_type is DNA, RNA or AA")


def validated(df, kind: str, mode: str = "PERMISSIVE"):
    """df checked as rows of that kind: gene, transcript, variant or sequence."""
    rules = {"gene": valid_gene, "transcript": valid_transcript, "variant": valid_variant, "sequence": valid_sequence}
    return checked(df, rules[kind](), mode)
