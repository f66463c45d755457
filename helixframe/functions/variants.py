"""Variants as columns: classes, formats, VCF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.schemas import normalize_chrom

#: The symbols of a format and the columns they stand for.
SYMBOLS = {"c": "chrom", "p": "pos", "r": "ref", "a": "alt", "i": "rs"}
VCF_HEADER = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"])
KEY = ["chrom", "pos", "ref", "alt", "vclass"]


def vclass(ref: Column, alt: Column) -> Column:
    """SNP if both alleles are one base and neither is a gap."""
    snp = (F.length(ref) == 1) & (F.length(alt) == 1) & (ref != "-") & (alt != "-")
    return F.when(snp, "SNP").otherwise("INDEL")


def allele_class(alleles: Column) -> Column:
    """Of a site: INDEL if any allele is a gap or longer than one base."""
    return F.when(F.exists(alleles, lambda a: (a == "-") | (F.length(a) > 1)), "INDEL").otherwise("SNP")


def indel_length(ref: Column, alt: Column) -> Column:
    return F.abs(F.length(ref) - F.length(alt))


def format_variant(spec: str, mapping: dict[str, str] | None = None) -> Column:
    """spec with %c %p %r %a %i (or mapping's symbols) replaced; an unknown symbol is a KeyError at once."""
    mapping = SYMBOLS if mapping is None else mapping
    parts = []
    for i, piece in enumerate(re.split("%(.)", spec)):
        parts.append(F.coalesce(F.col(mapping[piece]).cast("string"), F.lit("")) if i % 2 else F.lit(piece))
    return F.concat(*parts)


def label(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.format_string("chr%s:%d_%s/%s", chrom, pos, ref, alt)


def parse_snp(text: Column) -> Column:
    """`chrC:P_R/A1/A2...` as an array of variants, one for each A; null if it is not one."""
    form = "^(?:chr)?([0-9]{1,2}|MT|X|Y):([0-9]{1,18})_([^/]+)/(.+)$"
    part = lambda k: F.regexp_extract(text, form, k)
    one = lambda a: F.struct(normalize_chrom(part(1)).alias("chrom"), part(2).try_cast("long").alias("pos"), F.upper(part(3)).alias("ref"), F.upper(a).alias("alt"))
    return F.when(text.rlike(form), F.transform(F.split(part(4), "/"), one))


def vcf_line(chrom: Column, pos: Column, rs: Column, ref: Column, alt: Column) -> Column:
    dot = F.lit(".")
    return F.concat_ws("\t", chrom, pos.cast("string"), F.coalesce(F.nullif(rs, F.lit("")), dot), ref, alt, dot, F.lit("PASS"), dot)


def variant_hash(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.xxhash64(chrom, pos, ref, alt)


def valid_rs(rs: Column) -> Column:
    return rs.isNull() | rs.rlike("^rs[0-9]+$")


def clean_rs(name: Column) -> Column:
    """Ids that do not start with rs are null."""
    return F.when(name.startswith("rs"), name)


def distinct_variants(df):
    """rs is ignored; the class counts."""
    return df.dropDuplicates(KEY)
