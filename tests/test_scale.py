"""What the larger tables need of plans: nothing that grows with the genome or the table comes to the driver."""

import os
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import variants
from helixframe.operators import genes, sequences
from helixframe.plans import catalogue
from helixframe.sources import impute2

HERE = "/root/testdata/sf0.001"
#: Queries that look bases up in the reference.
LOOKUPS = ["gene_region_sequences", "indel_allele_check", "reference_allele_check", "variant_allele_check"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reference_is_not_broadcast(spark):
    """Pieces whose text a plan takes for 20 bytes a row."""
    chunks = spark.range(200).select(F.lit("1").alias("chrom"), F.col("id").alias("chunk_id"), (F.col("id") * 1000 + 1).alias("chunk_start"), F.repeat(F.lit("ACGTA"), F.lit(200)).alias("seq"))
    asked = spark.range(3000).select(F.lit("1").alias("chrom"), (F.col("id") * 60 + 1).alias("start"), (F.col("id") * 60 + 7).alias("end"))
    found = sequences.with_reference(asked, chunks)
    assert "Broadcast" not in plan_of(found)
    text = "ACGTA" * 40_000
    assert all(r.sequence == text[r.start - 1 : r.end] for r in found.collect()) and found.count() == 3000


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
@pytest.mark.parametrize("name", LOOKUPS)
def test_lookups_do_not_broadcast(spark, name):
    assert "Broadcast" not in plan_of(catalogue.QUERIES[name](spark, HERE))


@pytest.mark.parametrize("batch", [10_000, 7])
def test_lanes_take_no_call_for_each_island(spark, batch):
    """Islands of one gene and of many, over ends of batches; a place missing."""
    rng = random.Random(11)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([1, 5, 400])
        rows.append((i, rng.choice(["+", "-", None]), at, at + rng.choice([1, 30, 300])))
    rows += [(900, "+", None, 5), (901, "+", None, 7), (902, None, None, None)]
    df = spark.createDataFrame(rows, "gene_id long, strand string, start long, end long").repartition(3)
    want = []
    for strand in ("+", "-", None):
        ends = []
        own = [r for r in rows if r[1] == strand]
        for g, _, s, e in sorted((r for r in own if r[2] is not None), key=lambda r: (r[2], r[3], r[0])):
            lane = next((j for j, x in enumerate(ends) if x < s), len(ends))
            ends[lane : lane + 1] = [e + genes.PAD]
            want.append((g, strand, -lane))
        want += [(r[0], strand, -j) for j, r in enumerate(r for r in own if r[2] is None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = genes.lanes(df, by=["strand"])
        assert "FlatMapGroups" not in plan_of(found)
        assert sorted(((r.gene_id, r.strand, r.lane) for r in found.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("mode", ["FAILFAST", "DROPMALFORMED"])
def test_genotype_lines_are_split_once(spark, mode):
    """A check of parsed lines takes no copy of their splitting, or of what makes the lines, into the loop over samples."""
    lines = spark.range(5).select(F.concat(F.lit("1 v"), F.col("id"), F.lit(" 7 A G"), F.repeat(F.lit(" 0.5 0.25 0.25"), F.lit(3))).alias("value"))
    found = impute2.parse(lines, mode=mode)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("repeat(") <= 1
    assert sorted(map(tuple, found.collect())) == [(f"v{i}", "1", 7, "A", "G", [[0.5, 0.25, 0.25]] * 3) for i in range(5)]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def pieces_of(spark, text, size):
    rows = [("1", i // size, i + 1, text[i : i + size]) for i in range(0, len(text), size)]
    return spark.createDataFrame(rows, "chrom string, chunk_id long, chunk_start long, seq string")


def test_pieces_that_nothing_asks_for_are_not_built(spark):
    """Far pieces' text is an error."""
    text = F.when(F.col("id").between(2, 4) | (F.col("id") == 0), F.repeat(F.lit("ACGTA"), F.lit(20))).otherwise(F.raise_error(F.lit("built")).cast("string"))
    chunks = spark.range(40).select(F.lit("1").alias("chrom"), F.col("id").alias("chunk_id"), (F.col("id") * 100 + 1).alias("chunk_start"), text.alias("seq"))
    asked = spark.createDataFrame([("1", 251, 253), ("1", 399, 402), ("1", None, 7), (None, 1, 7), ("2", 300, 301)], "chrom string, start long, end long")
    found = {(r.chrom, r.start): r.sequence for r in sequences.with_reference(asked, chunks).collect()}
    assert found == {("1", 251): "ACG", ("1", 399): "TAAC", ("1", None): None, (None, 1): None, ("2", 300): None}


def test_gaps_take_one_lookup(spark):
    """The base before a gap is there, too, where the deleted bases run past the reference, and where ref is null."""
    rows = [(7, "GT", "-"), (10, "AC", "-"), (11, "A", "-"), (12, "A", "-"), (1, "A", "-"), (4, "-", "GG"), (5, None, "-"), (3, "GTA", "G"), (10, "ACC", "A")]
    indels = spark.createDataFrame([("1", *r) for r in rows], "chrom string, pos long, ref string, alt string")
    found = sequences.check_indels(indels, pieces_of(spark, "ACGTACGTAC", 4), fix=True)
    assert optimized(found).count("collect_list(") == 1
    want = {(6, "CGT", "C", "FIXED"), (9, "AAC", "A", "MISMATCH"), (10, "CA", "C", "MISMATCH"), (11, "?A", "?", "MISMATCH"), (0, "?A", "?", "MISMATCH"), (3, "G", "GGG", "FIXED"), (4, None, "T", "MISMATCH"), (3, "GTA", "G", "OK"), (10, "ACC", "A", "MISMATCH")}
    assert {(r.pos, r.ref, r.alt, r.status) for r in found.collect()} == want


def test_single_bytes_are_cut_as_bytes(spark):
    """Pieces with other characters are cut as text."""
    rng = random.Random(5)
    text = "".join(rng.choice("acgt") for _ in range(40)) + "acég世t" + "".join(rng.choice("ACGT") for _ in range(40))
    asked = [(s, s + n) for s in range(1, len(text) + 1) for n in (0, 1, 9, 30) if s + n <= len(text)]
    df = spark.createDataFrame([("1", *a) for a in asked], "chrom string, start long, end long")
    found = sequences.with_reference(df, pieces_of(spark, text, 10))
    assert "as binary)" in optimized(found)
    assert {(r.start, r.end): r.sequence for r in found.collect()} == {(s, e): text[s - 1 : e].upper() for s, e in asked}


@pytest.mark.parametrize("flip", [False, True])
def test_both_classes_take_one_lookup(spark, flip):
    rng = random.Random(3)
    text = "".join(rng.choice("acGT") for _ in range(60))
    alleles = ["A", "c", "G", "T", "-", "GT", "ACG", "", None]
    rows = [(rng.choice(["1", "1", "1", "2", None]), rng.choice([None, *range(-1, 64)]), rng.choice(alleles), rng.choice(alleles), i) for i in range(600)]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, i long")
    chunks = pieces_of(spark, text, 7)
    found = sequences.check_variants(df, chunks, flip=flip)
    assert optimized(found).count("collect_list(") == 1
    kind = variants.vclass(F.col("ref"), F.col("alt"))
    apart = sequences.check_snps(df.where(kind == "SNP"), chunks, flip=flip).drop("genome").unionByName(sequences.check_indels(df.where(kind == "INDEL"), chunks, fix=flip))
    assert found.columns == apart.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, apart.collect()))
