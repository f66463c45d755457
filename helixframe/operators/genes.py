"""Genes, transcripts, principal isoforms, variants of a region, and drawing lanes."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.intervals import segment
from helixframe.functions.sequences import strip_gaps
from helixframe.functions.variants import allele_class, clean_rs
from helixframe.operators.intervals import islands, overlap_join
from helixframe.operators.prefix import fresh
from helixframe.operators.sequences import check_indels

# Categories of principal isoforms, best first.
CATEGORIES = ("appris_principal", "appris_candidate_longest_ccds", "appris_candidate_ccds", "appris_candidate_longest_seq", "appris_candidate")
SEQUENCE_KINDS = ("genomic", "cds", "cdna", "protein")


def principal_transcripts(table: DataFrame, *, gene: str = "ensembl_gene", category: str = "category") -> DataFrame:
    """All transcripts of each gene's best category; other categories never count."""
    place = F.array_position(F.array(*(F.lit(c) for c in CATEGORIES)), F.col(category))
    rows = table.withColumn("_place", place).where("_place > 0")
    best = rows.groupBy(F.col(gene).alias("_gene")).agg(F.min("_place").alias("_best"))
    return rows.join(best, (F.col(gene) == F.col("_gene")) & (F.col("_place") == F.col("_best"))).drop("_place", "_gene", "_best")


def with_categories(transcripts: DataFrame, table: DataFrame) -> DataFrame:
    """Transcripts with appris_cat, null where the table has none."""
    known = table.groupBy(F.col("ensembl_transcript").alias("_t")).agg(F.max("category").alias("_cat"))
    return transcripts.drop("appris_cat").join(known, F.col("enst") == F.col("_t"), "left").withColumnRenamed("_cat", "appris_cat").drop("_t")


def genes_of(features: DataFrame, assembly: str) -> DataFrame:
    """Gene rows from features of all types (gene, transcript, exon in one table), with their transcripts and exons."""
    own = features.where(F.col("assembly_name") == assembly)
    genes = own.where("feature_type = 'gene'").select(F.lit(assembly).alias("build"), F.col("id").alias("gene_id"), F.col("seq_region_name").alias("chrom"), "start", "end", "strand", F.col("external_name").alias("symbol"), F.col("description").alias("desc"), "biotype")
    scripts = own.where("feature_type = 'transcript'")
    exons = own.where("feature_type = 'exon'").select(F.col("Parent").alias("_enst"), "start", "end")
    nested = scripts.groupBy(F.col("Parent").alias("_gene")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("enst"), F.col("start"), F.col("end"), F.col("biotype")))).alias("transcripts"))
    per_gene = exons.join(scripts.select(F.col("id").alias("_enst"), F.col("Parent").alias("_owner")), "_enst").groupBy("_owner").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("exons"))
    joined = genes.join(nested, F.col("gene_id") == F.col("_gene"), "left").join(per_gene, F.col("gene_id") == F.col("_owner"), "left")
    xrefs = F.create_map(F.lit("ensembl_gene_id"), F.col("gene_id"))
    return joined.drop("_gene", "_owner").withColumn("xrefs", xrefs)


def display_name(symbol, xrefs):
    """symbol, else the first of three cross references, else Unknown."""
    ids = [F.try_element_at(xrefs, F.lit(k)) for k in ("ensembl_gene_id", "entrez_id", "ucsc_id")]
    return F.coalesce(symbol, *ids, F.lit("Unknown"))


def genes_by_symbol(genes: DataFrame, xrefs: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols(symbol) through xrefs(symbol, ensembl_gene_id) to genes(gene_id)."""
    return symbols.join(xrefs, "symbol").join(genes.withColumnRenamed("symbol", "gene_symbol"), F.col("ensembl_gene_id") == F.col("gene_id"))


def _overlapping(regions: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of table(chrom, start, end, key) that overlap any segment of regions(region_id, chrom, start, end), once a region."""
    c, s, e = fresh(table.columns, "region_chrom", "region_start", "region_end")
    asked = regions.select(F.col("region_id"), F.col("chrom").alias(c), F.col("start").alias(s), F.col("end").alias(e))
    return overlap_join(asked, table, left_on=(c, s, e)).drop(c, s, e).dropDuplicates(["region_id", key])


def transcripts_in(regions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Transcripts that overlap any segment of regions(region_id, chrom, start, end)."""
    return _overlapping(regions, transcripts, "enst")


def region_of(genes: DataFrame, out: str = "region") -> DataFrame:
    """genes or transcripts with their region, of one segment."""
    return genes.withColumn(out, F.array(segment(F.col("chrom"), F.col("start"), F.col("end"))))


def genes_in(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes that overlap any segment of regions(region_id, chrom, start, end)."""
    return _overlapping(regions, genes, "gene_id")


def isoforms_of(table: DataFrame, gene: str) -> DataFrame:
    """The transcripts of a gene, each with its category."""
    return table.where(F.col("ensembl_gene") == gene).select("ensembl_transcript", "category")


def category_of(table: DataFrame, transcript: str) -> DataFrame:
    """The category of a transcript; no row where the table lacks it."""
    return table.where(F.col("ensembl_transcript") == transcript).select("category")


def variants_by_rs(names: DataFrame, sites: DataFrame, vclass: str | None = None) -> DataFrame:
    """A variant for each alternative of the sites(id, chrom, start, end, alleles) named in names(rs); of one class, if asked.

    A site of one base is a SNP, others are indels.  Unknown names give no row.
    """
    if vclass not in (None, "SNP", "INDEL"):
        raise ValueError(f"vclass is SNP, INDEL or None, not {vclass!r}")
    known = names.where(F.col("rs").isNotNull()).select(F.col("rs").alias("id")).distinct().join(sites, "id").where(F.size("alleles") >= 2)
    kind = F.when(F.col("start") == F.col("end"), "SNP").otherwise("INDEL")
    alts = F.explode(F.transform(F.slice("alleles", 2, F.size("alleles")), F.upper))
    rows = known.select(F.col("id").alias("rs"), "chrom", F.col("start").alias("pos"), F.upper(F.get("alleles", F.lit(0))).alias("ref"), alts.alias("alt"), kind.alias("vclass"))
    return rows if vclass is None else rows.where(F.col("vclass") == vclass)


def annotated(variants: DataFrame, annotations: DataFrame) -> DataFrame:
    """variants(rs, ...) with maf, evidence and most_severe_consequence of annotations(rs, ...); null where there are none."""
    known = annotations.groupBy(F.col("rs").alias("rs_")).agg(*(F.max(c).alias(c) for c in ("maf", "evidence", "most_severe_consequence")))
    return variants.join(known, F.col("rs") == F.col("rs_"), "left").drop("rs_")


def variants_in(regions: DataFrame, sites: DataFrame, chunks: DataFrame | None = None, *, include_gaps: bool = False) -> DataFrame:
    """A variant for each alternative of sites(id, chrom, start, end, alleles) that overlap a region.

    Sites with fewer than two alleles go.  With chunks of the reference, indels with gaps are written with the base before.
    include_gaps: a region is taken from its first start to its last end.
    """
    if include_gaps:
        regions = regions.groupBy("region_id", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    asked = regions.select("region_id", F.col("chrom").alias("_rc"), F.col("start").alias("_rs"), F.col("end").alias("_re"))
    # an insertion stands between two bases, its start one past its end
    held = sites.where(F.size("alleles") >= 2).withColumns({"_lo": F.least("start", "end"), "_hi": F.greatest("start", "end")})
    met = overlap_join(asked, held, left_on=("_rc", "_rs", "_re"), right_on=("chrom", "_lo", "_hi"))
    alts = F.explode(F.transform(F.slice("alleles", 2, F.size("alleles")), F.upper))
    rows = met.select("region_id", "chrom", F.col("start").alias("pos"), clean_rs(F.col("id")).alias("rs"), F.upper(F.get("alleles", F.lit(0))).alias("ref"), alts.alias("alt"), allele_class(F.col("alleles")).alias("vclass")).distinct()
    if chunks is None:
        return rows
    indels = check_indels(rows.where("vclass = 'INDEL'"), chunks, fix=True).drop("status")
    return rows.where("vclass = 'SNP'").unionByName(indels)


def transcript_sequences(transcripts: DataFrame, sequences: DataFrame, kind: str) -> DataFrame:
    """sequences(enst, kind, seq) of the transcripts; proteins are AA, others DNA."""
    if kind not in SEQUENCE_KINDS:
        raise ValueError(f"kind is one of {', '.join(SEQUENCE_KINDS)}")
    own = sequences.where(F.col("kind") == kind).select("enst", F.upper("seq").alias("seq"))
    return transcripts.join(own, "enst").select(F.col("enst").alias("uid"), "seq", F.lit("AA" if kind == "protein" else "DNA").alias("seq_type"))


def homologs(table: DataFrame, gene_id: str, kind: str) -> DataFrame:
    """Gapless sequences of a gene's orthologs or paralogs, with species, taxon and identity."""
    if kind not in ("orthologues", "paralogues"):
        raise ValueError("kind is orthologues or paralogues")
    rows = table.where((F.col("gene_id") == gene_id) & (F.col("kind") == kind))
    return rows.select("target_id", strip_gaps(F.col("align_seq")).alias("seq"), "species", "taxon_id", "perc_id")


#: Room after a gene in its lane.
PAD = 3e-3


def lanes(genes: DataFrame, *, by: list[str], start: str = "start", end: str = "end", key: str = "gene_id", pad: float = PAD, window: tuple[float, float] | None = None) -> DataFrame:
    """by, key, lane (0, -1, ...): each gene of a group, by start, end and key, in the first lane whose last end it clears.

    window: only genes that overlap it count, and they are clipped to it.  Genes are dealt by islands between which nothing
    stands, as no lane passes from one to the next.  A task reads its islands in order, one after another, and holds only the lanes in use: most islands
    are of one gene, so a call of Python for each would cost more than all else.
    """
    fields = ", ".join(f"`{c}` {genes.schema[c].dataType.simpleString()}" for c in [*by, key])
    lo, hi = F.col(start).cast("double"), F.col(end).cast("double")
    if window is not None:
        genes = genes.where((hi >= window[0]) & (lo <= window[1]))
        lo, hi = F.greatest(lo, F.lit(float(window[0]))), F.least(hi, F.lit(float(window[1])))
    group = F.concat(*(F.concat(F.coalesce(F.length(F.col(c).cast("string")), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in by)) if by else F.lit("")
    placed = genes.select(*by, key, group.alias("lane_group"), F.col(start).alias("lane_first"), F.col(end).alias("lane_last"), lo.alias("lane_from"), (hi + F.lit(pad)).alias("lane_to"))
    cut = islands(placed, on=("lane_group", "lane_from", "lane_to"))

    def pack(batches):
        at, busy, free = None, [], []
        n = len(by) + 1
        for batch in batches:
            out = []
            for group, island, s, e in zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True):
                here = (group, "nan" if island != island else island)
                if here != at:
                    at, busy, free = here, [], []
                s, e = (math.nan if x is None else x for x in (s, e))
                while busy and busy[0][0] < s:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                j = heapq.heappop(free) if free else len(busy)
                heapq.heappush(busy, (e, j))
                out.append(-j)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.int32())], [*by, key, "lane"])

    order = [F.col(c).asc_nulls_last() for c in ("lane_first", "lane_last", f"`{key}`")]
    rows = cut.repartition("lane_group", "island").sortWithinPartitions("lane_group", "island", *order)
    return rows.select(*(f"`{c}`" for c in [*by, key]), "lane_group", "island", "lane_from", "lane_to").mapInArrow(pack, f"{fields}, lane int")
