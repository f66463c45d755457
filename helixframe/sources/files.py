"""Other files: SeqXML, FASTA, delimited loci, principal isoforms, JDBC tables."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.schemas import PRINCIPAL, checked, let, normalize_chrom
from helixframe.sources.leading import body_lines

_NAMED = "array<struct<_name:string,_value:string>>"
SEQXML = (
    f"_id string, species struct<_name:string,_ncbiTaxID:string>, description string, DNAseq string, RNAseq string, AAseq string, DBRef array<struct<_source:string,_id:string>>, property {_NAMED}"
)
CHUNK = 1 << 16


def seqxml(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """uid, seq (upper-cased), seq_type, info, ordinal of each entry.  The last reference stands; a property without a value is "1".

    ordinal grows along the file, so that operators.sequences.sequence_by_id finds the last entry of an id.
    """
    rows = spark.read.format("xml").option("rowTag", "entry").schema(SEQXML).load(path)
    kinds = (("DNAseq", "DNA"), ("RNAseq", "RNA"), ("AAseq", "AA"))
    kind = F.coalesce(*(F.when(F.col(c).isNotNull(), k) for c, k in kinds))
    ref = F.try_element_at("DBRef", F.lit(-1))
    fixed = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("species", F.col("species._name")), ("species_ncbi_tax_id", F.col("species._ncbiTaxID")), ("description", F.col("description")), ("db_name", ref["_source"]), ("db_acc", ref["_id"]))))
    properties = F.transform(F.coalesce("property", F.array().cast(_NAMED)), lambda p: F.struct(p["_name"].alias("key"), F.coalesce(p["_value"], F.lit("1")).alias("value")))
    named = F.filter(F.concat(fixed, properties), lambda e: e["value"].isNotNull())
    last = let(named, lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda x: x["key"] == e["key"])))
    out = rows.select(F.col("_id").alias("uid"), F.upper(F.coalesce(*(c for c, _ in kinds))).alias("seq"), kind.alias("seq_type"), F.map_from_entries(last).alias("info"))
    out = out.withColumn("ordinal", F.monotonically_increasing_id())
    return checked(out, F.when(F.col("seq").isNull(), "entry without a sequence"), mode)


def fasta_reference(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """chrom, chunk_id, chunk_start, seq: a genome in pieces of `chunk` bases, for equi-joins.

    Records are read whole (a chromosome is one, and one task holds it), then cut in one pass over their bytes.
    """

    def cut(batches):
        for batch in batches:
            for value in batch.column(0):
                head, _, body = value.as_buffer().to_pybytes().partition(b"\n")
                name = re.match(rb"(?:>\s*)?(?:chr)?(\S*)", head)[1].decode()
                body = body.translate(None, b" \t\r\n\v\f").upper()
                for lo in range(0, len(body), chunk * 256):
                    at = np.arange(lo, min(len(body), lo + chunk * 256), chunk)
                    pieces = pa.array([body[i : i + chunk] for i in at.tolist()], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at // chunk), pa.array(at + 1), pieces], ["chrom", "chunk_id", "chunk_start", "seq"])

    return spark.read.option("lineSep", "\n>").text(path).mapInArrow(cut, "chrom string, chunk_id long, chunk_start long, seq string")


def remote_reference(spans: DataFrame, fetch: Callable[[str, int, int], str | None], chunk: int = CHUNK, most: int = 10_000) -> DataFrame:
    """The chunks of a reference that spans(chrom, start, end) ask for, from fetch(chrom, start, end), as from fasta_reference.

    The service's quota is global, so the driver fetches; more than `most` chunks are an error, which says to use a file.
    Chunk 0 of each chromosome is fetched too, as its length tells that of all.
    """
    spark = spans.sparkSession
    ids = F.explode(F.array_union(F.array(F.lit(0).cast("long")), F.sequence(F.floor((F.col("start") - 1) / chunk), F.floor((F.col("end") - 1) / chunk))))
    asked = spans.where("chrom is not null and start >= 1 and start <= end").select("chrom", ids.alias("chunk_id")).distinct().orderBy("chrom", "chunk_id").limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} chunks are asked for: use a FASTA file")
    rows = [(r.chrom, r.chunk_id, r.chunk_id * chunk + 1, fetch(r.chrom, r.chunk_id * chunk + 1, (r.chunk_id + 1) * chunk)) for r in asked]
    return spark.createDataFrame([r for r in rows if r[3]], "chrom string, chunk_id long, chunk_start long, seq string")


def reference(spark: SparkSession, path: str | None, spans: DataFrame, fetch: Callable[[str, int, int], str | None], chunk: int = CHUNK) -> DataFrame:
    """The FASTA file's chunks, or, where there is no such file, those that spans ask for from the service."""
    if path is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return fasta_reference(spark, path, chunk)
    return remote_reference(spans, fetch, chunk)


def delimited(spark: SparkSession, path: str, chrom_col: int, pos_col: int, *, sep: str = "\t", skip_lines: int = 0, ignore_startswith: str | None = None) -> DataFrame:
    """chrom, pos, fields, line of text files with loci; lines whose position is no number go to `_error`.

    skip_lines are the first ones of each file, by their place.
    """
    rows = body_lines(spark, path, skip=skip_lines)
    if ignore_startswith:
        rows = rows.where(~F.col("value").startswith(ignore_startswith))
    r = F.split("value", F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E")))
    out = rows.where(F.length("value") > 0).select(normalize_chrom(F.get(r, F.lit(chrom_col))).alias("chrom"), F.get(r, F.lit(pos_col)).try_cast("long").alias("pos"), r.alias("fields"), F.col("value").alias("line"))
    return checked(out, F.when(F.col("pos").isNull(), "position is not a number"))


def principal_isoforms(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated table of principal isoforms; .gz is decoded by its codec."""
    return spark.read.csv(path, sep="\t", schema=PRINCIPAL, mode="FAILFAST", enforceSchema=True)


#: The databases of genome builds.
DATABASES = {"grch37": "hg19", "grch38": "hg38"}


def genome_browser(spark: SparkSession, build: str, query: str, *, url: str, **options) -> DataFrame:
    """A query on the build's public database, run there; url has {db} where its name goes."""
    if build.lower() not in DATABASES:
        raise ValueError(f"build is GRCh37 or GRCh38, not {build!r}")
    reader = spark.read.format("jdbc").option("url", url.format(db=DATABASES[build.lower()])).option("query", query)
    return reader.options(**options).load()
