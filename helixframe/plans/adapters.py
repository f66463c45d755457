"""Genomic views of the test tables, for Spark and, as SQL text, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHROM = "cast({} % 22 + 1 as varchar(9))"
CHUNK = 11_000

#: One text for both dialects; {g} is the oracle's flag for replacing all matches.
VIEWS = {
    "intervals": f"select {_CHROM.format('l_suppkey')} as chrom, l_partkey * 500 + l_linenumber * 7 + 1 as seg_start, l_partkey * 500 + l_linenumber * 7 + 1 + cast(l_quantity as bigint) as seg_end from lineitem",
    "genes": f"select p_partkey as gene_id, p_name as symbol, {_CHROM.format('p_partkey')} as chrom, p_partkey * 500 + 1 as gene_start, p_partkey * 500 + 1 + p_size * 20 as gene_end, case when p_partkey % 2 = 0 then 1 else -1 end as strand, p_type as biotype from part",
    "variants": f"select {_CHROM.format('o_custkey')} as chrom, (o_orderkey * 71) % 1000000 + 1 as pos, case when o_orderkey % 5 = 0 then null else concat('rs', o_orderkey) end as rs, substring('ACGT', cast(o_orderkey % 4 + 1 as int), 1) as ref, case when o_orderkey % 7 = 0 then 'TTC' else substring('CGTA', cast(o_orderkey % 4 + 1 as int), 1) end as alt from orders",
    "sequences": "select concat('doc', doc_id) as uid, regexp_replace(upper(text), '[^ACGT]', ''{g}) as seq from documents",
    "gtf_lines": "select event_id, concat('chr', user_id % 22 + 1, '\t', 'sim', '\t', event_type, '\t', event_id + 1, '\t', event_id + 1 + user_id, '\t', case when event_id % 3 = 0 then '.' else cast(user_id as varchar(20)) end, '\t', case event_id % 3 when 0 then '+' when 1 then '-' else '.' end, '\t', event_id % 3, '\t', 'gene_id \"g', user_id, '\"; props=', regexp_replace(props, '[^0-9]', ''{g}), ';') as line from events",
    "principal": "select c_nationkey as gene_id, c_custkey as transcript_id, case c_mktsegment when 'BUILDING' then 'appris_principal' when 'AUTOMOBILE' then 'appris_candidate_longest_ccds' when 'MACHINERY' then 'appris_candidate_ccds' when 'HOUSEHOLD' then 'appris_candidate_longest_seq' else 'appris_candidate' end as category from customer",
    "reference_chunks": f"select {_CHROM.format('p_partkey')} as chrom, cast(floor(p_partkey / 22) as bigint) as chunk_id, cast(floor(p_partkey / 22) as bigint) * {CHUNK} + 1 as chunk_start, repeat(substring('ACGTACGT', cast(p_partkey % 4 + 1 as int), 4), {CHUNK // 4}) as seq from part",
}
_TABLES = {"intervals": "lineitem", "genes": "part", "variants": "orders", "sequences": "documents", "gtf_lines": "events", "principal": "customer", "reference_chunks": "part"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "genotypes":
        return genotypes(spark, sf_dir)
    table = _TABLES[name]
    sql = VIEWS[name].replace("{g}", "").replace(f" from {table}", " from {source}")
    return spark.sql(sql, source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, a1, a2, probabilities: each vector's values in threes, made positive and to sum 1."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    value = lambda i: F.abs(F.get("embedding", i).cast("double"))
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1), lambda t: F.array(value(t * 3), value(t * 3 + 1), value(t * 3 + 2)))
    total = lambda p: F.get(p, 0) + F.get(p, 1) + F.get(p, 2)
    unit = F.transform(triples, lambda p: F.transform(p, lambda x: x / total(p)))
    return e.select("vec_id", F.lit("A").alias("a1"), F.lit("G").alias("a2"), unit.alias("probabilities"))


def sql_view(name: str) -> str:
    return VIEWS[name].replace("{g}", ", 'g'")


GENOTYPES_SQL = """
  select vec_id, sample, p0 / (p0 + p1 + p2) as p0, p1 / (p0 + p1 + p2) as p1, p2 / (p0 + p1 + p2) as p2 from (
    select vec_id, sample, abs(cast(embedding[sample * 3 + 1] as double)) as p0, abs(cast(embedding[sample * 3 + 2] as double)) as p1, abs(cast(embedding[sample * 3 + 3] as double)) as p2
    from embeddings, range(0, 21) as t(sample))"""
