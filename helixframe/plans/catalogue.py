"""Registered queries over whole tables, each with the oracle's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import genotypes as G
from helixframe.functions import intervals as I
from helixframe.functions import sequences as S
from helixframe.functions import variants as V
from helixframe.operators import genes as genes_
from helixframe.operators import intervals as intervals_
from helixframe.operators import sequences as sequences_
from helixframe.plans.adapters import CHUNK, GENOTYPES_SQL, sql_view, view
from helixframe.sinks.tables import long_matrix
from helixframe.sources import gtf, impute2

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GENE = ("chrom", "gene_start", "gene_end")
SEG = ("chrom", "seg_start", "seg_end")
_THRESHOLD = 0.6


def query(sql: str | None = None, *views: str):
    """Register a function as the query of its name; sql reads the views named."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [f"{v} as ({sql_view(v) if v != 'genotypes' else GENOTYPES_SQL})" for v in views]
            ORACLES[f.__name__] = (f"with {', '.join(parts)} " if parts else "") + sql
        return f

    return register


def _genes(spark, d, prefix: str = "") -> DataFrame:
    df = view(spark, d, "genes")
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in ("chrom", "strand")}) if prefix else df


@query("select g.gene_id, count(*) as n_variants from genes g join variants v on g.chrom = v.chrom and v.pos between g.gene_start and g.gene_end group by g.gene_id", "genes", "variants")
def gene_variant_counts(spark, d):
    pairs = intervals_.points_in(view(spark, d, "variants"), _genes(spark, d, "g_"), on=("g_chrom", "gene_start", "gene_end"))
    return pairs.groupBy("gene_id").agg(F.count("*").alias("n_variants"))


@query("select v.* from variants v where exists (select 1 from genes g where g.chrom = v.chrom and v.pos between g.gene_start and g.gene_end)", "genes", "variants")
def variants_in_any_gene(spark, d):
    return intervals_.points_in(view(spark, d, "variants"), _genes(spark, d), on=GENE, how="left_semi")


@query("select v.* from variants v where not exists (select 1 from genes g where g.chrom = v.chrom and v.pos between g.gene_start and g.gene_end)", "genes", "variants")
def variants_outside_genes(spark, d):
    return intervals_.points_in(view(spark, d, "variants"), _genes(spark, d), on=GENE, how="left_anti")


_MERGE = """select chrom, min(seg_start) as seg_start, max(seg_end) as seg_end from (
  select *, sum(opens) over (partition by chrom order by seg_start, seg_end rows unbounded preceding) as island from (
    select *, case when seg_start <= max(seg_end) over (partition by chrom order by seg_start, seg_end rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from {}))
  group by chrom, island"""


@query(_MERGE.format("intervals"), "intervals")
def merge_intervals(spark, d):
    return intervals_.merge(view(spark, d, "intervals"), on=SEG)


@query(_MERGE.format("(select chrom, seg_start, seg_end from intervals union all select chrom, gene_start, gene_end from genes)"), "intervals", "genes")
def union_intervals(spark, d):
    spans = _genes(spark, d).select("chrom", F.col("gene_start").alias("seg_start"), F.col("gene_end").alias("seg_end"))
    return intervals_.union(view(spark, d, "intervals"), spans, on=SEG)


def _pairs(spark, d, contained: bool) -> DataFrame:
    return intervals_.overlap_join(_genes(spark, d, "g_"), view(spark, d, "intervals"), left_on=("g_chrom", "gene_start", "gene_end"), right_on=SEG, contained=contained)


@query("select g.gene_id, i.chrom, i.seg_start, i.seg_end from genes g join intervals i on g.chrom = i.chrom and g.gene_start <= i.seg_end and g.gene_end >= i.seg_start", "genes", "intervals")
def interval_overlap_pairs(spark, d):
    return _pairs(spark, d, False).select("gene_id", *SEG)


@query("select g.gene_id, i.chrom, i.seg_start, i.seg_end from genes g join intervals i on g.chrom = i.chrom and g.gene_start <= i.seg_start and i.seg_end <= g.gene_end", "genes", "intervals")
def interval_containment(spark, d):
    return _pairs(spark, d, True).select("gene_id", *SEG)


@query("select v.chrom, v.pos, v.rs, min(greatest(0, g.gene_start - v.pos, v.pos - g.gene_end)) as distance from (select distinct chrom, pos, rs from variants) v left join genes g on g.chrom = v.chrom group by v.chrom, v.pos, v.rs", "genes", "variants")
def nearest_gene_distance(spark, d):
    return intervals_.nearest_distance(view(spark, d, "variants").select("chrom", "pos", "rs").distinct(), _genes(spark, d), on=GENE)


@query("select i.chrom, i.seg_start, i.seg_end, min(greatest(0, g.gene_start - i.seg_end, i.seg_start - g.gene_end)) as distance from (select distinct * from intervals) i left join genes g on g.chrom = i.chrom group by all", "genes", "intervals")
def nearest_gene_of_interval(spark, d):
    return intervals_.nearest_distance(view(spark, d, "intervals").distinct(), _genes(spark, d), pos="seg_start", end="seg_end", on=GENE)


@query("select chrom, min(seg_start) as seg_start, max(seg_end) as seg_end, count(*) as n_segments from intervals group by chrom", "intervals")
def region_span(spark, d):
    return intervals_.spans(view(spark, d, "intervals"), "chrom", start="seg_start", end="seg_end")


@query("select concat('chr', chrom, ':', seg_start, '-', seg_end) as region, chrom, seg_start, seg_end from intervals where seg_start < seg_end", "intervals")
def parse_region(spark, d):
    text = F.format_string("chr%s:%d-%d", *(F.col(c) for c in SEG))
    rows = view(spark, d, "intervals").select(text.alias("region")).withColumn("s", I.parse_region(F.col("region")))
    return rows.where("s is not null").select("region", F.col("s.chrom").alias("chrom"), F.col("s.start").alias("seg_start"), F.col("s.end").alias("seg_end"))


@query("select chrom, pos, ref, unnest([alt, 'G']) as alt from variants", "variants")
def parse_snp(spark, d):
    text = F.concat(V.label(F.col("chrom"), F.col("pos"), F.col("ref"), F.lower("alt")), F.lit("/g"))
    return view(spark, d, "variants").select(F.explode(V.parse_snp(text)).alias("v")).select("v.*")


@query("select concat(chrom, chr(9), pos, chr(9), coalesce(rs, '.'), chr(9), ref, chr(9), alt, chr(9), '.', chr(9), 'PASS', chr(9), '.') as line from variants", "variants")
def vcf_lines(spark, d):
    return view(spark, d, "variants").select(V.vcf_line(*(F.col(c) for c in ("chrom", "pos", "rs", "ref", "alt"))).alias("line"))


@query("select concat('chr', chrom, ':', pos, '_', ref, '/', alt) as label, concat('chr', chrom, ':', pos, '-', pos, ' ', coalesce(rs, ''), ';') as formatted from variants", "variants")
def variant_labels(spark, d):
    return view(spark, d, "variants").select(V.label(*(F.col(c) for c in ("chrom", "pos", "ref", "alt"))).alias("label"), V.format_variant("chr%c:%p-%p %i;").alias("formatted"))


@query("select case when length(ref) = 1 and length(alt) = 1 then 'SNP' else 'INDEL' end as vclass, count(*) as n, count(rs) as n_named from variants group by 1", "variants")
def variant_class_counts(spark, d):
    rows = view(spark, d, "variants").withColumn("vclass", V.vclass(F.col("ref"), F.col("alt")))
    return rows.groupBy("vclass").agg(F.count("*").alias("n"), F.count("rs").alias("n_named"))


@query("select cast(abs(length(ref) - length(alt)) as int) as indel_length, count(*) as n from variants group by 1", "variants")
def indel_lengths(spark, d):
    return view(spark, d, "variants").groupBy(V.indel_length(F.col("ref"), F.col("alt")).alias("indel_length")).agg(F.count("*").alias("n"))


@query("select distinct chrom, pos, ref, alt, case when length(ref) = 1 and length(alt) = 1 then 'SNP' else 'INDEL' end as vclass from variants", "variants")
def distinct_variants(spark, d):
    rows = view(spark, d, "variants").withColumn("vclass", V.vclass(F.col("ref"), F.col("alt")))
    return V.distinct_variants(rows).select(*V.KEY)


@query("select uid, round((length(seq) - length(translate(seq, 'GC', ''))) / nullif(length(seq), 0), 9) as gc from sequences", "sequences")
def gc_content(spark, d):
    return view(spark, d, "sequences").select("uid", F.round(S.gc_content(F.col("seq")), 9).alias("gc"))


@query("select uid, translate(reverse(seq), 'ACGT', 'TGCA') as seq from sequences", "sequences")
def reverse_complement(spark, d):
    return view(spark, d, "sequences").select("uid", S.reverse_complement(F.col("seq")).alias("seq"))


_TABLE = ", ".join(f"('{c}', '{a}')" for c, a in S.CODONS.items())


@query(
    f"""select s.uid, concat('M', coalesce(p.protein, '')) as protein from sequences s left join (
    select uid, string_agg(amino, '' order by i) as protein from (select uid, unnest(range(0, length(seq) // 3)) as i, seq from sequences) x join (values {_TABLE}) t(codon, amino) on t.codon = substring(x.seq, x.i * 3 + 1, 3) group by uid) p on p.uid = s.uid""",
    "sequences",
)
def translate_codons(spark, d):
    """Each sequence's sense codons between a start and a stop codon."""
    sense = F.filter(S.codons(F.col("seq")), lambda c: ~c.isin(*S.STOPS))
    frame = F.concat(F.lit("ATG"), F.array_join(sense, ""), F.lit("TAA"))
    return view(spark, d, "sequences").select("uid", S.translate(frame).alias("protein"))


@query("select uid, base, count(*) as n, round(count(*) / any_value(size), 9) as freq from (select uid, length(seq) as size, unnest(string_split(seq, '')) as base from sequences where seq != '') where base != '' group by uid, base", "sequences")
def base_frequencies(spark, d):
    return sequences_.base_frequencies(view(spark, d, "sequences")).withColumn("freq", F.round("freq", 9))


_BBC = """select uid, a, b, round(sum(dd + dd * dd / 2 * (pa * pb) * (pa * pb) + dd * dd * dd), 6) as bbc from (
  select g.uid, g.a, g.b, g.pa, g.pb, coalesce(c.n, 0) / (g.size - g.lag) - g.pa * g.pb as dd from (
    select x.uid, x.size, lag, x.base as a, y.base as b, x.freq as pa, y.freq as pb from f x join f y on x.uid = y.uid, range(1, 12) as t(lag)) g
  left join (select uid, lag, substring(seq, i, 1) as a, substring(seq, i + lag, 1) as b, count(*) as n from (select uid, seq, lag, unnest(range(1, length(seq) - lag + 1)) as i from sequences, range(1, 12) as t(lag) where length(seq) >= 12) group by all) c
  on c.uid = g.uid and c.lag = g.lag and c.a = g.a and c.b = g.b) group by uid, a, b"""
_FREQ = "select s.uid, length(s.seq) as size, t.base, (length(s.seq) - length(replace(s.seq, t.base, ''))) / length(s.seq) as freq from sequences s, (values ('A'), ('C'), ('G'), ('T')) t(base) where length(s.seq) >= 12"


@query(f"select * from (with f as ({_FREQ}) {_BBC})", "sequences")
def base_base_correlation(spark, d):
    long = view(spark, d, "sequences").where(F.length("seq") >= 12)
    rows = sequences_.base_base_correlation(long).select("uid", F.posexplode("bbc").alias("i", "bbc"))
    base = lambda k: F.substring(F.lit("ACGT"), k.cast("int") + 1, F.lit(1))
    return rows.select("uid", base(F.floor(F.col("i") / 4)).alias("a"), base(F.col("i") % 4).alias("b"), F.round("bbc", 6).alias("bbc"))


@query("select uid, concat('> ', uid, chr(10), regexp_replace(regexp_replace(seq, '(.{80})', '\\1' || chr(10), 'g'), chr(10) || '$', ''), chr(10)) as record from sequences", "sequences")
def fasta_records(spark, d):
    return view(spark, d, "sequences").select("uid", S.fasta(F.col("uid"), F.col("seq")).alias("record"))


@query("select vec_id, sample, round(2 * p2 + p1, 6) as dosage from genotypes", "genotypes")
def dosage(spark, d):
    rows = view(spark, d, "genotypes").select("vec_id", F.posexplode(G.dosage(F.col("probabilities"))).alias("sample", "dosage"))
    return rows.select("vec_id", F.col("sample").cast("long").alias("sample"), F.round("dosage", 6).alias("dosage"))


@query(
    f"""select vec_id, n_nocall, round(case when share > 0.5 then 1 - share else share end, 6) as maf, round(case when share > 0.5 then 2 * n - total else total end, 6) as mac from (
    select vec_id, count(*) - count(d) as n_nocall, count(d) as n, coalesce(sum(d), 0) as total, sum(d) / nullif(2 * count(d), 0) as share from (
      select vec_id, case when greatest(p0, p1, p2) > {_THRESHOLD} then 2 * p2 + p1 end as d from genotypes) group by vec_id)""",
    "genotypes",
)
def maf(spark, d):
    record = G.dosage_record(F.col("probabilities"), F.col("a1"), F.col("a2"), _THRESHOLD)
    rows = view(spark, d, "genotypes").select("vec_id", record.alias("r"))
    return rows.select("vec_id", (F.size("r.dosage") - G.called(F.col("r.dosage"))).cast("long").alias("n_nocall"), F.round("r.maf", 6).alias("maf"), F.round("r.minor_allele_count", 6).alias("mac"))


@query(
    f"select vec_id, sample, case when greatest(p0, p1, p2) < {_THRESHOLD} then '0 0' when p0 >= p1 and p0 >= p2 then 'A A' when p1 >= p2 then 'A G' else 'G G' end as call from genotypes",
    "genotypes",
)
def hard_calls(spark, d):
    called = G.hard_calls(F.col("probabilities"), F.col("a1"), F.col("a2"), _THRESHOLD)
    rows = view(spark, d, "genotypes").select("vec_id", F.posexplode(called).alias("sample", "call"))
    return rows.select("vec_id", F.col("sample").cast("long").alias("sample"), "call")


@query("select concat('v', vec_id) as name, sample, round(case when flips then 2 - d else d end, 6) as dosage from (select *, avg(d) over (partition by vec_id) / 2 > 0.5 as flips from (select vec_id, sample, 2 * p2 + p1 as d from genotypes))", "genotypes")
def dosage_matrix(spark, d):
    """Written as an imputed genotype line, parsed, and laid out long."""
    g = view(spark, d, "genotypes")
    line = F.concat_ws(" ", F.lit("1"), F.concat(F.lit("v"), "vec_id"), F.col("vec_id").cast("string"), "a1", "a2", F.array_join(F.transform(F.flatten("probabilities"), lambda x: x.cast("string")), " "))
    rows = long_matrix(impute2.dosages(impute2.parse(g.select(line.alias("value")), mode="FAILFAST")))
    return rows.select("name", F.col("sample").cast("long").alias("sample"), F.round("dosage", 6).alias("dosage"))


@query("select cast(user_id % 22 + 1 as varchar) as seqname, 'sim' as source, event_type as features, event_id + 1 as start_pos, event_id + 1 + user_id as end_pos, case when event_id % 3 != 0 then cast(user_id as double) end as score, case event_id % 3 when 0 then '+' when 1 then '-' end as strand, cast(event_id % 3 as varchar) as frame from events")
def gtf_parse(spark, d):
    rows = gtf.parse(view(spark, d, "gtf_lines"), "line", mode="FAILFAST").drop("attributes")
    return rows.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query("select event_id, concat('g', user_id) as gene_id, regexp_replace(props, '[^0-9]', '', 'g') as props from events")
def gtf_attributes(spark, d):
    field = F.get(F.split("line", "\t"), F.lit(8))
    rows = view(spark, d, "gtf_lines").select("event_id", gtf.attributes(field).alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("gene_id")).alias("gene_id"), F.try_element_at("m", F.lit("props")).alias("props"))


@query("select v.* from variants v join (select chrom, min(pos) as first from variants group by chrom) f on v.chrom = f.chrom and v.pos = f.first", "variants")
def locus_lookup(spark, d):
    """The rows of each chromosome's first locus."""
    rows = view(spark, d, "variants")
    first = rows.groupBy("chrom").agg(F.min("pos").alias("pos"))
    return rows.join(first, ["chrom", "pos"]).select(rows.columns)


@query("select * from variants where chrom = '7' and pos = (select min(pos) from variants where chrom = '7')", "variants")
def locus_filter(spark, d):
    """One locus by a filter that reaches the scan."""
    rows = view(spark, d, "variants")
    pos = rows.where("chrom = '7'").agg(F.min("pos")).first()[0]
    return intervals_.locus(rows, "7", pos if pos is not None else -1)


@query(
    f"""select v.chrom, v.pos, v.rs, genome, case when genome = ref then 'OK' when genome = alt then 'FLIPPED' else 'INVALID' end as status, case when genome = alt and genome != ref then alt else ref end as ref, case when genome = alt and genome != ref then ref else alt end as alt from (
    select v.*, substring(c.seq, cast((v.pos - 1) % {CHUNK} + 1 as int), 1) as genome from variants v left join reference_chunks c on c.chrom = v.chrom and c.chunk_id = (v.pos - 1) // {CHUNK} where length(v.alt) = 1) v""",
    "variants",
    "reference_chunks",
)
def reference_allele_check(spark, d):
    snps = view(spark, d, "variants").where(F.length("alt") == 1)
    return sequences_.check_snps(snps, view(spark, d, "reference_chunks"), flip=True)


@query("select gene_id, transcript_id, category from (select *, rank() over (partition by gene_id order by case category when 'appris_principal' then 1 when 'appris_candidate_longest_ccds' then 2 when 'appris_candidate_ccds' then 3 when 'appris_candidate_longest_seq' then 4 else 5 end) as place from principal) where place = 1", "principal")
def principal_transcript(spark, d):
    return genes_.principal_transcripts(view(spark, d, "principal"), gene="gene_id")


@query("select g.chrom, g.gene_id, i.n from genes g join (select chrom, count(*) as n from intervals group by chrom) i on i.chrom = g.chrom where g.gene_end >= 500000 and g.gene_start <= 600000", "genes", "intervals")
def genes_in_region(spark, d):
    """Genes that overlap 500000-600000 of any chromosome, with the chromosome's interval count."""
    counts = view(spark, d, "intervals").groupBy("chrom").agg(F.count("*").alias("n"))
    regions = counts.select(F.col("chrom").alias("region_id"), "chrom", F.lit(500_000).cast("long").alias("start"), F.lit(600_000).cast("long").alias("end"))
    renamed = _genes(spark, d).withColumnsRenamed({"gene_start": "start", "gene_end": "end"})
    found = genes_.genes_in(regions, renamed)
    return found.join(counts, "chrom").select("chrom", "gene_id", "n")


_LANES = """select strand, gene_id, cast(lane as int) as lane from (
  with recursive marked as (
    select strand, gene_id, cast(gene_start as double) as s, gene_end + 0.003 as e from genes),
  opened as (
    select *, case when s <= max(e) over (partition by strand order by s, e, gene_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from marked),
  numbered as (
    select *, sum(opens) over (partition by strand order by s, e, gene_id rows unbounded preceding) as island from opened),
  ordered as (
    select *, row_number() over (partition by strand, island order by s, e, gene_id) as i from numbered),
  placed as (
    select strand, island, i, gene_id, 0 as lane, [e] as ends from ordered where i = 1
    union all
    select strand, island, i, gene_id, -(coalesce(nullif(j, 0), len(ends) + 1) - 1) as lane,
      case when coalesce(j, 0) = 0 then list_append(ends, e) else list_concat(list_concat(ends[1:j - 1], [e]), ends[j + 1:]) end as ends
    from (select o.strand, o.island, o.i, o.gene_id, o.e, p.ends, list_position(list_transform(p.ends, lambda x: x < o.s), true) as j
      from placed p join ordered o on o.strand = p.strand and o.island = p.island and o.i = p.i + 1))
  select strand, gene_id, lane from placed)"""


@query(_LANES, "genes")
def gene_lanes(spark, d):
    """Lanes of each strand's genes, over all chromosomes on one line."""
    return genes_.lanes(_genes(spark, d), by=["strand"], start="gene_start", end="gene_end")


_INDELS = "select chrom, pos, case when pos % 2 = 0 then '-' else ref end as ref, alt from variants where length(alt) = 3"


@query(
    f"""select chrom, cast(case when gap then pos - 1 else pos end as bigint) as pos, case when gap then coalesce(base, '?') else ref end as ref, case when gap then concat(coalesce(base, '?'), alt) else alt end as alt,
    case when gap and base is not null then 'FIXED' when not gap and base = ref then 'OK' else 'MISMATCH' end as status from (
    select v.*, substring(c.seq, cast((v.at - 1) % {CHUNK} + 1 as int), 1) as base from (select *, ref = '-' as gap, case when ref = '-' then pos - 1 else pos end as at from ({_INDELS})) v
    left join reference_chunks c on c.chrom = v.chrom and v.at >= 1 and c.chunk_id = (v.at - 1) // {CHUNK})""",
    "variants",
    "reference_chunks",
)
def indel_allele_check(spark, d):
    """Insertions, half of them written with a gap, compared to the reference; gaps are written with the base before."""
    gap = F.when(F.col("pos") % 2 == 0, "-").otherwise(F.col("ref"))
    indels = view(spark, d, "variants").where(F.length("alt") == 3).select("chrom", "pos", gap.alias("ref"), "alt")
    return sequences_.check_indels(indels, view(spark, d, "reference_chunks"), fix=True)


@query(
    f"""select vclass, status, count(*) as n from (
    select v.*, case when length(alt) = 1 then 'SNP' else 'INDEL' end as vclass,
      case when genome = ref then 'OK' when length(alt) = 1 and genome = alt then 'FLIPPED' when length(alt) = 1 then 'INVALID' else 'MISMATCH' end as status from (
      select v.*, substring(c.seq, cast((v.pos - 1) % {CHUNK} + 1 as int), 1) as genome from variants v left join reference_chunks c on c.chrom = v.chrom and c.chunk_id = (v.pos - 1) // {CHUNK}) v) group by all""",
    "variants",
    "reference_chunks",
)
def variant_allele_check(spark, d):
    """SNPs and indels, each checked by its class."""
    found = sequences_.check_variants(view(spark, d, "variants").select("chrom", "pos", "ref", "alt"), view(spark, d, "reference_chunks"), flip=True)
    return found.groupBy(V.vclass(F.col("ref"), F.col("alt")).alias("vclass"), "status").agg(F.count("*").alias("n"))


@query(
    """select gene_id, a1 <= b2 and a2 >= b1 or a1 <= b4 and a2 >= b3 or a3 <= b2 and a4 >= b1 or a3 <= b4 and a4 >= b3 as meets,
    least(greatest(0, b1 - a2, a1 - b2), greatest(0, b3 - a2, a1 - b4), greatest(0, b1 - a4, a3 - b2), greatest(0, b3 - a4, a3 - b4)) as distance,
    p between a1 and a2 or p between a3 and a4 as holds_point, a1 <= b1 and b2 <= a2 or a3 <= b1 and b2 <= a4 as holds_segment, a1 as region_start, a4 as region_end, a2 >= a3 as contiguous
    from (select gene_id, gene_start as a1, gene_end as a2, gene_start + 600 as a3, gene_end + 900 as a4, gene_start + 500 as b1, gene_start + 560 as b2, gene_end + 1000 as b3, gene_end + 1200 as b4, gene_start + 590 as p from genes)""",
    "genes",
)
def region_predicates(spark, d):
    """Overlap, distance, containment and bounds of regions of two segments."""
    start, end = F.col("gene_start"), F.col("gene_end")
    part = lambda a, b: I.segment(F.col("chrom"), a, b)
    rows = _genes(spark, d).select("gene_id", "chrom", F.array(part(start, end), part(start + 600, end + 900)).alias("a"), F.array(part(start + 500, start + 560), part(end + 1000, end + 1200)).alias("b"), (start + 590).alias("p"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "gene_id",
        I.regions_overlap(a, b).alias("meets"),
        I.region_distance(a, b).alias("distance"),
        I.region_contains_point(a, F.col("chrom"), F.col("p")).alias("holds_point"),
        I.region_contains(a, F.get("b", F.lit(0))).alias("holds_segment"),
        I.region_start(a).alias("region_start"),
        I.region_end(a).alias("region_end"),
        I.is_contiguous(I.merged_region(a)).alias("contiguous"),
    )


@query(
    f"""select concat('chr', chrom, ':', gene_start, '-', gene_end) as uid, case when length(seq) = gene_end - gene_start + 1 then seq end as seq, 'DNA' as seq_type from (
    select g.*, substring(concat(a.seq, coalesce(b.seq, '')), cast((gene_start - 1) % {CHUNK} + 1 as int), cast(gene_end - gene_start + 1 as int)) as seq from genes g
    left join reference_chunks a on a.chrom = g.chrom and a.chunk_id = (gene_start - 1) // {CHUNK} left join reference_chunks b on b.chrom = g.chrom and b.chunk_id = (gene_start - 1) // {CHUNK} + 1)""",
    "genes",
    "reference_chunks",
)
def gene_region_sequences(spark, d):
    """Bases of each gene, some of them across two chunks of the reference."""
    regions = _genes(spark, d).select("chrom", F.col("gene_start").alias("start"), F.col("gene_end").alias("end"))
    return sequences_.region_sequences(regions, view(spark, d, "reference_chunks")).drop("info")


@query("select v.rs, v.chrom, v.pos, upper(v.ref) as ref, a.alt, 'SNP' as vclass from variants v, lateral (select unnest([v.alt, 'N']) as alt) a where v.rs is not null and cast(substring(v.rs, 3) as bigint) % 3 = 0", "variants")
def variants_by_rs(spark, d):
    """Each third site's variants by its name; each site has two alternatives."""
    sites = view(spark, d, "variants").select(F.col("rs").alias("id"), "chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), F.array("ref", "alt", F.lit("N")).alias("alleles"))
    names = sites.where(F.substring("id", 3, 20).cast("long") % 3 == 0).select(F.col("id").alias("rs"))
    return genes_.variants_by_rs(names, sites)


@query("select distinct i.chrom, i.seg_start, i.seg_end from intervals i where i.seg_end >= 500000 and i.seg_start <= 500700 or i.seg_end >= 700000 and i.seg_start <= 700300", "intervals")
def transcripts_in_region(spark, d):
    """Intervals, as transcripts, that overlap a region of two segments on any chromosome."""
    rows = view(spark, d, "intervals").select("chrom", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), F.format_string("%s:%d-%d", *SEG).alias("enst"))
    chroms = rows.select("chrom").distinct()
    both = [(500_000, 500_700), (700_000, 700_300)]
    regions = chroms.select(F.col("chrom").alias("region_id"), "chrom", F.inline(F.array(*(F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in both))))
    return genes_.transcripts_in(regions, rows).select("chrom", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))


@query(
    """select g.gene_id, g.chrom, g.gene_start, g.gene_end, coalesce(t.n, 0) as n_transcripts, coalesce(x.n, 0) as n_exons from genes g
    left join (select l_partkey as k, count(*) as n from lineitem where l_linenumber = 1 group by 1) t on t.k = g.gene_id
    left join (select p.l_partkey as k, count(distinct struct_pack(a := e.l_partkey, b := e.l_linenumber, c := cast(e.l_quantity as bigint))) as n from lineitem e join lineitem p on p.l_orderkey = e.l_orderkey and p.l_linenumber = 1 group by 1) x on x.k = g.gene_id""",
    "genes",
)
def nested_genes(spark, d):
    """Genes with their transcripts and exons from one table of features: an order's first item is a transcript of its part, and all items are its exons."""
    genes, items = _genes(spark, d), spark.read.parquet(f"{d}/lineitem.parquet")
    nothing = lambda c: F.lit(None).cast("string").alias(c)
    own = genes.select(F.lit("gene").alias("feature_type"), F.col("gene_id").cast("string").alias("id"), nothing("Parent"), F.col("chrom").alias("seq_region_name"), F.col("gene_start").alias("start"), F.col("gene_end").alias("end"), "strand", F.col("symbol").alias("external_name"), nothing("description"), "biotype")
    start = (F.col("l_partkey") * 500 + F.col("l_linenumber") * 7 + 1).cast("long")
    part = lambda kind, id_, parent: (F.lit(kind).alias("feature_type"), id_.cast("string").alias("id"), parent.cast("string").alias("Parent"), F.lit("1").alias("seq_region_name"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.lit(1).alias("strand"), nothing("external_name"), nothing("description"), nothing("biotype"))
    scripts = items.where("l_linenumber = 1").select(*part("transcript", F.concat(F.lit("T"), F.col("l_orderkey")), F.col("l_partkey")))
    exons = items.select(*part("exon", F.concat_ws("E", "l_orderkey", "l_linenumber"), F.concat(F.lit("T"), F.col("l_orderkey"))))
    features = own.unionByName(scripts).unionByName(exons).withColumn("assembly_name", F.lit("GRCh38"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    found = genes_.genes_of(features, "GRCh38")
    return found.select(F.col("gene_id").cast("long").alias("gene_id"), "chrom", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"), size("transcripts").alias("n_transcripts"), size("exons").alias("n_exons"))


@query("select concat('s', doc_id % 100) as uid, arg_max(regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g'), doc_id) as seq from documents group by 1")
def last_sequences(spark, d):
    """Of the sequences with one id the last."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seq = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "")
    rows = docs.select(F.concat(F.lit("s"), F.col("doc_id") % 100).alias("uid"), seq.alias("seq"), F.col("doc_id").alias("ordinal"))
    return sequences_.last_of_each(rows).select("uid", "seq")


@query("select count(*) as n, count(distinct seq) as n_seqs from (select distinct concat('s', doc_id % 7) as uid, substring(seq, 1, 3) as seq, 'DNA' as seq_type from (select doc_id, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') as seq from documents))")
def distinct_sequences(spark, d):
    """Sequences that differ in id, bases or type."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seq = F.left(F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", ""), F.lit(3))
    rows = docs.select(F.concat(F.lit("s"), F.col("doc_id") % 7).alias("uid"), seq.alias("seq"), F.lit("DNA").alias("seq_type"), F.create_map(F.lit("i"), F.col("doc_id").cast("string")).alias("info"))
    return sequences_.distinct_sequences(rows).agg(F.count("*").alias("n"), F.count_distinct("seq").alias("n_seqs"))
