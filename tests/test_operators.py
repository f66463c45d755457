import itertools
import random

import pytest
from pyspark.sql import functions as F

from helixframe import schemas
from helixframe.operators import genes, intervals, prefix, sequences
from helixframe.sinks import tables


def random_intervals(spark, n, seed, prefix="", wide=300_000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randint(1, 3_000_000)
        rows.append((i, rng.choice("123"), a, a + rng.choice([1, 50, 2_000, rng.randint(1, wide)])))
    return spark.createDataFrame(rows, f"{prefix}id long, {prefix}chrom string, {prefix}start long, {prefix}end long"), rows


def test_overlap_join_and_containment(spark):
    a, ra = random_intervals(spark, 150, 1)
    b, rb = random_intervals(spark, 150, 2, "b_")
    on = ("b_chrom", "b_start", "b_end")
    want = sorted((x[0], y[0]) for x, y in itertools.product(ra, rb) if x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2])
    assert sorted((r.id, r.b_id) for r in intervals.overlap_join(a, b, right_on=on).collect()) == want
    want = sorted((x[0], y[0]) for x, y in itertools.product(ra, rb) if x[1] == y[1] and x[2] <= y[2] and y[3] <= x[3])
    assert sorted((r.id, r.b_id) for r in intervals.overlap_join(a, b, right_on=on, contained=True).collect()) == want
    with pytest.raises(ValueError, match="both sides"):
        intervals.overlap_join(a, a)


def test_overlap_join_meets_few_candidates(spark):
    """Short intervals all over a chromosome, with and without one long one: short ones meet in short bins only."""
    on, other_on, names = ("chrom", "start", "end"), ("b_chrom", "b_start", "b_end"), ["own_l", "level_l", "bin_l", "own_r", "level_r", "bin_r"]
    short = spark.range(4000).select(F.lit("1").alias("chrom"), (F.col("id") * 700 + 1).alias("start"), (F.col("id") * 700 + 40).alias("end"))
    other = short.select(F.col("chrom").alias("b_chrom"), (F.col("start") + 20).alias("b_start"), (F.col("end") + 20).alias("b_end"))
    for table, long in ((short, 0), (short.unionByName(spark.createDataFrame([("1", 1, 2_800_000)], short.schema)), 1)):
        assert intervals.overlap_join(table, other, right_on=other_on).count() == 4000 + long * 4000
        met = sum(x.join(y, (x.chrom == y.b_chrom) & (x.level_l == y.level_r) & (x.bin_l == y.bin_r)).count() for x, y in intervals._sides(table, other, on, other_on, names))
        assert met < 3 * 4000 + long * 2 * 4000


def test_overlap_join_names_and_odd_rows(spark):
    a = spark.createDataFrame([("1", 5, 9, "x"), (None, 5, 9, "y"), ("1", None, 9, "z"), ("1", 9, 5, "r"), ("1", 5, 9, "x")], "chrom string, start long, end long, level_l string")
    b = spark.createDataFrame([("1", 9, 9, 7)], "bin_r string, s long, e long, own_l int")
    got = intervals.overlap_join(a, b, right_on=("bin_r", "s", "e"))
    assert got.columns == a.columns + b.columns and sorted(map(tuple, got.collect())) == [("1", 5, 9, "x", "1", 9, 9, 7)] * 2
    assert intervals.overlap_join(a.limit(0), b, right_on=("bin_r", "s", "e")).count() == 0


@pytest.mark.parametrize("chunk", [prefix.CHUNK, 1000])
def test_running_extremes(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix, "CHUNK", chunk)
    rng = random.Random(9)
    rows = [(i, rng.choice(["1", "2", None]), rng.randint(1, 20_000), rng.randint(1, 99)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, chunk long, v long")
    order = [F.col("chunk"), F.col("id")]
    got = prefix.running(df, "c", "chunk", order, most=prefix.Running(F.col("v")), least=prefix.Running(F.col("v"), backward=True), so_far=prefix.Running(F.col("v"), inclusive=True))
    assert got.columns == [*df.columns, "most", "least", "so_far"]
    for r in got.collect():
        own = [x for x in rows if r.c is not None and x[1] == r.c]
        before, after = [x[3] for x in own if (x[2], x[0]) < (r.chunk, r.id)], [x[3] for x in own if (x[2], x[0]) > (r.chunk, r.id)]
        assert (r.most, r.least) == (max(before, default=None), min(after, default=None))
        assert r.so_far == (max([*before, r.v]) if own else None)


def test_sortedness(spark):
    table = lambda rows: spark.createDataFrame(rows, "chrom string, pos long").coalesce(1)
    rows = [("2", p) for p in range(1, 500)] + [("1", p) for p in range(1, 500)]
    assert intervals.out_of_order(spark.createDataFrame(rows, "chrom string, pos long").repartitionByRange(3, F.col("chrom").desc(), "pos").sortWithinPartitions(F.col("chrom").desc(), "pos")) == []
    assert intervals.out_of_order(table([("2", 5), ("2", 4)])) == ["positions of 2 decrease"]
    assert intervals.out_of_order(table([("2", 5), ("1", 4), ("2", 6)])) == ["2 comes again"]
    assert intervals.out_of_order(table([("2", 5)]).limit(0)) == []


@pytest.mark.parametrize("chunk", [prefix.CHUNK, 3000])
def test_merge_is_idempotent_and_order_free(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix, "CHUNK", chunk)
    a, rows = random_intervals(spark, 200, 3, wide=20_000)
    want = []
    for chrom in "123":
        for _, _, s, e in sorted((r for r in rows if r[1] == chrom), key=lambda r: r[2:]):
            if want and want[-1][0] == chrom and s <= want[-1][2]:
                want[-1] = (chrom, want[-1][1], max(e, want[-1][2]))
            else:
                want.append((chrom, s, e))
    merged = intervals.merge(a)
    got = sorted(map(tuple, merged.collect()))
    assert got == sorted(want)
    assert sorted(map(tuple, intervals.merge(merged.orderBy(F.desc("start"))).collect())) == got


def test_points(spark):
    a, ra = random_intervals(spark, 60, 4)
    pts = [(random.Random(5).choice("1234"), p) for p in range(1, 3_000_000, 40_009)] + [(None, 5)]
    points = spark.createDataFrame(pts, "chrom string, pos long")
    inside = sorted(p for p in pts if any(r[1] == p[0] and r[2] <= p[1] <= r[3] for r in ra))
    assert sorted(map(tuple, intervals.points_in(points, a, how="left_semi").collect())) == inside
    assert intervals.points_in(points, a, how="left_anti").count() == len(pts) - len(inside)
    far = {(r.chrom, r.pos): r.distance for r in intervals.nearest_distance(points, a).collect()}
    for c, p in pts:
        own = [max(0, r[2] - p, p - r[3]) for r in ra if r[1] == c]
        assert far[c, p] == (min(own) if own else None)


def test_gaps_and_loci(spark, tmp_path):
    table = spark.createDataFrame([("chr1", 0, 10, "telomere"), ("chr1", 90, 99, "centromere")], "chrom string, chromStart long, chromEnd long, type string")
    assert [tuple(r) for r in intervals.gaps(table, "1", "telomere").collect()] == [("1", 1, 10)]
    assert [tuple(r) for r in intervals.gaps(table, "chr1", "centromere").collect()] == [("1", 91, 99)]
    for rows in (table.limit(0), table.unionByName(table)):
        with pytest.raises(Exception, match="centromeres"):
            intervals.gaps(rows, "1", "centromere").collect()
    assert intervals.gaps(table.unionByName(table), "1", "telomere").count() == 1
    with pytest.raises(TypeError):
        intervals.gaps(table, "1", "clone")
    assert intervals.check_mergeable(spark.createDataFrame([("1", 5, 5), ("1", 5, 6), ("Q", 1, 2)], "chrom string, start long, end long")).count() == 2
    rows = spark.createDataFrame([("1", 5, "a"), ("1", 5, "b"), ("X", 7, "c")], "chrom string, pos long, mark string")
    tables.write_by_locus(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert intervals.locus(back, "1", 5).count() == 2 and intervals.locus(back, "1", 0).count() == 0
    assert intervals.has_chromosome(back, "X") and not intervals.has_chromosome(back, "3")


def chunks(spark, text, size=4):
    rows = [("22", i // size, i + 1, text[i : i + size]) for i in range(0, len(text), size)]
    return spark.createDataFrame(rows, "chrom string, chunk_id long, chunk_start long, seq string")


def test_reference(spark):
    ref = chunks(spark, "ggactTACGTA")
    asked = spark.createDataFrame([("22", 2, 6), ("22", 4, 4), ("22", 9, 99), ("30", 1, 2)], "chrom string, start long, end long")
    got = {(r.chrom, r.start): r.sequence for r in sequences.with_reference(asked, ref).collect()}
    assert got == {("22", 2): "GACTT", ("22", 4): "C", ("22", 9): None, ("30", 1): None}
    snps = spark.createDataFrame([("22", 1, "G", "T"), ("22", 3, "C", "A"), ("22", 5, "A", "C")], "chrom string, pos long, ref string, alt string")
    assert [(r.status, r.ref) for r in sequences.check_snps(snps, ref, flip=True).orderBy("pos").collect()] == [("OK", "G"), ("FLIPPED", "A"), ("INVALID", "A")]
    assert sequences.check_snps(snps, ref).where("pos = 3").first().status == "MISMATCH"
    indels = spark.createDataFrame([("22", 6, "TA", "-"), ("22", 3, "-", "CC"), ("22", 6, "GG", "-")], "chrom string, pos long, ref string, alt string")
    fixed = {(r.pos, r.ref, r.alt, r.status) for r in sequences.check_indels(indels, ref, fix=True).collect()}
    assert fixed == {(5, "TTA", "T", "FIXED"), (2, "G", "GCC", "FIXED"), (5, "TGG", "T", "MISMATCH")}
    assert sequences.check_variants(snps.unionByName(indels), ref, flip=True).count() == 6


def plain_correlation(seq, k, letters):
    p = {c: sum(x == c for x in seq) / sum(x in letters for x in seq) for c in letters}
    out = []
    for a, b in itertools.product(letters, letters):
        total = 0.0
        for lag in range(1, k + 2):
            d = sum(x == a and y == b for x, y in zip(seq, seq[lag:])) / (len(seq) - lag) - p[a] * p[b]
            total += d + d * d / 2 * (p[a] * p[b]) ** 2 + d**3
        out.append(total)
    return out


def test_base_base_correlation(spark, monkeypatch):
    monkeypatch.setattr(sequences, "STEP_CHARS", 60)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (12, 20, 50, 200, 31)] + [None, "ACACACACACACé"]
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, seq string")
    for alphabet in ("TGCA", None):
        for r in sequences.base_base_correlation(rows, 3, alphabet).collect():
            text = texts[r.uid]
            if text is None:
                assert r.bbc is None
            else:
                letters = "".join(sorted(set(alphabet or text)))
                assert r.alphabet == letters and r.bbc == pytest.approx(plain_correlation(text, 3, letters))
    with pytest.raises(ValueError, match="too large"):
        sequences.correlations(["ACGT"], 3, "ACGT")
    got = {(r.uid, r.base): (r.n, r.freq) for r in sequences.base_frequencies(rows).collect()}
    assert got == {(i, c): (t.count(c), t.count(c) / len(t)) for i, t in enumerate(texts) if t for c in set(t)}


def test_sequences_of_regions(spark):
    ref = chunks(spark, "ggactTACGTA")
    regions = spark.createDataFrame([("r", "22", 9, 10), ("r", "22", 1, 2), ("q", "22", 3, 5)], "region_id string, chrom string, start long, end long")
    assert {r.region_id: r.seqs for r in sequences.sequences_of_regions(regions, ref).collect()} == {"r": ["GG", "GT"], "q": ["ACT"]}
    rows = {r.uid: (r.seq, r.seq_type, r.info) for r in sequences.region_sequences(regions, ref).collect()}
    assert rows["chr22:3-5"] == ("ACT", "DNA", {"species": "human"})


def test_genes(spark):
    table = spark.createDataFrame([("g", "t1", "appris_candidate"), ("g", "t2", "appris_candidate_ccds"), ("g", "t3", "appris_candidate_ccds"), ("h", "t4", "other")], "ensembl_gene string, ensembl_transcript string, category string")
    assert sorted(r.ensembl_transcript for r in genes.principal_transcripts(table).collect()) == ["t2", "t3"]
    regions = spark.createDataFrame([("r", "19", 7300, 7346)], "region_id string, chrom string, start long, end long")
    sites = spark.createDataFrame([("rs1", "19", 7300, 7300, ["C", "T", "G"]), ("COSM1", "19", 7345, 7346, ["TC", "-"]), ("rs2", "19", 7305, 7305, ["A"]), ("rs3", "19", 5, 5, ["A", "C"])], "id string, chrom string, start long, end long, alleles array<string>")
    got = {(r.rs, r.ref, r.alt, r.vclass) for r in genes.variants_in(regions, sites).collect()}
    assert got == {("rs1", "C", "T", "SNP"), ("rs1", "C", "G", "SNP"), (None, "TC", "-", "INDEL")}
    drawn = spark.createDataFrame([("1", 1, 1, 10), ("1", 2, 5, 20), ("1", 3, 10, 30), ("1", 4, 11, 12), ("1", 5, 31, 40)], "chrom string, gene_id long, start long, end long")
    assert {r.gene_id: r.lane for r in genes.lanes(drawn, by=["chrom"]).collect()} == {1: 0, 2: -1, 3: -2, 4: 0, 5: 0}
    assert {r.gene_id: r.lane for r in genes.lanes(drawn, by=["chrom"], window=(11, 29)).collect()} == {2: 0, 3: -1, 4: -2}
    asked = spark.createDataFrame([("rs1",), ("rs1",), ("COSM1",), ("rs9",), (None,)], "rs string")
    named = lambda kind: sorted((r.rs, r.ref, r.alt, r.vclass) for r in genes.variants_by_rs(asked, sites, kind).collect())
    assert named(None) == [("COSM1", "TC", "-", "INDEL"), ("rs1", "C", "G", "SNP"), ("rs1", "C", "T", "SNP")] and named("INDEL") == [("COSM1", "TC", "-", "INDEL")]
    with pytest.raises(ValueError):
        genes.variants_by_rs(asked, sites, "SV")
    notes = spark.createDataFrame([("rs1", 0.25, "A,B", "c")], "rs string, maf double, evidence string, most_severe_consequence string")
    assert {r.rs: r.maf for r in genes.annotated(asked.distinct(), notes).collect()} == {"rs1": 0.25, "COSM1": None, "rs9": None, None: None}


FEATURES = [
    ("gene", "g1", None, "B38", "5", 100, 900, 1, "AAA", "first", "coding"),
    ("gene", "g2", None, "B38", "5", 2000, 2900, -1, None, None, "coding"),
    ("gene", "g3", None, "B37", "5", 1, 9, 1, "CCC", None, "coding"),
    ("transcript", "t1", "g1", "B38", "5", 100, 500, 1, None, None, "coding"),
    ("transcript", "t2", "g1", "B38", "5", 300, 900, 1, None, None, "coding"),
    ("exon", "e1", "t1", "B38", "5", 100, 150, 1, None, None, None),
    ("exon", "e2", "t2", "B38", "5", 300, 350, 1, None, None, None),
    ("exon", "e3", "t2", "B38", "5", 100, 150, 1, None, None, None),
]


def test_gene_tables(spark):
    features = spark.createDataFrame(FEATURES, "feature_type string, id string, Parent string, assembly_name string, seq_region_name string, start long, end long, strand int, external_name string, description string, biotype string")
    table = genes.genes_of(features, "B38")
    rows = {r.gene_id: r for r in table.collect()}
    assert set(rows) == {"g1", "g2"} and [t.enst for t in rows["g1"].transcripts] == ["t1", "t2"] and [tuple(e) for e in rows["g1"].exons] == [(100, 150), (300, 350)]
    assert rows["g2"].transcripts is None and rows["g2"].xrefs == {"ensembl_gene_id": "g2"}
    named = {r.gene_id: r.name for r in table.select("gene_id", genes.display_name(F.col("symbol"), F.col("xrefs")).alias("name")).collect()}
    assert named == {"g1": "AAA", "g2": "g2"}
    xrefs = spark.createDataFrame([("AAA", "g1"), ("ZZZ", "g9")], "symbol string, ensembl_gene_id string")
    assert [r.gene_id for r in genes.genes_by_symbol(table, xrefs, xrefs.select("symbol")).collect()] == ["g1"]
    scripts = features.where("feature_type = 'transcript'").selectExpr("id as enst", "seq_region_name as chrom", "start", "end", "'x' as appris_cat")
    regions = spark.createDataFrame([("r", "5", 505, 600), ("r", "5", 550, 2950)], "region_id string, chrom string, start long, end long")
    assert [r.enst for r in genes.transcripts_in(regions, scripts).collect()] == ["t2"]
    assert sorted(r.gene_id for r in genes.genes_in(regions, table.drop("transcripts", "exons", "xrefs")).collect()) == ["g1", "g2"]
    assert tuple(genes.region_of(scripts.where("enst = 't1'")).first().region[0]) == ("5", 100, 500)
    cats = spark.createDataFrame([("t1", "appris_principal")], "ensembl_transcript string, category string")
    assert {r.enst: r.appris_cat for r in genes.with_categories(scripts, cats).collect()} == {"t1": "appris_principal", "t2": None}
    seqs = spark.createDataFrame([("t1", "cds", "atg"), ("t1", "protein", "m"), ("t9", "cds", "a")], "enst string, kind string, seq string")
    assert [tuple(r) for r in genes.transcript_sequences(scripts, seqs, "protein").collect()] == [("t1", "M", "AA")]
    with pytest.raises(ValueError):
        genes.transcript_sequences(scripts, seqs, "intron")
    table = spark.createDataFrame([("g1", "orthologues", "o1", "A-C-", "mouse", 5, 91.0), ("g1", "paralogues", "p1", "AC", "human", 6, 55.0)], "gene_id string, kind string, target_id string, align_seq string, species string, taxon_id int, perc_id double")
    assert [tuple(r) for r in genes.homologs(table, "g1", "orthologues").collect()] == [("o1", "AC", "mouse", 5, 91.0)]
    with pytest.raises(ValueError):
        genes.homologs(table, "g1", "all")


def test_validation(spark):
    variants = spark.createDataFrame([("1", 5, "rs1", "A", "C", "SNP"), ("Q", 5, None, "A", "C", "SNP"), ("1", None, None, "A", "C", "SNP"), ("1", 5, "x", "A", "C", "SNP"), ("1", 5, None, "-", "C", "INDEL")], "chrom string, pos long, rs string, ref string, alt string, vclass string")
    assert [r._error is None for r in schemas.validated(variants, "variant").collect()] == [True, False, False, False, False]
    seqs = spark.createDataFrame([("u", "A", "DNA"), ("u", "A", "XNA"), (None, "A", "DNA")], "uid string, seq string, seq_type string")
    assert schemas.validated(seqs, "sequence", "DROPMALFORMED").count() == 1
    scripts = spark.createDataFrame([("GRCh38", "1", 1, 5, "t"), ("GRCh36", "1", 1, 5, "t"), ("GRCh38", "1", 5, 5, "t")], "build string, chrom string, start long, end long, enst string")
    with pytest.raises(Exception, match="unknown build|not before"):
        schemas.validated(scripts, "transcript", "FAILFAST").collect()
