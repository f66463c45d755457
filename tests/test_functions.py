import pytest
from pyspark.sql import functions as F

from helixframe.functions import genotypes as G
from helixframe.functions import intervals as I
from helixframe.functions import sequences as S
from helixframe.functions import variants as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def region(*pairs, chrom="3"):
    return F.array(*(I.segment(F.lit(chrom), F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in pairs))


def pairs(rows):
    return [(r["start"], r["end"]) for r in rows]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([(1, 5), (7, 20), (12, 25), (24, 31), (35, 42)], [(1, 5), (7, 31), (35, 42)]),
        ([(1, 2), (4, 15), (5, 6), (8, 12), (18, 21)], [(1, 2), (4, 15), (18, 21)]),
        ([(1, 5), (7, 11), (7, 15), (21, 26)], [(1, 5), (7, 15), (21, 26)]),
        ([(1, 5), (2, 8), (7, 40)], [(1, 40)]),
        ([(1, 20), (2, 3), (7, 40)], [(1, 40)]),
        ([(1, 5)], [(1, 5)]),
        ([(1, 5), (6, 9)], [(1, 5), (6, 9)]),
    ],
)
def test_merged_region(spark, given, want):
    assert pairs(one(spark, I.merged_region(region(*given)))) == want


def test_predicates_and_distance(spark):
    seg = lambda a, b, c="2": I.segment(F.lit(c), F.lit(a), F.lit(b))
    assert one(spark, I.distance(seg(12, 43), seg(121, 210))) == 78
    assert one(spark, I.distance(seg(1234, 4000), seg(4001, 5412))) == 1
    assert one(spark, I.distance(seg(1, 9), seg(9, 12))) == 0
    assert one(spark, I.region_distance(region((2, 13)), region((51, 102), (123, 246)))) == 38
    with pytest.raises(Exception, match="different chromosomes"):
        one(spark, I.distance(seg(1, 2), seg(1, 2, "5")))
    assert one(spark, I.region_contains_point(region((5, 14), (101, 132)), F.lit("3"), F.lit(123)))
    assert not one(spark, I.region_contains(region((5, 14), (15, 32)), seg(10, 20, "3")))
    assert one(spark, I.regions_overlap(region((1, 5)), region((5, 9))))
    with pytest.raises(Exception, match="one chromosome"):
        one(spark, I.merged_region(F.concat(region((1, 5)), region((2, 9), chrom="5"))))


def test_parse_region(spark):
    parsed = one(spark, I.parse_region(F.lit("chr12:5-90")))
    assert (parsed["chrom"], parsed["start"], parsed["end"]) == ("12", 5, 90)
    for bad in ("12:5-90", "chr12:9-9", "chr12:9", "chrQ:1-2"):
        assert one(spark, I.parse_region(F.lit(bad))) is None


def test_sequences(spark):
    assert one(spark, S.gc_content(F.lit("TAGTTACTAT"))) == 0.2
    assert one(spark, S.gc_content(F.lit(""))) is None
    assert one(spark, S.reverse_complement(F.lit("TAGTVTAMCTATK"))) == "MATAGKTABACTA"
    assert one(spark, S.translate(F.lit("ATGGCCTAA"))) == "MA"
    assert one(spark, S.translate(F.lit("AUGGCCUAA"))) == "MA"
    assert one(spark, S.translate(F.lit("GCC"), no_check=True)) == "A"
    for bad in ("ATGGC", "GCCTAA", "ATGGCC", "ATGTAAGCCTAA", "ATGNNNTAA"):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, S.translate(F.lit(bad)))
    assert one(spark, S.fasta(F.lit("u"), F.lit("ACGTA"), F.create_map(F.lit("k"), F.lit("v")), 2)) == "> u - 'k'='v'\nAC\nGT\nA\n"


def test_variants(spark):
    row = spark.createDataFrame([("12", 7300, "rs480", "C", "T")], "chrom string, pos long, rs string, ref string, alt string")
    show = lambda spec: row.select(V.format_variant(spec)).first()[0]
    assert show("chr%c:%p-%p") == "chr12:7300-7300"
    assert show("%c,%p,1,%r/%a") == "12,7300,1,C/T"
    assert show("%cc\t%i end") == "12c\trs480 end"
    for bad in ("%z", "%C"):
        with pytest.raises(KeyError):
            V.format_variant(bad)
    got = one(spark, V.parse_snp(F.lit("chr3:12_a/c/G")))
    assert [tuple(v) for v in got] == [("3", 12, "A", "C"), ("3", 12, "A", "G")]
    assert one(spark, V.vcf_line(F.lit("1"), F.lit(5), F.lit(None).cast("string"), F.lit("A"), F.lit("G"))) == "1\t5\t.\tA\tG\t.\tPASS\t."
    kinds = spark.createDataFrame([("A", "G"), ("TTC", "T"), ("-", "A")], "r string, a string").select(V.vclass(F.col("r"), F.col("a"))).collect()
    assert [k[0] for k in kinds] == ["SNP", "INDEL", "INDEL"]


@pytest.mark.parametrize(
    ("triples", "alleles", "threshold", "dosage", "major", "maf", "mac"),
    [
        ([(1, 0, 0), (0.988, 0.002, 0), (0, 0.997, 0.003)], "AG", 0, [0, 0.002, 1.003], "A", 1.005 / 6, 1.005),
        ([(0.869, 0.130, 0), (0, 1, 0), (0, 0, 1)], ("T", "TC"), 0, [1.87, 1, 0], "TC", 2.87 / 6, 2.87),
        ([(1, 0, 0), (0.1, 0.3, 0.6), (0.1, 0.35, 0.55), (0, 1, 0)], "AT", 0.9, [0, None, None, 1], "A", 0.25, 1),
        ([(0.5, 0.5, 0)], "AT", 0.9, [None], "A", None, 0),
    ],
)
def test_dosage(spark, triples, alleles, threshold, dosage, major, maf, mac):
    p = F.array(*(F.array(*(F.lit(float(x)) for x in t)) for t in triples))
    got = one(spark, G.dosage_record(p, F.lit(alleles[0]), F.lit(alleles[1]), threshold))
    assert [x is None for x in got["dosage"]] == [x is None for x in dosage]
    assert [x for x in got["dosage"] if x is not None] == pytest.approx([x for x in dosage if x is not None])
    assert got["major"] == major and got["minor_allele_count"] == pytest.approx(mac)
    assert got["maf"] is None if maf is None else got["maf"] == pytest.approx(maf)


def test_hard_calls(spark):
    p = F.array(*(F.array(*(F.lit(x) for x in t)) for t in [(0.869, 0.130, 0.0), (0.9, 0.1, 0.0), (0.0, 0.0, 1.0), (0.4, 0.4, 0.2)]))
    assert one(spark, G.hard_calls(p, F.lit("T"), F.lit("C"), 0.9)) == ["0 0", "T T", "C C", "0 0"]
    assert one(spark, G.hard_calls(p, F.lit("T"), F.lit("C")))[3] == "T T"
    with pytest.raises(NotImplementedError):
        G.dosage_record(p, F.lit("A"), F.lit("G"), is_chr23=True)
