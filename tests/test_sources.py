import gzip

import pytest

from helixframe import settings
from helixframe.operators import genes, sequences
from helixframe.remote.services import Client, annotations, reference_bases, url_prefix, xrefs
from helixframe.sinks import tables
from helixframe.sources import files, gtf, impute2
from helixframe.sources.leading import body_lines
from helixframe.streaming.lines import stream_dosages, stream_gtf

LINES = "7 m1 4100 A G 1 0 0 0.98 0.02 0 0 0.9375 0.0625\n7 m2 8200 T C 0.75 0.25 0 0.9375 0.0625 0 0 0 1\n"


def test_impute2(spark, tmp_path):
    (tmp_path / "a").mkdir()
    path = tmp_path / "a" / "x.impute2.gz"
    path.write_bytes(gzip.compress(LINES.encode()))
    rows = impute2.read(spark, str(path)).orderBy("pos").collect()
    assert [(r.name, r.chrom, r.pos, len(r.probabilities)) for r in rows] == [("m1", "7", 4100, 3), ("m2", "7", 8200, 3)]
    d = impute2.read(spark, str(path), "dosage", prob_threshold=0.9).orderBy("pos").collect()
    assert d[1].dosage[0] is None and d[1].major == "C" and d[1].maf == pytest.approx(1 - 2.0625 / 4)
    calls = impute2.read(spark, str(path), "hard_call", prob_threshold=0.9).orderBy("pos").collect()
    assert calls[1].calls == ["0 0", "T T", "C C"]
    for mode, options in (("line", {"prob_threshold": 0.9}), ("hard_call", {"is_chr23": True}), ("nothing", {})):
        with pytest.raises(TypeError):
            impute2.read(spark, str(path), mode, **options)
    bad = spark.createDataFrame([("1 rs1  5 A G 1 0 0",), ("1 rs2 5 A G",), ("1 rs3 5 A G 1 0",)], "value string")
    marked = impute2.parse(bad).collect()
    assert [r._error is None for r in marked] == [False, True, False] and marked[1].probabilities == []
    stream = stream_dosages(spark, str(tmp_path / "a")).writeStream.format("memory").queryName("dosages").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("dosages").count() == 2
    wide = tables.wide_matrix(impute2.read(spark, str(path), "dosage"), ["m1", "m2"]).orderBy("sample").collect()
    assert [r.m1 for r in wide] == pytest.approx([0, 0.02, 1.0625])


GFF = """##gff-version 3
##source-version drawer v0.7
##date 2021-03-04
##Type RNA toy
##DNA piece
##ttg
##cat
##end-DNA
##sequence-region K77 4 912
K77\thand\tPart\t4\t912\t.\t.\t.\tID=one;Note=first of all;
chrK77\thand\tStem\t40\t61\t2.25\t-\t1\tNote "bent"; seen "a"; seen "c"
"""


def test_gtf(spark, tmp_path):
    path = tmp_path / "x.gff"
    path.write_text(GFF)
    rows = gtf.read(spark, str(path)).orderBy("start").collect()
    assert rows[0].attributes == {"ID": "one", "Note": "first of all"} and rows[0].score is None and rows[0].frame is None
    assert rows[1].seqname == "K77" and rows[1].attributes == {"Note": "bent", "seen": "c"} and rows[1].frame == "1" and rows[1].score == 2.25
    head = gtf.read_header(spark, str(path)).first()
    assert head.gff_version == 3 and head.source_version == {"drawer": "v0.7"} and str(head.date) == "2021-03-04" and head.type == {"toy": "RNA"}
    assert head.sequences["piece"]["seq"] == "TTGCAT" and tuple(head.sequence_regions["K77"]) == (4, 912)
    bad = ["#x", "a\tb", "1\ts\tf\t9\t3\t.\t.\t.", "1\ts\tf\t1\t3\tx\t.\t.", "1\ts\tf\t1\t3\t.\t?\t.", "1\ts\tf\t1\t3\t.\t.\t7", "1\ts\tf\t1\t3\t.\t.\t.\t9=1"]
    errors = gtf.parse(spark.createDataFrame([(b,) for b in bad], "value string")).collect()
    assert all(r._error for r in errors)
    with pytest.raises(Exception):  # noqa: B017
        gtf.parse(spark.createDataFrame([(bad[1],)], "value string"), mode="FAILFAST").collect()
    path.write_text(GFF + "# late\n")
    with pytest.raises(Exception, match="comment"):
        gtf.read(spark, str(path)).collect()
    assert gtf.read(spark, str(path), "DROPMALFORMED").count() == 2
    with pytest.raises(gtf.InvalidGTF):
        gtf.header(["##RNA x", "##acg"])
    (tmp_path / "empty").write_text("")
    with pytest.raises(gtf.InvalidGTF):
        gtf.read_header(spark, str(tmp_path / "empty"))
    (tmp_path / "long").write_text("##DNA long\n" + "##acgt\n" * 30_000 + "##end-DNA\n" + GFF)
    assert len(gtf.read_header(spark, str(tmp_path / "long")).first().sequences["long"]["seq"]) == 120_000


def test_gtf_plan_splits_a_line_once(spark):
    lines = spark.createDataFrame([("1\ts\tf\t1\t3\t.\t.\t.",)], "value string")
    for mode in ("PERMISSIVE", "FAILFAST"):
        plan = gtf.parse(lines, mode=mode)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(namedlambdavariable()") + plan.count("split(lambda") <= 6, plan


def test_gtf_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gtf").write_text("# head\n1\ts\tf\t1\t3\t.\t.\t.\tid 1\n")
    query = stream_gtf(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("features").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.attributes for r in spark.table("features").collect()] == [{"id": "1"}]


SEQXML = """<?xml version="1.0"?><seqXML><entry id="a" source="s"><species name="Homo sapiens" ncbiTaxID="9606"/><description>d</description><DNAseq>acgt</DNAseq>
<DBRef source="X" id="1"/><DBRef source="Y" id="2"/><property name="p" value="007"/><property name="flag"/></entry><entry id="b"><description>none</description></entry></seqXML>"""


def test_other_files(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SEQXML)
    rows = {r.uid: r for r in files.seqxml(spark, str(tmp_path / "s.xml")).collect()}
    assert rows["a"].seq == "ACGT" and rows["a"].seq_type == "DNA" and rows["b"]._error
    assert rows["a"].info == {"species": "Homo sapiens", "species_ncbi_tax_id": "9606", "description": "d", "db_name": "Y", "db_acc": "2", "p": "007", "flag": "1"}
    (tmp_path / "g.fa").write_text(">chr22 test\nacgt\nacgta\n>X\nTT\n")
    got = [tuple(r) for r in files.fasta_reference(spark, str(tmp_path / "g.fa"), chunk=4).orderBy("chrom", "chunk_id").collect()]
    assert got == [("22", 0, 1, "ACGT"), ("22", 1, 5, "ACGT"), ("22", 2, 9, "A"), ("X", 0, 1, "TT")]
    again = SEQXML.replace("acgt", "tt").replace('"b"', '"a"')
    (tmp_path / "t.xml").write_text(again)
    found = sequences.sequence_by_id(files.seqxml(spark, str(tmp_path / "t.xml"), "DROPMALFORMED"), "a").collect()
    assert [r.seq for r in found] == ["TT"] and sequences.sequence_by_id(files.seqxml(spark, str(tmp_path / "t.xml")), "q").count() == 0
    for name in ("one", "two"):
        (tmp_path / "loci").mkdir(exist_ok=True)
        (tmp_path / "loci" / name).write_text("1|5|x\n#c\n1|5|x\nchr2|6|y\nX|x|b\n")
    rows = files.delimited(spark, str(tmp_path / "loci"), 0, 1, sep="|", skip_lines=1, ignore_startswith="#").collect()
    assert sorted((r.chrom, r.pos, r._error is None) for r in rows if r.pos) == [("1", 5, True)] * 2 + [("2", 6, True)] * 2
    assert sum(r._error is not None for r in rows) == 2 and len(rows) == 6
    (tmp_path / "iso.txt").write_text("S\tg\tt1\tc\tappris_principal\nS\tg\tt2\tc\tappris_candidate\n")
    table = files.principal_isoforms(spark, str(tmp_path / "iso.txt"))
    assert sorted(r.category for r in genes.isoforms_of(table, "g").collect()) == ["appris_candidate", "appris_principal"]
    assert genes.category_of(table, "t1").first().category == "appris_principal" and genes.category_of(table, "t9").count() == 0


def test_leading_lines_within_the_first_split(spark, tmp_path):
    (tmp_path / "x").write_text("".join(f"{i}\n" for i in range(2000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        rows = body_lines(spark, str(tmp_path / "x"), skip=3)
        assert rows.rdd.getNumPartitions() > 3 and sorted(int(r.value) for r in rows.collect()) == list(range(3, 2000))
        with pytest.raises(Exception, match="first split"):
            body_lines(spark, str(tmp_path / "x"), skip=1500).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_reference_from_file_or_service(spark, tmp_path):
    genome = {"22": "ACGTTGCAAC", "X": "TTT"}
    (tmp_path / "g.fa").write_text("".join(f">chr{c}\n{s[:4]}\n{s[4:]}\n" for c, s in genome.items()))
    asked = []

    def fetch(chrom, start, end):
        asked.append((chrom, start, end))
        return genome.get(chrom, "")[start - 1 : end]

    spans = spark.createDataFrame([("22", 6, 9), ("X", 2, 2), ("9", 1, 2), (None, 1, 1)], "chrom string, start long, end long")
    for path in (str(tmp_path / "g.fa"), str(tmp_path / "none.fa"), None):
        chunks = files.reference(spark, path, spans, fetch, chunk=4)
        got = {r.chrom: r.seq for r in sequences.with_reference(spans, chunks, out="seq").where("chrom is not null").collect()}
        assert got == {"22": "GCAA", "X": "T", "9": None} and bool(asked) == (path is None or "none" in path)
    with pytest.raises(ValueError, match="chunks"):
        files.remote_reference(spans, fetch, chunk=1, most=3)


def test_browser(spark):
    with pytest.raises(ValueError):
        files.genome_browser(spark, "hg19", "select 1", url="jdbc:x")


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("1", 9, None, "A", "G"), ("1", 5, "rs5", "A", "T")], "chrom string, pos long, rs string, ref string, alt string")
    tables.write_vcf(v, str(tmp_path / "v"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert lines.count("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO") >= 1 and "1\t5\trs5\tA\tT\t.\tPASS\t." in lines and "1\t9\t.\tA\tG\t.\tPASS\t." in lines
    seqs = spark.createDataFrame([("u", "ACGTA")], "uid string, seq string")
    tables.write_fasta(seqs, str(tmp_path / "f"), line_len=2)
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == ["> u", "AC", "GT", "A"]
    info = spark.createDataFrame([("1", 1, None, "A", "G", {"maf": "0.1"}), ("1", 2, None, "A", "G", {"x": "0.1"})], "chrom string, pos long, rs string, ref string, alt string, info map<string,string>")
    assert tables.variant_table(info.where("pos = 1"), ["maf"]).first().maf == "0.1"
    with pytest.raises(Exception, match="differ"):
        tables.variant_table(info, ["maf"]).collect()


def test_services():
    import json

    slept, answers = [], []

    def transport(url, headers):
        return answers.pop(0)

    ok = lambda body, **h: (200, h, json.dumps(body).encode())
    client = Client(transport, slept.append, lambda: 1.0)
    answers[:] = [(429, {"Retry-After": "3"}, b""), ok([1])]
    assert client.json("u") == [1] and slept == [3.0]
    answers[:] = [(404, {}, b"")]
    assert client.json("u") is None
    answers[:] = [(200, {"X-RateLimit-Remaining": "2", "X-RateLimit-Reset": "10"}, b"[]")]
    assert client.json("u") == [] and slept[-1] == 5.5
    answers[:] = [ok({"response": {"numFound": 1, "docs": [{}]}}), ok({"response": {"numFound": 1, "docs": [{"symbol": "S", "ensembl_gene_id": "E"}]}})]
    assert xrefs("symbol", "S", client)["ensembl_gene_id"] == "E"
    answers[:] = [ok({"response": {"numFound": 0}}), ok([{"dbname": "EntrezGene", "primary_id": "7"}])]
    assert xrefs("ensembl_gene_id", "E", client) == {"ensembl_gene_id": "E", "entrez_id": "7"}
    answers[:] = [ok({"seq": "acg"}), ok({"MAF": "0.25", "evidence": ["A", "B"], "most_severe_consequence": "c"}), (404, {}, b"")]
    assert reference_bases("1", 5, 7, client, "GRCh38") == "ACG"
    assert annotations("rs9", client, "GRCh38") == {"maf": 0.25, "evidence": "A,B", "most_severe_consequence": "c"}
    assert annotations("rs9", client, "GRCh38")["maf"] is None
    with pytest.raises(ValueError):
        url_prefix("hg17")
    with pytest.raises(ValueError):
        xrefs("nothing", "x", client)


def test_settings(spark, tmp_path):
    (tmp_path / "s.ini").write_text("[helixframe]\nreference_fasta = /data/g.fa\nbuild = GRCh37\n")
    assert settings.load(tmp_path / "s.ini") == settings.Settings("/data/g.fa", "GRCh37", None)
    assert settings.load(tmp_path / "none.ini") == settings.Settings()
    spark.conf.set("spark.helixframe.build", "GRCh38")
    assert settings.load(tmp_path / "s.ini", spark).build == "GRCh38"
    spark.conf.unset("spark.helixframe.build")
    (tmp_path / "s.ini").write_text("[helixframe]\nwrong = 1\n")
    with pytest.raises(KeyError):
        settings.load(tmp_path / "s.ini")
