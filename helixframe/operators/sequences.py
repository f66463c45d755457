"""Relations of sequences: base frequencies, base-base correlation, reference lookups and checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.prefix import fresh

#: Characters that one step of base-base correlation takes (a longer sequence is a step of its own).
STEP_CHARS = 1 << 20


def base_frequencies(seqs: DataFrame, *, uid: str = "uid", seq: str = "seq") -> DataFrame:
    """uid, base, n, freq of each row of seqs, for the characters that it has; nothing is shuffled."""
    letters = F.filter(F.array_distinct(F.split(F.col(seq), "")), lambda b: b != "")
    size = F.length(seq)
    each = F.transform(letters, lambda b: F.struct(b.alias("base"), (size - F.length(F.replace(F.col(seq), b, F.lit("")))).cast("long").alias("n")))
    rows = seqs.select(uid, size.alias("size"), F.explode(each).alias("each"))
    return rows.select(uid, "each.base", "each.n", (F.col("each.n") / F.col("size")).alias("freq"))


def correlations(seqs: list[str], k: int, letters: str) -> np.ndarray:
    """Base-base correlation of each sequence over lags 1 to k + 1, row by row of the letters, which are sorted."""
    size = np.array([len(x) for x in seqs])
    if short := size[size < k + 2].tolist():
        raise ValueError(f"k = {k} is too large for {short[0]} characters")
    m = len(letters)
    alphabet = np.array([ord(c) for c in letters], np.uint32)
    text = np.frombuffer("".join(seqs).encode("utf-32-le"), np.uint32)
    place = np.minimum(np.searchsorted(alphabet, text), m - 1)
    known = alphabet[place] == text
    row = np.repeat(np.arange(len(seqs)), size)
    n = np.bincount(row[known] * m + place[known], minlength=len(seqs) * m).reshape(-1, m)
    p = n / np.maximum(1, n.sum(axis=1, keepdims=True))
    expected = p[:, :, None] * p[:, None, :]
    total = np.zeros_like(expected)
    cell = row * m * m + place * m
    for lag in range(1, k + 2):
        both = known[:-lag] & known[lag:] & (row[:-lag] == row[lag:])
        pairs = np.bincount((cell[:-lag] + place[lag:])[both], minlength=len(seqs) * m * m).reshape(-1, m, m)
        d = pairs / (size - lag)[:, None, None] - expected
        total += d + d**2 / 2 * expected**2 + d**3
    return total.reshape(len(seqs), -1)


def base_base_correlation(seqs: DataFrame, k: int = 10, alphabet: str | None = "ACGT", *, uid: str = "uid", seq: str = "seq") -> DataFrame:
    """uid, alphabet (sorted), bbc (its length squared values).  Without an alphabet each sequence's own characters are taken.

    Pairs are counted in numpy for many sequences at a time, where a join would make a row for each position and lag.  A null sequence has a null bbc.
    """
    kind = seqs.schema[uid].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, out, letters = batch.column(1).to_pylist(), [None] * batch.num_rows, [None] * batch.num_rows
            groups: dict[str, list[int]] = {}
            for i, t in enumerate(texts):
                if t is not None:
                    groups.setdefault("".join(sorted(set(t if alphabet is None else alphabet))), []).append(i)
            for own, rows in groups.items():
                lo = 0
                while lo < len(rows):
                    hi, chars = lo + 1, len(texts[rows[lo]])
                    while hi < len(rows) and chars + len(texts[rows[hi]]) <= STEP_CHARS:
                        chars += len(texts[rows[hi]])
                        hi += 1
                    for i, found in zip(rows[lo:hi], correlations([texts[i] for i in rows[lo:hi]], k, own), strict=True):
                        out[i], letters[i] = found, own
                    lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(letters, pa.string()), pa.array(out, pa.list_(pa.float64()))], [uid, "alphabet", "bbc"])

    return seqs.select(uid, F.col(seq).alias("seq")).mapInArrow(run, f"`{uid}` {kind}, alphabet string, bbc array<double>")


def with_reference(df: DataFrame, chunks: DataFrame, *, chrom: str = "chrom", start: str = "start", end: str = "end", out: str = "sequence", first: str | None = None) -> DataFrame:
    """df with the reference bases from start to end (both in), upper-cased; null where the reference does not reach.

    first names a column for the base at start alone, which may be there where the end is not reached.

    chunks(chrom, chunk_id, chunk_start, seq) has pieces of equal size, chunk_id = (chunk_start - 1) / size.  Equi-joined
    on chromosome and chunk; only the spans asked for, each once, are put together.  Pieces before the first or after the last
    that any span asks for are left out before their text is shuffled.  The pieces are never broadcast: a plan guesses
    their size from the files that they are made of, and takes a column of text for 20 bytes a row, so a genome would come to the driver.  A piece of single bytes is cut
    as such: in text, finding a character takes a walk from the piece's start for each span.
    """
    size = chunks.where("chunk_id = 0").agg(F.max(F.length("seq"))).first()[0] or 1
    c, s, e = fresh([*df.columns, out, *([first] if first else [])], "span_chrom", "span_start", "span_end")
    piece_of = lambda at: F.floor((at - 1) / size)
    span = F.struct(F.col(chrom).alias(c), F.col(start).cast("long").alias(s), F.col(end).cast("long").alias(e))
    spans = df.select(F.explode(F.array(span)).alias("span")).select("span.*")  # no filter moves below a generator: it would repeat what makes the places
    spans = spans.where(F.col(c).isNotNull() & (F.col(s) >= 1) & (F.col(s) <= F.col(e)))
    each = spans.distinct().withColumn("k", F.explode(F.sequence(piece_of(F.col(s)), piece_of(F.col(e)))))
    needed = F.col("chunk_id").between(spans.agg(piece_of(F.min(s))).scalar(), spans.agg(piece_of(F.max(e))).scalar())
    pieces = chunks.where(needed).select(F.col("chrom").alias("rc"), F.col("chunk_id").cast("long").alias("rk"), F.col("chunk_start").cast("long").alias("at"), "seq", (F.length("seq") == F.octet_length("seq")).alias("plain")).hint("merge")
    met = each.join(pieces, (F.col(c) == F.col("rc")) & (F.col("k") == F.col("rk")))
    lo, hi = F.greatest(s, "at"), F.col(e)
    cut = lambda x: F.substring(x, (lo - F.col("at") + 1).cast("int"), (F.least(hi, F.col("at") + size - 1) - lo + 1).cast("int"))
    part = F.when(F.col("plain"), cut(F.col("seq").cast("binary")).cast("string")).otherwise(cut(F.col("seq")))
    whole = met.groupBy(c, s, e).agg(F.array_sort(F.collect_list(F.struct("k", part.alias("p")))).alias("parts"))
    text = lambda parts: F.upper(F.array_join(F.transform(parts, lambda x: x["p"]), ""))
    found = [F.when(F.length(text("parts")) == F.col(e) - F.col(s) + 1, text("parts")).alias(out)]
    if first:
        base = F.upper(F.array_join(F.transform(F.filter("parts", lambda x: x["k"] == piece_of(F.col(s))), lambda x: F.substring(x["p"], 1, 1)), ""))
        found.append(F.when(F.length(base) == 1, base).alias(first))
    whole = whole.select(c, s, e, *found)
    return df.join(whole, (F.col(chrom) == F.col(c)) & (F.col(start) == F.col(s)) & (F.col(end) == F.col(e)), "left").drop(c, s, e)


def _snp_status(genome: Column, flip: bool) -> Column:
    return F.when(genome == F.upper("ref"), "OK").when(genome == F.upper("alt"), "FLIPPED" if flip else "MISMATCH").otherwise("INVALID")


def _turned(found: DataFrame) -> DataFrame:
    """Alleles put right where the status is FLIPPED."""
    turn = F.col("status") == "FLIPPED"
    return found.withColumns({"ref": F.when(turn, F.col("alt")).otherwise(F.col("ref")), "alt": F.when(turn, F.col("ref")).otherwise(F.col("alt"))})


def _gap() -> Column:
    return (F.col("ref") == "-") | (F.col("alt") == "-")


def _looked_up(variants: DataFrame, chunks: DataFrame, gap: Column) -> DataFrame:
    """variants with _genome, the reference's bases of ref; where gap holds, both alleles are written with the base before first.

    The base before and the bases of ref are one span, so the reference is read once.
    """
    rows = variants.withColumn("_gap", gap)
    bare = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    rows = rows.withColumn("pos", F.when(F.col("_gap"), F.col("pos") - 1).otherwise(F.col("pos")))
    more = F.when(F.col("_gap"), F.length(bare("ref"))).otherwise(F.length("ref") - 1)
    rows = rows.withColumn("_end", F.coalesce(F.col("pos") + more, F.col("pos")))
    rows = with_reference(rows, chunks, start="pos", end="_end", out="_genome", first="_base")
    lead = lambda c: F.when(F.col("_gap"), F.concat(F.coalesce("_base", F.lit("?")), bare(c))).otherwise(F.col(c))
    return rows.withColumns({"ref": lead("ref"), "alt": lead("alt")}).drop("_base", "_end")


def _indel_status() -> Column:
    good = F.coalesce(F.col("_genome") == F.upper("ref"), F.lit(False))
    return F.when(good & F.col("_gap"), "FIXED").when(good, "OK").otherwise("MISMATCH")


def check_snps(snps: DataFrame, chunks: DataFrame, *, flip: bool = False) -> DataFrame:
    """snps(chrom, pos, ref, alt) with genome, status (OK, FLIPPED, MISMATCH, INVALID) and, with flip, alleles put right.

    MISMATCH: only the alternative is the genome's base and flip is off.  INVALID: neither allele is, or
    the genome does not reach.
    """
    found = with_reference(snps, chunks, start="pos", end="pos", out="genome")
    return _turned(found.withColumn("status", _snp_status(F.col("genome"), flip)))


def check_indels(indels: DataFrame, chunks: DataFrame, *, fix: bool = False) -> DataFrame:
    """indels with status (OK, FIXED, MISMATCH) after comparing ref to the genome.

    With fix, gaps are written with the base before: pos - 1, and that base in front of both alleles.
    """
    rows = _looked_up(indels, chunks, _gap() & F.lit(fix))
    return rows.withColumn("status", _indel_status()).drop("_gap", "_genome")


def check_variants(variants: DataFrame, chunks: DataFrame, *, flip: bool = False) -> DataFrame:
    """Both checks, by class; with one lookup for both."""
    from helixframe.functions.variants import vclass

    rows = variants.withColumn("_snp", vclass(F.col("ref"), F.col("alt")) == "SNP")
    rows = _looked_up(rows, chunks, ~F.col("_snp") & _gap() & F.lit(flip))
    status = F.when(F.col("_snp"), _snp_status(F.col("_genome"), flip)).otherwise(_indel_status())
    return _turned(rows.withColumn("status", status)).drop("_snp", "_gap", "_genome")


def region_sequences(regions: DataFrame, chunks: DataFrame, *, species: str = "human") -> DataFrame:
    """uid (`chrC:S-E`), seq, seq_type, info of each segment."""
    found = with_reference(regions, chunks, out="seq")
    uid: Column = F.format_string("chr%s:%d-%d", "chrom", "start", "end")
    return found.select(uid.alias("uid"), "seq", F.lit("DNA").alias("seq_type"), F.create_map(F.lit("species"), F.lit(species)).alias("info"))


def sequences_of_regions(regions: DataFrame, chunks: DataFrame) -> DataFrame:
    """region_id with its segments' sequences in order: regions(region_id, chrom, start, end) may have several segments each."""
    found = with_reference(regions, chunks, out="seq")
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "seq")))
    return found.groupBy("region_id").agg(parts.alias("parts")).select("region_id", F.transform("parts", lambda p: p["seq"]).alias("seqs"))


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """One row of each uid, seq and seq_type; info plays no part."""
    return seqs.dropDuplicates(["uid", "seq", "seq_type"])


def last_of_each(seqs: DataFrame, *, uid: str = "uid", ordinal: str = "ordinal") -> DataFrame:
    """Of the rows with one uid the last by ordinal."""
    row = F.struct(*(F.col(f"`{c}`") for c in seqs.columns))
    return seqs.groupBy(F.col(uid)).agg(F.max_by(row, F.col(ordinal)).alias("last")).select("last.*")


def sequence_by_id(seqs: DataFrame, uid: str, *, ordinal: str = "ordinal") -> DataFrame:
    """The last row with that uid, or no row."""
    return last_of_each(seqs.where(F.col("uid") == uid), ordinal=ordinal)
