"""Sequences as columns."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amino acids of the standard code with bases in the order TCAG (first base slowest), stops as *.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(b): a for b, a in zip(product("TCAG", repeat=3), _AMINO, strict=True) if a != "*"}
STOPS = ("TAA", "TAG", "TGA")
# Base codes and their complements.
CODES, COMPLEMENTS = "ACGTMRWSYKVHDB", "TGCAKYWSRMBDHV"
TYPES = ("DNA", "RNA", "AA")


def gc_content(seq: Column) -> Column:
    """Share of G and C in all characters; null for an empty sequence."""
    return F.try_divide(F.length(seq) - F.length(F.translate(seq, "GC", "")), F.length(seq))


def reverse_complement(seq: Column) -> Column:
    """By the 14 base codes; other characters stay."""
    return F.translate(F.reverse(seq), CODES, COMPLEMENTS)


def codons(seq: Column) -> Column:
    """Whole codons, left to right."""
    return F.regexp_extract_all(seq, F.lit("(?s).{3}"), F.lit(0))


def translate(seq: Column, no_check: bool = False) -> Column:
    """The protein of DNA or RNA; what cannot be translated raises an error.

    Unless no_check, a start and a stop codon are required.  A stop at the end is left out; one
    inside, or a codon with ambiguous bases, is an error.
    """
    table = F.create_map(*(F.lit(x) for pair in CODONS.items() for x in pair))
    dna = F.translate(F.upper(seq), "U", "T")
    last = F.right(dna, F.lit(3))
    body = F.when(last.isin(*STOPS), F.left(dna, F.length(dna) - 3)).otherwise(dna)
    one = lambda c: F.coalesce(F.try_element_at(table, c), F.raise_error(F.concat(F.lit("no amino acid for codon "), c)))
    out = F.array_join(F.transform(codons(body), one), "")
    fail = lambda why: F.raise_error(F.lit(why))
    out = F.when(F.length(dna) % 3 != 0, fail("length is not a multiple of 3")).otherwise(out)
    if no_check:
        return out
    return F.when((F.length(dna) % 3 == 0) & (F.left(dna, F.lit(3)) != "ATG"), fail("no start codon")).when((F.length(dna) % 3 == 0) & ~last.isin(*STOPS), fail("no stop codon")).otherwise(out)


def same_sequence(a: Column, b: Column) -> Column:
    """uid, seq and seq_type are equal; info plays no part."""
    return (a["uid"] == b["uid"]) & (a["seq"] == b["seq"]) & (a["seq_type"] == b["seq_type"])


def sequence_text(uid: Column, seq: Column, seq_type: Column) -> Column:
    """A sequence in a line: its type, id and length."""
    return F.format_string("%s %s (%d)", seq_type, uid, F.length(seq))


def strip_gaps(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def fasta(uid: Column, seq: Column, info: Column | None = None, line_len: int = 80) -> Column:
    """A record: `> uid`, with info ` - 'k'='v', ...`, then lines of line_len characters, each ended."""
    head = F.concat(F.lit("> "), uid)
    if info is not None:
        pairs = F.transform(F.array_sort(F.map_entries(info)), lambda e: F.concat(F.lit("'"), e["key"], F.lit("'='"), F.coalesce(e["value"], F.lit("")), F.lit("'")))
        head = F.concat(head, F.when(F.size(info) > 0, F.concat(F.lit(" - "), F.array_join(pairs, ", "))).otherwise(""))
    return F.concat(head, F.lit("\n"), F.regexp_replace(seq, f"(.{{{line_len}}})(?=.)", "$1\n"), F.lit("\n"))
