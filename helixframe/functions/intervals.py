"""Closed 1-based intervals as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.schemas import chrom_ok, normalize_chrom


def segment(chrom: Column, start: Column, end: Column) -> Column:
    return F.struct(chrom.alias("chrom"), start.alias("start"), end.alias("end"))


def valid_segment(s: Column) -> Column:
    """A known chromosome, and start strictly before end."""
    return chrom_ok(s["chrom"]) & F.coalesce(s["start"] < s["end"], F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    return (a["chrom"] == b["chrom"]) & (a["start"] <= b["end"]) & (a["end"] >= b["start"])


def contains_point(s: Column, chrom: Column, pos: Column) -> Column:
    return (s["chrom"] == chrom) & pos.between(s["start"], s["end"])


def contains(s: Column, inner: Column) -> Column:
    return (s["chrom"] == inner["chrom"]) & (s["start"] <= inner["start"]) & (inner["start"] <= inner["end"]) & (inner["end"] <= s["end"])


def same(a: Column, b: Column) -> Column:
    return (a["chrom"] == b["chrom"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])


def gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """0 for overlapping intervals of one chromosome, 1 for adjacent ones."""
    return F.greatest(F.lit(0).cast("long"), b_start - a_end, a_start - b_end)


def distance(a: Column, b: Column) -> Column:
    """Fails on different chromosomes."""
    found = gap(a["start"], a["end"], b["start"], b["end"])
    return F.when(a["chrom"] == b["chrom"], found).otherwise(F.raise_error(F.lit("segments on different chromosomes have no distance")).cast("long"))


# A region is an array of segments.
def region_contains_point(region: Column, chrom: Column, pos: Column) -> Column:
    return F.exists(region, lambda s: contains_point(s, chrom, pos))


def region_contains(region: Column, inner: Column) -> Column:
    """Whether one of the segments holds all of it."""
    return F.exists(region, lambda s: contains(s, inner))


def regions_overlap(a: Column, b: Column) -> Column:
    return F.exists(a, lambda s: F.exists(b, lambda t: overlaps(s, t)))


def region_distance(a: Column, b: Column) -> Column:
    return F.array_min(F.transform(a, lambda s: F.array_min(F.transform(b, lambda t: distance(s, t)))))


def region_start(region: Column) -> Column:
    return F.array_min(F.transform(region, lambda s: s["start"]))


def region_end(region: Column) -> Column:
    return F.array_max(F.transform(region, lambda s: s["end"]))


def region_chrom(region: Column) -> Column:
    return F.get(region, 0)["chrom"]


def is_contiguous(region: Column) -> Column:
    return F.size(region) == 1


def merged_region(region: Column) -> Column:
    """The union of a region's segments: touching ones become one, adjacent ones do not; one chromosome only."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["chrom"].alias("chrom"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))
        foreign = F.raise_error(F.lit("segments of one region lie on one chromosome")).cast(empty)
        return F.when(F.size(done) == 0, F.array(s)).when(last["chrom"] != s["chrom"], foreign).when(s["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(s)))

    empty = "array<struct<chrom:string,start:bigint,end:bigint>>"
    typed = F.array_sort(region.cast(empty))
    return F.aggregate(typed, F.array().cast(empty), add)


def union_regions(a: Column, b: Column) -> Column:
    return merged_region(F.concat(a, b))


def parse_region(text: Column) -> Column:
    """`chrC:S-E` as a segment; null if it is not one."""
    form = "^chr([0-9]{1,2}|MT|X|Y):([0-9]{1,18})-([0-9]{1,18})$"
    part = lambda k: F.regexp_extract(text, form, k)
    start, end = part(2).try_cast("long"), part(3).try_cast("long")
    return F.when(text.rlike(form) & (start < end), segment(normalize_chrom(part(1)), start, end))


def region_text(s: Column) -> Column:
    return F.format_string("chr%s:%d-%d", s["chrom"], s["start"], s["end"])
