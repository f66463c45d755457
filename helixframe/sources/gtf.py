"""GTF and GFF files: body lines as rows, header directives as one row."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from helixframe.errors import InvalidGTF
from helixframe.schemas import checked, let
from helixframe.sources.leading import body_lines, leading_lines

HEADER = "gff_version int, source_version map<string,string>, date date, date_text string, type map<string,string>, sequences map<string,struct<kind:string,seq:string>>, sequence_regions map<string,struct<start:bigint,end:bigint>>"
_FIELDS = ("gff_version", "source_version", "date", "date_text", "type", "sequences", "sequence_regions")
_TAG = "^([A-Za-z][A-Za-z0-9_]*)[\\s=]"


def _pieces(field: Column) -> Column:
    """The trimmed pieces between semicolons; empty ones go."""
    return F.transform(F.filter(F.split(F.trim(field), ";"), lambda p: p != ""), lambda p: F.trim(p))


def _pairs(pieces: Column) -> Column:
    """The pieces as a map; of a tag given twice the last value stays."""
    pair = lambda p: F.struct(F.regexp_extract(p, _TAG, 1).alias("key"), F.replace(F.regexp_replace(F.regexp_replace(p, _TAG, ""), "^[= \t]+|[= \t]+$", ""), F.lit('"'), F.lit("")).alias("value"))
    last = lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(let(F.transform(pieces, pair), last))


def attributes(field: Column) -> Column:
    """The ninth field as a map; of a tag given twice the last value stays; null if it is empty."""
    return F.when(F.length(F.trim(field)) > 0, _pairs(_pieces(field)))


def _record(text: Column, r: Column) -> Column:
    """What a line's text and its fields r hold, and what is wrong with it."""
    rest = F.array_join(F.slice(r, 9, F.greatest(F.size(r) - 8, F.lit(0))), " ")
    dot = lambda i: F.nullif(F.get(r, F.lit(i)), F.lit("."))
    start, end = (F.get(r, F.lit(i)).try_cast("long") for i in (3, 4))
    score, strand, frame = dot(5).try_cast("double"), dot(6), dot(7)

    def whole(pieces: Column) -> Column:
        bad = F.exists(pieces, lambda p: ~p.rlike(_TAG))
        error = (
            F.when(text.startswith("#"), "comment among the body lines")
            .when(F.size(r) < 8, F.concat(F.lit("fewer than 8 fields: "), F.left(text, F.lit(60))))
            .when(start.isNull() | end.isNull(), "start or end is not a number")
            .when((start > end) | (start < 1), "start is after end, or under 1")
            .when(score.isNull() & (F.get(r, F.lit(5)) != "."), "score is not a number")
            .when(~F.coalesce(strand.isin("+", "-"), F.lit(True)), "strand is not +, - or .")
            .when(~F.coalesce(frame.isin("0", "1", "2"), F.lit(True)), "frame is not 0, 1, 2 or .")
            .when(bad, "attribute without a tag")
        )
        return F.struct(
            F.regexp_replace(F.get(r, F.lit(0)), "^chr", "").alias("seqname"),
            F.get(r, F.lit(1)).alias("source"),
            F.get(r, F.lit(2)).alias("features"),
            start.alias("start"),
            end.alias("end"),
            score.alias("score"),
            strand.alias("strand"),
            frame.alias("frame"),
            F.when(~bad & (F.length(F.trim(rest)) > 0), pieces).alias("pieces"),
            error.alias("error"),
        )

    return let(_pieces(rest), whole)


def parse(lines: DataFrame, line: str = "value", mode: str = "PERMISSIVE") -> DataFrame:
    """seqname, source, features, start, end, score, strand, frame, attributes of body lines, batch or stream.

    A line is split once; its attributes become a map only if they are asked for.
    """
    text = F.regexp_replace(F.rtrim(F.col(line)), "^chr", "")
    record = let(text, lambda t: let(F.split(t, "\t"), lambda r: _record(t, r)))
    rows = lines.select(record.alias("record")).select("record.*")
    rows = rows.withColumn("attributes", _pairs(F.col("pieces")))
    return checked(rows, F.col("error"), mode).drop("pieces", "error")


def read(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Body rows of one file or many.  Lines that start with # are skipped at the head of a file; later ones are wrong.  .gz is decoded by its codec."""
    return parse(body_lines(spark, path, comment="#").where(F.length("value") > 0), mode=mode)


read_gff = read


def header(lines: list[str]) -> dict:
    """The directives of a file's leading # lines."""
    out: dict = dict.fromkeys(_FIELDS)
    block: tuple[str, str, list[str]] | None = None
    for raw in lines:
        text = raw.strip()
        if block is not None:
            kind, name, parts = block
            if text.lower() == f"##end-{kind.lower()}":
                out["sequences"] = (out["sequences"] or {}) | {name: ("AA" if kind == "Protein" else kind, "".join(parts).upper())}
                block = None
            else:
                parts.append(text.lstrip("#").strip())
            continue
        if not text.startswith("##"):
            continue
        words = text[2:].split()
        if not words:
            continue
        tag, rest = words[0], words[1:]
        if tag == "gff-version" and rest:
            out["gff_version"] = int(rest[0])
        elif tag == "source-version" and len(rest) >= 2:
            out["source_version"] = (out["source_version"] or {}) | {rest[0]: rest[1]}
        elif tag == "date" and rest:
            out["date_text"] = " ".join(rest)
            try:
                out["date"] = datetime.date.fromisoformat(rest[0])
            except ValueError:
                out["date"] = None
        elif tag == "Type" and rest:
            out["type"] = (out["type"] or {}) | {rest[1] if len(rest) > 1 else "": rest[0]}
        elif tag == "sequence-region" and len(rest) >= 3:
            out["sequence_regions"] = (out["sequence_regions"] or {}) | {rest[0]: (int(rest[1]), int(rest[2]))}
        elif m := re.fullmatch("DNA|RNA|Protein", tag):
            block = (m.group(), rest[0] if rest else "", [])
    if block is not None:
        raise InvalidGTF(f"##{block[0]} {block[1]} has no end")
    return out


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """One row of metadata from a file's leading # lines.  A ##Type without a name is filed under ''."""
    lines = leading_lines(spark, path, "#")
    if lines is None:
        raise InvalidGTF(f"{path} is empty")
    return spark.createDataFrame([Row(**header(lines))], HEADER)
