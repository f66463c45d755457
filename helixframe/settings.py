"""Settings from an INI file, with what the session's configuration says in their place."""

from __future__ import annotations

import configparser
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

#: The session's setting for each field.
CONF = {"reference_fasta": "spark.helixframe.referenceFasta", "build": "spark.helixframe.build", "gene_database": "spark.helixframe.geneDatabase"}


@dataclass(frozen=True)
class Settings:
    reference_fasta: str | None = None
    build: str = "GRCh38"
    gene_database: str | None = None


def load(path: str | Path | None = None, spark: SparkSession | None = None) -> Settings:
    """The [helixframe] section of an INI file (none: ~/.helixframe.ini, if it is there); the session's settings go before the file's."""
    parser = configparser.ConfigParser()
    parser.read(path or Path.home() / ".helixframe.ini")
    found = dict(parser["helixframe"]) if parser.has_section("helixframe") else {}
    if spark is not None:
        found |= {k: v for k, name in CONF.items() if (v := spark.conf.get(name, None)) is not None}
    if unknown := set(found) - set(CONF):
        raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**found)
