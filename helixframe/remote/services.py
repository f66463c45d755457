"""Clients of public gene services, for the driver: quotas are global, so executors never call them.

transport(url, headers) returns (status, headers, body); tests bring their own.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping

Transport = Callable[[str, Mapping[str, str]], tuple[int, Mapping[str, str], bytes]]

# Service addresses, and fields by which names can be searched.
PREFIXES = {"grch37": "http://grch37.rest.ensembl.org/", "hg19": "http://grch37.rest.ensembl.org/", "grch38": "http://rest.ensembl.org/", "hg38": "http://rest.ensembl.org/"}
NAMES = "http://rest.genenames.org/"
FIELDS = frozenset({"ccds_id", "ensembl_gene_id", "entrez_id", "hgnc_id", "name", "symbol", "ucsc_id", "uniprot_ids", "vega_id"})
#: The keys of a cross-reference map and the service's field for each.
XREFS = {"name": "name", "symbol": "symbol", "entrez_id": "entrez_id", "cosmic_id": "cosmic", "refseq_ids": "refseq_accession", "ensembl_gene_id": "ensembl_gene_id", "omim_ids": "omim_id", "uniprot_ids": "uniprot_ids", "ucsc_id": "ucsc_id"}


def url_prefix(build: str) -> str:
    try:
        return PREFIXES[build.lower()]
    except KeyError:
        raise ValueError(f"build is GRCh37 or GRCh38, not {build!r}") from None


def urlopen(url: str, headers: Mapping[str, str]) -> tuple[int, Mapping[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers))) as answer:
            return answer.status, answer.headers, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers, e.read()


class Client:
    """Keeps within the quota that answers announce; waits and asks again when told to."""

    def __init__(self, transport: Transport = urlopen, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time, retries: int = 5):
        self.transport, self.sleep, self.clock, self.retries, self.last = transport, sleep, clock, retries, 0.0

    def json(self, url: str):
        """The answer, or None if the service refuses."""
        for _ in range(self.retries + 1):
            now = self.clock()
            since, self.last = now - self.last, now
            status, headers, body = self.transport(url, {"Accept": "application/json"})
            if status == 429:
                self.sleep(float(headers.get("Retry-After", 1)))
                continue
            if status != 200:
                return None
            left = int(headers.get("X-RateLimit-Remaining", 0))
            if left > 0 and since < (pause := int(headers.get("X-RateLimit-Reset", 0)) / left):
                self.sleep(pause - since + 0.5)
            return json.loads(body)
        return None


def xrefs(field: str, query: str, client: Client, build: str = "GRCh38") -> dict:
    """Cross references of the best hit, in one set of keys; by gene id also from the gene service; {} if there are none."""
    if field not in FIELDS:
        raise ValueError(f"field is one of {', '.join(sorted(FIELDS))}")
    hits = client.json(f"{NAMES}search/{field}:{query}") or {"response": {"numFound": 0}}
    if hits["response"]["numFound"]:
        docs = (client.json(f"{NAMES}fetch/{field}/{query}") or {"response": {"docs": []}})["response"]["docs"]
        if not docs or docs[0].get(field) != query:
            raise LookupError(f"no gene with {field} {query}")
        return {k: docs[0].get(v) for k, v in XREFS.items()}
    if field != "ensembl_gene_id":
        return {}
    out = {"ensembl_gene_id": query}
    for row in client.json(f"{url_prefix(build)}xrefs/id/{query}?content-type=application/json") or []:
        if key := {"EntrezGene": "entrez_id", "Uniprot_gn": "uniprot_ids"}.get(row["dbname"]):
            out[key] = row["primary_id"]
    return out


def overlapping(region: str, features: tuple[str, ...], client: Client, build: str) -> list[dict]:
    """Features of a region `C:S-E`: the rows of genes_of, genes_in and variants_in."""
    kinds = ";".join(f"feature={f}" for f in features)
    return client.json(f"{url_prefix(build)}overlap/region/homo_sapiens/{region}?{kinds};content-type=application/json") or []


def sequence(transcript: str, kind: str, client: Client, build: str) -> str | None:
    answer = client.json(f"{url_prefix(build)}sequence/id/{transcript}?type={kind};content-type=application/json")
    return answer and answer.get("seq")


def reference_bases(chrom: str, start: int, end: int, client: Client, build: str) -> str | None:
    """1-based, both ends in, upper-cased."""
    answer = client.json(f"{url_prefix(build)}sequence/region/human/{chrom}:{start}..{end}:1?content-type=application/json")
    return answer and answer["seq"].upper()


def annotations(rs: str, client: Client, build: str) -> dict:
    """maf (float), evidence (comma-joined), most_severe_consequence of a variant."""
    answer = client.json(f"{url_prefix(build)}variation/homo_sapiens/{rs}?content-type=application/json") or {}
    maf = answer.get("MAF")
    return {"maf": None if maf is None else float(maf), "evidence": ",".join(answer.get("evidence", [])), "most_severe_consequence": answer.get("most_severe_consequence")}
