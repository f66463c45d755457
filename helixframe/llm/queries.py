"""The queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontamination, fingerprints, language, language_model, mixing, ngram_join, pseudonyms, quality, secrets, token_files
from helixframe.llm.shared import crc_mod, documents

#: For the registered query only: a real run brings its own secret.
PSEUDONYM_KEY = b"key of the registered query"


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"))
    return language_model.score(held_out, ~F.col("held_out"), keep=["doc_id", "held_out"])


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = crc_mod(F.col("doc_id"), 4)
    profile = language.profiles(docs.where(fold != 2))
    held_out = docs.select("doc_id", "text", (fold == 2).alias("held_out"))
    return language.identify(held_out, profile, keep=["doc_id", "held_out"])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_cost")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.Join(documents(spark, sf_dir)).documents()


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(documents(spark, sf_dir))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(documents(spark, sf_dir), PSEUDONYM_KEY)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("items")).alias("contaminated"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("row.doc_id", "size", "source_size", "target", "taken")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_model": op1_language_model,
        "op2_language": op2_language,
        "op3_secrets": op3_secrets,
        "op4_quality": op4_quality,
        "op5_ngram_join": op5_ngram_join,
        "op6_fingerprints": op6_fingerprints,
        "op7_pseudonyms": op7_pseudonyms,
        "op8_decontamination": op8_decontamination,
        "op9_mixing": op9_mixing,
        "op10_token_files": op10_token_files,
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: All texts against all by the runs that they share, and the components of the links by reaching out from each text.
NGRAM_JOIN = f"""with recursive texts as (
    select text, min(doc_id) as id, count(*) as copies, {_WORDS} as w from documents where text != '' group by text),
  sets as (
    select distinct id, array_to_string(w[i:i + 4], ' ') as run from (select id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from texts where len(w) > 0)),
  sizes as (select id, count(*) as n from sets group by id),
  met as (select a.id as a, b.id as b, count(*) as n from sets a join sets b on a.run = b.run and a.id != b.id group by all),
  links as (select a, b from met join sizes x on x.id = a join sizes y on y.id = b where met.n >= 0.8 * (x.n + y.n - met.n)),
  reached as (select id as a, id as b from texts union select r.a, l.b from reached r join links l on l.a = r.b),
  classes as (select a as id, min(b) as class_id from reached group by a),
  linked as (select a as id, sum(copies) as n from links join texts on id = b group by a)
  select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, cast(coalesce(l.n, 0) + coalesce(t.copies, 1) - 1 as bigint) as n_links
  from documents d left join texts t on t.text = d.text left join classes c on c.id = t.id left join linked l on l.id = t.id"""

#: All windows of items against all runs of as many words of documents.
DECONTAMINATION = f"""with docs as (select doc_id, {_WORDS} as w from documents),
  items as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
  windows as (
    select distinct item, least(len(w), 8) as n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') as run
    from (select item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) as i from items where len(w) > 0)),
  sizes as (select distinct n from windows),
  runs as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as run from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
  met as (select doc_id, item, i, r.n from runs r join windows v on v.run = r.run and v.n = r.n),
  hits as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + n)) as p from met) group by doc_id),
  found as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from met) group by doc_id)
  select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(h.n, 0) as n_hit, coalesce(f.n, 0) as n_items, sha256(coalesce(f.items, '')) as items_sha256, coalesce(f.n, 0) >= 2 as contaminated
  from docs d left join hits h on h.doc_id = d.doc_id left join found f on f.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express over whole tables; the others are tested against brute force, a round trip, or held-out rows."""
    return {"op5_ngram_join": NGRAM_JOIN, "op8_decontamination": DECONTAMINATION}
