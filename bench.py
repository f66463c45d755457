"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from helixframe.plans import catalogue

HEADLINE = [
    "gene_variant_counts", "variants_in_any_gene", "merge_intervals", "interval_overlap_pairs", "nearest_gene_distance", "region_span", "vcf_lines",
    "gc_content", "reverse_complement", "translate_codons", "base_base_correlation", "maf", "hard_calls", "gtf_parse", "reference_allele_check", "principal_transcript",
]


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):
            begun = time.time()
            catalogue.QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
            times.append(time.time() - begun)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "headline queries, the better of two runs each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(where)}))


if __name__ == "__main__":
    main()
