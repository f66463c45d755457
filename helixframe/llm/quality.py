"""Quality classification by hierarchical empirical Bayes.

A document's own evidence comes from logistic models of quality and of toxicity over its style and its
words.  Sites come in levels (host, then path).  A level's rate is that of its documents (labels where there
are any, else the model's probability, at SOFT of a label's weight), shrunk toward the level above by
as many pseudo-documents as the spread between the level's sites tells (method of moments), so a sparse site
stays near the global prior.  A document's own share is taken out of the rates of its host and path, so that its text and its label do not
count twice.  The result's log-odds are the document's plus those of its path's rate over the global one.

The words are picked by counts over all labelled rows; the two models are fitted on SAMPLE_ROWS of
them at most (those of least hash), on the driver.

Defined results: null and empty texts have the style of an empty text; null site values make sites of
their own; with no labels of a target, or of one kind only, that target's evidence is its prior (a half
without labels); repeated labels of one document are averaged; repeated rows each get their result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import kernels as K
from helixframe.llm.shared import drop, per_text, stash

#: Labelled rows that the models are fitted on at most; words they look at for each target.
SAMPLE_ROWS, PICKED = 10_000, 128
#: Word hashes that are counted; weight of a document without a label in its site's rate.
BUCKETS, SOFT = 1 << 18, 0.25
#: Up to so many sites (a few numbers each) are broadcast; more are joined by shuffle.
BROADCAST_SITES = 100_000
#: Up to so many labelled ids (24 bytes each) are broadcast to pick their rows; more go by shuffle, once.
BROADCAST_LABELS = 500_000
KEEP_QUALITY, KEEP_TOXIC = 0.5, 0.5
_STYLE = 12


def _style(text: str, words: np.ndarray) -> list[float]:
    n, w = max(1, len(text)), max(1, len(words))
    kinds = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines = text.split("\n")
    ascii_ = kinds[kinds < 128]
    letter = int(((ascii_ >= 65) & (ascii_ <= 90) | (ascii_ >= 97) & (ascii_ <= 122)).sum() + (kinds >= 192).sum())
    upper = int(((ascii_ >= 65) & (ascii_ <= 90)).sum())
    digit = int(((ascii_ >= 48) & (ascii_ <= 57)).sum())
    space = int((ascii_ <= 32).sum())
    other = max(0, len(kinds) - letter - digit - space)
    return [
        1.0,
        np.log1p(len(words)),
        letter / n,
        10 * digit / n,
        min(5.0, 10 * other / n),
        5 * text.count("|") / w,
        5 * text.count("!") / w,
        5 * upper / max(1, letter),
        letter / w / 5,
        len(np.unique(words)) / w,
        len(set(lines)) / len(lines),
        min(5.0, (text.count(".") + text.count(",")) * 5 / w),
    ]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Style of each text; then (text, word bucket) of its different words."""
    buf, at = K.utf8(texts)
    buf = K.LOWER[buf]
    starts, ends, first = K.word_spans(buf, at, K.ALNUM)
    hashes = K.hash_spans(buf, starts, ends)
    first = np.append(first[:-1], len(hashes))
    rows = K.owner(first, len(hashes))
    style = np.array([_style(t or "", hashes[a:b]) for t, a, b in zip(texts.to_pylist(), first[:-1], first[1:], strict=True)]).reshape(-1, _STYLE)
    both = np.unique(rows * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64))
    return style, both // BUCKETS, both % BUCKETS


def _matrix(texts: pa.Array, picked: np.ndarray) -> np.ndarray:
    style, rows, words = features(texts)
    out = np.zeros((len(texts), _STYLE + len(picked)))
    out[:, :_STYLE] = style
    if len(picked):
        at = np.minimum(np.searchsorted(picked, words), len(picked) - 1)
        hit = picked[at] == words
        out[rows[hit], _STYLE + at[hit]] = 1.0
    return out


def _pick_words(labelled: DataFrame, targets: list[str], most: int) -> np.ndarray:
    """The word buckets that tell most about each target, by counts over all labelled rows."""

    def count(batches):
        held = np.zeros((BUCKETS, 2 * len(targets)), np.int64)
        for batch in batches:
            texts = batch.column(len(targets))
            for lo, hi in K.steps(texts):
                _, rows, words = features(texts.slice(lo, hi - lo))
                for k in range(len(targets)):
                    y = np.array([-1 if v is None else int(v > 0.5) for v in batch.column(k).slice(lo, hi - lo).to_pylist()])[rows]
                    for c in (0, 1):
                        held[:, 2 * k + c] += np.bincount(words[y == c], minlength=BUCKETS)
        some = np.flatnonzero(held.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(held[some, i]) for i in range(held.shape[1]))], ["word", *names])

    names = [f"n{i}" for i in range(2 * len(targets))]
    rows = labelled.select(*targets, "text").mapInArrow(count, ", ".join(["word long", *(f"{n} long" for n in names)]))
    counts = stash(rows.groupBy("word").agg(*(F.sum(n).alias(n) for n in names)), "word-counts")
    totals = labelled.agg(*(F.count_if((F.col(t) > 0.5) == bool(c)).alias(f"{t}{c}") for t in targets for c in (0, 1))).first()
    picked = set()
    for k in range(len(targets)):
        n0, n1 = totals[2 * k], totals[2 * k + 1]
        if not n0 or not n1:
            continue
        a, b = F.col(names[2 * k]), F.col(names[2 * k + 1])
        gap = (b / n1 - a / n0) / F.sqrt((a + b + 1) * F.lit(1 / n0 + 1 / n1) / F.lit(n0 + n1))
        picked |= {r.word for r in counts.select("word", F.abs(gap).alias("gap")).orderBy(F.desc("gap"), "word").limit(most).collect()}
    drop(counts)
    return np.array(sorted(picked), np.int64)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic model, by Newton's method with a ridge on all but the constant."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def strength(sites: DataFrame) -> float:
    """Pseudo-documents by which sites(s, n, up) are shrunk toward up, by the method of moments.

    The spread of the sites' rates beyond what sampling makes: n (rate - up)^2 ~ up (1 - up) (1 + (n - 1) rho).
    """
    share, free = F.col("s") / F.col("n"), F.col("up") * (1 - F.col("up"))
    spread, even, pairs = sites.where("n > 0").agg(F.sum(F.col("n") * (share - F.col("up")) ** 2), F.sum(free), F.sum(free * (F.col("n") - 1))).first()
    rho = min(0.999, max(1e-4, ((spread or 0) - (even or 0)) / pairs)) if pairs and pairs > 0 else 1e-4
    return (1 - rho) / rho


def sites(rows: DataFrame, target: str) -> tuple[DataFrame, float, float, float]:
    """host, path with sums s and weights n of their rows and s_host and n_host of their hosts'; the global rate, and the strengths of hosts and paths."""
    total, weight = rows.agg(F.sum(F.col("w") * F.col(target)), F.sum("w")).first()
    prior = total / weight if weight else 0.5
    paths = stash(rows.groupBy("host", "path").agg(F.sum(F.col("w") * F.col(target)).alias("s"), F.sum("w").alias("n")), "paths")
    hosts = stash(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("up", F.lit(prior)), "hosts")
    of_hosts = strength(hosts)
    above = hosts.select(F.col("host").alias("above"), F.col("s").alias("s_host"), F.col("n").alias("n_host"))
    both = stash(paths.join(above, F.col("host").eqNullSafe(F.col("above"))).drop("above"), "sites")
    of_paths = strength(both.withColumn("up", (F.col("s_host") + of_hosts * prior) / (F.col("n_host") + of_hosts)))
    drop(paths, hosts)
    return both, prior, of_hosts, of_paths


def rate_of_others(own: Column, w: Column, prior: float, of_hosts: float, of_paths: float) -> Column:
    """The shrunk rate of a path of sites() without a document of value own and weight w."""
    host = (F.col("s_host") - w * own + of_hosts * prior) / (F.col("n_host") - w + of_hosts)
    return (F.col("s") - w * own + of_paths * host) / (F.col("n") - w + of_paths)


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", quality: str = "quality", toxic: str = "toxic", sample_rows: int = SAMPLE_ROWS, keep_quality: float = KEEP_QUALITY, keep_toxic: float = KEEP_TOXIC) -> DataFrame:
    """doc_id, quality and toxic (posteriors), quality_text and toxic_text (the text's own evidence), keep.

    host and path name columns of docs; a path is told apart within its host.
    """
    spark = docs.sparkSession
    targets = ["quality", "toxic"]
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{quality}`").cast("double").alias("quality"), F.col(f"`{toxic}`").cast("double").alias("toxic"))
    known = stash(known.where("id is not null").groupBy("id").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic")), "labels")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{text}`").alias("text"))
    known = known.where("quality is not null or toxic is not null")
    labelled = rows.join(F.broadcast(known), "id") if known.count() <= BROADCAST_LABELS else stash(rows.join(known, "id"), "labelled")
    picked = _pick_words(labelled, targets, PICKED)
    # of the labelled ids those of least hash, of rows with one id the least text; the texts stay on the executors, only features come to the driver
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id")
    seen = labelled.join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"), *(F.first(t).alias(t) for t in targets))

    def extract():
        def work(texts: pa.Array, _):
            x = _matrix(texts, picked).astype(np.float32)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            return [pa.ListArray.from_arrays(ends, pa.array(x.ravel()))]

        return work

    sample = per_text(seen, extract, T.StructType([T.StructField("x", T.ArrayType(T.FloatType()))]), text="text", keep=targets).toArrow()
    flat = [np.asarray(c.flatten()) for c in sample.column("x").chunks]
    x = np.concatenate([np.zeros(0), *flat]).reshape(-1, _STYLE + len(picked))
    weights = []
    for t in targets:
        y = np.array([np.nan if v is None else v for v in sample.column(t).to_pylist()])
        use = ~np.isnan(y)
        if use.any() and 0 < y[use].mean() < 1:
            weights.append(fit(x[use], y[use]))
        else:
            p = min(max(y[use].mean(), 1e-3), 1 - 1e-3) if use.any() else 0.5
            weights.append(np.append(np.log(p / (1 - p)), np.zeros(x.shape[1] - 1)))
    model = spark.sparkContext.broadcast((picked, np.array(weights).T))

    def make():
        words, w = model.value

        def work(texts: pa.Array, _):
            p = 1 / (1 + np.exp(-np.clip(_matrix(texts, words) @ w, -30, 30)))
            return [pa.array(p[:, 0]), pa.array(p[:, 1])]

        return work

    made = T.StructType([T.StructField("quality_text", T.DoubleType()), T.StructField("toxic_text", T.DoubleType())])
    scored = stash(per_text(rows, make, made, text="text", keep=["id", "host", "path"]), "scored")
    out = scored = stash(scored.join(known, "id", "left"), "scored")
    for t in targets:
        w = F.when(F.col(t).isNotNull(), 1.0).otherwise(SOFT)
        own = F.coalesce(t, f"{t}_text")
        table, prior, of_hosts, of_paths = sites(scored.select("host", "path", w.alias("w"), own.alias(t)), t)
        if table.count() <= BROADCAST_SITES:
            table = F.broadcast(table)
        table = table.withColumnsRenamed({"host": "of_host", "path": "of_path"})
        out = out.join(table, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left")
        odds = _logit(F.col(f"{t}_text")) + _logit(rate_of_others(own, w, prior, of_hosts, of_paths)) - _logit(F.lit(prior))
        out = out.withColumn(f"{t}_all", 1 / (1 + F.exp(-odds))).drop(*table.columns)
    kept = (F.col("quality_all") >= keep_quality) & (F.col("toxic_all") < keep_toxic)
    return out.select(F.col("id").alias("doc_id"), F.col("quality_all").alias("quality"), F.col("toxic_all").alias("toxic"), "quality_text", "toxic_text", kept.alias("keep"))
