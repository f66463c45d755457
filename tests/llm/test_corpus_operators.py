"""Operators that look at all rows, against brute force."""

import base64
import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import fingerprints, language_model, mixing, ngram_join

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n", "!!!", "a", "a", "A b c", "x" * 30_000]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus(seed=0, groups=12):
    """Random texts, exact copies, and near copies of several degrees."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    texts = list(ODD)
    for g in range(groups):
        base = rng.choice(vocabulary, rng.integers(40, 160))
        for k in range(rng.integers(1, 12)):
            own = base.copy()
            own[rng.integers(0, len(own), k // 2)] = rng.choice(vocabulary, k // 2)
            texts.append(" ".join(own))
    texts += texts[9:14]
    return texts


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 5 else None, None) for i, t in enumerate(texts)], DOC)


def brute_classes(texts):
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [runs(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if texts[i] and texts[i] == texts[j] or a and b and len(a & b) / len(a | b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [top(i) for i in range(len(texts))]


def test_banding():
    bands, rows = ngram_join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MOST_HASHES


def test_ngram_join_keeps_one_of_each(spark):
    texts = corpus(groups=6)
    want = set(brute_classes(texts))
    extra = spark.createDataFrame([(None, texts[-1], None, None, None), (3, "!!!", "en", "s3", None)], DOC)
    kept = ngram_join.one_of_each(table(spark, texts).unionByName(extra), broadcast_rows=0)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    nameless = spark.createDataFrame([(None, t, None, None, None) for t in ("p q r s t", "u v w x y", "u v w x y")], DOC)
    assert sorted(r.text for r in ngram_join.one_of_each(nameless).collect()) == ["p q r s t", "u v w x y"]
    assert ngram_join.Join(table(spark, texts).limit(0)).documents().count() == 0


@pytest.mark.parametrize("task_bytes, most_hashes", [(ngram_join.TASK_BYTES, 128), (500, 600)])
def test_ngram_join_counts_all_links(spark, monkeypatch, task_bytes, most_hashes):
    """Also with groups cut into many slices, and with more bands of fewer rows, whose buckets stay in parts."""
    monkeypatch.setattr(ngram_join, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(ngram_join, "banding", lambda *_: (most_hashes // 2, 2) if most_hashes > 128 else (24, 5))
    texts = corpus(1, groups=7)
    sets = [runs(t) for t in texts]
    linked = lambda i, j: texts[i] and texts[j] and (texts[i] == texts[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)
    want = [sum(bool(linked(i, j)) for j in range(len(texts)) if j != i) for i in range(len(texts))]
    assert max(want) > 4
    got = ngram_join.Join(table(spark, texts).repartition(3 if most_hashes > 128 else 1)).documents().orderBy("doc_id").collect()
    assert [r.n_links for r in got] == want
    assert [r.class_id for r in got] == brute_classes(texts)


def test_ngram_join_keeps_columns_of_any_name(spark):
    """Clashing names, and one id on several rows."""
    rows = [(1, "a b c d e f", 5, 6, 7), (1, "a b c d e f", 5, 6, 7), (2, "a b c d e f", 8, 9, 10), (3, "q r s t u v", 1, 2, 3), (3, None, 4, 4, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, node long, key_0 long")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in ngram_join.components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("order, lane", [(1, 1024), (2, 5), (3, 4), (4, 1024)])
def test_language_model(spark, monkeypatch, order, lane):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(language_model, "RANGE_KEYS", 100)
    monkeypatch.setattr(language_model, "LANE", lane)
    texts = [*corpus(4), "w1 w2 w3 w1 w2 w3 w1 w2 w4"]
    held = table(spark, texts).withColumn("train", F.col("doc_id") % 5 != 1)
    held = held.unionByName(held.where("doc_id = 30"))  # a repeated row counts twice
    got = {r.doc_id: r for r in language_model.score(held, F.col("train"), keep=["doc_id", "train"], order=order).collect()}
    tokens = [["<s>"] * (order - 1) + re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for t in texts]
    count, state = collections.Counter(), collections.Counter()
    for i, t in enumerate(tokens + [tokens[30]]):
        if i % 5 != 1 or i == len(tokens):
            for at in range(order - 1, len(t)):
                for n in range(1, order + 1):
                    count[tuple(t[at - n + 1 : at + 1])] += 1
                    state[tuple(t[at - n + 1 : at])] += 1
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)

    def weight(gram):
        if len(gram) == 1:
            return (count[gram] + 0.5) / (n + 0.5 * (v + 1))
        c = state[gram[:-1]] if gram[-2] == "<s>" else count[gram[:-1]]
        back = language_model.STRENGTH * max(c, 1) ** language_model.GROWTH if c else None
        return weight(gram[1:]) if back is None else (count[gram] + back * weight(gram[1:])) / (c + back)

    for i, t in enumerate(tokens):
        own = range(order - 1, len(t))
        base = sum(math.log10(weight((t[at],))) for at in own)
        score = sum(math.log10(weight(tuple(t[at - order + 1 : at + 1]))) for at in own)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[(t[at],)] > 0 for at in own), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    assert language_model.score(held.limit(0), F.lit(True)).count() == 0
    assert language_model.score(held, F.lit(False)).where("base_score = 0 and score = 0").count() == len(texts) + 1


def test_automaton_weights_add_up():
    """Out of each state that a text goes on from, the words' weights and one unseen word's add up to 1."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 20)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    tokens = rng.integers(1, 12, begin[-1]).astype(np.uint64)
    tokens[begin[1:] - 1] = language_model._END
    own = language_model.grams(tokens, begin, 3)
    keys, sums = zip(*(np.unique(x, return_counts=True) for x in own))
    model = language_model.Automaton(own, begin, list(keys), list(sums), len(tokens), len(keys[0]), 3.0, 0.8)
    words = np.arange(len(keys[0]))
    unseen = np.log10(0.5 / (len(tokens) + 0.5 * (len(words) + 1)))
    ended = set(model.leads[model.arc % model.words == np.searchsorted(keys[0], language_model._END)].tolist())
    for state in range(len(model.counts)):
        if state not in ended:
            total = (10 ** model._step(np.full(len(words), state), words)).sum()
            at, rest = state, unseen
            while at:
                rest += model.fail_weight[at]
                at = model.fail[at]
            assert total + 10**rest == pytest.approx(1)


def test_fingerprints(spark):
    texts = corpus(5)
    got = {r.doc_id: r for r in fingerprints.edited(table(spark, texts)).collect()}
    for i in range(len(texts)):
        text, after = texts[i] or "", texts[(i - 1) % len(texts)] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for other, near in ((changed, got[i].near_edited), (after, got[i].near_next)):
            a, b = runs(text), runs(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert near == pytest.approx(true, abs=1e-9 if len(a | b) <= fingerprints.K else 0.2)
        assert got[i].n_runs == pytest.approx(len(runs(text)), rel=0.35)
    same = collections.defaultdict(set)
    for i, t in enumerate(texts):
        same[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    twice = table(spark, ["a b", "c d"]).unionByName(table(spark, ["a b"]))
    assert fingerprints.edited(twice).count() == 3
    assert fingerprints.edited(table(spark, ["a"]).limit(0)).count() == 0


def test_sketches_merge(spark):
    rows = table(spark, [" ".join(f"v{i}" for i in range(n, n + 300)) for n in (0, 150)])
    s = [r.s for r in rows.orderBy("doc_id").select(fingerprints.sketch(F.col("text")).alias("s")).collect()]
    pair = spark.createDataFrame([(s[0], s[1])], "a array<long>, b array<long>")
    r = pair.select(fingerprints.merged(F.col("a"), F.col("b")).alias("m"), fingerprints.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert r.m == sorted(set(s[0]) | set(s[1]))[: fingerprints.K] and r.c == pytest.approx(146 / 296, abs=0.15)


def test_mixing(spark):
    texts = corpus(6, groups=40)
    rows = table(spark, texts)
    got = mixing.mix(rows, block=16, shard_words=500).select("row.doc_id", "size", "source_size", "target", "taken").collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    source = [f"s{i % 4}" if i % 5 else None for i in range(len(texts))]
    total = collections.Counter()
    for s, n in zip(source, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, sum(size) * 1.5, set(order)
    while True:
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
        left -= sum(target[s] for s in over)
        free -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = collections.Counter()
    assert len(got) == len(texts)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        shards = -(-total[s] // 500)
        assert abs(taken[s] - target[s]) <= 16 * shards + 16
    again = mixing.mix(rows.repartition(3), block=16, shard_words=500).select("row.doc_id", "taken").collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    mixed = mixing.mixed_documents(rows, block=16, shard_words=500)
    assert mixed.columns == rows.columns
    own = collections.Counter()
    for r in mixed.collect():
        own[r.doc_id] += len(r.text.split())
        assert r.text in texts[r.doc_id] + texts[r.doc_id]
    assert own == collections.Counter({r.doc_id: r.taken for r in got if r.taken})
    assert mixing.mix(rows.limit(0)).count() == 0


def test_mixing_gives_out_tied_seats_and_small_targets(spark):
    rows = [(i, "w " * 100, "en", f"s{i}", None) for i in range(4)]
    tie = mixing.mix(spark.createDataFrame(rows, DOC), block=100, weights=(1,)).select("row.doc_id", "taken").collect()
    assert sorted(r.taken for r in tie) == [100, 100, 200, 200]
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOC).repartition(3), block=100, weights=(1,)).select("row.doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, tie))
    few = spark.createDataFrame([(0, "w " * 3000, "en", "a", None), (1, "w " * 30, "en", "b", None), (2, "w " * 7, "en", None, None)], DOC)
    got = {r.doc_id: r for r in mixing.mix(few).select("row.doc_id", "target", "taken").collect()}
    assert [got[i].taken for i in (1, 2)] == [60, 14] == [got[i].target for i in (1, 2)]
    assert abs(got[0].taken - got[0].target) <= mixing.BLOCK


def test_language_stage_rejects_foreign_text_and_junk(spark):
    rng = np.random.default_rng(4)
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text", "lang")
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Python",
    ]
    junk = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(n)) for n in (12, 40, 200)]
    junk += [base64.b64encode(rng.bytes(n)).decode() for n in (150, 600, 3000)]
    clean = [" ".join(r.text.split()[:n]) for n in (4, 8, 30) for r in known.where("lang is not null and length(text) > 400").orderBy("doc_id").limit(40).collect()]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(foreign + junk + clean)], known.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, known.unionByName(more), "").select("doc_id").collect()}
    out = len(foreign + junk)
    assert not kept & {-1 - i for i in range(out)}
    assert kept >= {-1 - i for i in range(out, out + len(clean))}
    assert kept >= {r.doc_id for r in known.where("text rlike '[a-z]'").collect()}


def test_pipeline(spark, tmp_path):
    """Each stage does its work on all that the one before kept."""
    rng = np.random.default_rng(8)
    vocabulary = np.array("the and with other thing house went what about they think cat dog river mountain light under between many".split())
    base = [" ".join(rng.choice(vocabulary, 60)) for _ in range(40)]
    items = [" ".join(f"q{i}x{k}" for k in range(12)) for i in range(3)]
    texts = [*base, base[0], base[1] + " more", "123 456", None, f"{base[2]} {items[0]} {base[3]} {items[1]}", f"{base[4]} {items[2]} {base[5]}"]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = table(spark, texts)
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        sizes[name] = {r.doc_id for r in kept.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == table(spark, texts).columns
    everything = set(range(len(texts)))
    assert sizes["language"] == everything - {42, 43}
    assert sizes["near-copies"] == sizes["language"] - {40, 41}
    assert sizes["decontaminate"] == sizes["near-copies"] - {44, 45}
    assert sizes["token-ids"] == sizes["mix"] <= sizes["decontaminate"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept.count()
