"""Both classifiers: held-out accuracy, and defined results for odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylume.llm import labelled, quality, toxicity

BAD = ["idiot", "moron", "scumbag", "worthless"]


def corpus(spark, n=500):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ka", "lo", "mi", "te", "ru", "so"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        toxic, good = int(rng.random() < 0.4), int(rng.random() < 0.6)
        if toxic:
            for _ in range(3):
                bad = rng.choice(BAD)
                words[rng.randrange(len(words))] = bad + rng.choice(["", "s", "zz", "ity"])
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en"))
        labels.append((i, good, toxic))
    rows += [(n, None, "en"), (n + 1, "", "en"), (n + 2, "ka lo " * 30000, "en"), (None, "ka lo mi", "en"), (3, rows[3][1], "en")]
    labels += [(n + 50, 1, 0), (None, 1, 1), (5, labels[5][1], labels[5][2]), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels[:n]}


@pytest.mark.parametrize(("module", "place", "threshold"), [(quality, 0, 0.3), (toxicity, 1, 0.5)])
def test_held_out_accuracy(spark, module, place, threshold):
    docs, labels, known = corpus(spark)
    got = module.score(docs, module.fit(docs, labels)).collect()
    assert len(got) == docs.count()
    right = []
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] in known:
            right.append(r["predicted"] == known[r["doc_id"]][place])
    assert len(right) > 50 and np.mean(right) > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels(spark, module):
    docs, labels, _ = corpus(spark, 20)
    model = module.fit(docs, labels.limit(0))
    assert {r["score"] for r in module.score(docs, model).collect()} == {0.5}
    assert module.score(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = corpus(spark, 200)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"] or -1, r["score"]) for r in quality.score(docs, quality.fit(docs, x)).collect()) for x in (labels, flipped))
    assert a == b


def test_rejected_documents_go(spark):
    docs, labels, known = corpus(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 200 < kept.count() < docs.count()
    assert kept.exceptAll(docs).isEmpty()


def test_unseen_misspellings_share_ngrams(spark):
    docs, labels, _ = corpus(spark)
    model = toxicity.fit(docs, labels)
    amounts = toxicity.WordAmounts(model.amounts)
    syllables = ["ka", "lo", "mi", "te", "ru", "so"]
    harmless = [f"{a}{b}{c}".encode() for a in syllables for b in syllables for c in syllables]
    assert min(amounts[b"moronnn"], amounts[b"xworthless"]) > max(amounts[w] for w in harmless)


def test_all_of_a_long_word_and_every_passage_count():
    amounts = toxicity.WordAmounts(np.zeros(toxicity.BUCKETS))
    amounts.update({b"bad": 1.0, b"mm": 0.0})
    for before in range(8):
        assert toxicity.highest_passage([b"mm"] * before + [b"bad"] * 4 + [b"mm"] * 8, amounts) == 1
    insult = "\u7b28\u86cb\u767d\u75f4".encode()
    told = np.zeros(toxicity.BUCKETS)
    told[toxicity.subwords(insult)] = 1
    model = toxicity.Model(told, 1.0, 0.0)
    filler = "\u5929\u6c14".encode() * 100
    plain, *rest = model.scores([filler, filler + insult, filler[:300] + insult + filler[300:]], toxicity.WordAmounts(told))
    assert min(rest) > plain
    for size in (1, 63, 64, 65, 124, 125, 600, 601):
        word = (bytes(range(128, 256)) * 5)[:size]
        grams = {word[i : i + n] for n in (3, 4, 5) for i in range(size - n + 1)}
        pieces = toxicity.stretches([b"a", word])
        assert max(map(len, pieces)) <= 64 and all(any(g in x for x in pieces) for g in grams)


def test_log_count_ratios_and_dual_against_plain_ones(monkeypatch):
    monkeypatch.setattr(quality, "WIDTH", 40)
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, int(rng.integers(1, 15)), replace=False)) for _ in range(60)]
    y = np.array([int((x < 12).sum() > (x > 27).sum()) for x in rows])
    ratios = quality.log_count_ratios(rows, y)
    counts = {c: [1 + sum(j in x.tolist() for x, v in zip(rows, y, strict=True) if v == c) for j in range(40)] for c in (0, 1)}
    for j in range(40):
        expected = np.log(counts[1][j] / sum(counts[1])) - np.log(counts[0][j] / sum(counts[0]))
        assert np.isclose(ratios[j], expected if counts[0][j] + counts[1][j] >= 4 else 0)
    values = [ratios[x] / (np.linalg.norm(ratios[x]) or 1) for x in rows]
    cost, sign = np.full(60, 0.5), 2.0 * y - 1
    w = quality.dual_coordinate_descent(rows, values, sign, cost, 300, 1)
    dense = np.zeros((60, 41))
    for i, (x, v) in enumerate(zip(rows, values, strict=True)):
        dense[i, x], dense[i, -1] = v, 1
    signed = dense * sign[:, None]
    alpha, step = np.zeros(60), 1 / np.linalg.norm(signed @ signed.T, 2)
    for _ in range(20000):  # projected gradient on the same dual
        alpha = np.clip(alpha - step * (signed @ (signed.T @ alpha) - 1), 0, cost)
    primal = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - signed @ w)).sum()
    assert abs(primal(w) - primal(signed.T @ alpha)) < 1e-2


def test_gradients_are_finite_differences():
    net, rng, step = toxicity.Embeddings(4, 1), np.random.default_rng(2), 1e-5
    net.vectors, net.softmax, net.bias = (p.astype(np.float64) for p in (net.vectors, net.softmax, net.bias))
    place, share, lengths, y = rng.integers(0, 50, 12), rng.random(12), [3, 4, 5], np.array([0, 1, 1])
    _, slopes = net.gradients(place, share, lengths, y)
    for parameter, slope in zip((net.vectors, net.softmax, net.bias), slopes, strict=True):
        flat, told = parameter.reshape(-1), slope.reshape(-1)
        for i in rng.integers(0, 200 if len(flat) > 200 else len(flat), 20):
            before, out = flat[i], []
            for way in (1, -1):
                flat[i] = before + way * step
                out.append(net.gradients(place, share, lengths, y)[0])
            flat[i] = before
            assert np.isclose(told[i], (out[0] - out[1]) / (2 * step), atol=1e-6)


def test_punctuation_counts_whole():
    a, b = quality.Hashes(), quality.Hashes()
    assert not np.array_equal(quality.features("x !!!! y !!!! z", a), quality.features("x !!!!? y !!!!? z", b))
    assert quality.shape("!!!!?") != quality.shape("!!!!")


def test_samples_are_bounded_in_bytes(spark):
    docs, labels, known = corpus(spark, 100)
    sample, _ = labelled.training_sample(docs.withColumn("y", F.lit("clash")), labels, "quality", 1000, 1, sample_bytes=3000)
    rows = sample.collect()
    assert 5 < len(rows) and sum(len(r["text"]) for r in rows) <= 3000 and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["y"] == known[r["doc_id"]][0] for r in rows)
    whole, _ = labelled.training_sample(docs.unionByName(docs.withColumn("text", F.lit("\x01"))), labels, "quality", 1000, 1)
    assert {r["text"] for r in whole.collect()} <= {"\x01", ""}  # the first of several texts in the order of their bytes
    assert labelled.fitting([(1, 5), (2, 9), (3, 1)], 6) == [2]
