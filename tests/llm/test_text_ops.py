"""Decontamination, near duplicates, packing, language model and top-k against brute force."""

import dataclasses
import itertools
import math
import pickle
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querylume.llm import decontaminate, lm, near_dup, packing, topk
from querylume.llm.queries import word_bpe_path
from querylume.llm.word_bpe import Pieces

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EMPTY = "doc_id long, text string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(low(text or ""))


# -- decontamination ------------------------------------------------------------------------------------


def brute_hits(texts, items, size):
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(name)
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_automaton_finds_all_windows(items, text, size):
    named = [(str(i), [w.encode() for w in x]) for i, x in enumerate(items)]
    automaton = decontaminate.ItemAutomaton(named, size)
    codes = np.array([automaton.vocabulary.get(w.encode(), -1) for w in text] + [-1])
    hit, found = set(), set()
    for a, b in automaton.candidates(codes):
        for i, n, _, names in automaton.stream(codes[a:b].tolist()):
            hit.update(range(a + i - n + 1, a + i + 1))
            found |= names
    expected = brute_hits([" ".join(text)], [(str(i), " ".join(x)) for i, x in enumerate(items)], size)[0]
    assert (len(hit), sorted(found)) == expected[1:]


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_decontamination_of_documents(spark, small, block_bytes):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    short = spark.createDataFrame([(900, "And, the"), (901, None), (902, "!!"), (None, "of to the in")], "item_id long, text string")
    items = items.select("item_id", "text").unionByName(short)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "AND the. of TO the in"), (-3, "AND the. of TO the in"), (None, "x" * 50000)], EMPTY)
    docs = docs.select("doc_id", "text").unionByName(odd)
    found = decontaminate.find_hits(docs.withColumn("longest", F.lit("clash")), items, block_bytes=block_bytes).collect()
    expected = brute_hits([r["text"] for r in found], [("" if r["item_id"] is None else str(r["item_id"]), r["text"]) for r in items.collect()], 10)
    got = [(r["n_words"], sum(h["last"] - h["first"] + 1 for h in r["hits"]), r["items"]) for r in found]
    assert got == expected and len(got) == docs.count()
    assert decontaminate.report(docs.limit(0), items).count() == 0
    assert decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0


def test_spans_are_cut(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"Before, this. {item.upper()}! after é many words more to keep it under half of all words here"), (2, item), (3, "clean text"), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: "Before, this. ! after é many words more to keep it under half of all words here", 3: "clean text", 4: None, 5: ""}


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300}])
def test_spans_are_cut_in_the_worker_that_finds_them(spark, options, capsys):
    """One Python step a stage, however many blocks of items there are; the cut is the same."""
    rng = np.random.default_rng(3)
    passages = [" ".join(f"w{j}" for j in rng.integers(0, 500, 14)) for _ in range(12)]
    filler = " ".join(f"f{i}" for i in range(60))
    rows = [(i, f"{filler} {p}; and {passages[i - 1]}. {filler}", [i], i / 2) for i, p in enumerate(passages)] + [(50, passages[0], None, 0.0), (None, None, [1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits array<int>, `a b` double")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    clean = decontaminate.decontaminate(docs, items, **options)
    assert clean.columns == ["doc_id", "text", "a b"]
    capsys.readouterr()
    clean.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    got = {r["doc_id"]: (r["text"], r["a b"]) for r in clean.collect()}
    assert got == {i: (f"{filler} ; and . {filler}", i / 2) for i in range(12)} | {None: (None, None)}


def test_workers_hold_an_automaton_in_arrays():
    """At most 100 bytes a state besides the vocabulary and the filter of pairs, which have bounds of their own."""
    rng = np.random.default_rng(4)
    named = [(str(i), [b"w%d" % j for j in rng.integers(0, 500, 200)]) for i in range(200)]
    automaton = decontaminate.ItemAutomaton(named, 10)
    del automaton.pairs, automaton.vocabulary
    packed = pickle.dumps(automaton)
    tracemalloc.start()
    held = pickle.loads(packed)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(held.link) > 40_000 and size < 100 * len(held.link)


# -- near duplicates ------------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            both = len(sets[i] & sets[j])
            if same or (both and both >= 0.8 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        out[find(i)].append(doc)
    return sorted(sorted(x) for x in out.values())


def found_classes(frame):
    out = defaultdict(list)
    for r in frame.collect():
        out[r["root"]].append(r["doc_id"])
    return sorted(sorted(x) for x in out.values())


def test_classes_equal_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    body = [f"t{i}" for i in range(120)]
    chain = [(1000 + k, " ".join(body[:60] + [f"n{k}x{j}" for j in range(3 * k)] + body[60:])) for k in range(6)]
    odd = [(2000, ""), (2001, None), (2002, "!!"), (2003, "?"), (2004, "two words"), (2005, "Two, words"), (2006, "x"), (2006, "x")]
    rows = docs + chain + odd
    frame = spark.createDataFrame(rows, EMPTY).withColumn("bands", F.lit("clash")).repartition(5)
    assert found_classes(near_dup.near_duplicates(frame)) == brute_classes(rows)


def test_one_of_each_class_stays(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "another text of some words"), (4, None), (None, "null id text here now")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], EMPTY + ", lang string")
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in near_dup.keep_one(docs).collect())
    assert [k for k, _ in kept][0] == 0 and len(kept) == 4
    assert near_dup.keep_one(docs.limit(0)).count() == 0
    twice = docs.where("doc_id = 2")
    assert near_dup.keep_one(twice).count() == 1


@pytest.mark.parametrize("levels", [near_dup.LEVELS, 0])
def test_similar_pairs_in_mixed_buckets_are_found(spark, monkeypatch, levels):
    """300 pairs share a passage with all others, so their buckets hold many classes; what is compared whole is small.

    Without levels, all of it is compared by pairs of blocks, and no pair is missed; with them, under 1 % in the mean.
    """
    monkeypatch.setattr(near_dup, "WHOLE_TEXTS", 32)
    monkeypatch.setattr(near_dup.missed_links, "__defaults__", (levels,))
    passage = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(300):
        own = [f"o{k}x{i}" for i in range(6)]  # a pair is similar by 0.83, other texts by 0.77
        rows += [(2 * k + t, " ".join(passage + own + [f"p{k}x{t}x{i}" for i in range(16)])) for t in range(2)]
    got = found_classes(near_dup.near_duplicates(spark.createDataFrame(rows, EMPTY).repartition(4)))
    assert all(c[-1] - c[0] < 2 for c in got) and len(got) <= (310 if levels else 300)


def test_no_link_of_large_mixed_buckets_is_missed(spark, monkeypatch):
    """Pairs similar by 0.83 among texts at 0.77, and families of texts with shingles left out, in overlapping buckets."""
    monkeypatch.setattr(near_dup, "WHOLE_TEXTS", 16)
    rng, sets = np.random.default_rng(9), []
    for k in range(60):
        own = 10**6 * (k + 1) + np.arange(6)
        sets += [np.r_[np.arange(150), own, own[0] + 100 * (t + 1) + np.arange(16)] for t in range(2)]
    for k in range(20):
        parent = rng.permutation(150)[:125]
        sets += [rng.permutation(parent)[: 125 - rng.integers(0, 25)] for _ in range(3)]
    sets = [np.unique(x.astype(np.uint32)) for x in sets]
    texts = spark.createDataFrame([(k, i, i, x.nbytes, x.tobytes()) for i, x in enumerate(sets) for k in (0, 1 + i % 8 // 4)], "key long, row_id long, root long, size int, x binary")
    found = {(r["a"], r["b"]) for r in near_dup.missed_links(texts, 0.8).collect()}
    size = lambda i, j: len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    similar = {(i, j) for j in range(len(sets)) for i in range(j) if (both := size(i, j)) >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9}

    def joined(links):
        roots = list(range(len(sets)))
        for a, b in links:
            roots = [roots[a] if r == roots[b] else r for r in roots]
        return {frozenset(i for i, r in enumerate(roots) if r == x) for x in roots}

    assert found <= similar and joined(found) == joined(similar) and {(2 * k, 2 * k + 1) for k in range(60)} <= found


def test_recall_of_links_in_a_large_mixed_bucket(spark, monkeypatch):
    """Families of texts edited from one base, with edits of their own: many similar pairs, more just under the threshold."""
    monkeypatch.setattr(near_dup, "WHOLE_TEXTS", 64)
    rng, base, rows = np.random.default_rng(8), [f"w{i}" for i in range(200)], []
    for family in range(200):
        parent = base.copy()
        for i in rng.choice(200, 5, replace=False):
            parent[i] = f"f{family}x{i}"
        for child in range(5):
            text = parent.copy()
            for i in rng.choice(200, int(rng.integers(0, 4)), replace=False):
                text[i] = f"c{family}x{child}x{i}"
            rows.append((len(rows), " ".join(text)))
    got, expected = found_classes(near_dup.near_duplicates(spark.createDataFrame(rows, EMPTY).repartition(4))), brute_classes(rows)
    joined = lambda classes: sum(len(c) - 1 for c in classes)  # noqa: E731  links of spanning trees
    assert len(expected) > 20 and joined(got) >= 0.98 * joined(expected)


def test_classes_do_not_depend_on_partitions(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(1000 - k, " ".join([*base[: 7 * k % 100], *(f"v{k % 40}x{i}" for i in range(k % 7)), *base[7 * k % 100 :]])) for k in range(200)]
    frame = spark.createDataFrame([*rows, *rows[:20]], EMPTY)
    got = [sorted(tuple(r) for r in near_dup.classes(frame.repartition(n)).collect()) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 220


def test_one_row_of_equal_ids_and_texts_stays(spark):
    rows = [(1, "same text here", "b"), (1, "same text here", "a"), (1, "another one of them", "c"), (None, "same text here", "0")]
    docs = spark.createDataFrame(rows, EMPTY + ", root string")
    for n in (1, 3):
        assert sorted(tuple(r) for r in near_dup.keep_one(docs.repartition(n)).collect()) == [(1, "another one of them", "c"), (1, "same text here", "a")]


def test_large_group_of_near_copies_is_one_class(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[: k % 200], f"v{k}", *base[k % 200 :]])) for k in range(600)]
    got = near_dup.classes(spark.createDataFrame(rows, EMPTY)).select("class_id").distinct().count()
    assert got == 1


def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    ids = near_dup.mixed(rng.integers(0, 2**62, 300).astype(np.uint64))
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    a[:100], b[200:] = 0, 0
    both = np.flatnonzero((a > 0) & (b > 0))
    expected = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    x, y = a > 0, b > 0
    sign = near_dup.prob_min_hash(np.r_[ids[x], ids[y]], np.r_[a[x], b[y]], np.r_[np.zeros(x.sum(), int), np.ones(y.sum(), int)], 2, 4096)
    assert abs((sign[0] == sign[1]).mean() - expected) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 140))


# -- packing --------------------------------------------------------------------------------------------

HARD = ["Hello, World!!", "it's THEY'LL 've 12 3½ x²", "naïve İstanbul ǅ ß ÿ Ÿ", "e\u0301 a\u0308b", "a\u00a0b\u2003c\u3000d\x85e\x1cf\x0bg", "<|endoftext|> x<|startoftext|>y", "日本語 テキスト ١٢٣", "😀😀 a😀b", "\u0000\u0001 x", "ΑΣ ΣΑΣ", "don't'sss '' 'S 'LL", ""]


def test_ids_are_the_tokenizers_own(spark, small):
    pieces = Pieces(word_bpe_path())
    texts = HARD + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    for text in texts:
        assert np.frombuffer(pieces.encode(text.encode()), "<u4").tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB's \t\x0b\x85\u00a0é½İ1,<|>'\u0301ΣА中"), max_size=30))
def test_ids_of_any_text(text):
    pieces = PIECES.setdefault("p", Pieces(word_bpe_path()))
    assert np.frombuffer(pieces.encode(text.encode()), "<u4").tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids


PIECES: dict = {}


def test_packing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 5000), (-4, "x")], EMPTY)
    docs = docs.unionByName(odd).withColumn("offset", F.lit("clash"))
    pieces, parts, sequences = Pieces(word_bpe_path()), defaultdict(list), defaultdict(list)
    rows = packing.pack_documents(docs, word_bpe_path()).collect()
    for r in rows:
        parts[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc in docs.collect():
        ids, at = [*np.frombuffer(pieces.encode((doc["text"] or "").encode()), "<u4").tolist(), 1], 0
        for r in sorted(parts[doc["doc_id"]], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part)) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.02 * sum(r["length"] for r in rows) + 2048 * docs.rdd.getNumPartitions()
    steps = defaultdict(dict)
    for r in rows:
        steps[r["step_group"]][r["sequence_id"]] = r["tier"]
    assert all(sum(x.values()) <= 65536 and len(set(x.values())) == 1 for x in steps.values())
    assert packing.pack_documents(docs.limit(0), word_bpe_path()).count() == 0


def test_packed_ids_and_whole_step_groups(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").repartition(3)
    rows, pieces = packing.pack_documents(docs, word_bpe_path(), step_tokens=4096).collect(), Pieces(word_bpe_path())
    parts, groups = defaultdict(list), defaultdict(dict)
    for r in sorted(rows, key=lambda r: r["start"]):
        parts[r["doc_id"]].append(bytes(r["ids"]))
        groups[r["tier"], r["step_group"]][r["sequence_id"]] = r["tier"]
    assert all(b"".join(parts[d["doc_id"]]) == pieces.encode((d["text"] or "").encode()) + b"\1\0\0\0" for d in docs.collect())
    assert len({g for _, g in groups}) == len(groups)
    short = Counter(tier for (tier, _), found in groups.items() if sum(found.values()) < 4096)
    assert max(short.values()) == 1


# -- language model -------------------------------------------------------------------------------------

SMALL_MODEL = lm.Settings(states=3, own=50, kinds=16, hot=200, rounds=2, start_pieces=50, start_rounds=3)


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low(text or "")) if w] + ["\0"]


def test_base_scores_and_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Ab\x0bAB\x1cé\u00a0x\x85"), (None, "no id")], EMPTY)).withColumn("score", F.lit("clash"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2 and i is not None
    counts = Counter(w for i, t in texts.items() if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for s in (SMALL_MODEL, lm.Settings(states=2, rounds=1, start_rounds=2)):
        rows = lm.score_documents(docs, s).collect()
        assert len(rows) == len(texts)
        for r in rows:
            t = tokens(texts[r["doc_id"]])
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(t), sum(counts[w] > 0 for w in t), n)
            assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score_documents(docs.limit(0), SMALL_MODEL).count() == 0
    alone = lm.score_documents(docs.where("doc_id = 2 OR doc_id = 5").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2), SMALL_MODEL)
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in alone.collect())


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(3)
    normal = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = lm.Model(normal(rng.random(3)), normal(rng.random(3)), normal(rng.random((3, 3))), normal(rng.random((3, 7))).T)
    texts = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 5, 700, 5)]
    for x, got in zip(texts, lm.log_probabilities(model, [t.tobytes() for t in texts]), strict=True):
        p, total = None, 0.0
        for s in x:
            p = (model.start if p is None else p @ model.move) * model.emit[s]
            total += math.log10(p.sum())
            p = p / p.sum()
        assert math.isclose(got, total, rel_tol=1e-9)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(4)
    texts = [np.repeat(rng.integers(0, 3, 6), 20).astype(np.uint16).tobytes() for _ in range(60)]
    s = lm.Settings(states=3, own=2, kinds=2, start_rounds=0, prior=0.01)
    model, logs = lm.first_model(s, texts), []
    for _ in range(8):
        counts = lm.Counts(s.states, s.symbols)
        counts.add(model, texts, 64)
        logs.append(counts.log)
        assert math.isclose(counts.emit.sum(), 60 * 120, rel_tol=1e-9)
        model = counts.model(model, s.prior)
    assert all(b > a - 1 for a, b in zip(logs, logs[1:], strict=False)) and logs[-1] > logs[0]


# -- top-k ----------------------------------------------------------------------------------------------


def brute_top(rows, k):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, queries = [], {}
    for i, v in whole:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in whole if j != q)[:k]
        out += [(q, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=6 if i % 13 else 4) * (1e6 if i == 77 else 1)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 420)]
    rows += [(500, None), (501, [1.0, None]), (550, [float("nan")] * 6), (551, [float("inf")] * 6), (None, [1.0] * 6), (600, []), (3, rows[3][1]), (50, rows[60][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, q string").repartition(7)
    got = sorted(tuple(r) for r in topk.top_k(topk.whole_vectors(frame), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 5)
    few = topk.top_k(topk.whole_vectors(frame.where("vec_id in (0, 1, 2)")), F.col("vec_id") % 50 == 0)
    assert few.count() == 2
    assert topk.top_k(topk.whole_vectors(frame.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 3 * 5 * 8)
    monkeypatch.setattr(topk, "SCORES", 40)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(topk.whole_vectors(frame), F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows, 5)


def test_scores_beyond_64_bits_are_refused(spark):
    frame = spark.createDataFrame([(0, [2.0**60, 1.0]), (1, [1.0, 2.0**60])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(topk.whole_vectors(frame), F.col("vec_id") % 50 == 0)


def test_long_and_repeated_items(spark):
    """Items longer than a stretch, and very often repeated ones, are found whole."""
    rng = np.random.default_rng(9)
    long = [f"w{i}" for i in rng.integers(0, 400, 300)]
    items = spark.createDataFrame([(1, " ".join(long))] + [(2, "a b c d e f g h i j k")] * 500 + [(3, "few words")], "item_id long, text string")
    texts = [" ".join(long), " ".join(long[35:60]), "x a b c d e f g h i j y", "few words", " ".join(long[100:109]), " ".join(reversed(long))]
    docs = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    expected = brute_hits(texts, [(1, " ".join(long)), (2, "a b c d e f g h i j k"), (3, "few words")], 10)
    for stretch in (12, 50, 1000):
        got = decontaminate.find_hits(docs, items, block_bytes=700, stretch=stretch).orderBy("doc_id").collect()
        assert [(r["n_words"], sum(h["last"] - h["first"] + 1 for h in r["hits"]), [int(i) for i in r["items"]]) for r in got] == expected
    assert decontaminate.stretches(items, 10, 1000).count() == 3


def test_expected_counts_against_all_paths():
    rng = np.random.default_rng(6)
    normal = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = lm.Model(normal(rng.random(3)), normal(rng.random(3)), normal(rng.random((3, 3))), normal(rng.random((3, 5))).T)
    texts, begins = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 7, 6)], [True, False, True, False]
    counts = lm.Counts(3, 5)
    counts.add(model, [t.tobytes() for t in texts], 4, begins)
    expected = lm.Counts(3, 5)
    for text, first in zip(texts, begins, strict=True):
        for at in range(0, len(text), 4):
            x, start = text[at : at + 4], model.start if first and at == 0 else model.inside
            paths = list(itertools.product(range(3), repeat=len(x)))
            p = np.array([start[q[0]] * np.prod([model.move[a, b] for a, b in itertools.pairwise(q)]) * np.prod([model.emit[s, k] for s, k in zip(x, q, strict=True)]) for q in paths])
            expected.log += np.log10(p.sum())
            for q, w in zip(paths, p / p.sum(), strict=True):
                (expected.start if first and at == 0 else expected.inside)[q[0]] += w
                for a, b in itertools.pairwise(q):
                    expected.move[a, b] += w
                for s, k in zip(x, q, strict=True):
                    expected.emit[s, k] += w
    assert np.allclose(counts.start, expected.start) and np.allclose(counts.inside, expected.inside) and np.isclose(counts.log, expected.log)
    assert np.allclose(counts.move * model.move, expected.move) and np.allclose(counts.emit, expected.emit)


def test_starting_pieces_come_from_long_texts_too(spark):
    s = lm.Settings(piece=4, start_pieces=60)
    rows = [(i, n, np.arange(n, dtype=np.uint16).tobytes()) for i, n in enumerate([1, 4, 5, 2000])]
    got = lm.start_sample(spark.createDataFrame(rows, "row_id long, n_tokens long, symbols binary"), s).collect()
    assert 30 < len(got) < 100 and sum(r["row_id"] == 3 for r in got) > 25
    for r in got:
        assert np.frombuffer(r["symbols"], np.uint16).tolist() == list(range(rows[r["row_id"]][1]))[4 * r["at"] : 4 * r["at"] + 4]
    every = lm.start_sample(spark.createDataFrame(rows[:3], "row_id long, n_tokens long, symbols binary"), s)
    assert sorted((r["row_id"], r["at"]) for r in every.collect()) == [(0, 0), (1, 0), (2, 0), (2, 1)]


def test_long_words_and_repeated_rows_of_the_language_model(spark):
    texts = {1: "a b " * 3000 + "w" * 500_000, 2: "w" * 500_000, 3: "a", 4: ""}
    docs = spark.createDataFrame([*texts.items(), (3, "a"), (3, "a")], EMPTY)
    rows = lm.score_documents(docs, lm.Settings(states=2, rounds=1, start_rounds=2, hot=2)).collect()
    assert len(rows) == 6 and len({tuple(r) for r in rows if r["doc_id"] == 3}) == 1
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    seen = Counter(w for i in [*texts, 3, 3] if not out(i) for w in tokens(texts[i]))
    n, v = sum(seen.values()), len(seen)
    for r in rows:
        assert math.isclose(r["base_score"], sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(texts[r["doc_id"]])), rel_tol=1e-9)


def test_language_model_learns_from_every_training_row(spark, small, monkeypatch):
    """The model is what as many rounds over all training texts make in one process; no sample decides where they begin."""
    s, seen = dataclasses.replace(SMALL_MODEL, start_pieces=5), {}

    def train(encoded, settings, overall):
        rows = encoded.where("not held_out").select("symbols").collect()
        seen.update(texts=[bytes(r["symbols"]) for r in rows], overall=overall, model=trained(encoded, settings, overall))
        return seen["model"]

    trained = lm.train
    monkeypatch.setattr(lm, "train", train)
    lm.score_documents(spark.read.parquet(f"{small}/documents.parquet"), s)
    assert (seen["overall"] == np.bincount(np.frombuffer(b"".join(seen["texts"]), np.uint16), minlength=s.symbols)).all()
    model = lm.first_guess(s, seen["overall"])
    for _ in range(s.rounds):
        counts = lm.Counts(s.states, s.symbols)
        counts.add(model, seen["texts"], s.piece)
        model = counts.model(model, s.prior)
    for name in ("start", "inside", "move", "emit"):
        assert np.allclose(getattr(model, name), getattr(seen["model"], name), rtol=1e-6, atol=1e-12)
