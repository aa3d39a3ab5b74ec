"""Benchmark decontamination with a generalised suffix automaton over the items' words.

The automaton of all items is built once and broadcast; documents stream past it.  At each word it holds
the longest match that ends there, so a window of an item ends at the word exactly if that match is as
long as the window.  Items are taken in blocks of `block_bytes` of text, the bound of what is broadcast;
further blocks are further passes over the documents, each written before the next.  What a pass finds is
used in the same Python worker: every further Python step of a stage would start one more worker a core, and
executors keep them for the stages that follow.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, Shared, bounded_arrow_batches, discard, raw_bytes, written

Batches = Iterator[pa.RecordBatch]
WORD_BYTES = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")
FOUND = "n_words long, hits array<struct<first:int,last:int>>, items array<string>, longest int"
FOUND_TYPES = {
    "n_words": pa.int64(),
    "hits": pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])),
    "items": pa.list_(pa.string()),
    "longest": pa.int32(),
}


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the windows that end in each state.

    A window is `window` consecutive words of an item; an item of fewer words is one window.  Once built it is kept
    in arrays, as each worker holds it: a state's words are codes[starts[v] : starts[v + 1]], ascending, and lead to the
    states in `targets`; ends[v] is the place in `groups` of the items with a full window there, or -1.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            if words:
                coded.append((name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self.extend(last, c)
        self.shortest = min((min(window, len(c)) for _, c in coded), default=1)
        self.windows: dict[int, set[str]] = {}  # state of a full window -> items
        self.whole: dict[int, list[tuple[int, str]]] = {}  # state -> whole items under the window's length
        for name, codes in coded:
            self.register(name, codes)
        self.above = array("i", self.nearest_whole())
        self.flatten()
        self.pairs = np.zeros(1 << 22, dtype=bool)
        for _, codes in coded:
            x = np.array(codes, dtype=np.int64)
            self.pairs[self.slot(x[:-1], x[1:])] = True

    def extend(self, last: int, c: int) -> int:
        """One more word after state `last`, as in any suffix automaton; a word already there is shared."""
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self.split(last, c, q)
        new = self.state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, c, q)
        return new

    def state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def split(self, p: int, c: int, q: int) -> int:
        clone = self.state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def register(self, name: str, codes: list[int]) -> None:
        size, v = min(self.window, len(codes)), 0
        for i, c in enumerate(codes):
            v = self.next[v][c]
            v = self.holder(v, min(size, i + 1))
            if i + 1 >= size:
                if size == self.window:
                    self.windows.setdefault(v, set()).add(name)
                else:
                    self.whole.setdefault(v, []).append((size, name))

    def holder(self, v: int, size: int) -> int:
        """The state that holds the suffix of `size` words."""
        while self.length[self.link[v]] >= size:
            v = self.link[v]
        return v

    def nearest_whole(self) -> list[int]:
        """For each state the nearest one, itself or up the suffix links, where a whole short item ends."""
        out = [-1] * len(self.next)
        if self.whole:
            for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                out[v] = v if v in self.whole else out[self.link[v]]
        return out

    def flatten(self) -> None:
        """Arrays instead of the lists, dictionaries and sets that building took."""
        self.starts = array("i", accumulate(map(len, self.next), initial=0))
        self.codes = array("i", (c for x in self.next for c in sorted(x)))
        self.targets = array("i", (x[c] for x in self.next for c in sorted(x)))
        self.link, self.length = array("i", self.link), array("i", self.length)
        places: dict[frozenset[str], int] = {}
        self.ends = array("i", [-1]) * len(self.next)
        for v, names in self.windows.items():
            self.ends[v] = places.setdefault(frozenset(names), len(places))
        self.groups = list(places)
        del self.next, self.windows

    def coded(self, words: list[bytes]) -> np.ndarray:
        """-1 for words that no item has."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7919) & (len(self.pairs) - 1)

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches that can hold a window: no match crosses an unknown word or a pair of words no item has."""
        known = codes >= 0
        if self.shortest == 1:
            joined = known[:-1] & known[1:]
        else:
            joined = known[:-1] & known[1:] & self.pairs[self.slot(codes[:-1], codes[1:])]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2] + 1  # words [start, end)
        long = ends - starts >= self.shortest
        yield from zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        if self.shortest == 1:
            alone = known.copy()
            alone[:-1] &= ~joined
            alone[1:] &= ~joined
            yield from ((i, i + 1) for i in np.flatnonzero(alone).tolist())

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int, int, frozenset[str] | set[str]]]:
        """(position, window's length, longest match, items) of each window's end."""
        v, matched, window = 0, 0, self.window
        starts, known, link, length = self.starts, self.codes, self.link, self.length
        for i, c in enumerate(codes):
            at, end = bisect_left(known, c, starts[v], starts[v + 1]), starts[v + 1]
            while v and (at == end or known[at] != c):
                v = link[v]
                matched = length[v]
                at, end = bisect_left(known, c, starts[v], starts[v + 1]), starts[v + 1]
            if at == end or known[at] != c:
                continue
            v = self.targets[at]
            matched += 1
            if matched >= window:
                group = self.ends[self.holder(v, window)]
                if group >= 0:
                    yield i, window, matched, self.groups[group]
            u = self.above[v]
            while u > 0:
                for size, name in self.whole[u]:
                    if size <= matched:
                        yield i, size, matched, {name}
                u = self.above[link[u]]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def scan(automaton, before: bool):
    """A mapInArrow function: adds the columns of FOUND, or joins its findings to those of earlier passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemAutomaton = automaton.value
        for batch in batches:
            texts = [items.coded(words_of(t)) for t in raw_bytes(batch.column("text"))]  # no more than one text's words are held
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            begin = np.concatenate(([0], np.cumsum(sizes + 1)))  # one unknown word parts the texts
            codes = np.full(begin[-1], -1, dtype=np.int64)
            for at, text in zip(begin.tolist(), texts, strict=False):
                codes[at : at + len(text)] = text
            hits: list[list] = [[] for _ in texts]
            names: list[set] = [set() for _ in texts]
            longest = [0] * len(texts)
            if before:
                hits = [[(h["first"], h["last"]) for h in x] for x in batch.column("hits").to_pylist()]
                names = [set(x) for x in batch.column("items").to_pylist()]
                longest = batch.column("longest").to_pylist()
            for start, end in items.candidates(codes):
                doc = int(np.searchsorted(begin, start, side="right")) - 1
                at = start - int(begin[doc])
                for i, size, matched, found in items.stream(codes[start:end].tolist()):
                    hits[doc].append((at + i - size + 1, at + i))
                    names[doc] |= found
                    longest[doc] = max(longest[doc], matched)
            found = {
                "n_words": sizes.tolist(),
                "hits": [[{"first": a, "last": b} for a, b in merged(x)] for x in hits],
                "items": [sorted(x) for x in names],
                "longest": longest,
            }
            kept = [n for n in batch.schema.names if n not in FOUND_TYPES]
            arrays = [batch.column(n) for n in kept] + [pa.array(found[n], type=t) for n, t in FOUND_TYPES.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *FOUND_TYPES])

    return run


def stretches(items: DataFrame, window: int, words: int) -> DataFrame:
    """item and text of the distinct items; those of over `words` words as stretches that overlap by window - 1 words.

    So every window of an item is in a stretch, and no row is longer than a block can hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                found = words_of(text)
                step = max(1, words - window + 1)
                parts = [b" ".join(found[i : i + words]) for i in range(0, max(1, len(found) - window + 1), step)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.binary())], names=["item", "words"])

    named = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item"), F.coalesce(items["text"], F.lit("")).alias("text"))
    return named.mapInArrow(run, "item string, words binary").distinct()


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 2 << 20, stretch: int = 8192, use: Callable[[Batches], Batches] | None = None) -> DataFrame:
    """`docs` (with a text column) and the columns of FOUND.

    hits: merged spans of word positions, first to last, that lie in an occurrence of some window; items:
    ids as text, sorted, of the items with such a window; longest: the longest match of any hit.  Null
    texts have no words.  An item without words, or null, has no window; repeated items count once; a
    null item id reads ''.  Without items nothing is hit.  Columns named like FOUND's are replaced.  A match
    counts within a stretch of `stretch` words of a longer item.  With `use` the last pass gives its batches to that
    function, which returns batches of docs' columns without FOUND's; so has the result.
    """
    spark = docs.sparkSession
    bounded_arrow_batches(spark)
    kept = [c for c in docs.columns if c not in FOUND_TYPES]
    docs = docs.select(*kept)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shape = own + ", " + FOUND
    named = written(stretches(items, window, stretch), "items")
    total = named.agg(F.sum(F.octet_length("words")).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect()
        automaton = ItemAutomaton(sorted((r["item"], bytes(r["words"]).split()) for r in rows), window)
        run = scan(Shared(spark, automaton), b > 0)
        if b + 1 < blocks:
            docs = written(docs.mapInArrow(run, shape), "hits")
        elif use:
            docs = docs.mapInArrow(lambda batches, run=run: use(run(batches)), own)
        else:
            docs = docs.mapInArrow(run, shape)
    discard(named)
    return docs


def hit_words(hits) -> F.Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row a document: how many of its words lie in items' windows, and in which items'."""
    found = find_hits(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), items, window)
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        "longest",
    )


def cut_spans(max_coverage: float) -> Callable[[Batches], Batches]:
    """For find_hits: texts without the words of `hits` and what stands between them; rows with more than a share of hit words go."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            every = batch.column("hits").to_pylist()
            under = [sum(h["last"] - h["first"] + 1 for h in hits) <= n * max_coverage for hits, n in zip(every, batch.column("n_words").to_pylist(), strict=True)]
            texts, nulls = raw_bytes(batch.column("text")), batch.column("text").is_null().to_pylist()
            cut = (without(t, hits) if hits and kept else t for t, hits, kept in zip(texts, every, under, strict=True))
            out = [None if null else t.decode("utf-8", "replace") for t, null in zip(cut, nulls, strict=True)]
            names = [n for n in batch.schema.names if n not in FOUND_TYPES]
            rows = pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)
            yield rows.filter(pa.array(under, pa.bool_()))

    return run


def without(text: bytes, hits: list[dict[str, int]]) -> bytes:
    places = [m.span() for m in WORD_BYTES.finditer(text)]
    kept, at = [], 0
    for h in hits:
        kept.append(text[at : places[h["first"]][0]])
        at = places[h["last"]][1]
    return b"".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, **options) -> DataFrame:
    """`docs` without the passages they share with items: every hit span of `window` words or more (or a whole
    shorter item) is cut out of the text, and a document is dropped if hits cover over `max_coverage` of its
    words.  Documents without hits stay as they are, null and empty texts, repeated rows and null ids too.  An
    empty table of documents gives no rows, one of items leaves all documents alone.  `options` are find_hits's."""
    return find_hits(docs, items, window, use=cut_spans(max_coverage), **options)
