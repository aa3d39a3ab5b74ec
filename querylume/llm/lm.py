"""A hidden Markov language model over word classes, trained by Baum-Welch, scored by the forward recursion.

Tokens are a text's lower-cased words and one end.  The HMM emits symbols: the end, each of the `own` most
frequent words, and for all other words one of `kinds` spelling classes.  Within a class a word has
probability (count + 1) / (class's tokens + class's distinct words + 1), so an unseen word has its share.

Word counts, the first guess, every Baum-Welch round and scores cover all training rows.  Counts are pre-aggregated in each task
and summed by Spark.  The `hot` most frequent words, a fixed number, are broadcast with their counts;
all other words of a text meet their counts in a join, so no vocabulary has to fit into one process.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, bounded_arrow_batches, is_held_out, raw_bytes, written
from .labelled import hashed_share

#: Stands for the end of a text; no word is empty.
END = b""


@dataclass(frozen=True)
class Settings:
    states: int = 8
    own: int = 4096  # words with a symbol of their own
    kinds: int = 2048  # spelling classes of the others
    hot: int = 200_000  # words broadcast with their counts, of hot_bytes at most each
    hot_bytes: int = 64
    rounds: int = 8  # Baum-Welch rounds, each over all training rows
    piece: int = 128  # tokens; training cuts texts into sequences of at most so many
    start_pieces: int = 4000  # of start_sample() and first_model(), which train() does without
    start_rounds: int = 12
    prior: float = 20.0  # tokens of the overall symbol distribution added to each state
    seed: int = 11

    @property
    def symbols(self) -> int:
        return 1 + self.own + self.kinds


def kind_of(word: bytes, kinds: int) -> int:
    """Spelling class: by the first two and last three bytes."""
    return zlib.crc32(word[:2] + b" " + word[-3:]) % kinds


def tokens(text: bytes) -> list[bytes]:
    """bytes.lower() changes A-Z only, and bytes.split() parts at space and \\x09-\\x0D."""
    return text.lower().split()


def counter(kinds: int, limit: int = 400_000):
    """A mapInArrow function (text) -> word, kind, n: counted within the task, handed on when many are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = list(seen)
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([-1 if w == END else kind_of(w, kinds) for w in words], pa.int32()), pa.array(seen.values(), pa.int64())],
                names=["word", "kind", "n"],
            )
            seen.clear()
            return out

        for batch in batches:
            for text in raw_bytes(batch.column(0)):
                seen.update(tokens(text))
            seen[END] += batch.num_rows
            if len(seen) > limit:
                yield rows()
        yield rows()

    return run


class Vocabulary:
    """What the encoder broadcasts: hot words, and every class's denominator.  Its size is fixed by Settings."""

    def __init__(self, hot: list[tuple[bytes, int, int]], kinds: dict[int, tuple[int, int]], s: Settings):
        """hot: (word, kind, count), most frequent first; kinds: tokens and distinct words of each class."""
        self.place = {w: i for i, (w, _, _) in enumerate(hot)}
        counts = np.array([c for _, _, c in hot], dtype=np.float64)
        left = np.zeros((s.kinds, 2))
        for k, x in kinds.items():
            left[k] = x
        ranked = [i for i, (w, _, _) in enumerate(hot) if w != END][: s.own]
        self.symbol = np.array([0 if w == END else 1 + s.own + k for w, k, _ in hot], dtype=np.uint16)
        for symbol, i in enumerate(ranked, start=1):
            self.symbol[i] = symbol
            left[hot[i][1]] -= (hot[i][2], 1)
        self.overall = np.concatenate([np.zeros(1 + s.own), left[:, 0]])  # training tokens of each symbol
        for symbol, c in zip(self.symbol, counts, strict=True):
            if symbol <= s.own:
                self.overall[symbol] = c
        self.log_kind = np.log10(left.sum(axis=1) + 1)
        self.log_count = np.log10(counts + 1)
        in_kind = self.symbol > s.own
        kind = np.where(in_kind, self.symbol.astype(np.int64) - 1 - s.own, 0)
        self.log_within = np.where(in_kind, self.log_count - self.log_kind[kind], 0.0)


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_hot long, log_hot double, log_within double, symbols binary, cold array<binary>, cold_n array<int>"


def encoder(vocabulary, s: Settings):
    """A mapInArrow function (doc_id, held_out, text) -> ENCODED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        end = v.place.get(END, -1)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in raw_bytes(batch.column(2)):
                words = tokens(text)
                place = np.empty(len(words) + 1, dtype=np.int64)
                place[:-1] = np.fromiter(map(v.place.get, words, repeat(-1)), np.int64, len(words))
                place[-1] = end
                known = place >= 0
                hot = place[known]
                symbols = np.zeros(len(place), dtype=np.uint16)
                symbols[known] = v.symbol[hot]
                cold = [words[i] for i in np.flatnonzero(~known[:-1])]
                kinds = np.fromiter((kind_of(w, s.kinds) for w in cold), np.int64, len(cold))
                symbols[:-1][~known[:-1]] = 1 + s.own + kinds
                counted = Counter(cold)
                row = (len(place), len(hot), float(v.log_count[hot].sum()), float(v.log_within[hot].sum() - v.log_kind[kinds].sum()), symbols.tobytes(), list(counted), list(counted.values()))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, type=t) for c, t in zip(out, types, strict=True))], names=[x.split()[0] for x in ENCODED.split(", ")])

    return run


@dataclass
class Model:
    start: np.ndarray  # at the beginning of a text
    inside: np.ndarray  # at the beginning of a later piece, in training only
    move: np.ndarray  # (state, next state)
    emit: np.ndarray  # (symbol, state)


def pieces_of(symbols: list[bytes], size: int, begins: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as rows of at most `size` symbols, longest first: (rows, lengths, whether a row begins its text).

    `begins` tells of each of `symbols` whether it is the beginning of a text; all are, if it is not given.
    """
    parts = [np.frombuffer(x, np.uint16) for x in symbols]
    cut = [(p[i : i + size], i == 0 and b) for p, b in zip(parts, begins or [True] * len(parts), strict=True) for i in range(0, len(p), size)]
    cut.sort(key=lambda x: -len(x[0]))
    rows = np.zeros((len(cut), max((len(x) for x, _ in cut), default=0)), dtype=np.uint16)
    for i, (x, _) in enumerate(cut):
        rows[i, : len(x)] = x
    return rows, np.array([len(x) for x, _ in cut], dtype=np.int64), np.array([b for _, b in cut], dtype=bool)


class Counts:
    """Expected counts of one Baum-Welch round."""

    def __init__(self, states: int, symbols: int):
        self.start, self.inside = np.zeros(states), np.zeros(states)
        self.move, self.emit, self.log = np.zeros((states, states)), np.zeros((symbols, states)), 0.0

    def add(self, model: Model, symbols: list[bytes], size: int, begins: list[bool] | None = None) -> None:
        rows, lengths, begins = pieces_of(symbols, size, begins)
        if not len(rows):
            return
        states, steps = len(model.start), rows.shape[1]
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows longer than t
        forward, scale = [], []
        a = np.where(begins[:, None], model.start, model.inside) * model.emit[rows[:, 0]]
        for t in range(steps):
            if t:
                a = (forward[-1][: active[t]] @ model.move) * model.emit[rows[: active[t], t]]
            c = a.sum(axis=1, keepdims=True)
            forward.append(a / c)
            scale.append(c)
            self.log += float(np.log10(c).sum())
        back = np.ones((active[-1], states))
        posterior = []
        for t in range(steps - 1, -1, -1):
            if active[t] > len(back):
                back = np.concatenate([back, np.ones((active[t] - len(back), states))])
            posterior.append(forward[t] * back)
            if t:
                seen = model.emit[rows[: active[t], t]] * back / scale[t]
                self.move += forward[t - 1][: active[t]].T @ seen
                back = seen @ model.move.T
        first = posterior[-1]
        self.start += first[begins].sum(axis=0)
        self.inside += first[~begins].sum(axis=0)
        posterior.reverse()
        flat = np.concatenate([rows[: active[t], t] for t in range(steps)]).astype(np.int64)
        weight = np.concatenate(posterior)
        for k in range(states):
            self.emit[:, k] += np.bincount(flat, weights=weight[:, k], minlength=len(self.emit))

    def model(self, model: Model, prior: float) -> Model:
        """The re-estimated model; move counts still lack the old model's factor."""
        move = self.move * model.move + 0.1
        overall = (self.emit.sum(axis=1) + 1) / (self.emit.sum() + len(self.emit))
        emit = self.emit + prior * overall[:, None]
        normal = lambda x: (x + 0.1) / (x + 0.1).sum()
        return Model(normal(self.start), normal(self.inside), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_guess(s: Settings, overall: np.ndarray) -> Model:
    """The point that the rounds set out from: each symbol's count in all training texts, but for a fixed disturbance by state."""
    rng = np.random.default_rng(s.seed)
    emit = (overall + 0.1)[:, None] * rng.uniform(0.5, 1.5, (s.symbols, s.states))
    move = np.full((s.states, s.states), 0.2 / s.states) + 0.8 * np.eye(s.states)
    flat = np.full(s.states, 1 / s.states)
    return Model(flat, flat, move, emit / emit.sum(axis=0))


def first_model(s: Settings, symbols: list[bytes], begins: list[bool] | None = None) -> Model:
    """A model fitted on a few texts in one process."""
    model = first_guess(s, np.bincount(np.frombuffer(b"".join(symbols), np.uint16), minlength=s.symbols))
    for _ in range(s.start_rounds):
        counts = Counts(s.states, s.symbols)
        counts.add(model, symbols, s.piece, begins)
        model = counts.model(model, s.prior)
    return model


def expectation(model, s: Settings):
    """A mapInArrow function (symbols) -> place, values: the task's Baum-Welch counts, a row for each symbol.

    Places from s.symbols on hold the start, inside and move counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(s.states, s.symbols)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                counts.add(model.value, batch.column(0).slice(at, 500).to_pylist(), s.piece)
        rows = np.concatenate([counts.emit, [counts.start], [counts.inside], counts.move])
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(rows[used, k]) for k in range(s.states))], names=["place", *(f"s{k}" for k in range(s.states))])

    return run


def start_sample(rows: DataFrame, s: Settings) -> DataFrame:
    """row_id, at and symbols of about `start_pieces` pieces of at most s.piece tokens.

    Every piece of every text has the same chance, by a hash, so long texts count by their length.
    """
    pieces = F.ceil(F.col("n_tokens") / s.piece)
    total = rows.agg(F.sum(pieces).alias("n")).first()["n"] or 0
    each = rows.select("row_id", "symbols", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))).alias("at"))
    drawn = each.where(hashed_share(F.struct("row_id", "at"), s.start_pieces, total, s.seed))
    width = 2 * s.piece  # two bytes a symbol
    return drawn.select("row_id", "at", F.substring("symbols", F.col("at") * width + 1, F.lit(width)).alias("symbols"))


def train(encoded: DataFrame, s: Settings, overall: np.ndarray) -> Model:
    """The model after `rounds` rounds over all training rows; `overall` are their tokens of each symbol."""
    spark = encoded.sparkSession
    rows = encoded.where("not held_out")
    model = first_guess(s, overall)
    names = [f"s{k}" for k in range(s.states)]
    for _ in range(s.rounds):
        shape = "place long, " + ", ".join(f"{n} double" for n in names)
        told = rows.select("symbols").mapInArrow(expectation(Shared(spark, model), s), shape)
        total = told.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).collect()  # as many rows as symbols, at most
        counts = Counts(s.states, s.symbols)
        table = np.zeros((s.symbols + 2 + s.states, s.states))
        for r in total:
            table[r["place"]] = r[1:]
        counts.emit, counts.start, counts.inside, counts.move = table[: s.symbols], table[s.symbols], table[s.symbols + 1], table[s.symbols + 2 :]
        model = counts.model(model, s.prior)
    return model


def log_probabilities(model: Model, symbols: list[bytes]) -> np.ndarray:
    """log10 probability of each whole sequence by the scaled forward recursion."""
    parts = [np.frombuffer(x, np.uint16) for x in symbols]
    order = np.array(sorted(range(len(parts)), key=lambda i: -len(parts[i])), dtype=np.int64)
    lengths = np.array([len(parts[i]) for i in order])
    out = np.zeros(len(parts))
    a = None
    for t in range(lengths[0] if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        if t % 256 == 0:  # symbols of the next steps, a column a step
            block = np.zeros((256, n), dtype=np.uint16)
            for i in range(n):
                x = parts[order[i]][t : t + 256]
                block[: len(x), i] = x
        a = (model.start if a is None else a[:n] @ model.move) * model.emit[block[t % 256, :n]]
        c = a.sum(axis=1)
        a /= c[:, None]
        out[order[:n]] += np.log10(c)
    return out


def scorer(model):
    """A mapInArrow function: (row_id, symbols) -> (row_id, log_symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log_probabilities(model.value, batch.column(1).to_pylist()))], names=["row_id", "log_symbols"])

    return run


def hot_words(counts: DataFrame, most: int, longest: int) -> list[tuple[bytes, int, int]]:
    """(word, kind, count) of the end and the words at or above a count that at most `most` words reach, most frequent first.

    Words of over `longest` bytes are left to the join, so what is returned is bounded in bytes too.  The
    count is found from a histogram in eighths of a power of two, so nothing is sorted over all words.
    """
    counts = counts.where(F.octet_length("word") <= longest)
    step = F.floor(F.log2("c") * 8).cast("int")
    bins = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for b, n in bins:
        held += n
        if held > most:
            break
        least = b
    chosen = F.col("word") == F.lit(bytearray(END))
    found = counts.where(chosen if least is None else chosen | (step >= least)).select("word", "kind", "c").toArrow()
    rows = zip(found.column("word").to_pylist(), found.column("kind").to_pylist(), found.column("c").to_pylist(), strict=True)
    return sorted(rows, key=lambda r: (-r[2], r[0]))


def score_documents(docs: DataFrame, settings: Settings = Settings(), modulus: int = 7, remainder: int = 2) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row for each row of docs.

    Held out are rows with crc32(doc_id as text) mod `modulus` = `remainder`; all others train.  A null text is
    empty and has one token, the end.  Rows with a null id train.  base_score: add-one unigram log10
    probability.  score: the HMM's.  With no training rows every token is unseen.  An empty table gives no
    rows.  Columns besides doc_id and text are ignored.
    """
    spark, s = docs.sparkSession, settings
    bounded_arrow_batches(spark)
    doc_id = docs["doc_id"].cast("long")
    named = docs.select(doc_id.alias("doc_id"), is_held_out(docs["doc_id"], modulus, remainder).alias("held_out"), "text")
    seen = named.where("not held_out").select("text").mapInArrow(counter(s.kinds), "word binary, kind int, n long")
    counts = written(seen.groupBy("word", "kind").agg(F.sum("n").alias("c")).where("c > 0"), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    hot = hot_words(counts, s.hot, s.hot_bytes)
    kinds = {r["kind"]: (r["n"], r["v"]) for r in counts.where("kind >= 0").groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    known = Vocabulary(hot, kinds, s)
    vocabulary = Shared(spark, known)
    encoded = written(named.mapInArrow(encoder(vocabulary, s), ENCODED).select(F.monotonically_increasing_id().alias("row_id"), "*"), "encoded")
    cold = encoded.select("row_id", F.explode(F.arrays_zip("cold", "cold_n")).alias("x")).select("row_id", F.col("x.cold").alias("word"), F.col("x.cold_n").alias("n"))
    met = cold.join(counts.select("word", "c"), "word").groupBy("row_id").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_cold"), F.sum("n").alias("n_cold"))
    model = Shared(spark, train(encoded, s, known.overall))
    scored = encoded.select("row_id", "symbols").mapInArrow(scorer(model), "row_id long, log_symbols double")
    rows = encoded.drop("symbols", "cold", "cold_n").join(scored, "row_id").join(met, "row_id", "left")
    log_cold = F.coalesce("log_cold", F.lit(0.0))
    out = rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("log_hot") + log_cold - F.col("n_tokens") * F.log10(F.lit(float(total["n"] + total["v"] + 1)))).alias("base_score"),
        (F.col("log_symbols") + F.col("log_within") + log_cold).alias("score"),
    )
    return out
