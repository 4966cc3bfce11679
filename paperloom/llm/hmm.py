"""A hidden Markov language model of whole texts.

Tokens are lower-cased (A-Z) words and one end per text.  Every word belongs to
one of CLASSES classes by its hash (the end to one of its own); the model is

    P(text) = P_hmm(classes of the tokens) * prod P(token | its class)

P(token | class) comes from exact counts over all training texts, with one more
count for each known token and one for all unknown ones of the class.  The
hidden Markov model has STATES latent states with an emission table over the
classes, a transition table and start probabilities.  Its size is fixed by
these two numbers, so it is broadcast whatever the size of the corpus.

Training is Baum-Welch: each partition runs the scaled forward and backward
recursions over its texts and returns expected counts, which are summed by
class across partitions; ROUNDS such rounds go over all training texts.  The
first parameters come from a few rounds over about INIT_DOCS texts on the driver.

Texts are read twice and never shuffled.  The first pass counts tokens.  The
counts of the most frequent ones, HEAD of HEAD_BYTES each at most, are then
broadcast, which bounds their size, and the second pass gives for each text the
sequence of its classes, the sums over its head tokens, and its other tokens.
That table is written to the shared checkpoint folder; the rounds of training and
the likelihoods run over its sequences.  Exact counts of the other tokens are
joined by token.  Each of those is rare, so no key of the join is hot but for
those longer than HEAD_BYTES, which Spark splits like any skewed join.

A text is read in pieces, so a long one costs its token numbers and not its
words.  Long texts of a partition run through the recursions together, and the
backward one keeps the forward values of SEGMENT tokens at a time: those of
earlier segments are computed again from the values at their start.

Null text is empty: its one token is the end.  Rows keep their number, null and
repeated ids included.  A null id counts as remainder 0.  Without training rows
a score is the base score.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import id_remainder, materialize, slices, texts_of, thinned

STATES = 8
CLASSES = 1 << 16
ROUNDS = 3
INIT_DOCS = 1000
INIT_TOKENS = 1 << 14
INIT_ROUNDS = 15
HEAD = 1 << 18
HEAD_BYTES = 64
LONG = 2048
SLICE = 2 << 20
SEGMENT = 1 << 21
PIECE = 1 << 20
FLUSH = 500_000
END = b""  # no word is empty
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def pieces_of(text: bytes | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, those of about `size` bytes at a time."""
    at = 0
    while text and at < len(text):
        cut = SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


class Lexicon:
    """Counts and classes of the head tokens, and how a text reads with them."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray, classes: int):
        self.place, self.classes = {t: i for i, t in enumerate(tokens)}, classes
        self.log_counts, self.of = np.log10(np.asarray(counts, np.float64) + 1), classes_of(tokens, classes)[:-1]

    def read(self, text: bytes | None) -> tuple[np.ndarray, int, float, Counter]:
        """Of the tokens but the end: the class of each, how many are of the head,
        the sum of their log10(count + 1), and the others with their numbers."""
        classes, known, total, others = [np.empty(0, np.int32)], 0, 0.0, Counter()
        for words in pieces_of(text):
            at, of = self._read(words)
            head = at >= 0
            classes.append(of)
            known += int(head.sum())
            total += float(self.log_counts[at[head]].sum())
            others.update([words[i] for i in np.flatnonzero(~head)])
        return np.concatenate(classes), known, total, others

    def _read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int32, len(words))
        of, rare = np.empty(len(words), np.int32), np.flatnonzero(at < 0)
        of[at >= 0] = self.of[at[at >= 0]]
        of[rare] = classes_of([words[i] for i in rare], self.classes)[:-1]
        return at, of


_LEXICONS: dict[str, Lexicon] = {}


def _lexicon(key: str, head: tuple[list[bytes], np.ndarray], classes: int) -> Lexicon:
    """Built once in each worker process."""
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(*head, classes)
    return _LEXICONS[key]


def classes_of(words: list[bytes], classes: int = CLASSES) -> np.ndarray:
    """Class of each token, the end included."""
    h = xxhash.xxh64_intdigest
    out = np.empty(len(words) + 1, np.int32)
    out[:-1] = np.array([h(w, 42) for w in words], np.uint64) & np.uint64(classes - 1)
    out[-1] = classes
    return out


class Batch:
    """Sequences laid out by time: position t of all sequences longer than t
    stands together, the longest sequence first."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        self.live = np.searchsorted(-lengths[self.order], -np.arange(longest), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.live)])
        self.flat = np.empty(int(self.offset[-1]), np.int32)
        for rank, i in enumerate(self.order.tolist()):
            s = sequences[i]
            self.flat[self.offset[: len(s)] + rank] = s
        self.size = len(sequences)

    def steps(self) -> list[tuple[int, int]]:
        return list(zip(self.offset.tolist(), self.live.tolist(), strict=False))


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """start [S], move [S, S], emit [classes + 1, S]."""
        self.start, self.move, self.emit = start, move, emit

    def _forward(self, batch: Batch, steps: list[tuple[int, int]], before: np.ndarray | None, into: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Scaled forward values of each step and their scales, from those of the
        step before; written one after the other to `into`, or over each other."""
        width, ones = len(self.start), np.ones(len(self.start))
        most = max((m for _, m in steps), default=0)
        room, taken = (np.empty((2, most, width)) if into is None else None), np.empty((most, width))
        for k, (at, m) in enumerate(steps):
            a = room[k & 1, :m] if into is None else into[at - steps[0][0] : at - steps[0][0] + m]
            if before is None:
                a[:] = self.start
            else:
                np.matmul(before[:m], self.move, out=a)
            a *= np.take(self.emit, batch.flat[at : at + m], axis=0, out=taken[:m], mode="clip")
            c = a @ ones
            a /= c[:, None]
            before = a
            yield a, c

    def log10_likelihood(self, batch: Batch) -> np.ndarray:
        """Of each sequence, by the scaled forward recursion."""
        total, steps = np.zeros(batch.size), batch.steps()
        for (_, m), (_, c) in zip(steps, self._forward(batch, steps, None), strict=True):
            total[:m] += np.log10(c)
        out = np.empty(batch.size)
        out[batch.order] = total
        return out

    def expected(self, batch: Batch, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts [S], moves [S, S] and emissions [classes + 1, S].
        Forward values are held for about `segment` tokens at a time."""
        s, steps = len(self.start), batch.steps()
        cuts, begin = [0], 0
        for t, (at, _) in enumerate(steps):
            if at - begin >= segment:
                cuts.append(t)
                begin = at
        entry: list[np.ndarray | None] = [None]
        if len(cuts) > 1:  # what the later segments begin from
            for t, (values, _) in enumerate(self._forward(batch, steps[: cuts[-1]], None), 1):
                if t in cuts:
                    entry.append(values.copy())
        beta, moves, starts, emissions = np.ones((batch.size, s)), np.zeros((s, s)), np.zeros(s), np.zeros((len(self.emit), s))
        taken, back = np.empty((batch.size, s)), np.ascontiguousarray(self.move.T)
        for first, last, before in zip(cuts[::-1], [len(steps), *cuts[:0:-1]], entry[::-1], strict=True):
            part = steps[first:last]
            if not part:
                continue
            base, size = part[0][0], part[-1][0] + part[-1][1] - part[0][0]
            alpha, scale = np.empty((size, s)), np.empty(size)
            for (at, m), (_, c) in zip(part, self._forward(batch, part, before, alpha), strict=True):
                scale[at - base : at - base + m] = c
            for k in range(len(part) - 1, -1, -1):
                at, m = part[k][0] - base, part[k][1]
                own = alpha[at : at + m]
                if first or k:
                    was = before if not k else alpha[part[k - 1][0] - base :]
                    eb = np.take(self.emit, batch.flat[at + base : at + base + m], axis=0, out=taken[:m], mode="clip")
                    eb *= beta[:m]
                    eb /= scale[at : at + m, None]
                    moves += was[:m].T @ eb
                    own *= beta[:m]
                    np.matmul(eb, back, out=beta[:m])
                else:
                    own *= beta[:m]
                    starts = own.sum(axis=0)
            flat = batch.flat[base : base + size]
            for j in range(s):
                emissions[:, j] += np.bincount(flat, weights=alpha[:, j], minlength=len(self.emit))
        return starts, moves * self.move, emissions

    @classmethod
    def from_counts(cls, starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, mass: np.ndarray, weight: float = 50.0) -> "Hmm":
        """Re-estimated parameters; each state's emissions are mixed with
        `weight` counts of the corpus share of the classes."""
        share = mass / mass.sum()
        emit = (emissions + weight * share[:, None]) / (emissions.sum(axis=0) + weight)
        return cls((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emit)

    @classmethod
    def initial(cls, batch: Batch, mass: np.ndarray, states: int = STATES, rounds: int = INIT_ROUNDS) -> "Hmm":
        rng, share = np.random.default_rng(0), mass / mass.sum()
        emit = share[:, None] * np.exp(0.5 * rng.standard_normal((len(mass), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9)
        model = cls(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        for _ in range(rounds if batch.size else 0):
            model = cls.from_counts(*model.expected(batch), mass)
        return model


def _texts(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, c) over all given texts; the end is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["token", "c"])
            counts.clear()
            return out

        for batch in slices(batches):
            for text in texts_of(batch):
                counts.update(words_of(text))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, head: int = HEAD, longest: int = HEAD_BYTES) -> tuple[Column, tuple[list[bytes], np.ndarray]]:
    """Which tokens are of the head, and they with their counts: the most
    frequent ones that are no longer than `longest`, as many whole eighths of a
    doubling of the count as make `head` or fewer."""
    fit = (F.length("token") > 0) & (F.length("token") <= longest) & (F.col("c") > 0)
    step = F.floor(F.log2("c") * 8)
    total, least = 0, None
    for row in counts.where(fit).groupBy(step.alias("b")).count().orderBy(F.desc("b")).collect():  # 8 * 64 rows at most
        if total + row["count"] > head:
            break
        total, least = total + row["count"], row["b"]
    chosen = fit & (step >= least) if least is not None else F.lit(False)
    got = counts.where(chosen).select("token", "c").toPandas().sort_values("token", kind="stable")  # `head` rows at most
    return chosen, ([bytes(t) for t in got["token"]], got["c"].to_numpy(np.int64))


def mass_of(counts: DataFrame, classes: int = CLASSES) -> np.ndarray:
    """The mass of each class: its tokens' counts, one more for each, and one for
    its unknown tokens."""
    bucket = F.when(F.length("token") == 0, classes).otherwise(F.xxhash64("token").bitwiseAND(F.lit(classes - 1)))
    mass = np.ones(classes + 1)
    got = counts.where("c > 0").groupBy(bucket.cast("int").alias("k")).agg(F.sum(F.col("c") + 1).alias("m")).toPandas()  # classes + 1 rows
    mass[got["k"].to_numpy()] += got["m"].to_numpy()
    return mass


ENCODED = "row long, doc_id long, learn boolean, n_tokens long, known long, counted double, inside double, s binary, words binary, numbers binary"


def encode(texts: DataFrame, head: tuple[list[bytes], np.ndarray], mass: np.ndarray, ends: int, classes: int = CLASSES) -> DataFrame:
    """For each text its number, the classes of its tokens but the end (s), and
    what is known of their counts: inside sums the log10 mass of all classes,
    known and counted are of head tokens and the end; words (space between) and
    numbers are the other tokens."""
    sent, key = texts.sparkSession.sparkContext.broadcast((np.log10(mass), head)), uuid.uuid4().hex
    names = [x.split()[0] for x in ENCODED.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_mass, lexicon = sent.value[0], _lexicon(key, sent.value[1], classes)
        context = TaskContext.get()
        number = itertools.count((context.partitionId() if context else 0) << 40)
        for batch in slices(batches):
            rows = []
            for text in texts_of(batch):
                of, known, counted, others = lexicon.read(text)
                inside = float(log_mass[of].sum() + log_mass[classes])
                rows.append((next(number), len(of) + 1, known + (ends > 0), counted + np.log10(ends + 1.0), inside, of.astype("<u2").tobytes(), b" ".join(others), np.array([*others.values()], "<i4").tobytes()))
            columns = [*zip(*rows, strict=True)]
            columns[1:1] = [batch.column("doc_id"), batch.column("learn")]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, ENCODED.split(", "), strict=True)], names=names)

    return texts.select("doc_id", "text", "learn").mapInArrow(run, ENCODED)


def sequence_of(s: bytes, classes: int) -> np.ndarray:
    """Classes of a stored text with the end."""
    return np.append(np.frombuffer(s, "<u2").astype(np.int32), np.int32(classes))


def _by_length(batches: Iterator[pa.RecordBatch], classes: int, run: Callable[[list[np.ndarray], list[int]], object]) -> Iterator[object]:
    """run() over sequences and their row numbers: the short ones of each slice,
    and the long ones of all together as far as they fit a segment, since the
    recursions take as many steps as the longest has tokens."""
    held: list[tuple[np.ndarray, int]] = []
    size = 0
    for batch in slices(batches, "s", SLICE):
        short: list[tuple[np.ndarray, int]] = []
        for s, row in zip(batch.column("s").to_pylist(), batch.column("row").to_pylist(), strict=True):
            x = sequence_of(s, classes)
            if len(x) <= LONG:
                short.append((x, row))
                continue
            if held and size + len(x) > SEGMENT:
                yield run(*map(list, zip(*held, strict=True)))
                held, size = [], 0
            held.append((x, row))
            size += len(x)
        if short:
            yield run(*map(list, zip(*short, strict=True)))
    if held:
        yield run(*map(list, zip(*held, strict=True)))


def train(encoded: DataFrame, mass: np.ndarray, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS) -> Hmm:
    """The model of encoded texts (row, doc_id, s)."""
    first = thinned(encoded.where(F.length("s") <= 2 * INIT_TOKENS), "doc_id", INIT_DOCS)
    rows = first.groupBy("doc_id").agg(F.min("s").alias("s")).toPandas().sort_values("doc_id")  # of a repeated id one
    model = Hmm.initial(Batch([sequence_of(s, classes) for s in rows["s"]]), mass, states)
    for _ in range(rounds):
        model = Hmm.from_counts(*_round(encoded, model, classes), mass)
    return model


def _round(encoded: DataFrame, model: Hmm, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all texts, summed by row of the tables."""
    states = len(model.start)
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    names = ["row", *(f"s{j}" for j in range(states))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        starts, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
        for a, b, c in _by_length(batches, classes, lambda x, _: model.expected(Batch(x))):
            starts, moves, emissions = starts + a, moves + b, emissions + c
        table = np.concatenate([emissions, moves, starts[None, :]])
        rows = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(table[rows, j]) for j in range(states))], names=names)

    kinds = ", ".join(["row int", *(f"{n} double" for n in names[1:])])
    summed = encoded.select("row", "s").mapInArrow(run, kinds).groupBy("row").agg(*[F.sum(n).alias(n) for n in names[1:]]).toPandas()  # classes + states + 2 rows
    sent.unpersist()
    table = np.zeros((classes + 2 + states, states))
    table[summed["row"].to_numpy()] = summed[names[1:]].to_numpy()
    return table[-1], table[classes + 1 : classes + 1 + states], table[: classes + 1]


def likelihoods(encoded: DataFrame, model: Hmm, classes: int = CLASSES) -> DataFrame:
    """(row, whole): log10 of the probability of each sequence."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for rows, whole in _by_length(batches, classes, lambda x, rows: (rows, model.log10_likelihood(Batch(x)))):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(whole)], names=["row", "whole"])

    return encoded.select("row", "s").mapInArrow(run, "row long, whole double")


def other_tokens(encoded: DataFrame) -> DataFrame:
    """(row, token, n) of the tokens outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            tokens, rows = [], []
            for row, words in zip(batch.column("row").to_pylist(), batch.column("words").to_pylist(), strict=True):
                tokens += (part := words.split())
                rows.append(np.full(len(part), row))
            numbers = np.frombuffer(b"".join(batch.column("numbers").to_pylist()), "<i4")
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).astype(np.int64)), pa.array(tokens, pa.binary()), pa.array(numbers)], names=["row", "token", "n"])

    return encoded.where(F.length("words") > 0).select("row", "words", "numbers").mapInArrow(run, "row long, token binary, n int")


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, classes: int = CLASSES, head: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every
    document, learning from those where `learn`, a condition on docs, holds."""
    if not 1 < classes <= CLASSES:
        raise ValueError("a class is stored in sixteen bits")
    texts = _texts(docs, id_col, text_col, learn)
    counts = materialize(count_tokens(texts.where("learn")))
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("token") == 0, F.col("c"))), F.lit(0))).first()
    chosen, tokens = head_of(counts, head)
    mass = mass_of(counts, classes)
    encoded = materialize(encode(texts, tokens, mass, int(ends), classes))
    model = train(encoded.where("learn"), mass, states, classes)
    found = other_tokens(encoded).join(counts.where(~chosen & (F.col("c") > 0)), "token").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("sum"))
    out = encoded.drop("s", "words", "numbers").join(likelihoods(encoded, model, classes), "row").join(found, "row", "left")
    out = out.withColumns({"n_known": F.col("known") + F.coalesce("more", F.lit(0)), "counted": F.col("counted") + F.coalesce("sum", F.lit(0.0))})
    base = F.col("counted") - F.col("n_tokens") * float(np.log10(n + 1.0 * (v + 1)))
    whole = F.col("whole") + F.col("counted") - F.col("inside") if n else base
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"))


def report(docs: DataFrame) -> DataFrame:
    return score(docs, id_remainder("doc_id", 7) != 2).withColumn("held_out", id_remainder("doc_id", 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
