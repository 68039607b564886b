"""Language-model scores by a hidden Markov model.

The model is class-based: the ``OWN`` most frequent training words and the end
of a text are classes of their own, every other word belongs to one of ``RARE``
classes by its last bytes.  A hidden state emits a class, the class emits the
word: ``P(word | class) = (c + 0.5) / total`` within a rare class, where each
has one slot of 0.5 for all unknown words.  So the probability of a text is a
proper one, and every parameter that grows with the corpus (the counts of all
training words) stays in a table.

1. Word counts of all training texts: summed in each batch, then by word.
2. Words up to the ``DIRECT`` most frequent are broadcast (a fixed bound); the
   tokens of all others join their counts by word.
3. Texts become class sequences, written once.  Baum-Welch runs over all
   training sequences: each partition returns expected transition and emission
   counts (their size depends on the model alone), which are summed by an
   aggregate.  Training cuts long sequences into segments of ``SEGMENT`` tokens;
   the segments of a batch move in lock step.
4. The scaled forward recursion gives every whole text's exact likelihood.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clickfeat.llm.common import staged
from clickfeat.llm.text import SPACED, LOWER, mix, raw, words

STATES, OWN, RARE, DIRECT = 8, 8192, 1024, 262_144
SEGMENT, ROUNDS, LANES = 256, 4, 1024
SEEDS = 512  # documents that the starting states are chosen from
END = OWN + RARE  # class of the end of a text
CLASSES = END + 1


def _rare_class(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The rare class of each word: a hash of its last three bytes."""
    h = np.zeros(len(s), np.uint64)
    for back in (1, 2, 3):
        at = e - back
        h = h * np.uint64(257) + np.where(at >= s, low[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (OWN + (mix(h) % np.uint64(RARE))).astype(np.int64)


def _batch_words(column):
    buf, offsets = raw(column)
    s, e, h, first = words(buf, offsets, SPACED)
    return LOWER[buf], s, e, h, first


def _counted(batches):
    for b in (x.slice(lo, 4000) for x in batches for lo in range(0, x.num_rows, 4000)):
        low, s, e, h, _ = _batch_words(b.column(0))
        code, distinct = pd.factorize(h)
        some = np.empty(len(distinct), np.int64)
        some[code[::-1]] = np.arange(len(code))[::-1]
        text = low.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([text[x:y] for x, y in zip(s[some].tolist(), e[some].tolist())], pa.binary()),
             pa.array(_rare_class(low, s[some], e[some]), pa.int64()),
             pa.array(np.bincount(code, minlength=len(distinct)), pa.int64())], ["word", "rare", "c"])


class Lexicon:
    """The broadcast part of the vocabulary: sorted word hashes with class and
    count, the totals of the rare classes, and the sums ``N`` and ``V``."""

    def __init__(self, vocabulary: DataFrame, train_docs: int):
        self.docs = train_docs
        total = vocabulary.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.tokens, self.distinct = int(total[0] or 0) + train_docs, total[1] + (train_docs > 0)
        # the lowest count that leaves at most DIRECT words, from a histogram of count sizes
        size = F.floor(F.log2("c") * 16).cast("int")
        self.least, room = 1 << 62, DIRECT
        for r in sorted(vocabulary.groupBy(size.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).collect(),
                        key=lambda r: -r["b"]):
            room -= r["n"]
            if room < 0:
                break
            self.least = r["low"]
        top = vocabulary.where(F.col("c") >= self.least).select("word", "rare", "c").toArrow()
        word, rare, c = top["word"].to_pylist(), top["rare"].to_numpy(), top["c"].to_numpy()
        by = sorted(range(len(word)), key=lambda i: (-c[i], word[i]))
        kind = rare.copy().astype(np.int64)
        kind[by[:OWN]] = np.arange(min(OWN, len(by)))
        ids = words(*raw(pa.array(word, pa.binary())), SPACED)[2]
        order = np.argsort(ids)
        self.hashes, self.kind, self.c = ids[order], kind[order], c[order].astype(np.float64)
        own = kind < OWN
        self.own_total = np.zeros(CLASSES)
        self.own_total[kind[own]] = c[own]
        mass = np.zeros(CLASSES)
        for r in vocabulary.groupBy("rare").agg(F.sum(F.col("c") + F.lit(0.5)).alias("m")).collect():  # RARE rows
            mass[r["rare"]] = r["m"]
        np.subtract.at(mass, rare[own], c[own] + 0.5)
        self.rare_total = mass + 0.5
        self.unigram = np.where(np.arange(CLASSES) < OWN, self.own_total + 0.5 * (self.own_total > 0), self.rare_total)
        self.unigram[END] = train_docs + 0.5
        self.unigram /= self.unigram.sum()

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))


def _encoded(lexicon):
    """Rows as class sequences, with what their direct words add to the scores."""
    def run(batches):
        lex: Lexicon = lexicon.value
        log_rare = np.log10(lex.rare_total)
        end_c = lex.docs
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                low, s, e, h, first = _batch_words(part.column("text"))
                kind, c = _rare_class(low, s, e), np.full(len(h), np.nan)
                if len(lex.hashes):
                    at = np.minimum(np.searchsorted(lex.hashes, h), len(lex.hashes) - 1)
                    ok = lex.hashes[at] == h
                    kind[ok], c[ok] = lex.kind[at[ok]], lex.c[at[ok]]
                known, rare = ~np.isnan(c), kind >= OWN
                log_c = np.log10(np.where(known, c, 0.5) + 0.5)
                log_c[~known] = 0
                inside = np.where(rare, log_c - log_rare[kind], 0.0)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                sums = lambda x: np.bincount(row, x, part.num_rows).astype(np.float64)
                n = np.diff(first)
                text, tail = low.tobytes(), np.flatnonzero(~known)
                seq = np.insert(kind, first[1:], END).astype(np.int16)
                cut = first + np.arange(len(first))
                bounds = np.concatenate([[0], np.cumsum(~known)])[first]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("held_out"), pa.array(n + 1, pa.int64()),
                    pa.array(sums(known.astype(float)).astype(np.int64) + (end_c > 0), pa.int64()),
                    pa.array(sums(log_c) + np.log10(end_c + 0.5)), pa.array(sums(inside)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()),
                                             pa.array([text[x:y] for x, y in zip(s[tail].tolist(), e[tail].tolist())], pa.binary())),
                    pa.array([seq[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())],
                    ["doc_id", "held_out", "n_tokens", "n_direct", "base_direct", "word_direct", "tail", "seq"])
    return run


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, seeds: list[np.ndarray], unigram: np.ndarray, seed: int = 5) -> "Model":
        """States from documents far from each other (k-means++ on square-rooted
        class shares)."""
        r = np.random.default_rng(seed)
        emit = np.tile(unigram, (STATES, 1))
        shares = [np.bincount(x, minlength=CLASSES) / len(x) for x in seeds]
        if shares:
            roots = np.sqrt(np.array(shares, np.float32))
            far = np.full(len(roots), 2.0)
            for k in range(STATES):
                i = int(r.choice(len(roots), p=far / far.sum())) if far.sum() > 1e-9 else int(r.integers(len(roots)))
                emit[k] = 0.5 * unigram + 0.5 * shares[i]
                far = np.minimum(far, ((roots - roots[i]) ** 2).sum(axis=1))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit)

    def forward(self, seqs: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each whole sequence, all in lock step."""
        order = np.argsort([-len(x) for x in seqs], kind="stable")
        size = np.array([len(seqs[i]) for i in order])
        flat, out = np.concatenate([seqs[i] for i in order]), np.zeros(len(seqs))
        at, emit = np.cumsum(size) - size, np.ascontiguousarray(self.emit.T)
        a = np.tile(self.start, (len(seqs), 1))
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t, "left"))
            a = (a[:m] @ self.move if t else a[:m]) * emit[flat[at[:m] + t]]
            scale = a.sum(axis=1)
            a /= scale[:, None]
            out[:m] += np.log10(scale)
        back = np.empty(len(seqs))
        back[order] = out
        return back

    def expected(self, seqs: list[np.ndarray], start, move, emit) -> None:
        """Adds the expected counts of the sequences (scaled forward-backward)."""
        order = np.argsort([-len(x) for x in seqs], kind="stable")
        size = np.array([len(seqs[i]) for i in order])
        flat = np.concatenate([seqs[i] for i in order])
        at, e = np.cumsum(size) - size, np.ascontiguousarray(self.emit.T.astype(np.float32))
        a_move, steps = self.move.astype(np.float32), int(size[0])
        live = np.searchsorted(-size, -np.arange(steps + 1), "left")
        alpha, scales = [], []
        a = np.tile(self.start.astype(np.float32), (len(seqs), 1))
        for t in range(steps):
            m = live[t]
            a = (a[:m] @ a_move if t else a[:m]) * e[flat[at[:m] + t]]
            scale = a.sum(axis=1)
            a = a / scale[:, None]
            alpha.append(a)
            scales.append(scale)
        beta, kinds, gammas = np.ones((live[steps - 1], STATES), np.float32), [], []
        for t in range(steps - 1, -1, -1):
            m = live[t]
            if len(beta) < m:
                beta = np.concatenate([beta, np.ones((m - len(beta), STATES), np.float32)])
            gamma = alpha[t] * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            kinds.append(flat[at[:m] + t])
            gammas.append(gamma)
            if t:
                ahead = e[kinds[-1]] * beta / scales[t][:, None]
                move += self.move * (alpha[t - 1][:m].T @ ahead)
                beta = ahead @ a_move.T
        start += gammas[-1].sum(axis=0)
        kinds, gammas = np.concatenate(kinds), np.concatenate(gammas)
        for k in range(STATES):
            emit[k] += np.bincount(kinds, gammas[:, k], CLASSES)


def _sequences(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16).astype(np.int64) for x in batch.column("seq").to_pylist()]


def _expectation(model):
    """Expected counts of a partition as ``(kind, i, j, v)``; kind 0 is the start
    (j unused), 1 transitions, 2 emissions."""
    def run(batches):
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
        waiting: list[np.ndarray] = []

        def flush() -> None:
            waiting.sort(key=len)  # segments of like length go together
            for i in range(0, len(waiting), LANES):
                model.value.expected(waiting[i:i + LANES], start, move, emit)
            waiting.clear()

        for b in batches:
            for x in _sequences(b):
                waiting.extend(x[i:i + SEGMENT] for i in range(0, len(x), SEGMENT))
                if len(waiting) >= 16 * LANES:
                    flush()
        flush()
        for kind, table in enumerate((start[:, None], move, emit)):
            i, j = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(table[i, j])], ["kind", "i", "j", "v"])
    return run


def train(sequences: DataFrame, unigram: np.ndarray) -> Model:
    """Baum-Welch over all rows of ``sequences (doc_id, seq)``."""
    spark = sequences.sparkSession
    some = sequences.select("seq").where("octet_length(seq) between 64 and 65536").orderBy(F.xxhash64("seq")).limit(SEEDS).toArrow()
    model = Model.begin([np.frombuffer(x, np.int16).astype(np.int64) for x in some["seq"].to_pylist()], unigram)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        rows = (sequences.select("seq").mapInArrow(_expectation(shared), "kind int, i int, j int, v double")
                         .groupBy("kind", "i", "j").agg(F.sum("v").alias("v")).toArrow())  # at most the size of the model
        kind, i, j, v = (rows[c].to_numpy() for c in ("kind", "i", "j", "v"))
        if not len(v):
            break
        parts = []
        for k, shape, prior in ((0, (STATES, 1), 1.0), (1, (STATES, STATES), 1.0), (2, (STATES, CLASSES), None)):
            table = np.zeros(shape)
            own = kind == k
            table[i[own], j[own]] = v[own]
            parts.append(table + (20 * unigram if prior is None else prior))
        model = Model(parts[0][:, 0] / parts[0].sum(), *(p / p.sum(axis=1, keepdims=True) for p in parts[1:]))
    return model


def _likelihood(model):
    def run(batches):
        for b in batches:
            out = model.value.forward(_sequences(b)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(out)],
                                             [*b.schema.names[:-1], "class_score"])
    return run


def score(docs: DataFrame, held_out) -> DataFrame:
    """``docs (doc_id, text, ...)`` -> ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score`` for every row; learns from the rows where
    ``held_out`` (a condition on ``doc_id``) is false.

    A null text is empty: its end alone.  Repeated rows count and are scored
    each; a null ``doc_id`` is as good as any; other columns are ignored.  With
    no training text every word is unknown and the scores stay finite."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    learnt = rows.where(~F.col("held_out"))
    vocabulary = staged(learnt.select("text").mapInArrow(_counted, "word binary, rare long, c long")
                              .groupBy("word", "rare").agg(F.sum("c").alias("c")), "vocabulary")
    lexicon = Lexicon(vocabulary, learnt.count())
    names = ("doc_id long, held_out boolean, n_tokens long, n_direct long, base_direct double, word_direct double, "
             "tail array<binary>, seq binary")
    coded = staged(rows.mapInArrow(_encoded(spark.sparkContext.broadcast(lexicon)), names)
                       .withColumn("row", F.monotonically_increasing_id()), "sequences")
    model = train(coded.where(~F.col("held_out")), lexicon.unigram)
    tail = coded.select("row", F.explode("tail").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    rare = vocabulary.where(F.col("c") < lexicon.least).select("word", "c")
    tail = (tail.join(rare, "word", "left").groupBy("row")
                .agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("tail_log"),
                     F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known")))
    kept = coded.select("doc_id", "held_out", "n_tokens", "n_direct", "base_direct", "word_direct", "row", "seq")
    scored = kept.mapInArrow(_likelihood(spark.sparkContext.broadcast(model)),
                             "doc_id long, held_out boolean, n_tokens long, n_direct long, base_direct double, word_direct double, "
                             "row long, class_score double")
    full = scored.join(tail, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_direct") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base_direct") + tail_log - F.col("n_tokens") * F.lit(lexicon.base_norm)).alias("base_score"),
        (F.col("class_score") + F.col("word_direct") + tail_log).alias("score"))
