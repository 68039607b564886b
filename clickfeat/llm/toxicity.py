"""Toxicity by a convolutional text classifier, trained in numpy tasks.

Words are hashed twice into one embedding table; filters of width 1, 2 and 3
slide over a document, each keeps its largest response, and a linear layer
turns these into a score.  The embedding starts with the smoothed log-odds of
each bucket in its first dimension and is then trained with everything else.

Everything is learnt from every row that has a label: the log-odds are counted
over all of them, and each of ``EPOCHS`` passes goes over all of them, whole texts.
In a pass a task descends over its own rows from the common parameters; then the
tasks' changes are averaged, a filter's over all rows and a bucket's over the
tasks that met it.  Up to ``TASK_ROWS`` rows are one task, plain descent.  A fifth
of the ids is kept out of this and calibrates: for each language the threshold
with the best F1, exact over all these rows, and scores are shifted so that it
lies at 0.7.  At scoring time the language is guessed from the text's own words;
the ``LANGUAGES`` most frequent ones with ``LEAST`` such rows have thresholds of
their own, all others the common one.

What is held whole is the model, a fixed size: the driver gets one sum a block
of parameters, however many rows and tasks there are.

A filter's response to a word is a fixed vector for each place in the filter,
so scoring looks these vectors up and adds them; all documents are scored
whole, partition by partition, without a shuffle.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from clickfeat.llm.common import staged
from clickfeat.llm.text import ALNUM, raw, words

SAMPLE, SAMPLE_BYTES, SAMPLE_WORDS = 6000, 100_000, 8_000_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.01
THRESHOLD = 0.7
LEAST, LANGUAGES = 40, 64  # documents of a language in the calibration part, else the common threshold
TASK_ROWS = 4096
LONG = 1 << 18  # words worked at once
#: ``doc_id * 2654435761 % 2^32 / 2^16 % 5 = 0`` without overflow
CALIBRATES = "shiftright((doc_id & 65535) * 2654435761L + shiftleft((shiftright(doc_id, 16) & 65535) * 2654435761L & 65535L, 16) & 4294967295L, 16) % 5 = 0"
BLOCK = 2048  # buckets whose changes are added up together


def _hashed(texts: pa.Array):
    """Two bucket numbers a word, packed in 32 bits, and each row's bounds."""
    _, _, h, first = words(*raw(texts), ALNUM)
    return (h >> np.uint64(32)).astype(np.uint32), first


def _pair(code: np.ndarray):
    return (code & 0xFFFF).astype(np.int64), (code >> 16).astype(np.int64) + BUCKETS


def _spread(first: np.ndarray):
    """Rows laid out with gaps of the largest width between them: the place of
    every word, each row's bounds, and the whole length."""
    gap = max(WIDTHS)
    n = np.diff(first)
    begin = first[:-1] + np.arange(len(n)) * gap
    return np.arange(first[-1]) + np.repeat(np.arange(len(n)) * gap, n), begin, begin + n, first[-1] + len(n) * gap + gap


class Model:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.02, (2 * BUCKETS, DIM)).astype(np.float32)
        self.conv = [r.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = r.normal(0, 0.05, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(0)
        self.languages, self.word_language, self.shift, self.common = [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 0.0

        self.squares = np.full(self.emb.shape, 1e-4, np.float32)
        self.moments, self.steps = [np.zeros(sum(p.size for p in self.dense())) for _ in "mv"], 0.0

    def dense(self) -> list[np.ndarray]:
        return [*self.conv, self.bias, self.out]

    def start(self, seen: np.ndarray, n: list[int]) -> None:
        """The log-odds of the buckets: ``seen`` documents by class, of ``n`` in all."""
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        self.emb[:, 0] = (odds * seen.sum(axis=0) / (seen.sum(axis=0) + 8)).clip(-4, 4) / 2
        self.conv[0][:, :, 0] = np.eye(1, DIM)[0]
        self.bias[0], self.out[0], self.base = -1.0, 2.0, np.float32(-2.0)

    def _pooled(self, code, first, upto=None):
        """Largest response of each filter in each row, and the word it begins with (-1: no words)."""
        if len(first) == 2 and len(code) > LONG and upto is None:  # one long text, in parts that share the ends of filters
            best = None
            for lo in range(0, len(code), LONG):
                part = code[lo:lo + LONG + max(WIDTHS) - 1]
                pooled, where = self._pooled(part, np.array([0, len(part)]), LONG)
                more = None if best is None else pooled > best[0]
                best = (pooled, where + lo) if best is None else (np.where(more, pooled, best[0]), np.where(more, where + lo, best[1]))
            return best
        place, begin, end, n = _spread(first)
        a, b = _pair(code)
        x = np.zeros((n, DIM), np.float32)
        x[place] = self.emb[a] + self.emb[b]
        pooled = np.zeros((len(begin), self.bias.size), np.float32)
        where = np.full((len(begin), self.bias.size), -1, np.int64)
        for i, k in enumerate(self.conv):
            z = sum(x[j:len(x) - 2 + j] @ k[j] for j in range(len(k)))
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            for d, (lo, hi) in enumerate(zip(begin, end)):
                if hi > lo:
                    top = z[lo:hi if upto is None else min(hi, lo + upto)].argmax(axis=0)
                    where[d, cols] = top + first[d]
                    pooled[d, cols] = z[lo + top, np.arange(FILTERS)]
        return pooled, where

    def step(self, code: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
        """One step of descent on some rows; the buckets that it changed."""
        pooled, where = self._pooled(code, first)
        act = np.maximum(pooled + self.bias, 0)
        p = 1 / (1 + np.exp(-(act @ self.out + self.base)))
        g = ((p - y) / len(y)).astype(np.float32)
        back = g[:, None] * self.out * (act > 0) * (where >= 0)
        grads = [np.zeros_like(k) for k in self.conv] + [back.sum(axis=0), g @ act]
        buckets, deltas = [], []
        for i, k in enumerate(self.conv):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            for j in range(len(k)):
                at = where[:, cols] + j
                inside = (where[:, cols] >= 0) & (at < first[1:, None])
                a, b = _pair(code[at[inside]])
                x = np.zeros((*at.shape, DIM), np.float32)
                x[inside] = self.emb[a] + self.emb[b]
                grads[i][j] = np.einsum("df,dfe->ef", back[:, cols], x)
                buckets += [a, b]
                deltas += [(back[:, cols, None] * k[j].T[None])[inside]] * 2
        touched, inverse = np.unique(np.concatenate(buckets), return_inverse=True)
        total = np.zeros((len(touched), DIM), np.float32)
        np.add.at(total, inverse, np.concatenate(deltas))
        self.squares[touched] += total ** 2
        self.emb[touched] -= RATE * total / np.sqrt(self.squares[touched])
        self.steps += 1
        m, v = self.moments
        grad = np.concatenate([x.ravel() for x in grads])
        m += 0.1 * (grad - m)
        v += 0.001 * (grad ** 2 - v)
        change, at = RATE / 2 * (m / (1 - 0.9 ** self.steps)) / (np.sqrt(v / (1 - 0.999 ** self.steps)) + 1e-8), 0
        for q in self.dense():
            q -= change[at:at + q.size].reshape(q.shape).astype(np.float32)
            at += q.size
        self.base -= np.float32(RATE * g.sum())
        return touched

    def small(self) -> np.ndarray:
        """All parameters and moments but the embedding's, in one vector."""
        return np.concatenate([*[q.ravel() for q in self.dense()], *self.moments, [self.base, self.steps]])

    def merge(self, means: dict[int, pa.Buffer]) -> None:
        """The averages of what tasks changed (``_descent``, ``_averaged``)."""
        last = 2 * BUCKETS // BLOCK
        for block, mean in means.items():
            if block < last:
                changes = np.frombuffer(mean, np.float32).reshape(-1, 2 * DIM + 1)
                rows = block * BLOCK + changes[:, -1].astype(np.int64)
                self.emb[rows] += changes[:, :DIM]
                self.squares[rows] += changes[:, DIM:-1]
        mean, at = np.frombuffer(means[last]), 0
        for q in self.dense():
            q[:] = mean[at:at + q.size].reshape(q.shape)
            at += q.size
        self.moments = [mean[at:2 * at].copy(), mean[2 * at:3 * at].copy()]
        self.base, self.steps = np.float32(mean[-2]), float(mean[-1])

    def fitted(self) -> Model:
        """What scoring needs: without what only the steps of descent use."""
        m = copy.copy(self)
        m.squares = m.moments = None
        return m

    def tables(self):
        """Per filter place: the responses to every bucket."""
        return [[self.emb @ k[j] for j in range(len(k))] for k in self.conv]

    def logits(self, code: np.ndarray, first: np.ndarray, tables=None) -> np.ndarray:
        tables = tables or self.tables()
        place, begin, end, n = _spread(first)
        a, b = _pair(code)
        pooled = np.zeros((len(begin), self.bias.size), np.float32)
        some = np.flatnonzero(end > begin)
        for i, places in enumerate(tables):
            z = np.zeros((n + 2, FILTERS), np.float32)
            for j, t in enumerate(places):  # place j of the filter meets the word j places on
                own = place - j
                ok = own >= 0
                z[own[ok]] += (t[a] + t[b])[ok]
            if len(some):
                inside = np.full((n + 2, 1), -np.inf, np.float32)
                inside[place] = 0
                pooled[some, i * FILTERS:(i + 1) * FILTERS] = np.maximum.reduceat(z + inside, begin[some], axis=0)
        return (np.maximum(pooled + self.bias, 0) @ self.out + self.base).astype(np.float64)

    def guess(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Index of the likeliest calibrated language, or -1."""
        if not self.languages:
            return np.full(len(first) - 1, -1)
        sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.word_language[_pair(code)[0]], axis=0, dtype=np.float64)])
        of = sums[first[1:]] - sums[first[:-1]]
        return np.where(np.diff(first) > 0, of.argmax(axis=1), -1)

    def scores(self, code, first, tables=None) -> np.ndarray:
        g = self.guess(code, first)
        shift = np.append(self.shift, self.common)[g]
        return 1 / (1 + np.exp(-(self.logits(code, first, tables) - shift + np.log(THRESHOLD / (1 - THRESHOLD)))))


def best_threshold(z, y, weight, otherwise: float = 0.0) -> float:
    """The cut with the largest weighted F1, in the middle of its gap: on one machine what
    ``thresholds`` finds over a table."""
    if not len(z) or not y.sum():
        return otherwise
    by = np.argsort(-z, kind="stable")
    z, y, weight = z[by], y[by], weight[by]
    hit, taken = np.cumsum(y * weight), np.cumsum(weight)
    f1 = 2 * hit / (taken + hit[-1])
    f1[:-1][z[:-1] == z[1:]] = -1
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i] - 1)


def sample(docs: DataFrame, own: DataFrame) -> DataFrame:
    """``doc_id, toxic, lang, code`` of a bounded sample, for looking at labelled rows on one
    machine; ``learn`` takes all rows and does not call it.  At most ``SAMPLE`` ids of each
    class, texts up to ``SAMPLE_BYTES``, ``SAMPLE_WORDS`` words a class: one row of each sampled id
    however many rows share it.  A task sends a row of an id only if it is better
    than all that it has seen of it; an aggregate keeps the best of all tasks."""
    some = None
    for t in (0, 1):
        part = own.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        some = part if some is None else some.unionByName(part)

    def coded(batches):
        best = {}  # at most 2 * SAMPLE ids
        for b in batches:
            mine = []
            for i, (d, h) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist())):
                if d not in best or h < best[d]:
                    best[d] = h
                    mine.append(i)
            b = b.take(pa.array(mine, pa.int64()))
            code, first = _hashed(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "toxic", "h", "lang")), pa.ListArray.from_arrays(first.astype(np.int32), pa.array(code.view(np.int32)))],
                ["doc_id", "toxic", "h", "lang", "code"])

    texts = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text", "lang", F.xxhash64("text", "lang").alias("h"))
    rows = (texts.join(F.broadcast(some), "doc_id").select("doc_id", "toxic", "h", "lang", "text")  # at most 2 * SAMPLE ids
                 .mapInArrow(coded, "doc_id long, toxic int, h long, lang string, code array<int>"))
    rows = staged(rows.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("lang", "code"), "h").alias("row")), "labelled")
    # the words up to each id: two numbers of each of at most 2 * SAMPLE ids
    upto = F.sum(F.size("row.code")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    fits = rows.select("doc_id", upto.alias("words")).where(F.col("words") <= SAMPLE_WORDS).select("doc_id")
    return rows.join(F.broadcast(fits), "doc_id").select("doc_id", "toxic", "row.lang", "row.code")


def _coded(batches):
    for b in batches:
        code, first = _hashed(b.column("text"))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("toxic", "calibrates", "lang")),
                                          pa.LargeListArray.from_arrays(first, pa.array(code.view(np.int32))).cast(pa.list_(pa.int32()))],
                                         ["toxic", "calibrates", "lang", "code"])


def _codes(batch):
    """Codes and bounds of a batch of ``_coded``."""
    lists = batch.column("code")
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _added(rows: DataFrame, partial, dtype, finish=lambda block, total: total) -> dict[int, pa.Buffer]:
    """``partial`` (batches -> number and vector of each block) summed by block over all
    tasks, in the order of tasks: a vector at a time is held.  The driver gets what
    ``finish`` leaves of a sum, as Arrow batches that its JVM hands on as they are."""
    def run(batches):
        task = TaskContext.get().partitionId()
        for block, v in partial(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([v.astype(dtype).tobytes()], pa.binary())],
                                             ["block", "task", "data"])

    def add(batches):
        last, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([finish(last, total).tobytes()], pa.binary())], ["block", "data"])
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data")):
                v = np.frombuffer(data.as_buffer(), dtype).astype(np.float64)
                if block == last:
                    total += v
                else:
                    if last is not None:
                        yield done()
                    last, total = block, v
        if last is not None:
            yield done()

    parts = rows.mapInArrow(run, "block int, task int, data binary").repartition("block").sortWithinPartitions("block", "task")
    found = parts.mapInArrow(add, "block int, data binary").toArrow()
    return {block: data.as_buffer() for block, data in zip(found.column("block").to_pylist(), found.column("data"))}


def counted(rows: DataFrame, languages: list[str]):
    """Of all rows: documents with each bucket by class, and each bucket's words by language."""
    index = {x: i for i, x in enumerate(languages)}

    def partial(batches):
        seen, words_ = np.zeros((2, 2 * BUCKETS)), np.zeros((len(index), BUCKETS))
        for b in batches:
            code, first = _codes(b)
            for d, (t, x) in enumerate(zip(b.column("toxic").to_pylist(), b.column("lang").to_pylist())):
                a, other = _pair(code[first[d]:first[d + 1]])
                for ids in (a, other):
                    seen[t, np.unique(ids)] += 1
                if x in index:
                    words_[index[x]] += np.bincount(a, minlength=BUCKETS)
        for i, v in enumerate([*seen, *words_]):
            if v.any():
                yield i, v

    sums = _added(rows, partial, np.float64)
    of = lambda i, n: np.frombuffer(sums[i]) if i in sums else np.zeros(n)
    return np.stack([of(t, 2 * BUCKETS) for t in (0, 1)]), np.array([of(2 + i, BUCKETS) for i in range(len(index))]).reshape(-1, BUCKETS).T


def _minibatches(order, size):
    part, n = [], 0
    for i in order:
        if part and (len(part) == BATCH or n + size[i] > LONG):
            yield part
            part, n = [], 0
        part.append(i)
        n += size[i]
    if part:
        yield part


def _descent(shared, epoch: int):
    """A task's pass over its rows: the changes of its buckets, their squares and a mark by
    block, and its other parameters times its rows."""
    def partial(batches):
        old: Model = shared.value
        m, touched, n = copy.deepcopy(old), np.zeros(2 * BUCKETS, bool), 0
        r = np.random.default_rng([11, epoch, TaskContext.get().partitionId()])
        for b in batches:
            code, first = _codes(b)
            y, size = b.column("toxic").to_numpy(), np.diff(first)
            for part in _minibatches(r.permutation(len(y)), size):
                mine = np.concatenate([code[first[i]:first[i + 1]] for i in part])
                touched[m.step(mine, np.concatenate([[0], np.cumsum(size[part])]), y[part])] = True
            n += len(y)
        if n:
            for block in range(2 * BUCKETS // BLOCK):
                rows = slice(block * BLOCK, (block + 1) * BLOCK)
                if touched[rows].any():
                    yield block, np.hstack([m.emb[rows] - old.emb[rows], m.squares[rows] - old.squares[rows], touched[rows, None]]).ravel()
            yield 2 * BUCKETS // BLOCK, np.append(m.small() * n, n)
    return partial


def _averaged(block: int, total: np.ndarray) -> np.ndarray:
    """A block's sum -> the mean change of the buckets that any task met, in the precision the
    model has, each with its number in the block; of the other parameters their mean."""
    if block == 2 * BUCKETS // BLOCK:
        return total[:-1] / total[-1]
    total = total.reshape(BLOCK, 2 * DIM + 1)
    met = np.flatnonzero(total[:, -1])
    return np.hstack([total[met, :-1] / total[met, -1:], met[:, None]]).astype(np.float32)


def thresholds(rows: DataFrame) -> dict[int, float]:
    """``rows (own, z, y)`` -> for each ``own`` with some ``y`` of 1 the cut of ``z`` with the best F1, in
    the middle of its gap, the highest of equal ones.  Exact: every distinct ``z`` is a cut; sums run within
    narrow bins of ``z`` and over the table of bins."""
    cuts = rows.groupBy("own", "z").agg(F.sum("y").alias("hit"), F.count(F.lit(1)).alias("n"))
    cuts = cuts.withColumn("bin", F.greatest(F.lit(-4096), F.least(F.lit(4096), F.floor(F.col("z") * 64))))
    over = Window.partitionBy("own").orderBy(F.desc("bin"))
    above = over.rowsBetween(Window.unboundedPreceding, -1)
    bins = cuts.groupBy("own", "bin").agg(F.sum("hit").alias("bin_hit"), F.sum("n").alias("bin_n"), F.max("z").alias("top"))
    bins = bins.select("own", "bin", F.coalesce(F.sum("bin_hit").over(above), F.lit(0)).alias("hit_above"),
                       F.coalesce(F.sum("bin_n").over(above), F.lit(0)).alias("n_above"),
                       F.lead("top").over(over).alias("below"), F.sum("bin_hit").over(Window.partitionBy("own")).alias("all_hit"))
    inside = Window.partitionBy("own", "bin").orderBy(F.desc("z"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    found = cuts.join(F.broadcast(bins), ["own", "bin"]).where("all_hit > 0").select(  # at most 8,193 bins a language
        "own", "z", F.coalesce(F.lead("z").over(inside), "below").alias("next"),
        (2 * (F.col("hit_above") + F.sum("hit").over(upto)) / (F.col("n_above") + F.sum("n").over(upto) + F.col("all_hit"))).alias("f1"))
    best = found.groupBy("own").agg(F.max_by(F.struct("z", "next"), F.struct("f1", "z")).alias("best"))
    return {r["own"]: (r["best"]["z"] + r["best"]["next"]) / 2 if r["best"]["next"] is not None else r["best"]["z"] - 1 for r in best.collect()}


def _judged(shared):
    """Calibration rows -> their logits, for the guessed language and for all (-2)."""
    def run(batches):
        m: Model = shared.value
        tables = m.tables()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                code, first = _codes(part)
                z, own, y = m.logits(code, first, tables), m.guess(code, first), part.column("toxic").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.append(own, np.full(len(y), -2)), pa.int64()), pa.array(np.tile(z, 2)),
                                                  pa.array(np.tile(y, 2), pa.int32())], ["own", "z", "y"])
    return run


def learn(docs: DataFrame, labels: DataFrame, train) -> Model:
    """The model of ``labels (doc_id, toxic)`` on ``docs (doc_id, text, lang)``,
    from all rows where ``train`` (a condition on ``doc_id``) holds.  Labels other
    than 0 and 1 and ids without a document are left out; a document with
    several labels is toxic if any says so; every row of an id counts."""
    own = labels.where(train).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.withColumn("calibrates", F.expr(CALIBRATES))
    rows = docs.select("doc_id", "text", "lang").join(own.hint("merge"), "doc_id").select("toxic", "calibrates", F.col("lang").cast("string").alias("lang"), "text")
    rows = staged(rows.mapInArrow(_coded, "toxic int, calibrates boolean, lang string, code array<int>"), "labelled")
    size = {(r["calibrates"], r["toxic"]): r["count"] for r in rows.groupBy("calibrates", "toxic").count().collect()}
    n = [size.get((False, t), 0) + size.get((True, t), 0) for t in (0, 1)]
    model, sc = Model(), docs.sparkSession.sparkContext
    if not all(n):
        model.out[:], model.base = 0, np.float32(-4.0 if not n[1] else 4.0)
        return model
    fit, rest = rows.where("not calibrates"), rows.where("calibrates")
    if all(size.get((True, t)) for t in (0, 1)):
        n = [size.get((False, t), 0) for t in (0, 1)]
    else:
        fit = rest = rows
    by_lang = rest.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hit"))
    model.languages = sorted(r["lang"] for r in by_lang.where(f"n >= {LEAST} and hit > 0").orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    seen, by_language = counted(fit, model.languages)
    model.start(seen, n)
    fit = fit.coalesce(max(1, -(-sum(n) // TASK_ROWS)))
    for epoch in range(EPOCHS):
        shared = sc.broadcast(model)
        means = _added(fit, _descent(shared, epoch), np.float32, _averaged)
        shared.destroy()
        if means:
            model.merge(means)
    model.word_language = np.log((by_language + 0.1) / (by_language + 0.1).sum(axis=0)).astype(np.float32)
    shared = sc.broadcast(model.fitted())
    cut = thresholds(staged(rest.mapInArrow(_judged(shared), "own long, z double, y int"), "judged"))
    shared.destroy()
    model.common = cut.get(-2, 0.0)
    model.shift = np.array([cut.get(i, model.common) for i in range(len(model.languages))])
    return model


def _scored(model):
    def run(batches):
        m: Model = model.value
        tables = m.tables()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                score = m.scores(*_hashed(part.column("text")), tables)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs (doc_id, text, ...)`` -> ``doc_id, score, predicted`` for every row;
    ``predicted`` is 1 from ``THRESHOLD`` on.

    A null, empty or wordless text has no response in any filter; repeated rows
    score alike; ``lang`` and other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model.fitted())
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(shared), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, all columns kept as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model.fitted()), docs.columns.index("text")

    def run(batches):
        m: Model = shared.value
        tables = m.tables()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield part.filter(pa.array(m.scores(*_hashed(part.column(at)), tables) < THRESHOLD))
    return docs.mapInArrow(run, docs.schema)
