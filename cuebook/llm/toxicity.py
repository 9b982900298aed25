"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word (letters and digits, A-Z folded) is its 64-bit hash; hashes that enough rows of the sample hold have a
learned vector, all others share the vector of nothing. Filters of the widths ``WIDTHS`` slide over the vectors of a text,
each keeps its highest value (max pooling, so one passage decides however long the text is), and a sigmoid
over these gives the score. Vectors, filters and output are trained together in numpy, by gradient descent through the
place of each maximum; the first coordinate of a vector starts at the word's shrunken log odds.

Every labelled row outside the held-out fold counts. They are joined to their texts and stored once. Spark counts in how many rows
a word is; words that a thousandth of the rows hold make the vocabulary, so its size does not grow with the rows. Then the parts of
the stored table, about ``PART_ROWS`` rows each and a task each, train the model side by side: a part goes once over its rows and gives what
it changed, and the mean of the changes (of a word: over the parts that hold it) makes the model of the next round.
Changes are summed as whole numbers, so their order does not matter. Few rows are one part and one round.
A task holds the words of its part, 4 bytes each; ``spark.sql.files.maxPartitionBytes`` bounds the part. Only counts of words in the vocabulary and summed
changes come to the driver. ``max_rows`` or ``max_bytes`` ask for a model of a sample instead, trained there.

Thresholds are calibrated by language, on a sixth of the rows that the model does not see: a language with enough of
both classes there gets the threshold of its best F1, others the threshold of all; scores are counted in ``BINS`` bins. The
language never enters a score: ``predicted`` is the score against one fixed threshold, ``flagged`` against that of the row's language.

Labels count only from rows outside the held-out fold (``crc32(id as text) % 4 == 2``); label rows with a null id or
label are ignored, several labels of one id count by majority. Null and empty texts get the score of no word. Repeated
rows each get a row; extra columns are ignored; an empty table gives an empty result. Without labelled rows every score is
0.5, with one class only close to it.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import NON_ALNUM_BYTES, blocks, counted, distinct, hashes, words
from .common import mark, release, text_of, written

MAX_ROWS, MAX_BYTES = 4000, 32 << 20  # of a sample, if one is asked for
PART_ROWS, ROUNDS = 4000, 4  # rows that a part has about, and how often the parts' changes are put together
APART = 6  # one row in so many is kept for the thresholds
BINS = 10_000  # of the scores that thresholds are chosen by
UNIT = 2.0**40  # changes are summed in whole numbers of 1 / UNIT
WIDTHS, FILTERS, DIM = (1, 2, 3), 12, 8
BATCH = 32
SHRINK, SPREAD, OUT = 2, 1.0, 0.1  # rows that a word's odds are shrunk by, spread of the other coordinates, first output weights
LARGEST = 3.0  # of any weight but shifts and bias: three layers that grow together would run away
OWN_RATE = 8.0  # a word's vector learns so much faster: few of a batch's rows hold it


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each row's begin)."""
    starts, ends, rows = words(raw, offsets, NON_ALNUM_BYTES)
    return hashes(raw, starts, ends), rows


def _spaced(numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with blanks (0) after each row, so that no filter reads over its end; and the places of the words."""
    gap = max(WIDTHS) - 1
    places = np.arange(len(numbers)) + gap * np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    out = np.zeros(len(numbers) + gap * (len(rows) - 1), dtype=np.int64)
    out[places] = numbers
    return out, places


@dataclass
class Model:
    """``vocabulary``: sorted hashes, whose vectors follow the zero vector in ``vectors``."""

    vocabulary: np.ndarray
    vectors: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    shift: np.ndarray  # (widths, FILTERS)
    out: np.ndarray  # (widths, FILTERS)
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)

    def score(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The score of each row of word hashes."""
        ids, places = _spaced(self.numbers(h), rows)
        full = np.flatnonzero(np.diff(rows))
        total = np.full(len(rows) - 1, self.bias)
        for w, width in enumerate(WIDTHS):
            value = np.broadcast_to(self.shift[w], (len(places), FILTERS)).copy()
            for j in range(width):
                value += (self.vectors @ self.filters[w][j])[ids[places + j]]
            if len(full):
                total[full] += np.maximum(np.maximum.reduceat(value, rows[full], axis=0), 0) @ self.out[w]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    def column(self, text: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            parts = [pa.array(model.score(*word_hashes(raw, offsets))) for _, _, raw, offsets in blocks(texts)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

        return scored(text)


def _start(vocabulary: np.ndarray, held: np.ndarray, with_bad: np.ndarray, bad: int, n: int, rng: np.random.Generator) -> Model:
    """The model before training: the words that enough rows hold, their log odds, filters that look at these.

    ``held``, ``with_bad``: how many rows, and how many of the ``bad`` ones, hold each word of ``vocabulary``; ``n``: all rows."""
    odds = np.log((with_bad + 0.5) / (bad + 1)) - np.log((held - with_bad + 0.5) / (n - bad + 1))
    # The other coordinates tell words of like odds apart: then different filters look at different words, and several
    # such words count for more than one. They are as long as the odds are strong, so that usual words add no noise.
    strength = np.clip(odds / 4, -1, 1) * held / (held + SHRINK)
    vectors = np.zeros((len(vocabulary) + 1, DIM))
    vectors[1:] = strength[:, None] * np.concatenate([np.ones((len(strength), 1)), rng.normal(0, SPREAD, (len(strength), DIM - 1))], axis=1)
    filters = [rng.normal(0, 1, (w, DIM, FILTERS)) / (w * DIM ** 0.5) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = 1 / len(f)
    share = (bad + 0.5) / (n + 1)
    return Model(vocabulary, vectors, filters, np.zeros((len(WIDTHS), FILTERS)), np.full((len(WIDTHS), FILTERS), OUT), float(np.log(share / (1 - share))))


def _least(n: int) -> int:
    """How many of ``n`` rows hold a word of the vocabulary at least."""
    return 2 + n // 1000


def _epochs(n: int) -> int:
    return min(max(4, 6000 // max(n, 1)), 60)


def _blank() -> Model:
    return Model(np.zeros(0, np.uint64), np.zeros((1, DIM)), [np.zeros((w, DIM, FILTERS)) for w in WIDTHS],
                 np.zeros((len(WIDTHS), FILTERS)), np.zeros((len(WIDTHS), FILTERS)), 0.0)


def _held(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, how many rows hold each, how many of label 1)."""
    own, none = [distinct(r) for r in rows], np.zeros(0, np.uint64)
    every, n = counted(np.concatenate([*own, none]))
    bad, in_bad = counted(np.concatenate([*(own[r] for r in np.flatnonzero(labels)), none]))
    with_bad = np.zeros(len(every), dtype=np.int64)
    with_bad[np.searchsorted(every, bad)] = in_bad
    return every, n, with_bad


def _descend(m: Model, numbers: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, epochs: int, rate: float, decay: float,
             first: float = 1.0, last: float = 0.0) -> None:
    """So many times over the rows, in minibatches; the rate falls from its share ``first`` to its share ``last``."""
    steps, done = epochs * -(-len(numbers) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(numbers))
        for lo in range(0, len(numbers), BATCH):
            part = [r for r in order[lo:lo + BATCH] if len(numbers[r])]
            step = rate * (first + (last - first) * done / steps)
            done += 1
            if part:
                _step(m, [numbers[r] for r in part], labels[part].astype(float), step, decay)


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, rate: float = 0.6, decay: float = 1e-4, seed: int = 11) -> Model:
    """A model of rows of word hashes and their 0/1 labels, by minibatches of rows; few rows are seen more often."""
    rng = np.random.default_rng(seed)
    if not len(rows):
        return _blank()
    every, n, with_bad = _held(rows, labels)
    known = n >= _least(len(rows))
    m = _start(every[known], n[known], with_bad[known], int(labels.sum()), len(rows), rng)
    _descend(m, [m.numbers(r) for r in rows], labels, rng, epochs or _epochs(len(rows)), rate, decay)
    return m


def _flat(m: Model) -> np.ndarray:
    """All parameters but the vectors, as rows of ``DIM``."""
    every = np.concatenate([*(f.ravel() for f in m.filters), m.shift.ravel(), m.out.ravel(), [m.bias]])
    return np.append(every, np.zeros(-len(every) % DIM)).reshape(-1, DIM)


def _move(m: Model, change: np.ndarray) -> None:
    """Add a change of the form of ``_flat``."""
    rest = (_flat(m) + change).ravel()
    for a in (*m.filters, m.shift, m.out):
        a[...] = rest[:a.size].reshape(a.shape)
        rest = rest[a.size:]
    m.bias = float(rest[0])


CHANGE = ", ".join(["key long", *(f"v{i} long" for i in range(DIM))])  # key: place of a word's vector, or before 0 a row of ``_flat``


def _rows_of(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], list[pa.RecordBatch]]:
    rows, rest = [], []
    for batch in batches:
        for _, _, raw, offsets in blocks(batch["t"]):
            h, at = word_hashes(raw, offsets)
            rows += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        rest.append(batch.select(["y", "turn"]))
    return rows, rest


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, rows that hold it, such of label 1) of each batch."""
    for batch in batches:
        rows, _ = _rows_of([batch])
        every, n, bad = _held(rows, batch["y"].to_numpy(zero_copy_only=False))
        yield pa.record_batch({"word": every.view(np.int64), "n": n.astype(np.int64), "bad": bad})


def _part_trainer(start: Model, turn: int, epochs: int, first: float, last: float, rate: float, decay: float, seed: int):
    """What a part of the rows changes in a round, as rows of ``CHANGE``."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, numbers, rest = copy.deepcopy(start), [], []
        for batch in batches:
            rows, own = _rows_of([batch])
            numbers += [m.numbers(r).astype(np.int32) for r in rows]
            rest += own
        if not numbers:
            return
        meta = pa.Table.from_batches(rest).to_pydict()
        order = np.argsort(np.array(meta["turn"], dtype=np.int64), kind="stable")  # not the order in which files are read
        labels = np.array(meta["y"], dtype=np.int64)[order]
        numbers = [numbers[i] for i in order]
        rng = np.random.default_rng([seed, turn, meta["turn"][order[0]] & 0xFFFFFFFF])
        _descend(m, numbers, labels, rng, epochs, rate, decay, first, last)
        held = np.zeros(len(m.vectors), dtype=bool)
        for r in numbers:
            held[r] = True
        held[0] = False
        words_at, flat = np.flatnonzero(held), _flat(m) - _flat(start)
        change = np.rint(np.concatenate([(m.vectors - start.vectors)[words_at], flat]) * UNIT).astype(np.int64)
        keys = np.concatenate([words_at, -1 - np.arange(len(flat))])
        yield pa.record_batch({"key": keys, **{f"v{i}": change[:, i] for i in range(DIM)}})

    return trained


def _train_parts(rows: DataFrame, n: int, bad: int, epochs: int | None = None, rate: float = 0.6, decay: float = 1e-4, seed: int = 11) -> Model:
    """A model of all ``n`` rows of the stored table ``rows`` (t, y, turn), ``bad`` of them of label 1."""
    if not n:
        return _blank()
    counts = rows.select("t", "y", "turn").mapInArrow(_count_words, "word long, n long, bad long").groupBy("word") \
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("n") >= _least(n)).toArrow()
    words_of = counts["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words_of)
    m = _start(words_of[order], counts["n"].to_numpy()[order], counts["bad"].to_numpy()[order], bad, n, np.random.default_rng(seed))
    epochs, parts = epochs or _epochs(n), -(-n // PART_ROWS)
    rounds = min(ROUNDS, epochs) if parts > 1 else 1
    for turn in range(rounds):
        often = epochs * (turn + 1) // rounds - epochs * turn // rounds
        trainer = _part_trainer(m, turn, often, 1 - turn / rounds, 1 - (turn + 1) / rounds, rate, decay, seed)
        got = rows.select("t", "y", "turn").coalesce(parts).mapInArrow(trainer, CHANGE).groupBy("key") \
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM)]).toArrow().sort_by("key")
        key = got["key"].to_numpy()
        change = np.stack([got[f"v{i}"].to_numpy() for i in range(DIM)], axis=1) / UNIT / got["n"].to_numpy()[:, None]
        m.vectors[key[key > 0]] += change[key > 0]
        _move(m, change[key < 0][::-1])
    return m


def _step(m: Model, rows: list[np.ndarray], labels: np.ndarray, rate: float, decay: float) -> None:
    """One step of gradient descent on a batch; a filter's gradient goes to the place of its maximum."""
    edge = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ids, places = _spaced(np.concatenate(rows), edge)
    at, high = [], []
    for w, width in enumerate(WIDTHS):
        value = np.broadcast_to(m.shift[w], (len(places), FILTERS)).copy()
        for j in range(width):
            value += (m.vectors @ m.filters[w][j])[ids[places + j]]
        top = np.array([a + value[a:b].argmax(axis=0) for a, b in zip(edge[:-1], edge[1:], strict=True)])  # (rows, FILTERS)
        at.append(places[top])
        high.append(np.take_along_axis(value, top, axis=0))
    total = m.bias + sum(np.maximum(h, 0) @ m.out[w] for w, h in enumerate(high))
    error = (1 / (1 + np.exp(-np.clip(total, -40, 40))) - labels) / len(rows)
    for w, width in enumerate(WIDTHS):
        back = error[:, None] * m.out[w] * (high[w] > 0)  # (rows, FILTERS)
        m.out[w] -= rate * (error @ np.maximum(high[w], 0) + decay * m.out[w])
        m.shift[w] -= rate * back.sum(axis=0)
        for j in range(width):
            word = ids[at[w] + j]
            x = m.vectors[word]  # (rows, FILTERS, DIM)
            to_vectors = back[:, :, None] * m.filters[w][j].T[None]
            m.filters[w][j] -= rate * (np.einsum("rf,rfd->df", back, x) + decay * m.filters[w][j])
            np.add.at(m.vectors, word.ravel(), -rate * OWN_RATE * to_vectors.reshape(-1, DIM))
            m.vectors[word.ravel()] = np.clip(m.vectors[word.ravel()], -LARGEST, LARGEST)
            m.vectors[0] = 0
        np.clip(m.filters[w], -LARGEST, LARGEST, out=m.filters[w])
    np.clip(m.out, -LARGEST, LARGEST, out=m.out)
    m.bias -= rate * float(error.sum())


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of the highest F1; halfway between two scores, the lowest of equally good ones."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + labels.sum())
    last = np.append(s[1:] != s[:-1], True)  # equal scores are flagged together
    k = int(np.flatnonzero(last)[np.argmax(f1[last])])
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list, least: int = 5) -> tuple[dict[str, float], float]:
    """(threshold of each language with at least ``least`` rows of both classes, threshold of all)."""
    def enough(y: np.ndarray) -> bool:
        return min(int(y.sum()), int(len(y) - y.sum())) >= least

    every = best_threshold(scores, labels) if enough(labels) else 0.5
    known = {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if enough(labels[own]):
            known[lang] = best_threshold(scores[own], labels[own])
    return known, every


def best_bin(n: np.ndarray, bad: np.ndarray) -> float:
    """``best_threshold`` of counted scores: how many rows, and of label 1, lie in each bin."""
    at = np.flatnonzero(n)[::-1]
    hit = np.cumsum(bad[at])
    k = int(np.argmax(2 * hit / (np.cumsum(n[at]) + bad.sum())))
    return float((at[k] + (at[k + 1] + 1 if k + 1 < len(at) else 0)) / 2 / BINS)


def _calibrate(model: Model, apart: DataFrame, least: int = 5) -> tuple[dict[str, float], float]:
    """``calibrate`` over the rows of ``apart`` (t, y, lang), counted by Spark."""
    scored = apart.select("lang", "y", F.least(F.floor(model.column(F.col("t")) * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    by_lang: dict = {}
    for r in scored.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).collect():  # languages x BINS at most
        for lang in {r.lang, None}:
            n, bad = by_lang.setdefault(lang, (np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)))
            n[r.bin] += r.n
            bad[r.bin] += r.bad
    found = {lang: best_bin(n, bad) for lang, (n, bad) in by_lang.items() if min(bad.sum(), n.sum() - bad.sum()) >= least}
    every = found.pop(None, 0.5)
    return dict(sorted(found.items())), every


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def _words(text: Column) -> Column:
    """The word hashes of each text, 8 bytes each."""

    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([h[a:b].tobytes() for _, _, raw, offsets in blocks(texts)
                         for h, rows in (word_hashes(raw, offsets),) for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary())

    return made(text)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int | None = None, max_bytes: int | None = None, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", **how) -> Model:
    """A model from all labelled rows outside the held-out fold (with ``max_rows`` or ``max_bytes``: of a sample of them), thresholds
    calibrated by language."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")) \
        .filter("id is not null and y is not null").filter(~held_out(F.col("id"))) \
        .groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).withColumn("turn", F.xxhash64(F.col("id").cast("string")))
    texts = docs.select(docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"), text_of(docs[text_col]).alias("t")) \
        .filter(~held_out(F.col("id")))
    if max_rows is not None or max_bytes is not None:
        return _fit_sample(texts, known, MAX_ROWS if max_rows is None else max_rows, MAX_BYTES if max_bytes is None else max_bytes, **how)
    since = mark(docs.sparkSession)
    rows = written(texts.join(known, "id").groupBy("id").agg(F.max(F.struct("t", "y", "turn", "lang")).alias("s"))
                   .select("s.*", (F.pmod("s.turn", F.lit(APART)) == APART - 1).alias("apart")), "toxicity-rows")
    mine = rows.filter("not apart")
    total = mine.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad")).first()
    model = _train_parts(mine, total.n, total.bad, **how)
    model.thresholds, model.threshold = _calibrate(model, rows.filter("apart"))
    release(docs.sparkSession, since)  # the model is here
    return model


def _fit_sample(texts: DataFrame, known: DataFrame, max_rows: int, max_bytes: int, **how) -> Model:
    """A model of the first rows by the hash of their id, trained on the driver."""
    chosen = known.orderBy("turn", "id").limit(max_rows)  # bounded, so it can be broadcast
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max(F.struct("t", "y", "turn", "lang")).alias("s"))
    sofar = F.sum("size").over(Window.orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, 0))
    fits = rows.select("id", "s.turn", F.octet_length("s.t").alias("size")).withColumn("sofar", sofar) \
        .filter(F.col("sofar") <= max_bytes).select("id")  # of max_rows narrow rows
    got = rows.join(F.broadcast(fits), "id").select("id", "s.y", "s.lang", "s.turn", _words(F.col("s.t")).alias("w")) \
        .toArrow().sort_by([("turn", "ascending"), ("id", "ascending")])
    words_of = [np.frombuffer(w.as_buffer(), np.uint64) for w in got["w"]]
    y, langs = got["y"].to_numpy().astype(np.int64), got["lang"].to_pylist()
    apart = np.arange(len(y)) % 6 == 5
    model = train([words_of[i] for i in np.flatnonzero(~apart)], y[~apart], **how)
    edge = np.concatenate([[0], np.cumsum([len(words_of[i]) for i in np.flatnonzero(apart)])]).astype(np.int64)
    seen = np.concatenate([np.zeros(0, np.uint64), *(words_of[i] for i in np.flatnonzero(apart))])
    model.thresholds, model.threshold = calibrate(model.score(seen, edge), y[apart], [langs[i] for i in np.flatnonzero(apart)])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted, threshold, flagged) for each row."""
    threshold = F.lit(model.threshold)
    for lang, value in model.thresholds.items():
        threshold = F.when(F.col("_cue_lang") == lang, F.lit(value)).otherwise(threshold)
    return docs.select(docs[id_col].alias(id_col), held_out(docs[id_col]).alias("held_out"), docs[lang_col].cast("string").alias("_cue_lang"),
                       model.column(text_of(docs[text_col])).alias("score")) \
        .withColumn("predicted", (F.col("score") >= limit).cast("int")) \
        .withColumn("threshold", threshold).withColumn("flagged", (F.col("score") >= F.col("threshold")).cast("int")).drop("_cue_lang")
