"""Toxicity: a convolutional text classifier over hashed word embeddings, trained here in numpy on every labelled row.

The labelled rows are dealt into lanes. In each epoch every lane trains, on the
executors, from the model that all share; then the lanes' moves are averaged.
Nothing of the texts comes to the driver, only a model for each epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm.storage import fresh, map_arrow, materialize
from tessera.llm.textkit import NON_ALNUM, doc_slices, hash_words, mix64, string_buffers
from tessera.runtime import ship

BUCKETS = 1 << 15
PREFIXES = (4, 6)
ROWS = BUCKETS * (1 + len(PREFIXES))
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
#: As many lanes as hold about so many labelled rows and bytes of text each; that bounds a task's memory, not what is trained on.
LANE_ROWS = 6144
LANE_BYTES = 12 << 20
#: The embedding's rows are averaged in so many slices, and all other parameters in one more.
SLICES = 16
#: Bits of the filter that spares texts without labels the shuffle: so many a labelled row, up to the greatest size. What it lets through is joined exactly.
FILTER_BITS = 16
FILTER_MOST = 1 << 29
#: Bytes of text of either class that a caller who asks for a sample gets at most.
SAMPLE_BYTES = 64 << 20
BASE = np.arange(1 + len(PREFIXES), dtype=np.int32) * BUCKETS


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding for each word, and the number of its text.

    Words are runs of letters and digits in lower case. Each has a row by the hash of
    the word and one by the hash of its beginning at each of the PREFIXES
    (in bytes), in regions of their own; its embedding is their sum.
    """
    data, offsets = string_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    h, doc, s, e = hash_words(data, offsets, NON_ALNUM)
    ids = np.empty((len(h), 1 + len(PREFIXES)), np.int32)
    ids[:, 0] = h & np.uint64(BUCKETS - 1)
    head, taken = np.zeros(len(h), np.uint64), 0
    for at, length in enumerate(PREFIXES):
        for k in range(taken, length):
            place = s + k
            inside = place < e
            head[inside] |= data[place[inside]].astype(np.uint64) << np.uint64(8 * k)
        taken = length
        ids[:, at + 1] = (mix64(head) & np.uint64(BUCKETS - 1)).astype(np.int32) + BUCKETS * (at + 1)
    return ids, doc


@dataclass
class Model:
    embedding: np.ndarray
    kernels: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5

    def tables(self) -> np.ndarray:
        """Each row's share in each filter's response, for each width and place in the window."""
        return np.ascontiguousarray(np.concatenate([self.embedding @ part for k in self.kernels for part in k], axis=1), np.float32)

    def pooled(self, ids: np.ndarray, doc: np.ndarray, n: int, tables=None) -> np.ndarray:
        """Greatest response of each filter in each of n texts, 0 at least."""
        tables = self.tables() if tables is None else tables
        shares = tables[ids[:, 0]]
        for c in range(1, ids.shape[1]):
            shares += tables[ids[:, c]]
        result = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        column = 0
        for at, (width, bias) in enumerate(zip(WIDTHS, self.biases)):
            m = len(ids) - width + 1
            if m <= 0:
                break
            response = shares[:m, column : column + FILTERS]
            for j in range(1, width):
                response = response + shares[j : j + m, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += width * FILTERS
            owner = doc[:m]
            if width > 1:
                inside = owner == doc[width - 1 :]
                response, owner = response[inside], owner[inside]
            if not len(owner):
                continue
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            result[owner[first], at * FILTERS : (at + 1) * FILTERS] = np.maximum(np.maximum.reduceat(response, first, axis=0) + bias, 0)
        return result

    def score(self, ids: np.ndarray, doc: np.ndarray, n: int, tables=None) -> np.ndarray:
        """Probability of toxic for each of n texts; 0 for a text without words."""
        logit = self.pooled(ids, doc, n, tables) @ self.out + self.bias
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        p[np.bincount(doc, minlength=n)[:n] == 0] = 0
        return p


@dataclass
class Training:
    """A model, and the sums of squared gradients that Adagrad divides by: one for each row of the embedding, and for each other parameter."""

    model: Model
    past_rows: np.ndarray
    past_rest: np.ndarray

    @classmethod
    def start(cls, share: float, rng: np.random.Generator) -> Training:
        """Before the first step; share is that of the toxic among the texts."""
        model = Model(
            rng.normal(0, 0.02, (ROWS, DIM)).astype(np.float32),
            [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
            float(np.log((share + 1e-3) / (1 - share + 1e-3))),
        )
        return cls(model, np.full(ROWS, 1e-2, np.float32), np.full(len(_rest(model)), 1e-2, np.float32))

    def move(self, rest: np.ndarray) -> None:
        """Adds to the parameters other than the embedding, in the order of _rest."""
        at = 0
        for part in (*self.model.kernels, *self.model.biases, self.model.out):
            part += rest[at : at + part.size].reshape(part.shape)
            at += part.size
        self.model.bias += float(rest[at])


def _rest(model: Model) -> np.ndarray:
    """All parameters but the embedding, in a row."""
    return np.concatenate([x.ravel() for x in (*model.kernels, *model.biases, model.out)] + [np.array([model.bias])]).astype(np.float32)


def _winners(model: Model, ids: np.ndarray, doc: np.ndarray, n: int, step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Greatest response of each filter in each text, as Model.pooled, and the window's first word, -1 where none exceeds 0; step words at a time."""
    pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    winner = np.full(pooled.shape, -1, np.int64)
    kernel = np.concatenate([part for k in model.kernels for part in k], axis=1)
    for a in range(0, len(ids), step):
        piece, own = ids[a : a + step + max(WIDTHS) - 1], doc[a : a + step + max(WIDTHS) - 1]
        x = model.embedding[piece[:, 0]]
        for c in range(1, ids.shape[1]):
            x += model.embedding[piece[:, c]]
        shares = x @ kernel
        column = 0
        for at, width in enumerate(WIDTHS):
            m = min(step, len(piece) - width + 1)
            if m <= 0:
                break
            response = shares[:m, column : column + FILTERS].copy()
            for j in range(1, width):
                response += shares[j : j + m, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += width * FILTERS
            response += model.biases[at]
            if width > 1:
                response[own[:m] != own[width - 1 : width - 1 + m]] = -np.inf
            first = np.flatnonzero(np.r_[True, own[1:m] != own[: m - 1]])
            here, span = own[first], slice(at * FILTERS, (at + 1) * FILTERS)
            best = np.maximum.reduceat(response, first, axis=0)
            better = best > pooled[here, span]
            # the first of equal windows: written backwards, it is the last to be written
            best[~better] = np.inf
            place, filters = np.nonzero(response == np.repeat(best, np.diff(np.r_[first, m]), axis=0))
            winner[own[place[::-1]], at * FILTERS + filters[::-1]] = place[::-1] + a
            pooled[here, span] = np.where(better, best, pooled[here, span])
    return pooled, winner


def epoch(state: Training, texts: list[np.ndarray], y: np.ndarray, order: np.ndarray, base: np.ndarray | int = 0, rate: float = 0.1, batch: int = 32, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Adagrad on the log loss, once over the texts in the order; changes the model in place and returns the squared gradients it saw.

    Texts are arrays of rows, as from word_ids, less base. Only the windows that win the pooling carry a gradient.
    """
    model = state.model
    gain_rows, gain_rest = np.zeros(ROWS, np.float32), np.zeros(len(state.past_rest), np.float32)
    unit = np.eye(FILTERS, dtype=np.float32)
    for b in range(0, len(order), batch):
        chosen = order[b : b + batch]
        ids = np.concatenate([texts[i] for i in chosen]).astype(np.int32) + base
        doc = np.repeat(np.arange(len(chosen)), [len(texts[i]) for i in chosen])
        pooled, winner = _winners(model, ids, doc, len(chosen))
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -40, 40)))
        delta = ((p - y[chosen]) / len(chosen)).astype(np.float32)
        grad_pooled = delta[:, None] * model.out
        kernel_grads, bias_grads, touched, grads = [], [], [], []
        for at, (width, kernel) in enumerate(zip(WIDTHS, model.kernels)):
            span = slice(at * FILTERS, (at + 1) * FILTERS)
            rows, cols = np.nonzero(winner[:, span] >= 0)
            where, g = winner[:, span][rows, cols], grad_pooled[:, span][rows, cols]
            gk = decay * kernel
            mine = unit[cols] * g[:, None]
            for j in range(width):
                around = ids[where + j]
                part = g[:, None] * kernel[j].T[cols]
                for c in range(ids.shape[1]):
                    touched.append(around[:, c])
                    grads.append(part)
                gk[j] += model.embedding[around].sum(1).T @ mine
            kernel_grads.append(gk.ravel())
            bias_grads.append(mine.sum(0))
        rest = np.concatenate([*kernel_grads, *bias_grads, delta @ pooled + decay * model.out, [delta.sum()]]).astype(np.float32)
        touched, grads = np.concatenate(touched), np.concatenate(grads)
        if len(touched):
            by = np.argsort(touched, kind="stable")
            touched = touched[by]
            first = np.flatnonzero(np.r_[True, touched[1:] != touched[:-1]])
            rows, total = touched[first], np.add.reduceat(grads[by], first, axis=0)
            gain_rows[rows] += (total**2).sum(1)
            model.embedding[rows] -= rate * total / np.sqrt(state.past_rows[rows] + gain_rows[rows])[:, None]
        gain_rest += rest**2
        state.move(-rate * rest / np.sqrt(state.past_rest + gain_rest))
    return gain_rows, gain_rest


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.1, batch: int = 32, decay: float = 1e-4, seed: int = 7) -> Model:
    """What fit does, with one lane and here."""
    rng = np.random.default_rng(seed)
    state = Training.start(float(y.mean()), rng)
    order = np.arange(len(texts))
    for _ in range(epochs):
        rng.shuffle(order)
        rows, rest = epoch(state, texts, y, order, rate=rate, batch=batch, decay=decay)
        state.past_rows += rows
        state.past_rest += rest
    return state.model


def _order_statistics(scores: DataFrame, places: dict[tuple[str, int], int]) -> dict[tuple[str, int], int]:
    """The place-th least bits (from 0) of each (scope, toxic) of places; bits are of floats from 0 to 1, found by their upper half and then their lower."""
    if not places:
        return {}
    found = scores.join(F.broadcast(scores.sparkSession.createDataFrame([(*k, n) for k, n in places.items()], "scope string, toxic int, place long")), ["scope", "toxic"])
    for half in (F.shiftright("bits", 15), F.col("bits")):
        cells = found.groupBy("scope", "toxic", half.alias("cell")).agg(F.count("*").alias("n"), F.first("place").alias("place"))
        upto = F.sum("n").over(Window.partitionBy("scope", "toxic").orderBy("cell"))
        chosen = cells.withColumn("upto", upto).filter("upto > place AND upto - n <= place").selectExpr("scope", "toxic", "cell", "place - (upto - n) AS place").collect()
        top = scores.sparkSession.createDataFrame(chosen, "scope string, toxic int, top int, place long")
        found = scores.withColumn("top", F.shiftright("bits", 15)).join(F.broadcast(top), ["scope", "toxic", "top"])
    return {(r.scope, r.toxic): r.cell for r in chosen}


def calibrate(held: DataFrame, most_false: float = 0.002, least: int = 20) -> tuple[dict[str, float], float]:
    """Thresholds by language from all held-out scores, and one for other languages; held has lang, toxic and the bits of the score as float.

    A threshold lies midway, in logits, between the greatest score that may be
    a false alarm (the share most_false of the clean texts exceed it) and the toxic
    text next above it. Languages with fewer than ``least`` texts of either kind take the common one. Both scores
    are exact order statistics, counted by Spark; two of each language come to the driver.
    """
    scores = held.select(F.explode(F.array(F.concat(F.lit("="), F.coalesce("lang", F.lit(""))), F.lit("all"))).alias("scope"), "toxic", "bits")
    number = {r.scope: (r.clean, r.bad) for r in scores.groupBy("scope").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("bad")).filter(f"scope = 'all' OR least(clean, bad) >= {int(least)}").collect()}
    number = {scope: n for scope, n in number.items() if min(n)}
    low = _order_statistics(scores, {(scope, 0): max(0, clean - 1 - int(most_false * clean)) for scope, (clean, _) in number.items()})
    above = {}
    if low:
        limits = scores.sparkSession.createDataFrame([(scope, bits) for (scope, _), bits in low.items()], "scope string, low int")
        above = {r.scope: r.n for r in scores.join(F.broadcast(limits), "scope").filter("toxic = 1 AND bits > low").groupBy("scope").agg(F.count("*").alias("n")).collect()}
    high = _order_statistics(scores, {(scope, 1): number[scope][1] - n + int(0.02 * n) for scope, n in above.items()})

    def logit(bits):
        p = float(np.array(bits, np.int32).view(np.float32))
        return np.log(max(p, 1e-9) / max(1 - p, 1e-9))

    one = int(np.array(1, np.float32).view(np.int32))
    cuts = {scope: float(np.clip(1 / (1 + np.exp(-(logit(low[scope, 0]) + logit(high.get((scope, 1), one))) / 2)), 0.05, 0.98)) for scope in number}
    return {scope[1:]: cut for scope, cut in cuts.items() if scope != "all"}, cuts.get("all", 0.5)


def training_rows(docs: DataFrame, labels: DataFrame, sample: dict[int, int], sample_bytes: int, seed: str) -> pa.Table:
    """(doc_id, text, lang, toxic) of the labelled rows of least seeded hash: at most sample[c] of class c, and no more than sample_bytes of text of each.

    Rows alike in doc_id and text count once. Only ids, hashes and lengths are ranked; then the chosen texts alone are fetched, each whole.
    A row that does not fit in what is left of the bytes is passed over.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL")
    own = own.withColumn("mark", F.xxhash64("doc_id", "text"))
    found = own.select("doc_id", "mark", F.octet_length("text").alias("size")).join(known, "doc_id").groupBy("toxic", "doc_id", "mark").agg(F.max("size").alias("size"))
    order = (F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))), F.col("doc_id"), F.col("mark"))
    found = materialize(found, "labelled")
    chosen = []
    for c, n in sample.items():
        left = sample_bytes
        for r in found.filter(F.col("toxic") == c).orderBy(*order).limit(n).collect():
            if r["size"] <= left:
                left -= r["size"]
                chosen.append((r.doc_id, r.mark, r.toxic))
    # as many rows as the parameters say at most, so it may be broadcast
    table = F.broadcast(spark.createDataFrame(chosen, "doc_id long, mark long, toxic int"))
    rows = own.join(table, ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(*(F.min(x).alias(x) for x in ("text", "lang", "toxic")))
    return rows.drop("mark").toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def lanes_of(docs: DataFrame, labels: DataFrame, seed: str, lane_rows: int, lane_bytes: int) -> DataFrame:
    """All labelled rows with words, dealt into lanes by a seeded hash; a row of the table is a whole lane, in the order of the hash.

    It has the lane, its numbers of toxic and clean rows, and of each row in turn toxic (uint8), length in words (int64), lang, and words (word_ids less BASE, uint16).
    Rows alike in doc_id and text count once, with the least of their langs.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter("toxic IN (0, 1)")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND doc_id IS NOT NULL")
    own = own.withColumn("mark", F.xxhash64("doc_id", "text"))
    # the labelled rows first, without their texts; texts are shuffled once, into their lanes, and meet their labels there
    found = own.select("doc_id", "mark", F.octet_length("text").cast("long").alias("size")).join(known, "doc_id").groupBy("doc_id", "mark", "toxic").agg(F.max("size").alias("size"))
    found = materialize(found.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "mark")), "labelled")
    size = found.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    count = max(1, -(-size.n // lane_rows), -(-(size["size"] or 0) // lane_bytes))
    bits = _filter(found, size.n)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    keys = [F.pmod("place", F.lit(count)).cast("int").alias("lane"), "place", "doc_id", "mark"]
    texts = own.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "mark")).select(*keys, F.lit(None).cast("int").alias("toxic"), "lang", "text")
    names = texts.columns[:6]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = set(), shared.value
        for batch in batches:
            spot = batch.column(1).to_numpy() & (8 * len(bits) - 1)
            batch = batch.filter(pa.array((bits[spot >> 3] >> (spot & 7)) & 1 > 0))
            rows = list(zip(*(batch.column(c).to_pylist() for c in (2, 3, 5))))
            batch = batch.take(pa.array([i for i, k in enumerate(rows) if k not in seen and not seen.add(k)], pa.int64()))
            text = batch.column(6)
            for i, j in doc_slices(string_buffers(text)[1], 1 << 19):
                ids, doc = word_ids(text.slice(i, j - i))
                words = np.split((ids - BASE).astype(np.uint16), np.searchsorted(doc, np.arange(1, j - i)))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:6]), pa.array([w.tobytes() for w in words], pa.binary())], names=[*names, "words"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words = [], []
        for batch in batches:
            keys.append(pa.table(batch.columns[:6], names=batch.schema.names[:6]))
            words += batch.column(6).to_pylist()
        if not keys:
            return
        keys = pa.concat_tables(keys).append_column("at", pa.array(np.arange(len(words))))
        # nulls come last: a label, then its texts by lang
        keys = keys.sort_by([(c, "ascending") for c in ("lane", "place", "doc_id", "mark", "toxic", "lang", "at")])
        number = np.stack([keys[c].to_numpy() for c in ("lane", "place", "doc_id", "mark")])
        label = keys["toxic"].fill_null(-1).to_numpy()
        full = np.array([bool(words[i]) for i in keys["at"].to_pylist()])
        chosen = 1 + np.flatnonzero((number[:, 1:] == number[:, :-1]).all(0) & (label[:-1] >= 0) & full[1:])
        keys, label, lane = keys.take(pa.array(chosen)), label[chosen - 1], number[0, chosen]
        for k in np.unique(lane).tolist():
            part, toxic = keys.filter(pa.array(lane == k)), label[lane == k].astype(np.uint8)
            own = [words[i] for i in part["at"].to_pylist()]
            length = np.array([len(w) for w in own], np.int64) // (2 * len(BASE))
            bad = int(toxic.sum())
            values = (k, bad, len(own) - bad, toxic.tobytes(), length.tobytes(), part["lang"].to_pylist(), b"".join(own))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, LANE_TYPES)], names=LANE_NAMES)

    rows = map_arrow(texts, read, "lane int, place long, doc_id long, mark long, toxic int, lang string, words binary")
    rows = rows.unionAll(found.select(*keys, "toxic", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("words")))
    return materialize(map_arrow(rows.repartitionById(count, "lane"), pack, LANE), "lanes")


def _filter(found: DataFrame, n: int) -> np.ndarray:
    """Bytes of a bitmap with a bit for the place of each row, by its lowest digits."""
    bits = 1 << 10
    while bits < min(FILTER_BITS * n, FILTER_MOST):
        bits *= 2
    block = min(bits, 1 << 19)

    def run(group: pa.Table) -> pa.Table:
        own = np.zeros(block, np.uint8)
        own[group["spot"].to_numpy() % block] = 1
        return pa.table({"block": pa.array([group["block"][0].as_py()], pa.int64()), "bytes": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    spots = found.select(F.col("place").bitwiseAND(F.lit(bits - 1)).alias("spot")).withColumn("block", F.floor(F.col("spot") / block)).distinct()
    ship(found.sparkSession)
    out = np.zeros((bits // block, block // 8), np.uint8)
    for r in spots.groupBy("block").applyInArrow(run, "block long, bytes binary").collect():
        out[r.block] = np.frombuffer(r["bytes"], np.uint8)
    return out.ravel()


LANE = "lane int, bad long, clean long, toxic binary, length binary, lang array<string>, words binary"
LANE_NAMES = [x.split()[0] for x in LANE.split(", ")]
LANE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]


def _opened(batches: Iterator[pa.RecordBatch], before: dict[int, tuple[int, int]], held_out: int):
    """Of each lane its number, texts, classes, langs, and which rows are held out: those whose number among all of their class held_out divides."""
    for batch in batches:
        for row in range(batch.num_rows):
            lane, _, _, toxic, length, lang, words = (c[row] for c in batch.columns)
            lane, y = lane.as_py(), np.frombuffer(toxic.as_buffer(), np.uint8)
            ends = np.cumsum(np.frombuffer(length.as_buffer(), np.int64))
            texts = np.split(np.frombuffer(words.as_buffer(), np.uint16).reshape(-1, len(BASE)), ends[:-1])
            bad, clean = before[lane]
            turn = np.where(y > 0, bad + np.cumsum(y > 0), clean + np.cumsum(y == 0))
            yield lane, texts, y.astype(np.float32), lang, turn % held_out == 0


def _averaged(moves: DataFrame) -> DataFrame:
    """The lanes' moves in one, by slice: each parameter's mean, weighted by the squared gradients that each lane saw, as is the mean of these."""

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("lane")
        k = group["slice"][0].as_py()
        n, dim = (ROWS // SLICES, DIM) if k < SLICES else (int(np.frombuffer(group["at"][0].as_py(), np.int32).max()) + 1, 1)
        weight, square, total = np.zeros(n), np.zeros(n), np.zeros((n, dim))
        for row in range(group.num_rows):
            at, gain, move = (np.frombuffer(group[c][row].as_py(), t) for c, t in (("at", np.int32), ("gain", np.float32), ("move", np.float32)))
            gain = gain.astype(np.float64)
            weight[at] += gain
            square[at] += gain**2
            total[at] += gain[:, None] * move.reshape(-1, dim)
        at = np.flatnonzero(weight).astype(np.int32)
        values = (k, 0, at.tobytes(), (square[at] / weight[at]).astype(np.float32).tobytes(), (total[at] / weight[at, None]).astype(np.float32).tobytes())
        return pa.table([pa.array([v], t) for v, t in zip(values, MOVE_TYPES)], names=MOVE_NAMES)

    return moves.groupBy("slice").applyInArrow(merge, MOVE)


MOVE = "slice int, lane int, at binary, gain binary, move binary"
MOVE_NAMES = [x.split()[0] for x in MOVE.split(", ")]
MOVE_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: dict[int, int] | None = None,
    held_out: int = 4,
    seed: str = "tox-1",
    sample_bytes: int = SAMPLE_BYTES,
    epochs: int = 8,
    lane_rows: int = LANE_ROWS,
    lane_bytes: int = LANE_BYTES,
) -> Model | None:
    """Trains on all labelled rows but every held_out-th of each class; all of these calibrate.

    labels has doc_id and toxic (0/1, the greatest where a document has several); labels without id or class, null and wordless texts
    teach nothing. Returns None where either class is missing, as in an empty table: then nothing is toxic. Where a class has
    fewer than held_out rows none of it is held out, and the thresholds are 0.5. Only a caller who gives ``sample`` trains on a sample (training_rows).

    Each lane's steps depend on its rows, its number and the model alone, and lanes are added in their order, so the result does not hang on
    partitions, nor on tasks that are run again.
    """
    spark = docs.sparkSession
    if sample is not None:
        docs = spark.createDataFrame(training_rows(docs, labels, sample, sample_bytes, seed).to_pylist(), "doc_id long, text string, lang string, toxic int")
    lanes = lanes_of(docs, labels, seed, lane_rows, lane_bytes)
    number = np.array(sorted(tuple(r) for r in lanes.select("lane", "bad", "clean").collect()), np.int64).reshape(-1, 3)
    if len(np.unique(number[:, 0])) < len(number):
        raise RuntimeError("a lane of training rows was split")
    total = number[:, 1:].sum(0)
    if not total.all():
        return None
    before = dict(zip(number[:, 0].tolist(), (np.cumsum(number[:, 1:], 0) - number[:, 1:]).tolist()))
    bad, clean = total - total // held_out
    state = Training.start(float(bad / (bad + clean)), np.random.default_rng(7))
    for turn in range(epochs):
        shared = spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            for lane, texts, y, _, held in _opened(batches, before, held_out):
                old = shared.value
                own = deepcopy(old)
                order = np.flatnonzero(~held)
                np.random.default_rng([7, turn, lane]).shuffle(order)
                gain, gain_rest = epoch(own, texts, y, order, BASE)
                moved = own.model.embedding - old.model.embedding
                parts = [(k, gain[k * size : (k + 1) * size], moved[k * size : (k + 1) * size]) for size in [ROWS // SLICES] for k in range(SLICES)]
                for k, weight, move in [*parts, (SLICES, gain_rest, _rest(own.model) - _rest(old.model))]:
                    at = np.flatnonzero(weight).astype(np.int32)
                    if len(at):
                        values = (k, lane, at.tobytes(), weight[at].tobytes(), np.ascontiguousarray(move[at], np.float32).tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, MOVE_TYPES)], names=MOVE_NAMES)

        rest, gain_rest = np.zeros(len(state.past_rest), np.float32), np.zeros(len(state.past_rest), np.float32)
        for r in _averaged(map_arrow(lanes, run, MOVE)).toArrow().to_pylist():
            at, gain, move = np.frombuffer(r["at"], np.int32), np.frombuffer(r["gain"], np.float32), np.frombuffer(r["move"], np.float32)
            if r["slice"] < SLICES:
                at = at + r["slice"] * (ROWS // SLICES)
                state.model.embedding[at] += move.reshape(-1, DIM)
                state.past_rows[at] += gain
            else:
                rest[at], gain_rest[at] = move, gain
        state.move(rest)
        state.past_rest += gain_rest
        shared.destroy()
    model = state.model
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for _, texts, y, lang, held in _opened(batches, before, held_out):
            chosen = np.flatnonzero(held)
            if len(chosen):
                scores = np.array([model.score(texts[i].astype(np.int32) + BASE, np.zeros(len(texts[i]), np.int64), 1, tables)[0] for i in chosen], np.float32)
                yield pa.RecordBatch.from_arrays([lang.values.take(pa.array(chosen)), pa.array(y[chosen].astype(np.int32)), pa.array(scores.view(np.int32))], names=["lang", "toxic", "bits"])

    model.thresholds, model.default_threshold = calibrate(materialize(map_arrow(lanes, judge, "lang string, toxic int, bits int"), "held-out"))
    return model


def score_documents(docs: DataFrame, model: Model | None, score: str = "toxicity", threshold: str = "toxicity_threshold") -> DataFrame:
    """docs with the score of each whole text and the threshold of its language, both double.

    The columns ``score`` and ``threshold`` must be new. Null and wordless
    texts score 0; a null or unknown language takes the common threshold. Rows
    are never dropped, merged or reordered by key; an empty table stays empty.
    """
    if model is None:
        return docs.withColumn(score, F.lit(0.0)).withColumn(threshold, F.lit(1.0))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(score), F.lit(0.0).alias(threshold)).schema
    t, g = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for batch in batches:
            column = batch.column(t)
            _, offsets = string_buffers(column)
            scores = np.zeros(len(column))
            for i, j in doc_slices(offsets, 1 << 19):
                ids, doc = word_ids(column.slice(i, j - i))
                scores[i:j] = model.score(ids, doc, j - i, tables)
            cuts = [model.thresholds.get(x or "", model.default_threshold) for x in batch.column(g).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(cuts, pa.float64())], names=[*batch.schema.names, score, threshold])

    return map_arrow(docs, run, schema)


def toxic_documents(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents judged toxic: doc_id, lang, toxicity, threshold.

    Null and wordless texts are not toxic; a very long text is scored whole; repeated rows repeat, a null doc_id or lang stays null; without
    a label of each class, or documents, there are no rows. Other columns are ignored.
    """
    model = fit(docs, labels, **parameters)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), model)
    return scored.filter("toxicity >= toxicity_threshold").select("doc_id", "lang", F.col("toxicity"), F.col("toxicity_threshold").alias("threshold"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """docs without the documents judged toxic; all columns as they were, those that have names of this operator's own too.

    Rows are judged one by one: repeated rows all stay or all go; null and wordless texts, rows of null doc_id or lang with clean texts, and, where a class has
    no label, all rows stay; an empty table stays empty.
    """
    model = fit(docs, labels, **parameters)
    s, t = fresh(docs, "toxicity", "toxicity_threshold")
    return score_documents(docs, model, s, t).filter(F.col(s) < F.col(t)).drop(s, t)
