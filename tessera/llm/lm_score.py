"""LM scoring: a document's probability over all its segmentations into subwords."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import map_arrow

_MULT = np.uint64(0x9E3779B97F4A7C15)
_RUNS = re.compile(r" +[^ \n]*|\n[^ \n]*")
SPACE = "▁"


def pieces_of(text: str) -> list[str]:
    """The stretches of a text that no vocabulary piece crosses, as keys.

    A text is read as the vocabulary's own encoder reads it: with a space before
    it and spaces as marks. A key is a word with its space left out, more
    spaces in front of it if it has several, or a line break and the word next to it.
    """
    if "  " in text or text[:1] == " ":
        return [m[1:] if m[0] == " " else m for m in _RUNS.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def symbols(key: str) -> str:
    """What the lattice of a key is built over."""
    return key if key[:1] == "\n" else SPACE + key.replace(" ", SPACE)


@dataclass
class Vocabulary:
    """Hashes of all beginnings of pieces, the number of the piece that each is (-1: only a beginning), and log probabilities.

    The numbers after the last piece are that of a byte and that of no edge.
    """

    keys: np.ndarray
    numbers: np.ndarray
    longest: int
    logp: np.ndarray

    @property
    def byte(self) -> int:
        return len(self.logp) - 2

    def with_logp(self, logp: np.ndarray) -> Vocabulary:
        return Vocabulary(self.keys, self.numbers, self.longest, np.append(logp, -np.inf))


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_MULT) + ord(c) + 1) & (1 << 64) - 1
    return h


def vocabulary(pieces: Iterable[tuple[str, float]], ranked: bool | None = None, shift: float = 2.7) -> Vocabulary:
    """From (piece, score) pairs. Scores that are log probabilities are normalised.

    Scores that are negated merge ranks (any below -100, or ``ranked``) are not logarithms; they weigh pieces by the Zipf-Mandelbrot
    law 1 / (rank + shift). Each of the 256 bytes that spell characters without a piece weighs as the least ranked piece.
    Pieces with a space mark after another character are left out: they would cross words.
    """
    kept = [(p, float(s)) for p, s in pieces if p and SPACE not in p.lstrip(SPACE) and "\n" not in p]
    scores = np.array([s for _, s in kept])
    if ranked if ranked is not None else scores.min() < -100:
        scores = -np.log(np.maximum(-scores, 0) + shift)
    logp = np.append(scores, np.sort(scores[scores > -20])[0] if (scores > -20).any() else scores.min())
    top = logp.max()
    mass = np.exp(logp - top)
    logp = logp - top - np.log(mass[:-1].sum() + 256 * mass[-1])
    table: dict[int, int] = {}
    for n, (piece, _) in enumerate(kept):
        for k in range(1, len(piece)):
            table.setdefault(_hash(piece[:k]), -1)
        table[_hash(piece)] = n
    keys = np.array(sorted(table), np.uint64)
    return Vocabulary(keys, np.array([table[int(k)] for k in keys], np.int64), max(len(p) for p, _ in kept), np.append(logp, -np.inf))


def load_vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return vocabulary((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))


class Lattices:
    """The lattices of keys of one length: the piece on each edge, by its length and start."""

    def __init__(self, vocab: Vocabulary, chars: np.ndarray):
        k, n = chars.shape
        self.vocab, self.k, self.n = vocab, k, n
        self.edges: list[np.ndarray] = []
        h = np.zeros((k, n), np.uint64)
        alive = np.ones(k * n, bool)
        with np.errstate(over="ignore"):
            for size in range(1, min(vocab.longest, n) + 1):
                m = n - size + 1
                h = h[:, :m] * _MULT + chars[:, size - 1 :] + np.uint64(1)
                if size > 1:
                    alive = np.ascontiguousarray(alive.reshape(k, m + 1)[:, :m]).ravel()
                at = np.flatnonzero(alive)
                if not len(at):
                    break
                hv = h.ravel()[at]
                place = np.minimum(np.searchsorted(vocab.keys, hv), len(vocab.keys) - 1)
                hit = vocab.keys[place] == hv
                number = np.full(k * m, -1, np.int64)
                number[at[hit]] = vocab.numbers[place[hit]]
                alive = np.zeros(k * m, bool)
                alive[at[hit]] = True
                self.edges.append(number.reshape(k, m))
        c = chars.astype(np.int64)
        spelt = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        self.spelt = np.where(self.edges[0] < 0, spelt, 0)  # bytes of a character without a piece
        self.live = [(e >= 0).any(0) for e in self.edges]

    def _weights(self, logp: np.ndarray) -> list[np.ndarray]:
        out = [logp[e] for e in self.edges]  # -1 is the last, -inf
        out[0] = np.where(self.spelt > 0, self.spelt * logp[self.vocab.byte], out[0])
        return out

    def forward(self, logp: np.ndarray, weights=None) -> np.ndarray:
        """Log probability of each beginning of the keys: (keys, length + 1)."""
        w = weights or self._weights(logp)
        alpha = np.full((self.k, self.n + 1), -np.inf)
        alpha[:, 0] = 0
        for t in range(self.n):
            for size, part in enumerate(w, 1):
                if t < part.shape[1] and (size == 1 or self.live[size - 1][t]):
                    alpha[:, t + size] = np.logaddexp(alpha[:, t + size], alpha[:, t] + part[:, t])
        return alpha

    def expected(self, logp: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, and of bytes, in ``count`` copies of the keys."""
        w = self._weights(logp)
        alpha = self.forward(logp, w)
        beta = np.full((self.k, self.n + 1), -np.inf)
        beta[:, self.n] = 0
        for t in range(self.n - 1, -1, -1):
            for size, part in enumerate(w, 1):
                if t < part.shape[1] and (size == 1 or self.live[size - 1][t]):
                    beta[:, t] = np.logaddexp(beta[:, t], part[:, t] + beta[:, t + size])
        total = np.zeros(len(logp) - 1)
        for size, (e, part) in enumerate(zip(self.edges, w), 1):
            m = part.shape[1]
            log = alpha[:, :m] + part + beta[:, size:] - alpha[:, self.n :]
            uses = np.where(np.isfinite(log), np.exp(np.minimum(log, 0)), 0) * count[:, None]
            on = e >= 0
            total[: self.vocab.byte] += np.bincount(e[on], uses[on], self.vocab.byte)
            if size == 1:
                total[self.vocab.byte] += (uses * self.spelt).sum()
        return total


def grouped(keys: list[str], vocab: Vocabulary, cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, Lattices]]:
    """(places of keys, their lattices), keys of one length together and so many at once."""
    texts = [symbols(k) for k in keys]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(sizes, kind="stable")
    ends = np.flatnonzero(np.r_[np.diff(sizes[order]) != 0, True]) + 1 if len(order) else []
    start = 0
    for end in ends:
        n = int(sizes[order[start]])
        step = max(1, cells // n)
        for at in range(start, end, step):
            own = order[at : min(end, at + step)]
            flat = np.frombuffer("".join(texts[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield own, Lattices(vocab, flat.reshape(len(own), n).astype(np.uint64))
        start = end


def log_probabilities(keys: list[str], vocab: Vocabulary, lanes: list[np.ndarray]) -> np.ndarray:
    """(lanes, keys): each key's log probability over all segmentations, under each set of log probabilities."""
    out = np.zeros((len(lanes), len(keys)))
    for own, lattice in grouped(keys, vocab):
        for lane, logp in enumerate(lanes):
            out[lane, own] = lattice.forward(logp)[:, -1]
    return out


def key_counts(docs: DataFrame, hold: int = 300_000) -> DataFrame:
    """(key, n) over all texts: how often each stretch occurs in the corpus. A worker holds ``hold`` keys, then hands them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(pieces_of(text))
                    if len(counts) > hold:
                        yield flush()
        yield flush()

    return map_arrow(docs.select(F.col("text").cast("string")), run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def corpus_logp(docs: DataFrame, vocab: Vocabulary, prior: float = 10_000.0) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces in this corpus: one step of expectation and maximisation.

    Each different stretch of the corpus is counted once over the cluster and its lattice weighted by
    that count; the vocabulary's own probabilities are worth ``prior`` uses. What comes to the driver is bounded by the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        total = np.zeros(len(vocab.logp) - 1)
        for batch in batches:
            keys, count = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float)
            for own, lattice in grouped(keys, vocab):
                total += lattice.expected(vocab.logp, count[own])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "uses"])

    rows = map_arrow(key_counts(docs), run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
    uses = np.zeros(len(vocab.logp) - 1)
    uses[rows["piece"].to_numpy()] = rows["uses"].to_numpy()
    own = np.exp(vocab.logp[:-1])
    own[-1] *= 256
    p = (uses + prior * own) / (uses.sum() + prior)
    p[-1] /= 256
    return np.log(p)


SCHEMA = "doc_id long, n_chars long, n_stretches long, logprob double, bits_per_char double, corpus_logprob double, corpus_gain double"


def score_documents(docs: DataFrame, vocab: Vocabulary, adapted: np.ndarray | None = None, hold: int = 400_000) -> DataFrame:
    """Marginal log probability (natural) of every document of docs (doc_id, text), a row each.

    ``logprob`` sums over all segmentations of the whole text under the
    vocabulary's own scores; ``corpus_logprob`` does so under the pieces' probabilities in the
    corpus (corpus_logp, or ``adapted``); bits_per_char is of the first, corpus_gain is
    the gain of the second in bits a character. The text has the factors of its
    stretches, as no piece crosses them. An empty text has probability 1
    (logprob 0) and null rates; a null text has null everywhere but doc_id; a null doc_id stays;
    repeated rows repeat; other columns are ignored; an empty table gives no rows.
    """
    if adapted is None:
        adapted = corpus_logp(docs, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, vocab.logp, np.append(adapted, -np.inf)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, *lanes = shared.value
        place: dict[str, int] = {}
        values = np.zeros((len(lanes), 0))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= 1 << 20):
                    size += len(texts[to] or "")
                    to += 1
                lists = [pieces_of(t) if t else [] for t in texts[at:to]]
                lengths = np.fromiter(map(len, lists), np.int64, len(lists))
                keys = [k for ks in lists for k in ks]
                if len(place) > hold:
                    place, values = {}, values[:, :0]
                new = [k for k in dict.fromkeys(keys) if k not in place]
                if new:
                    place.update(zip(new, range(len(place), len(place) + len(new))))
                    values = np.concatenate([values, log_probabilities(new, vocab, lanes)], axis=1)
                index = np.fromiter(map(place.__getitem__, keys), np.int64, len(keys))
                own, fit = np.zeros((len(lanes), len(lists)))
                some = np.flatnonzero(lengths)
                if len(some):  # each text is summed by itself, so its digits do not hang on its neighbours
                    own[some], fit[some] = np.add.reduceat(np.ascontiguousarray(values[:, index]), (np.cumsum(lengths) - lengths)[some], axis=1)
                null = np.array([t is None for t in texts[at:to]])
                chars = np.array([len(t) if t else 0 for t in texts[at:to]])
                bare = null | (chars == 0)
                scale = np.log(2) * np.maximum(chars, 1)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(chars, mask=null), pa.array(lengths, mask=null), pa.array(own, mask=null), pa.array(-own / scale, mask=bare), pa.array(fit, mask=null), pa.array((fit - own) / scale, mask=bare)],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )
                at = to

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)
