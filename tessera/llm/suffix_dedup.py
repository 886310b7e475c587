"""Passages of many words that repeat across documents, by a distributed, sparse suffix array.

Suffixes start at anchors: the words whose following GRAM words hash least in some window of ``length``
words. The same passage has the same anchors wherever it stands, and every window of ``length`` words has
one, so anchored suffixes find every repeat while they are a small share of all suffixes.
Anchors that no other document has are left out first. The suffixes of the rest are range-partitioned at
sampled splitters by their leading words, each bucket is sorted by multikey quicksort, and windows that agree
to the right (by common prefixes) and to the left of their anchor are repeats. A run of suffixes
that reaches over a bucket's splitter is told by comparison with the splitter and settled together with the next bucket's.
No splitter parts suffixes that begin alike, as those of boilerplate do: where an anchor has more of them than a bucket
should hold, they are spread over parts of the bucket, and windows that a part cannot settle are settled across the parts.
A suffix carries no more words than the windows of its anchor reach: what lies beyond decides nothing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import map_arrow, materialize
from tessera.llm.textkit import SPACE, doc_slices, hash_words, mix64, string_buffers

LENGTH = 50
GRAM = 16
#: Words of a suffix that splitters look at.
DEPTH = 24
_U64 = np.uint64
_STEP = _U64(0x9FB21C651E98DF25)


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours, in log(width) passes."""
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` words, by doubling."""
    if len(h) < gram:
        return np.zeros(0, _U64)
    out, have = h, 1
    with np.errstate(over="ignore"):
        while have < gram:
            step = min(have, gram - have)
            out = mix64(out[:-step] * _STEP + out[step:])
            have += step
    return out


def anchors(h: np.ndarray, doc: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, fewest and most words to their left) of the anchors of texts' words.

    Every window of ``length`` words belongs to one anchor, the leftmost of its least grams; the last two tell how
    far left of the anchor its windows begin.
    """
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, np.zeros(0, _U64), none, none
    g = _gram_hashes(h, gram)
    width = length - gram + 1
    low = _sliding(g, width, np.minimum)
    valid = np.flatnonzero(doc[: len(low)] == doc[length - 1 :])
    if not len(valid):
        return none, np.zeros(0, _U64), none, none
    # the leftmost place of the least gram of each valid window: the next place from its start with that value
    least = low[valid]
    place = valid.copy()
    todo = np.flatnonzero(g[place] != least)
    while len(todo):
        place[todo] += 1
        todo = todo[g[place[todo]] != least[todo]]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    at = place[first]
    return at, g[at], at - valid[last], at - valid[first]


def _packed(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of words as binary values: 64 bits a word, big end first, never 0."""
    total = np.concatenate([[0], np.cumsum(size)])
    within = np.arange(total[-1]) - np.repeat(total[:-1], size)
    words = (h[np.repeat(start, size) + within] | _U64(1)).astype(">u8")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((total * 8).astype(np.int32)), pa.py_buffer(words)])


def _unpacked(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) words, 0 where there is none, and how many each row has."""
    n = len(column)
    if not n:
        return np.zeros((0, width), _U64), np.zeros(0, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    size = np.diff(off) // 8
    out = np.zeros((n, width), _U64)
    words = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(">u8") if off[-1] > off[0] else np.zeros(0, ">u8")
    out[np.arange(width) < size[:, None]] = words
    return out, size


def multikey_quicksort(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of rows of words, each a suffix of its size: three-way partition by one word at a time.

    Rows that agree on their next words skip them all at once, and a handful of rows is finished by sorting it whole. Words are compared as numbers above 0; of
    equal beginnings the shorter row is first.
    """
    n, width = words.shape
    keyed = np.where(np.arange(width) < size[:, None], words, 0)  # the end is less than any word
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth >= width:
            continue
        rows = order[lo:hi]
        part = keyed[rows, depth:]
        differs = (part != part[0]).any(0)
        if not differs.any():
            continue
        skip = int(differs.argmax())
        if hi - lo <= 24:
            order[lo:hi] = rows[np.lexsort(part[:, skip:][:, ::-1].T)]
            continue
        depth += skip
        word = part[:, skip]
        pivot = np.partition(word, len(word) // 2)[len(word) // 2]
        less, more = word < pivot, word > pivot
        same = ~(less | more)
        order[lo:hi] = np.concatenate([rows[less], rows[same], rows[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _common(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows."""
    differs = a != b
    first = np.where(differs.any(1), differs.argmax(1), a.shape[1])
    return np.minimum(first, np.minimum(na, nb))


def _scan_bucket(doc, at, fewest, most, parts, right, n_right, left, low, high, length, gram):
    """(spans, open windows) of one bucket of suffixes; low and high are the splitters at its ends, as rows of words or None.

    Spans are (doc, first word, end, other doc); open windows (hash, doc, first word) are those
    of runs that may go on elsewhere: in a neighbouring bucket, or in another part where ``parts`` is above 1. Of a window that two
    documents here have, two rows tell the others of it; of one that a single document has, each of its places is a row.
    """
    order = multikey_quicksort(right, n_right)
    doc, at, fewest, most, parts, right, n_right, left = (x[order] for x in (doc, at, fewest, most, parts, right, n_right, left))
    n = len(doc)
    lcp = np.zeros(n, np.int64)  # with the row before
    lcp[1:] = _common(right[1:], right[:-1], n_right[1:], n_right[:-1])
    heads = np.flatnonzero(lcp < gram)
    run = np.cumsum(lcp < gram) - 1
    opened = np.maximum.reduceat(parts, heads) > 1
    for edge in (low, high):
        if edge is not None and len(edge) >= gram:
            opened |= (right[heads, :gram] == edge[:gram]).all(1)
    lo_doc = np.minimum.reduceat(doc, heads)
    hi_doc = np.maximum.reduceat(doc, heads)
    is_open = opened[run]
    alive = (lo_doc != hi_doc)[run] | is_open
    if not alive.any():
        return [], []
    back = length - gram
    left_hash = np.zeros((n, back + 1), _U64)
    with np.errstate(over="ignore"):
        for k in range(back):
            left_hash[:, k + 1] = mix64(left_hash[:, k] * _STEP + left[:, k] + _U64(1))
    hits, open_rows = [], []
    for k in range(back + 1):  # windows that begin k words left of their anchor
        own = np.flatnonzero(alive & (fewest <= k) & (k <= most))
        if not len(own):
            continue
        need = length - k
        interval = np.cumsum(lcp < need)  # rows that agree on the next ``need`` words
        with np.errstate(over="ignore"):
            key = mix64(left_hash[own, k] * _STEP + interval[own].astype(_U64))
        sort = np.lexsort((at[own], doc[own], key))
        own, key = own[sort], key[sort]
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(key)])
        least, greatest = np.repeat(doc[own[first]], size), np.repeat(doc[own[first + size - 1]], size)
        ok = least != greatest
        own_doc = doc[own[ok]]
        hits.append(np.stack([own_doc, at[own[ok]] - k, np.where(least[ok] == own_doc, greatest[ok], least[ok])], axis=1))
        moved = np.r_[True, (doc[own][1:] != doc[own][:-1]) | (at[own][1:] != at[own][:-1])]
        end = np.r_[new[1:], True]
        free = own[is_open[own] & np.where(ok, new | end, new | moved)]
        if len(free):
            h = left_hash[free, k]
            with np.errstate(over="ignore"):
                for c in range(need):
                    h = mix64(h * _STEP + right[free, c] + _U64(7))
            open_rows.append(np.stack([h.view(np.int64), doc[free], at[free] - k], axis=1))
    spans = []
    if hits:
        hit = np.concatenate(hits)
        hit = hit[np.lexsort((hit[:, 1], hit[:, 0]))]
        if len(hit):
            begin = np.r_[True, (hit[1:, 0] != hit[:-1, 0]) | (hit[1:, 1] > hit[:-1, 1] + 1)]
            first = np.flatnonzero(begin)
            last = np.r_[first[1:], len(hit)] - 1
            spans = [np.stack([hit[first, 0], hit[first, 1], hit[last, 1] + length, hit[first, 2]], axis=1)]
    return spans, open_rows


def _shared_anchors(anchors: DataFrame, bucket_rows: int, most_hot: int = 100_000) -> tuple[DataFrame, int]:
    """(gram, row_key, parts, lead) of the anchors that several documents have, and their number; parts is how many buckets those of one gram fill.

    Grams are counted with partial aggregation. The join back to the anchors would gather a hot gram in one task: those with over
    one most_hot-th of the rows, no more than most_hot then, are broadcast.
    """
    counts = materialize(anchors.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("gram", "n"), "shared-grams")
    rows = int(counts.agg(F.sum("n")).first()[0] or 0)
    limit = max(bucket_rows, rows // most_hot)
    parts = F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts")
    hot = F.broadcast(counts.filter(F.col("n") > limit))
    usual = anchors.join(hot, "gram", "left_anti").join(counts.filter(F.col("n") <= limit), "gram")
    both = usual.unionByName(anchors.join(hot, "gram"))
    return materialize(both.select("gram", "row_key", parts, "lead"), "shared-anchors"), rows


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = 10_000, sampled: int = 100_000) -> DataFrame:
    """The stretches of documents (doc_id, text) whose every ``length`` words stand in another document too.

    Rows: doc_id, first_word, end_word (after the last), n_words, other_doc_id (one document that has the stretch's beginning). Words are
    what white space separates, compared by 63 bits of their hash. Stretches that overlap or touch are one. Repeats
    within one document alone are not reported; rows of one doc_id are one document. Null and
    short texts and null doc_ids have no rows; other columns are ignored; an empty table gives none.

    A task holds about bucket_rows suffixes at once, or twice as many. ``sampled`` heads of suffixes (192 bytes each) at most go to the driver to
    choose the splitters, one for every four of them at most; buckets beyond that are larger, and are read in turns that end between anchors.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    # rows alike in both columns have one key, as they have the same anchors
    texts = texts.withColumn("row_key", F.xxhash64("doc_id", "text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, offsets = string_buffers(batch.column(1))
            for i, j in doc_slices(offsets):
                h, doc, _, _ = hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACE)
                at, g, _, _ = anchors(h, doc, length, gram)
                owner = doc[at]
                order = np.lexsort((g, owner))
                at, g, owner = at[order], g[order], owner[order]
                new = np.r_[np.ones(min(len(g), 1), bool), (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])]
                at, g, owner = at[new], g[new], owner[new]
                key = keys[i:j][owner]
                some = mix64(g ^ key.view(_U64)) & _U64(31) == 0
                size = np.where(some, np.minimum(DEPTH, np.searchsorted(doc, doc[at], "right") - at), 0)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[i:j][owner]), pa.array(key), _packed(h, at, size)], names=["gram", "doc_id", "row_key", "lead"])

    every = materialize(map_arrow(texts, find, "gram long, doc_id long, row_key long, lead binary"), "anchors")
    shared, rows = _shared_anchors(every, bucket_rows)
    cells = max(1, -(-rows // bucket_rows))
    buckets = min(cells, max(1, sampled // 4))
    leads = shared.filter("length(lead) > 0").orderBy(F.xxhash64("gram", "row_key"), "gram", "row_key").select("lead").limit(sampled).toArrow()["lead"].to_pylist()
    leads.sort()
    splitters = sorted({leads[k * len(leads) // buckets] for k in range(1, buckets)}) if leads else []
    known = spark.sparkContext.broadcast(splitters)
    chosen = shared.groupBy("row_key").agg(F.collect_set(F.struct("gram", "parts")).alias("grams"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = known.value
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            data, offsets = string_buffers(batch.column(1))
            grams = batch.column(2)
            lists = grams.offsets.to_numpy().astype(np.int64)
            values, shares = grams.values.field(0).to_numpy().view(_U64), grams.values.field(1).to_numpy()
            for i, j in doc_slices(offsets):
                h, doc, _, _ = hash_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACE)
                at, g, fewest, most = anchors(h, doc, length, gram)
                if not len(at):
                    continue
                owner = np.repeat(np.arange(j - i), np.diff(lists[i : j + 1]))
                pairs = mix64(values[lists[i] : lists[j]]) + owner.astype(_U64) * _STEP
                order = np.argsort(pairs)
                pairs, share = pairs[order], shares[lists[i] : lists[j]][order]
                mine = mix64(g) + doc[at].astype(_U64) * _STEP
                place = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
                keep = pairs[place] == mine
                at, g, fewest, most, parts = at[keep], g[keep], fewest[keep], most[keep], share[place[keep]]
                if not len(at):
                    continue
                begin = np.searchsorted(doc, doc[at])
                end = np.searchsorted(doc, doc[at], "right")
                right = _packed(h, at, np.minimum(length - fewest, end - at))
                left = _packed(h[::-1], len(h) - at, most)
                bucket = np.array([bisect_left(splitters, x[: 8 * DEPTH]) for x in right.to_pylist()], np.int32)
                part = (mix64(keys[i:j][doc[at]].view(_U64) + at.astype(_U64)) % parts.astype(_U64)).astype(np.int32)
                columns = {"bucket": bucket, "part": part, "gram": g.view(np.int64), "parts": parts.astype(np.int32), "doc_id": ids[i:j][doc[at]], "at": (at - begin).astype(np.int32), "fewest": fewest.astype(np.int32), "most": most.astype(np.int32)}
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), right, left], names=[*columns, "right", "left"])

    found = map_arrow(texts.join(chosen, "row_key").select("doc_id", "text", "grams", "row_key"), suffixes, "bucket int, part int, gram long, parts int, doc_id long, at int, fewest int, most int, right binary, left binary")
    placed = found.repartition(min(2 * cells, 1 << 16), "bucket", "part").sortWithinPartitions("bucket", "part", "gram")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = known.value
        edge = lambda b: np.frombuffer(splitters[b], ">u8").astype(_U64) if 0 <= b < len(splitters) else None
        held: list[pa.RecordBatch] = []

        def finish(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            column = lambda name: table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
            b = int(table["bucket"][0].as_py())
            right, n_right = _unpacked(column("right"), length)
            left, _ = _unpacked(column("left"), length - gram)
            numbers = [column(c).to_numpy().astype(np.int64) for c in ("doc_id", "at", "fewest", "most", "parts")]
            spans, opened = _scan_bucket(*numbers, right, n_right, left, edge(b - 1), edge(b), length, gram)
            for rows in spans:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), *(pa.array(rows[:, c]) for c in range(4))], names=["window", "doc_id", "first_word", "end_word", "other"])
            for rows in opened:
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(rows[:, 2] + length), pa.nulls(len(rows), pa.int64())], names=["window", "doc_id", "first_word", "end_word", "other"])

        have, last = 0, None  # rows held, and where the last of them belongs
        for batch in batches:
            bucket, part, g = (batch.column(c).to_numpy() for c in range(3))
            hard = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            soft = np.flatnonzero((g[1:] != g[:-1]) | (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            at = 0
            while at < len(g):
                here = (bucket[at], part[at], g[at])
                if held and (here[:2] != last[:2] or have >= bucket_rows and here != last):
                    yield from finish(held)
                    held, have = [], 0
                # to the first anchor's end that fills the turn, but not into another bucket or part
                k = np.searchsorted(soft, at + max(1, bucket_rows - have))
                to = int(soft[k]) if k < len(soft) else len(g)
                k = np.searchsorted(hard, at, "right")
                to = min(to, int(hard[k])) if k < len(hard) else to
                held.append(batch.slice(at, to - at))
                have += to - at
                last = (bucket[to - 1], part[to - 1], g[to - 1])
                at = to
        if held:
            yield from finish(held)

    result = materialize(map_arrow(placed, scan, "window long, doc_id long, first_word long, end_word long, other long"), "repeats")
    opened = result.filter("window IS NOT NULL")
    several = opened.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi")
    across = opened.join(several, "window").select("doc_id", "first_word", "end_word", F.expr("if(lo = doc_id, hi, lo)").alias("other"))
    spans = result.filter("window IS NULL").drop("window").unionByName(across).groupBy("doc_id", "first_word", "end_word").agg(F.min("other").alias("other"))
    line = Window.partitionBy("doc_id").orderBy("first_word", "end_word", "other")
    ahead = F.max("end_word").over(line.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("ahead") >= F.col("first_word"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.withColumn("ahead", ahead).withColumn("island", island).groupBy("doc_id", "island")
        .agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.min_by("other", F.struct("first_word", "other")).alias("other_doc_id"))
        .select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "other_doc_id")
    )
