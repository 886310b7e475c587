"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import map_arrow, materialize
from tessera.runtime import ship

LENGTHS = (512, 1024, 2048, 4096)


def sequence_cost(length: int, window: int = 8192, overhead: int = 16) -> float:
    """Cost of training on one sequence: linear in its length, a part quadratic, and a constant for each sequence."""
    return overhead + length + length * length / window


def pack(lengths: list[int], sizes: tuple[int, ...] = LENGTHS, cost=sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and each bin's size: best fit in order of decreasing length.

    Every item goes to the open bin with the least room that holds it; if none
    does, a bin is opened whose size has the least cost for each token that it
    can be filled with by this item and what is still to come. At the end each
    bin gets the least size that holds its contents. Items must be from 1 to
    max(sizes) long.
    """
    sizes = tuple(sorted(sizes))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    ahead = sum(lengths)
    rooms: list[int] = []  # the different amounts of room, sorted
    having: dict[int, list[int]] = {}  # bins by room
    bins, offsets, fill = [0] * len(lengths), [0] * len(lengths), []
    for i in order:
        n = lengths[i]
        ahead -= n
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = having[room].pop()
            if not having[room]:
                del having[room], rooms[at]
        else:
            _, room = min((cost(c) / min(c, n + ahead), c) for c in sizes if c >= n)
            b = len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            left = room - n
            if left not in having:
                having[left] = []
                insort(rooms, left)
            having[left].append(b)
    return bins, offsets, [next(c for c in sizes if c >= f) for f in fill]


SCHEMA = "doc_id long, piece int, n_tokens int, shard int, bin int, bin_size int, bin_offset int"
COUNTS = "doc_id long, row long, n long"


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, row, n) of every row of docs: how many pieces the sentencepiece model file ``vocabulary`` makes of its whole text; none of null.

    ``row`` tells rows apart where doc_id is null or repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            counts = [len(model.encode(text.as_py())) if text.is_valid else 0 for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "row", "n"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id(), F.col("text").cast("string")), run, COUNTS)


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = LENGTHS, bytes_per_token: int = 4, shard_tokens: int = 1 << 24, vocabulary: str | None = None) -> DataFrame:
    """Each document's place in the packed sequences: a row for each piece of it.

    A document has the tokens that the sentencepiece model file ``vocabulary`` makes of its whole text; without a
    vocabulary ceil(n / bytes_per_token) are taken for n bytes, an estimate by which sequences may overflow. One longer than the
    greatest size is cut into pieces of that size and a rest, so no token is
    lost. Documents are spread by hash of their row's number over shards of about shard_tokens, each
    packed by itself; (shard, bin) names a sequence. Null and empty texts have
    no tokens and no row. Repeated rows are packed each by itself, null doc_ids
    too, and neither gather in one shard; other columns are ignored. An empty table gives no rows.
    The rows' numbers are written with the counts before anything is spread by them, so a task that is run again sees the same ones.
    """
    most = max(sizes)
    if vocabulary is None:
        tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.ceil(F.octet_length("text") / bytes_per_token).cast("long").alias("n"))
    else:
        tokens = count_tokens(docs, vocabulary)
    tokens = materialize(tokens, "token-counts").filter("n > 0")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    pieces = tokens.select(
        "doc_id",
        "row",
        F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"(n - 1) div {most}")), lambda k: F.least(F.lit(most).cast("long"), F.col("n") - k * most))).alias("piece", "n_tokens"),
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("n_tokens", "ascending"), ("row", "ascending")])
        bins, offsets, bin_sizes = pack(group["n_tokens"].to_pylist(), sizes)
        columns = {"bin": bins, "bin_size": [bin_sizes[b] for b in bins], "bin_offset": offsets}
        rest = [pa.array(x, pa.int32()) for x in columns.values()]
        return pa.Table.from_arrays([*(group[c].cast(pa.int64() if c == "doc_id" else pa.int32()) for c in ("doc_id", "piece", "n_tokens", "shard")), *rest], names=["doc_id", "piece", "n_tokens", "shard", *columns])

    ship(docs.sparkSession)
    return pieces.groupBy("shard").applyInArrow(run, SCHEMA)
