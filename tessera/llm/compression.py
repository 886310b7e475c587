"""Quality rule: bands of zstandard ratios over whole documents and over fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import map_arrow
from tessera.llm.textkit import string_buffers


@dataclass(frozen=True)
class Band:
    """Limits of compressed size / size for texts of fewer than below bytes."""

    below: float
    low: float
    high: float


#: A frame costs about a dozen bytes, so limits widen as texts get shorter; under 64 bytes a ratio says nothing.
BANDS = (
    Band(64, 0.0, float("inf")),
    Band(300, 0.30, 1.15),
    Band(1_000, 0.28, 0.90),
    Band(3_000, 0.22, 0.80),
    Band(10_000, 0.18, 0.75),
    Band(float("inf"), 0.16, 0.72),
)
CHUNK = 4096
CHUNK_BAND = Band(float("inf"), 0.20, 0.80)
SCHEMA = "doc_id long, n_bytes long, ratio double, min_chunk_ratio double, max_chunk_ratio double, bad_chunk_share double, verdict string"


def measure(text: bytes, compress, bands=BANDS, chunk=CHUNK, chunk_band=CHUNK_BAND, max_bad_share=0.5):
    """(ratio, least and greatest chunk ratio, share of bytes in chunks out of band, verdict) of one text."""
    n = len(text)
    if n == 0:
        return None, None, None, 0.0, "empty"
    ratio = len(compress(text)) / n
    band = next(b for b in bands if n < b.below)
    cuts = list(range(0, n, chunk)) + [n]
    if len(cuts) > 2 and n - cuts[-2] < chunk // 2:
        del cuts[-2]  # a short rest joins the chunk before it
    sizes = np.diff(cuts)
    if len(sizes) > 1:
        ratios = np.array([len(compress(text[a:b])) / (b - a) for a, b in zip(cuts, cuts[1:])])
        bad = float(sizes[(ratios < chunk_band.low) | (ratios > chunk_band.high)].sum() / n)
    else:
        ratios, bad = np.array([ratio]), 0.0
    if ratio < band.low:
        verdict = "repetitive"
    elif ratio > band.high:
        verdict = "incompressible"
    elif bad > max_bad_share:
        verdict = "repetitive chunks" if np.median(ratios) < chunk_band.low else "mixed chunks"
    else:
        verdict = "keep"
    return ratio, float(ratios.min()), float(ratios.max()), bad, verdict


def compression_ratios(docs: DataFrame, level: int = 3, bands=BANDS, chunk: int = CHUNK, chunk_band: Band = CHUNK_BAND, max_bad_share: float = 0.5) -> DataFrame:
    """A row of ratios and a verdict for each document; documents has doc_id and text, other columns are ignored.

    A text is rejected where its ratio leaves the band for its length in bytes
    (below: repetitive, above: incompressible), or where over max_bad_share of
    its bytes lie in chunks of ``chunk`` bytes out of chunk_band. Null and
    empty texts have null ratios and the verdict "empty". A null doc_id stays
    null. Repeated rows give repeated results; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            view = memoryview(data)
            rows = [(int(b - a), *measure(view[a:b], compress, bands, chunk, chunk_band, max_bad_share)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), *[pa.float64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "ratio", "min_chunk_ratio", "max_chunk_ratio", "bad_chunk_share", "verdict"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def compression_filter(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that compression_ratios keeps, with their ratios; null and empty texts go."""
    return compression_ratios(docs, **parameters).filter("verdict = 'keep'").drop("verdict")
