"""Static embeddings: word pieces to rows of a matrix, their mean normalised; with a table of vectors by content."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import ship

UNKNOWN = "[UNK]"
LONGEST_WORD = 100
_CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _is_punctuation(c: str) -> bool:
    return 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 or unicodedata.category(c)[0] == "P"


def words(text: str) -> list[str]:
    """Lower-case words without accents; control characters go, punctuation and ideographs stand alone."""
    spaced = []
    for c in text:
        if c in "\t\n\r" or unicodedata.category(c) == "Zs":
            spaced.append(" ")
        elif c in "\0�" or unicodedata.category(c)[0] == "C":
            continue
        elif any(a <= ord(c) <= b for a, b in _CJK):
            spaced.append(f" {c} ")
        else:
            spaced.append(c)
    plain = (c for c in unicodedata.normalize("NFD", "".join(spaced).lower()) if unicodedata.category(c) != "Mn")
    return "".join(f" {c} " if _is_punctuation(c) else c for c in plain).split()


def pieces(word: str, vocabulary: dict[str, int]) -> list[int]:
    """Greedy longest pieces, later ones marked ##; the unknown piece alone where one is missing or the word is too long."""
    unknown = [vocabulary[UNKNOWN]] if UNKNOWN in vocabulary else []
    if len(word) > LONGEST_WORD:
        return unknown
    found, start = [], 0
    while start < len(word):
        mark = "##" if start else ""
        end = next((e for e in range(len(word), start, -1) if mark + word[start:e] in vocabulary), None)
        if end is None:
            return unknown
        found.append(vocabulary[mark + word[start:end]])
        start = end
    return found


def read_vocabulary(path: str) -> dict[str, int]:
    """A piece on each line; its number is the line's."""
    with open(path, encoding="utf-8") as lines:
        return {line.rstrip("\r\n"): n for n, line in enumerate(lines)}


def read_matrix(path: str) -> np.ndarray:
    """The one tensor of a safetensors file: two dimensions, 32-bit floats."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) < 8:
        raise ValueError(f"{path}: no header")
    size = int.from_bytes(raw[:8], "little")
    if size > len(raw) - 8:
        raise ValueError(f"{path}: the header is longer than the file")
    tensors = {k: v for k, v in json.loads(raw[8 : 8 + size]).items() if k != "__metadata__"}
    if len(tensors) != 1:
        raise ValueError(f"{path}: {len(tensors)} tensors")
    (tensor,) = tensors.values()
    shape, (start, end) = tensor["shape"], tensor["data_offsets"]
    if tensor["dtype"] != "F32" or len(shape) != 2 or end - start != 4 * shape[0] * shape[1] or 8 + size + end > len(raw):
        raise ValueError(f"{path}: {tensor}")
    return np.frombuffer(raw, "<f4", shape[0] * shape[1], 8 + size + start).reshape(shape)


class Embedder:
    """Texts to unit vectors. The matrix goes to the workers once, as a broadcast."""

    def __init__(self, vocabulary: dict[str, int], matrix: np.ndarray):
        if max(vocabulary.values(), default=-1) >= len(matrix):
            raise ValueError("the vocabulary has pieces without a row")
        self.vocabulary, self.matrix = vocabulary, matrix

    @classmethod
    def load(cls, vocabulary: str, matrix: str) -> Embedder:
        return cls(read_vocabulary(vocabulary), read_matrix(matrix))

    def embed(self, text: str) -> np.ndarray:
        """The mean of the pieces' rows but for unknown ones, of length 1; zeros where there are none."""
        unknown = self.vocabulary.get(UNKNOWN)
        rows = [p for w in words(text) for p in pieces(w, self.vocabulary) if p != unknown]
        if not rows:
            return np.zeros(self.matrix.shape[1])
        mean = self.matrix[rows].mean(0, dtype=np.float64)
        size = np.sqrt(mean @ mean)
        return mean / size if size else mean

    def vectors(self, docs: DataFrame, text: Column, key: str = "id") -> DataFrame:
        """(key, vector) of each row."""
        ship(docs.sparkSession)
        shared = docs.sparkSession.sparkContext.broadcast((self.vocabulary, self.matrix))

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = Embedder(*shared.value)
            for batch in batches:
                yield batch.map(lambda t: own.embed(t or "").tolist())

        return docs.select(key, run(text).alias("vector"))


def symbol_text() -> Column:
    """What a symbol is embedded by; the name counts twice."""
    return F.concat_ws(" ", "name", "name", "qualified_name", "signature", "docstring", "parent_symbol")


def refreshed(symbols: DataFrame, cached: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, text_sha, vector) of all symbols: taken from ``cached`` where id and text are as they were, embedded anew elsewhere; other rows of it go."""
    now = symbols.select("id", symbol_text().alias("text")).withColumn("text_sha", F.sha1("text"))
    kept = cached.join(now.select("id", "text_sha"), ["id", "text_sha"], "left_semi")
    missing = now.join(cached.select("id", "text_sha"), ["id", "text_sha"], "left_anti")
    made = embedder.vectors(missing.select(F.struct("id", "text_sha").alias("k"), "text"), F.col("text"), "k").select("k.id", "k.text_sha", "vector")
    return kept.select("id", "text_sha", "vector").unionByName(made)
