"""Mixing sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import fresh


def water_fill(sizes: dict, weights: dict, budget: float, max_epochs: float) -> dict:
    """Epochs of each source: shares of budget in proportion to weight, none above max_epochs * size.

    Sources over their cap are clamped and what they leave is shared among
    the rest in proportion to weight, until all are feasible; if the caps hold less than the budget, all are at
    their cap. Sources without size or weight get 0.
    """
    open_ = sorted((s for s in sizes if sizes[s] > 0 and weights.get(s, 0) > 0), key=lambda s: (max_epochs * sizes[s] / weights[s], str(s)))
    epochs = {s: 0.0 for s in sizes}
    left, mass = float(budget), float(sum(weights[s] for s in open_))
    while open_:
        s = open_[0]
        cap = max_epochs * sizes[s]
        if left * weights[s] / mass < cap:
            break
        epochs[s] = float(max_epochs)
        left, mass = left - cap, mass - weights[s]
        open_ = open_[1:]
    for s in open_:
        epochs[s] = max(0.0, left) * weights[s] / mass / sizes[s]
    return epochs


def mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, budget_ratio: float = 1.0, max_epochs: float = 4.0, seed: str = "mix-1", source: str = "source", key: str = "doc_id", text: str = "text", copy: str | None = None, most_sources: int = 100_000) -> DataFrame:
    """docs, each repeated as its source's epochs say, to budget_ratio times the corpus in characters.

    A source's size is its texts' characters, counted over all rows. The whole
    part of the epochs is repetitions of every row; the fractional part keeps
    the rows whose seeded hash of key falls below it, the same rows in every
    run. Columns stay; with ``copy`` the number of the repetition is added.
    Rows of a null source form a source of their own, with default_weight; a
    null text has no characters and goes with its source; a null key hashes as
    an empty one. Equal keys are kept or left together, so repeated rows
    repeat. The table of sources goes to the driver: more than most_sources
    is an error.
    """
    spark = docs.sparkSession
    size = docs.groupBy(F.col(source).alias("s")).agg(F.sum(F.length(text)).alias("n")).limit(most_sources + 1).collect()
    if len(size) > most_sources:
        raise ValueError(f"more than {most_sources} sources; raise most_sources or group them")
    sizes = {r.s: float(r.n or 0) for r in size}
    wanted = {s: float(weights.get(s, default_weight)) if s is not None else default_weight for s in sizes}
    epochs = water_fill(sizes, wanted, budget_ratio * sum(sizes.values()), max_epochs)
    s, e, r = fresh(docs, "mix_source", "mix_epochs", "mix_copies")
    kind = docs.schema[source].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in epochs.items()], f"`{s}` {kind}, `{e}` double"))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = (F.floor(e) + F.when(unit < F.col(e) - F.floor(e), 1).otherwise(0)).cast("int")
    out = docs.join(table, F.col(source).eqNullSafe(F.col(s)), "inner").withColumn(r, copies).filter(F.col(r) > 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, F.explode(F.sequence(F.lit(1), F.col(r))).alias(copy or r)).select(*columns, *([copy] if copy else []))
