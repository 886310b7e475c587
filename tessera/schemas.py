"""The engine's tables. An edge runs from the dependent (src) to what it depends on (dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _B, _D, _TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CALL_SITE = _struct(callee=_S, line=_I, argc=_I, args=T.ArrayType(_S), generic=_B)
SYMBOLS = _struct(
    id=_S, file_path=_S, blob_sha=_S, language=_S, kind=_S, name=_S, qualified_name=_S, signature=_S, docstring=_S,
    span=_struct(start=_I, end=_I), imports=T.ArrayType(_S), exports=_B, raw_text=_S, parent_symbol=_S, token_estimate=_I,
    modifiers=T.ArrayType(_S), type_parameters=T.ArrayType(_S), annotations=T.ArrayType(_S),
    call_sites=T.ArrayType(CALL_SITE), attr_sites=T.ArrayType(CALL_SITE),
)
EDGES = _struct(src=_S, dst=_S, type=_S, confidence=_D, source=_S, reason=_S)
MANIFEST = _struct(file_path=_S, blob_sha=_S, language=_S, symbol_count=_I, indexed_at=_TS)
POSTINGS = _struct(part=_I, term=_S, id=_S, weight=_D, norm=_D, idf=_D)
VECTORS = _struct(id=_S, text_sha=_S, vector=T.ArrayType(_D))
LEASES = _struct(lock_key=_S, intent_id=_S, acquired_at=_TS, expires_at=_TS)

KINDS = ("function", "method", "constructor", "class", "interface", "type", "const", "enum", "module", "namespace", "variable", "field", "struct", "trait", "decorator", "annotation", "file", "document")
CALLABLE = ("function", "method", "constructor")
TYPE_LIKE = ("class", "interface", "type", "enum", "struct", "trait")
EDGE_TYPES = ("defines", "imports", "calls", "extends", "implements", "uses-type", "tests", "contains", "overrides")
IMPACT_TYPES = ("calls", "tests", "contains", "implements", "extends", "uses-type")
CLOSURE_TYPES = ("calls", "contains", "implements", "extends", "uses-type")


def complete(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in the schema's order and types; a column that it lacks is empty ('' / 0 / false / []), a struct null."""
    columns = []
    for f in schema.fields:
        kind = f.dataType
        if f.name in df.columns:
            columns.append(F.col(f.name).cast(kind).alias(f.name))
        elif isinstance(kind, T.ArrayType):
            columns.append(F.array().cast(kind).alias(f.name))
        elif isinstance(kind, (T.StructType, T.TimestampType)):
            columns.append(F.lit(None).cast(kind).alias(f.name))
        else:
            columns.append(F.lit({"string": "", "boolean": False}.get(kind.simpleString(), 0)).cast(kind).alias(f.name))
    return df.select(*columns)


def is_callable(kind="kind"):
    return F.col(kind).isin(*CALLABLE)


def is_type(kind="kind"):
    return F.col(kind).isin(*TYPE_LIKE)
