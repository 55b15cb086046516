"""Records that are the same but for white space, letter case, punctuation or the order of JSON members."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.storage import checkpointed

TEXTS = ("tool_name", "server_name", "tool_purpose")
SCHEMA = "input_schema_raw"


def plain(x):
    """A parsed JSON value with whole floats as integers, as 1.0 and 1 are one value."""
    if isinstance(x, float) and x.is_integer():
        return int(x)
    if isinstance(x, list):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


def canonical_json(text: str | None) -> str:
    """One spelling for each JSON value; null gives "-", what can't be parsed gives itself after "!"."""
    if text is None:
        return "-"
    try:
        return "=" + json.dumps(plain(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return "!" + text


def with_canonical(df: DataFrame) -> DataFrame:
    """Adds ``canon``, the full canonical text of a record, in place of the raw fields."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [p + "\x1f" + canonical_json(j) for p, j in zip(b["letters"].to_pylist(), b["j"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["raw"], b["copies"], b["first_id"], pa.array(found, pa.string())], ["raw", "copies", "first_id", "canon"])

    bare = [F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+", "") for c in TEXTS]
    cut = df.select("raw", "copies", "first_id", F.concat_ws("\x1f", *bare).alias("letters"), F.col(SCHEMA).alias("j"))
    return cut.mapInArrow(spell, "raw binary, copies long, first_id string, canon string")


def raw_key():
    """128 bits that name a raw row; nulls and empty texts differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in (*TEXTS, SCHEMA)]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.md5(F.concat(*sized).cast("binary")))


def identical(df: DataFrame, id_col: str = "tool_id") -> DataFrame:
    """The distinct raw rows: raw (key), first_id, copies (distinct ids), and their fields. Deliveries of one id count once."""
    fields = [*TEXTS, SCHEMA]
    rows = df.select(F.col(id_col).cast("string").alias("id"), *[F.col(c).cast("string").alias(c) for c in fields]).where("id IS NOT NULL")
    once = rows.groupBy(raw_key().alias("raw"), "id").agg(*[F.first(c).alias(c) for c in fields])
    return once.groupBy("raw").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"), *[F.first(c).alias(c) for c in fields])


def collapsed(df: DataFrame, id_col: str = "tool_id") -> DataFrame:
    """One row for each set of same records: keeper_id (the smallest id) and copies (distinct ids).

    Byte-identical raw rows are counted first, so a record delivered or copied a billion times is one row before any
    text is canonicalised; the survivors are grouped again on their full canonical text. Null fields count as empty, a
    null schema equals only a null schema, a schema that can't be parsed only itself; rows with a null id take no part;
    an empty table gives no row; other columns are ignored.
    """
    return with_canonical(identical(df, id_col)).groupBy("canon").agg(F.min("first_id").alias("keeper_id"), F.sum("copies").alias("copies")).select("keeper_id", "copies")


def copies(df: DataFrame, id_col: str = "tool_id") -> DataFrame:
    """(keeper_id, copy_id) for each record that isn't its set's keeper; cases as in ``collapsed``.

    The survivors' canonical texts are named by their SHA-256, made once and kept in the shared folder.
    """
    survivors = checkpointed(with_canonical(identical(df, id_col)).select("raw", "first_id", F.unhex(F.sha2("canon", 256)).alias("canon")))
    keepers = survivors.groupBy("canon").agg(F.min("first_id").alias("keeper_id"))
    keeper_of = survivors.join(keepers, "canon").select("raw", "keeper_id")
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("copy_id"), raw_key().alias("raw"))
    return ids.join(keeper_of, "raw").where("copy_id <> keeper_id").select("keeper_id", "copy_id").distinct()
