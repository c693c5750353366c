"""Digests of long ordered lists: texts of a bounded number of items, which one task reads as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_sha256(rows: DataFrame, keys: Sequence[str], at: str, text: str, *, separator: str = ", ", head: str = "", tail: str = "", block: int = 4096) -> DataFrame:
    """(keys, n, sha256): for each key the SHA-256 of head, the texts in order of ``at`` (0, 1, ... without gaps) joined by the
    separator, and tail. SHA-256 reads in order, so a key's texts pass one task, but in blocks, and no more than one is held."""
    number = F.floor(F.col(at) / block)
    parts = rows.groupBy(*keys, number.alias("_part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, text))), lambda x: x[text]), separator).alias("_text"), F.count("*").alias("_n"))
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("sha256", T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, n, out = None, None, 0, []
        for b in batches:
            for *key, piece, count in zip(*(b.column(c).to_pylist() for c in (*keys, "_text", "_n")), strict=True):
                if key != now:
                    if now is not None:
                        sha.update(tail.encode())
                        out.append((*now, n, sha.hexdigest()))
                    now, n, sha = key, 0, hashlib.sha256(head.encode())
                else:
                    sha.update(separator.encode())
                sha.update(piece.encode())
                n += count
        if now is not None:
            sha.update(tail.encode())
            out.append((*now, n, sha.hexdigest()))
        if out:
            types = [b.schema.field(k).type for k in keys] + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*keys, "n", "sha256"])

    ordered = parts.repartition(*keys) if keys else parts.coalesce(1)
    return ordered.sortWithinPartitions(*keys, "_part").mapInArrow(hashed, schema)
