"""SHA-256 of all members of a group, in order, in constant memory.

A digest of a sequence reads its members one after the other, so a group is read
by one task; but it is sorted by Spark, which spills, and streams through the
hash without ever being an array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_digest(rows: DataFrame, keys: list[str], member: str, joiner: str = "\n", digits: int = 64, out: str = "digest") -> DataFrame:
    """Rows (keys, out): the first hex digits of the SHA-256 of a group's members, sorted as strings and joined.

    Members are cast to strings; nulls are left out, and a group of nothing else
    has the digest of the empty string.
    """
    body = rows.select(*keys, F.col(member).cast("string").alias("__member"))
    named = ", ".join(f"`{k}` {body.schema[k].dataType.simpleString()}" for k in keys)
    between = joiner.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        now, sha, begun, done = None, None, False, []

        def emit() -> pa.RecordBatch:
            arrays = [pa.array([d[0][i] for d in done], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([d[1] for d in done], pa.string())], [*keys, out])

        for batch in batches:
            kinds = kinds or [batch.schema.field(k).type for k in keys]
            columns = [batch[k].to_pylist() for k in keys]
            for key, own in groupby(zip(*columns, batch["__member"].to_pylist(), strict=True), key=lambda r: r[:-1]):
                if sha is None or key != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()[:digits]))
                    now, sha, begun = key, hashlib.sha256(), False
                held = [r[-1].encode() for r in own if r[-1] is not None]
                if held:
                    sha.update((between if begun else b"") + between.join(held))
                    begun = True
            if len(done) >= 1024:
                yield emit()
                done.clear()
        if sha is not None:
            done.append((now, sha.hexdigest()[:digits]))
        if done:
            yield emit()

    return body.repartition(*keys).sortWithinPartitions(*keys, "__member").mapInArrow(run, f"{named}, `{out}` string")
