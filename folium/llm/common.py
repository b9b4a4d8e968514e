"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch between Spark and Python: texts are long, and a worker holds a batch and what is made of it.
BATCH_ROWS = 2000


def short_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_ROWS`` rows in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to clash with no column (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none and runs on this machine alone (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        else:
            found = tempfile.mkdtemp(prefix="folium-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def runs(df: DataFrame, keys: list[str], order: list[str], schema: str, fn: Callable[[dict], dict | None], n: int | None = None) -> DataFrame:
    """Deal rows by ``keys``, sort them, and give ``fn`` the rows of one key at a time as numpy arrays or lists.

    Only one run is held at a time, so the caller bounds what a key may gather. ``fn`` returns
    columns by name, or None for no rows.
    """
    import pyspark.sql.types as T

    out = T._parse_datatype_string(schema)
    arrow_schema = _to_arrow(out)
    plain = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType, T.DoubleType))}

    def emit(parts: list[dict]) -> pa.RecordBatch:
        cols = []
        for f in arrow_schema:
            values = [p[f.name] for p in parts]
            if isinstance(values[0], np.ndarray):
                cols.append(pa.array(np.concatenate(values), type=f.type))
            else:
                cols.append(pa.array([x for v in values for x in v], type=f.type))
        return pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        done: list[dict] = []
        count = 0

        def close() -> None:
            nonlocal held, count
            if held:
                t = pa.concat_tables(held).combine_chunks()
                r = fn({c: (t[c].to_numpy() if c in plain else t[c].to_pylist()) for c in t.column_names})
                if r is not None and len(next(iter(r.values()))):
                    done.append(r)
                    count += len(next(iter(r.values())))
                held = []

        for b in batches:
            if not b.num_rows:
                continue
            change = np.zeros(b.num_rows, bool)
            for k in keys:
                v = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            t = pa.Table.from_batches([b])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(b.column(b.schema.get_field_index(k))[s].as_py() for k in keys)
                if key != last:
                    close()
                    last = key
                held.append(t.slice(s, e - s))
            if count >= 5000:
                yield emit(done)
                done, count = [], 0
        close()
        if done:
            yield emit(done)

    dealt = df.repartition(n or width(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(go, schema)


def _to_arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
