"""Shared pieces: tables cut out of the lineage, ids of texts, and the bundle/shard exchange.

Lineage is only ever cut by writing a parquet table below ``spark.checkpoint.dir``; that folder is
shared by the cluster, so losing an executor costs a re-run of a few tasks and nothing else.
"""

from __future__ import annotations

import contextlib
import contextvars
import inspect
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one bundle of documents holds on average.
BUNDLE_BYTES = 4 << 20
#: Bundles for each shard of keys.
BUNDLES_PER_SHARD = 4
#: Shards at least, so that small clusters stay busy.
LEAST_SHARDS = 12
#: Rows of a few numbers each that may be broadcast: some 10 MB.
BROADCAST_ROWS = 200_000

#: For oracles: CRC-32 (polynomial 0xEDB88320) of an ASCII string {0} in DuckDB, bit by bit.
CRC32 = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),"
    " lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) for z in range(8)]), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session may do without and gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="benchloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Tables that were written inside the innermost scratch().
_SCRATCH: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that written() makes inside, when what they were for has been written: results must be stored before the end."""
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in made:
            delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a parquet table in the shared folder, read back with the same schema."""
    path = f"{shared_dir(df.sparkSession)}/benchloom-{name}-{uuid.uuid4().hex}"
    if (made := _SCRATCH.get()) is not None:
        made.append(path)
    return stored(df, path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as a parquet table of its own name, in place of what a run that did not end left there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later plan reads."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, file)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcasting if it has at most so many rows of a few numbers each; else a shuffle joins it."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bundled(docs: DataFrame, doc_id: str, text: str, keep: list[str] = ()) -> tuple[DataFrame, int, int]:
    """(bundle, doc_id, text as bytes), the number of bundles and of shards.

    A row's bundle follows from its id and text, so a lost task builds the same bundles again, and
    copies of a text spread over all of them. The number of bundles follows from the bytes of all
    texts. Rows that agree in id and text are interchangeable. Columns of keep ride along as keep_0, ...
    """
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n_bundles = max(1, -(-total // BUNDLE_BYTES))
    n_shards = max(LEAST_SHARDS, n_bundles // BUNDLES_PER_SHARD)
    key = F.pmod(F.xxhash64(F.col(doc_id), F.xxhash64(F.col(text))), F.lit(n_bundles)).cast("int")
    rows = docs.select(key.alias("bundle"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    return rows, n_bundles, n_shards


def texts_of(arrow_table) -> tuple[np.ndarray, np.ndarray, list, object]:
    """Rows of a bundle in their fixed order: the bytes of all texts, offsets, ids, and the table.

    Null texts count as empty. Order: id (nulls last), then text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    t = arrow_table.combine_chunks()
    order = pc.sort_indices(pa.table({"i": t["doc_id"], "t": t["text"]}), sort_keys=[("i", "ascending"), ("t", "ascending")])
    t = t.take(order)
    col = pc.fill_null(t["text"], b"").cast(pa.large_binary()).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offsets[-1] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], t["doc_id"].to_pylist(), t


def by_shard(shard: np.ndarray) -> tuple[np.ndarray, list, list]:
    """A stable order that puts the keys of a shard together, the shards that have any, and where they begin in it."""
    order = np.argsort(shard, kind="stable")
    held = shard[order]
    at = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.empty(0, np.int64)
    return order, held[at].tolist(), [*at.tolist(), len(held)]


def asks_table(bundle: int, shard: np.ndarray, *columns: np.ndarray):
    """Rows (shard, bundle, one binary for each column) from keys of a bundle."""
    import pyarrow as pa

    order, full, at = by_shard(shard)
    cols = [c[order] for c in columns]
    return pa.table(
        {"shard": pa.array(full, pa.int32()), "bundle": pa.array([bundle] * len(full), pa.int32())}
        | {f"k{i}": pa.array([c[s:e].tobytes() for s, e in zip(at, at[1:])], pa.binary()) for i, c in enumerate(cols)}
    )


ASKS = "shard int, bundle int, "
ANSWERS = "bundle int, shard int, answer binary"


def gathered(arrow_table, *dtypes) -> tuple[list, np.ndarray, list[np.ndarray]]:
    """The bundles that ask, how many keys each has, and the joined columns of a shard.

    Arrow joins the values of a column, so a shard's keys are held once more and not as objects too.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    cols, sizes = [], np.empty(0, np.int64)
    for i, d in enumerate(dtypes):
        col = arrow_table[f"k{i}"].cast(pa.large_binary()).combine_chunks()
        if i == 0:
            sizes = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(d).itemsize
        at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else (0, 0)
        size = int(at[-1] - at[0])
        cols.append(np.frombuffer(col.buffers()[2], d, size // np.dtype(d).itemsize, int(at[0])) if size else np.empty(0, d))
    return arrow_table["bundle"].to_pylist(), sizes, cols


def give_back() -> None:
    """Return a worker's free memory to the machine; where the C library can't, nothing happens."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(function):
    """function of one or two Arrow tables; after each call the worker gives its free memory back.

    Workers live on between stages, and an executor holds several: what one keeps, the next stage lacks.
    """

    def one(t):
        out = function(t)
        give_back()
        return out

    def two(t, other):
        out = function(t, other)
        give_back()
        return out

    return one if len(inspect.signature(function).parameters) == 1 else two


def answers_table(shard: int, bundles: list, sizes: np.ndarray, answer: np.ndarray):
    """Rows (bundle, shard, answer): the answers of each asking bundle, in the order it asked."""
    import pyarrow as pa

    ends = np.cumsum(sizes)
    cut = [answer[e - s : e] for e, s in zip(ends, sizes)]
    packed = [(np.packbits(c) if c.dtype == bool else c).tobytes() for c in cut]
    return pa.table({"bundle": pa.array(bundles, pa.int32()), "shard": pa.array([shard] * len(bundles), pa.int32()), "answer": pa.array(packed, pa.binary())})


def answered(arrow_table, shard: np.ndarray, dtype=bool) -> np.ndarray:
    """Answers of all shards, back in the order of the bundle's keys."""
    order, full, at = by_shard(shard)
    said = dict(zip(arrow_table["shard"].to_pylist(), arrow_table["answer"].to_pylist()))
    out = np.zeros(len(shard), dtype)
    for s, lo, hi in zip(full, at, at[1:]):
        raw = np.frombuffer(said[s], np.uint8)
        out[order[lo:hi]] = np.unpackbits(raw, count=hi - lo).astype(bool) if dtype is bool else raw.view(dtype)
    return out
