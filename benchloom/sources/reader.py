"""A data source for dataset specs: `spark.read.format("dataset").option("spec", "jsonl:path:limit=9").load()`.

It plans its own partitions. Text files are cut at byte ranges; where rows are asked for by number (limit, start,
stop), the lines of one range after the other are counted, the count carries over to the next range, and
counting ends where the last row asked for is, so a limit plans and reads only the ranges it needs. Parquet files are cut at row
groups, whose row counts are in their footers. Only the schema's columns are parsed or read.

Options: spec, whose path is one that pyarrow can open; start and stop, row numbers from 0; bytes, of a range. A column
`line` of the schema is the row's number. Filters are left to Spark: what one query pushes into a Python
source would stay for all later queries of the same DataFrame (so in Spark 4.1).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RANGE_BYTES = 64 << 20
#: Bytes that are read at a time.
CHUNK = 1 << 20
LINE = "line"
#: Lines whose fields make the schema of a JSONL file that comes without one.
SAMPLE_LINES = 1000


@dataclass
class Part(InputPartition):
    """Rows [skip, stop) of a byte range or a row group; first: the number of its first row, None where nobody asked."""

    path: str
    begin: int
    end: int
    first: int | None = None
    skip: int = 0
    stop: int | None = None


def opened(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """Data files at or below a path, by name, with their sizes."""
    from pyarrow import fs

    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    shown = lambda f: not any(p[:1] in "._" for p in f.path[len(at) :].strip("/").split("/"))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and shown(f))


def line_starts(path: str, begin: int, end: int) -> Iterator[bytes]:
    """The bytes of the lines that begin in [begin, end), in chunks of whole lines."""
    system, at = opened(path)
    with system.open_input_file(at) as file:
        where = begin
        if begin:  # the line that begin is in, unless it starts there, belongs to the range before
            file.seek(begin - 1)
            where = begin - 1
            while True:
                chunk = file.read(CHUNK)
                if not chunk:
                    return
                if (cut := chunk.find(b"\n")) >= 0:
                    where += cut + 1
                    break
                where += len(chunk)
        file.seek(where)
        rest = b""
        while where < end:
            chunk = file.read(CHUNK)
            if not chunk:
                break
            body = rest + chunk
            # where the last line that begins before `end` stops
            reach = end - (where - len(rest))
            last = body.rfind(b"\n") + 1 if len(body) < reach else body.find(b"\n", reach - 1) + 1
            where += len(chunk)
            if last:
                yield body[:last]
                rest = body[last:]
            else:
                rest = body
            if len(body) >= reach and last:
                return
        # the last line began in time: read it to its end
        while rest:
            chunk = file.read(CHUNK)
            cut = chunk.find(b"\n") + 1
            rest += chunk[:cut] if cut else chunk
            if cut or not chunk:
                yield rest
                return


class SpecReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        from benchloom.sources.spec import parse_spec

        self.schema, self.spec = schema, parse_spec(options["spec"])
        self.bytes = int(options.get("bytes", RANGE_BYTES))
        self.start, self.stop = int(options.get("start", 0)), int(options["stop"]) if "stop" in options else None
        if "limit" in self.spec.flags:
            self.until(self.start + self.spec.flags["limit"])

    def until(self, stop: int) -> None:
        self.stop = stop if self.stop is None else min(self.stop, stop)

    @property
    def numbered(self) -> bool:
        return self.start > 0 or self.stop is not None or LINE in self.schema.fieldNames()

    def ranges(self) -> Iterator[tuple[Part, int | None]]:
        """Parts in order, with their rows where that is known without looking."""
        for path, size in files_of(self.spec.name):
            if self.spec.kind in ("jsonl", "csv"):
                # a quoted field of a csv file may hold line breaks, so its rows are found from its beginning
                step = self.bytes if self.spec.kind == "jsonl" else max(1, size)
                for begin in range(0, size, step):
                    yield Part(path, begin, min(size, begin + step)), None
            else:
                import pyarrow.parquet as pq

                system, at = opened(path)
                meta = pq.ParquetFile(system.open_input_file(at)).metadata
                for group in range(meta.num_row_groups):
                    yield Part(path, group, group + 1), meta.row_group(group).num_rows

    def rows_in(self, part: Part) -> int:
        if self.spec.kind == "jsonl":
            return sum(chunk.count(b"\n") + (not chunk.endswith(b"\n")) for chunk in line_starts(part.path, part.begin, part.end))
        return sum(t.num_rows for t in self.tables(part))

    def partitions(self) -> Sequence[Part]:
        if not self.numbered:
            return [p for p, _ in self.ranges()] or [Part("", 0, 0)]
        out, before = [], 0
        for part, n in self.ranges():
            if self.stop is not None and before >= self.stop:
                break
            n = self.rows_in(part) if n is None else n
            if before + n > self.start:
                part.first, part.skip = before, max(0, self.start - before)
                part.stop = n if self.stop is None else min(n, self.stop - before)
                out.append(part)
            before += n
        return out or [Part("", 0, 0)]

    def arrow_schema(self):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.schema([f for f in to_arrow_schema(self.schema) if f.name != LINE])

    def tables(self, part: Part):
        """The part's rows with the schema's columns but the line number."""
        import pyarrow as pa

        wanted = self.arrow_schema()
        if self.spec.kind == "jsonl":
            from pyarrow import json

            options = json.ParseOptions(explicit_schema=wanted, unexpected_field_behavior="ignore")
            for chunk in line_starts(part.path, part.begin, part.end):
                if chunk.strip():
                    read = json.ReadOptions(block_size=len(chunk) + 1, use_threads=False)
                    t = json.read_json(pa.BufferReader(chunk), read, options) if wanted.names else pa.table({"": pa.nulls(chunk.count(b"\n"))}).select([])
                    yield t.select(wanted.names).cast(wanted)
            return
        system, at = opened(part.path)
        if self.spec.kind == "csv":
            from pyarrow import csv

            convert = csv.ConvertOptions(column_types=wanted, include_columns=wanted.names, include_missing_columns=True, strings_can_be_null=True, quoted_strings_can_be_null=False)
            with system.open_input_stream(at) as file:
                for batch in csv.open_csv(file, csv.ReadOptions(use_threads=False), csv.ParseOptions(newlines_in_values=True, escape_char="\\"), convert):
                    yield pa.Table.from_batches([batch]).cast(wanted)
            return
        import pyarrow.parquet as pq

        file = pq.ParquetFile(system.open_input_file(at))
        there = set(file.schema_arrow.names)
        t = file.read_row_group(part.begin, columns=[n for n in wanted.names if n in there], use_threads=False)
        for f in wanted:
            if f.name not in there:
                t = t.append_column(f, pa.nulls(t.num_rows, f.type))
        yield t.select(wanted.names).cast(wanted)

    def read(self, part: Part):
        import pyarrow as pa

        if not part.path:
            return
        at = 0
        for t in self.tables(part):
            n, from_, to = t.num_rows, max(0, part.skip - at), t.num_rows if part.stop is None else part.stop - at
            at += n
            t = t.slice(from_, max(0, min(n, to) - from_))
            if LINE in self.schema.fieldNames():
                first = part.first + at - n + from_
                t = t.append_column(LINE, pa.array(range(first, first + t.num_rows), pa.int64())).select(self.schema.fieldNames())
            yield from t.to_batches()
            if part.stop is not None and at >= part.stop:
                return


class SpecSource(DataSource):
    """The kinds of dataset specs but hub, whose splits are folders of parquet that Spark prunes by itself."""

    @classmethod
    def name(cls) -> str:
        return "dataset"

    def schema(self):
        """Of parquet: the first file's. Else from the first lines of the first file: a sample, so better given."""
        from benchloom.sources.spec import parse_spec
        from pyspark.sql.pandas.types import from_arrow_schema

        spec = parse_spec(self.options["spec"])
        path = files_of(spec.name)[0][0]
        system, at = opened(path)
        if spec.kind == "jsonl":
            import pyarrow as pa
            from pyarrow import json

            head = b"\n".join(next(line_starts(path, 0, CHUNK), b"{}").split(b"\n")[:SAMPLE_LINES])
            return from_arrow_schema(json.read_json(pa.BufferReader(head)).schema)
        if spec.kind == "csv":
            from pyarrow import csv

            with system.open_input_stream(at) as file:
                return from_arrow_schema(csv.open_csv(file).schema)
        import pyarrow.parquet as pq

        return from_arrow_schema(pq.ParquetFile(system.open_input_file(at)).schema_arrow)

    def reader(self, schema: StructType) -> SpecReader:
        return SpecReader(schema, self.options)
