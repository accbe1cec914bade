"""Growing files shipped as numbered chunks of whole lines: a streaming source.

The source hands out where chunks begin and end; tasks read the bytes. Its offsets are those of the stream's checkpoint, which
move only when a batch has been delivered: what failed is shipped again with the same numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

# Fixed value: the most bytes of a chunk.
MAX_CHUNK_BYTES = 256 << 10
_STEP = 4096
CUTS = "path string, seq long, begin long, end long"


def cut_points(file, begin: int, end: int, most: int = MAX_CHUNK_BYTES) -> list[tuple[int, int]]:
    """(begin, end) of chunks of whole lines of at most `most` bytes: only the bytes before each limit are read, up to a line's end.

    A chunk without a whole line waits, and all that follows it.
    """
    found = []
    while begin < end:
        limit = at = min(begin + most, end)
        cut = None
        while cut is None and at > begin:
            start = max(at - _STEP, begin)
            file.seek(start)
            place = file.read(at - start).rfind(b"\n")
            cut = start + place + 1 if place >= 0 else None
            at = start
        if cut is None:
            break
        found.append((begin, cut))
        begin = cut
        if limit == end:
            break
    return found


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def _files(self) -> tuple[pafs.FileSystem, dict[str, int]]:
        fs, path = pafs.FileSystem.from_uri(self.folder)
        return fs, {f.path: f.size for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and f.extension == "jsonl"}

    def _cut(self, start: dict, ends: dict[str, list] | None) -> tuple[list[tuple], dict]:
        fs, sizes = self._files()
        state, rows = json.loads(start["files"]), []
        for path, size in sorted(sizes.items()):
            offset, seq = state.get(path, [0, 0])
            if ends is not None:
                size = ends.get(path, [0, 0])[0]
            if size < offset:
                offset = 0  # the file is another one by now: from its beginning, with rising numbers
            with fs.open_input_file(path) as f:
                cuts = cut_points(f, offset, size, self.most)
            for begin, end in cuts:
                seq += 1
                rows.append((path, seq, begin, end))
                offset = end
            state[path] = [offset, seq]
        return rows, {"files": json.dumps(state, sort_keys=True)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._cut(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._cut(start, json.loads(end["files"]))[0])

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Format growing_lines: where the chunks of a folder's .jsonl files lie. Options: path (a URI), max_chunk_bytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return CUTS

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(self.options["path"], int(self.options.get("max_chunk_bytes", MAX_CHUNK_BYTES)))


def shipments(spark: SparkSession, folder: str, max_chunk_bytes: int = MAX_CHUNK_BYTES) -> DataFrame:
    """A stream of path, seq, body: numbered chunks of whole lines of the .jsonl files of a folder (a URI), read in tasks."""
    spark.dataSource.register(GrowingLines)
    cuts = spark.readStream.format("growing_lines").option("path", folder).option("max_chunk_bytes", str(max_chunk_bytes)).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for path, seq, begin, end in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(path) as f:
                    f.seek(begin)
                    body = f.read(end - begin).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([seq]), pa.array([body])], names=["path", "seq", "body"])

    return cuts.mapInArrow(run, "path string, seq long, body string")
