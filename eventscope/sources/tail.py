"""Tail event logs that grow in place (a file, or a folder of files).

The stream's offset is one byte position per file, always the end of a line: a half-written
last line waits for its newline.  What was added since the last batch is cut into pieces that
tasks read on their own.  A file that became shorter was replaced and is read from its start.

Rows are Kafka-shaped (``value`` is a line's bytes, with its ``file`` and first byte ``at``),
so :func:`eventscope.sources.kafka.parse_records` and the ingest take them as they are.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_event_log"
PIECE_BYTES = 16 << 20      # read by one task
LOOK_BACK = 1 << 16         # bytes searched at a time for the last newline


def _open(path: str):
    import pyarrow.fs as pafs
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class Piece(InputPartition):
    """Lines of ``path`` that start in [lo, hi); the growth that is read is [first, end)."""

    def __init__(self, path: str, first: int, lo: int, hi: int, end: int):
        self.path, self.first, self.lo, self.hi, self.end = path, first, lo, hi, end


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, piece_bytes: int):
        self.path, self.piece_bytes = path, piece_bytes
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list[tuple[str, int]]:
        import pyarrow.fs as pafs
        fs, local = _open(self.path)
        info = fs.get_file_info(local)
        if info.type == pafs.FileType.File:
            return [("", info.size)]
        if info.type != pafs.FileType.Directory:
            return []
        found = fs.get_file_info(pafs.FileSelector(local))
        return sorted((f.base_name, f.size) for f in found
                      if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))

    def _full(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}" if name else self.path

    def _last_line_end(self, name: str, size: int) -> int:
        """The byte after the last newline, searched backwards from the end."""
        known = self.known.get(name, 0)
        floor = known if known <= size else 0
        fs, local = _open(self._full(name))
        with fs.open_input_file(local) as f:
            hi = size
            while hi > floor:
                lo = max(floor, hi - LOOK_BACK)
                at = f.read_at(hi - lo, lo).rfind(b"\n")
                if at >= 0:
                    return lo + at + 1
                hi = lo
        return floor

    def latestOffset(self) -> dict:
        self.known = {name: self._last_line_end(name, size) for name, size in self._files()}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for name, stop in end.items():
            first = start.get(name, 0)
            first = first if first <= stop else 0
            for lo in range(first, stop, self.piece_bytes):
                out.append(Piece(self._full(name), first, lo, min(lo + self.piece_bytes, stop), stop))
        return out

    def read(self, partition: Piece):
        import pyarrow as pa
        p = partition
        fs, local = _open(p.path)
        with fs.open_input_file(local) as f:
            # a line that crosses the border belongs to the piece before
            at = p.lo - 1 if p.lo > p.first else p.lo
            data = f.read_at(p.hi - at, at)
            if at < p.lo:
                cut = data.find(b"\n") + 1
                if not cut:
                    return
                data, at = data[cut:], at + cut
            stop = p.hi
            while data and not data.endswith(b"\n") and stop < p.end:
                more = f.read_at(min(LOOK_BACK, p.end - stop), stop)
                cut = more.find(b"\n") + 1
                data += more[:cut] if cut else more
                stop += len(more)
                if cut:
                    break
        lines, places = [], []
        for line in data.split(b"\n")[:-1]:
            if line.strip():
                lines.append(line)
                places.append(at)
            at += len(line) + 1
        name = p.path.rsplit("/", 1)[-1]
        for k in range(0, len(lines), 10_000):
            part = lines[k:k + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), pa.array([name] * len(part)), pa.array(places[k:k + 10_000], pa.int64())],
                names=["value", "file", "at"])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value binary, file string, at long"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("pieceBytes", PIECE_BYTES)))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, as tasks outside the JVM need it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def tail_event_log(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A stream of the lines added to the log at ``path`` (value, file, at).

    The store must let several readers open a file by offset: local and HDFS paths, and all
    others that pyarrow opens.
    """
    # planner and workers get the class itself, wherever they look for packages
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(GrowingLog)
    return (spark.readStream.format(FORMAT).option("path", qualified(spark, path))
            .option("pieceBytes", piece_bytes).load())
