"""Recording text files as Python data sources: byte-range partitions, a line index, and slices that read only their blocks.

A file is cut into blocks of bytes; the lines that begin in a block belong to it. `recording_lines` counts them, a task
for each block, which gives the number of each block's first line. `recording_text` gives the samples of chosen blocks.
Files are opened through Arrow's file systems (local paths, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER_LINES, DEFAULT_FS = 14, 10_000.0
CHANNELS = ["Time_raw", "CH1", "CH40", "CH41"]
#: Bytes of a block, and bytes that are read at once.
BLOCK, PIECE = 64 << 20, 4 << 20


class Block(InputPartition):
    def __init__(self, body: dict):
        self.body = body


def opened(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return store.open_input_file(path)


def line_starts(file, lo: int, hi: int) -> int:
    """How many lines begin at the bytes from lo to before hi."""
    file.seek(max(lo - 1, 0))
    left, found = hi - 1 - max(lo - 1, 0), int(lo == 0 and hi > 0)
    while left > 0 and (data := file.read(min(left, PIECE))):
        found += data.count(b"\n")
        left -= len(data)
    return found


def lines_of(file, lo: int, hi: int):
    """The lines that begin at the bytes from lo to before hi, without their ends, in lists."""
    file.seek(max(lo - 1, 0))
    at, rest, skip = max(lo - 1, 0), b"", lo > 0
    while data := file.read(PIECE):
        if skip:  # the line that begins before the block
            cut = data.find(b"\n", 0, max(hi - 1 - at, 0))
            if cut < 0:
                at += len(data)
                if at >= hi - 1:
                    return
                continue
            at, data, skip = at + cut + 1, data[cut + 1 :], False
        begin = at - len(rest)
        data = rest + data
        at = begin + len(data)
        if at >= hi:
            end = data.find(b"\n", hi - 1 - begin)
            if end >= 0:
                yield data[:end].split(b"\n")
                return
        whole, _, rest = data.rpartition(b"\n")
        if _:
            yield whole.split(b"\n")
    if rest:
        yield rest.split(b"\n")


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.blocks = json.loads(options["blocks"])

    def partitions(self):
        return [Block(b) for b in self.blocks]

    def read(self, partition):
        b = partition.body
        with opened(b["file"]) as f:
            n = line_starts(f, b["lo"], b["hi"])
            fs = None
            if b["lo"] == 0:
                head, seen = [], 0
                for some in lines_of(f, 0, b["hi"]):
                    head += some[: HEADER_LINES - seen]
                    seen = len(head)
                    if seen >= HEADER_LINES:
                        break
                rates = [float(m[1]) for m in (re.search(rb"(\d+\.?\d*|\.\d+)\s*ms", line) for line in head) if m]
                fs = 1000.0 / rates[0] if rates and rates[0] > 0 else None
        yield b["file"], b["lo"], b["hi"], n, fs


class RecordingLines(DataSource):
    """Lines that begin in each of the blocks (file, lo, hi) of the option `blocks`, and the rate that a file's header tells."""

    @classmethod
    def name(cls):
        return "recording_lines"

    def schema(self):
        return "file string, lo long, hi long, n long, fs double"

    def reader(self, schema):
        return LineReader(self.options)


def numbers(cells: list[bytes]):
    """Doubles; what can't be read and NaN become 0."""
    import numpy as np

    try:
        out = np.array(cells, dtype=bytes).astype(float)
    except ValueError:
        out = np.zeros(len(cells))
        for i, c in enumerate(cells):
            try:
                out[i] = float(c)
            except ValueError:
                pass
    return np.where(np.isnan(out), 0.0, out)


class SampleReader(DataSourceReader):
    def __init__(self, options):
        self.blocks, self.channels = json.loads(options["blocks"]), json.loads(options["channels"])

    def partitions(self):
        return [Block(b) for b in self.blocks]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        b = partition.body
        at = b["line"]  # the number of the block's first line
        with opened(b["file"]) as f:
            for lines in lines_of(f, b["lo"], b["hi"]):
                lo, hi = max(b["first"] - at, 0), min(b["last"] - at, len(lines))
                if hi > lo:
                    cells = [line.rstrip(b"\r").split(b",") for line in lines[lo:hi]]
                    own = [i for i, c in enumerate(cells) if len(c) > 1]
                    idx = np.array(own, np.int64) + (at + lo - b["first"])
                    columns = [numbers([cells[i][k].strip() if k < len(cells[i]) else b"0" for i in own]) for k in (CHANNELS.index(c) for c in self.channels)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b["file"]] * len(own), pa.string()), pa.array(idx), pa.array(np.full(len(own), b["fs"])), *map(pa.array, columns)],
                        names=["file", "sample_idx", "fs", *self.channels],
                    )
                at += len(lines)
                if at >= b["last"]:
                    return


class RecordingText(DataSource):
    """Samples of the blocks of the option `blocks` (file, lo, hi, line, fs, first and last wanted line), of the channels of the option `channels`."""

    @classmethod
    def name(cls):
        return "recording_text"

    def schema(self):
        return "file string, sample_idx long, fs double" + "".join(f", {c} double" for c in json.loads(self.options["channels"]))

    def reader(self, schema):
        return SampleReader(self.options)


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files of a path, folder or pattern, with their sizes, as Hadoop lists them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    store = pattern.getFileSystem(conf)
    found = []
    for s in store.globStatus(pattern) or []:
        found += [x for x in store.listStatus(s.getPath()) if x.isFile()] if s.isDirectory() else [s]
    name = lambda s: re.sub(r"^file:/(?=[^/])", "file:///", s.getPath().toString())
    return sorted((name(s), s.getLen()) for s in found if not s.getPath().getName().startswith(("_", ".")))


def line_index(spark: SparkSession, path: str, block: int = BLOCK) -> list[dict]:
    """The blocks of all files: file, lo, hi, n (lines that begin there), line (number of the first one), fs.

    One pass over the bytes, a task for each block, and about a hundred bytes for each block on the driver. The index may
    be kept and given to read_recordings() as often as its files are read.
    """
    spark.dataSource.register(RecordingLines)
    blocks = [{"file": f, "lo": lo, "hi": min(lo + block, size)} for f, size in files(spark, path) for lo in range(0, size, block)]
    if not blocks:
        return []
    told = sorted(spark.read.format("recording_lines").option("blocks", json.dumps(blocks)).load().collect(), key=lambda r: (r.file, r.lo))
    out, line, fs = [], 0, DEFAULT_FS
    for r in told:
        if r.lo == 0:
            line, fs = 0, r.fs or DEFAULT_FS
        out.append({"file": r.file, "lo": r.lo, "hi": r.hi, "n": r.n, "line": line, "fs": fs})
        line += r.n
    return out


def chosen(index: list[dict], start: float = 0.0, duration: float | None = None, delay: float = 0.0) -> list[dict]:
    """The blocks that hold wanted samples, each with the first and (exclusive) last wanted line of its file."""
    out = []
    for b in index:
        first = HEADER_LINES + round(delay * b["fs"]) + round(start * b["fs"])
        last = first + round(duration * b["fs"]) if duration is not None else 1 << 62
        if b["n"] and b["line"] < last and b["line"] + b["n"] > first:
            out.append(b | {"first": first, "last": last})
    return out


def samples(spark: SparkSession, index: list[dict], channels: list[str], start: float = 0.0, duration: float | None = None, delay: float = 0.0) -> DataFrame:
    """Samples of an index's files: file, sample_idx (from the slice's start), fs and the channels. Only blocks of the slice are partitions."""
    if unknown := set(channels) - set(CHANNELS):
        raise ValueError(f"no such channels: {sorted(unknown)}")
    spark.dataSource.register(RecordingText)
    blocks = chosen(index, start, duration, delay)
    rows = spark.read.format("recording_text").option("channels", json.dumps(channels)).option("blocks", json.dumps(blocks)).load()
    return rows if blocks else spark.createDataFrame([], rows.schema)
