"""Frame files in Arrow IPC format as a Spark data source."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ["year", "day_of_year", "prn", "gps_week"]


def write_frame_files(frames: DataFrame, folder: str, key: str = "netcdf_metadata") -> DataFrame:
    """Write frames (time, multiplicity, navbits, FIELDS, source_file) as one Arrow file per source_file; (path, frames) of the files.

    Each task writes the files of its groups, compressed, with the least year, day, entity and week of its frames in its
    metadata. A group is what one receiver file holds. The files are written when the result is read; writing again replaces them.
    """
    schema = pa.schema([("time", pa.int32()), ("multiplicity", pa.int32()), ("navbits", pa.binary())])

    def write(table: pa.Table) -> pa.Table:
        first = {k: pc.min(table.column(k)).as_py() for k in (*FIELDS, "source_file")}
        files, root = filesystem(folder)
        path = f"{root}/{first['source_file'] or 'unnamed.arrow'}"
        files.create_dir(path.rpartition("/")[0], recursive=True)
        rows = table.sort_by("time").select(schema.names).cast(schema).replace_schema_metadata({key: json.dumps(first)})
        with files.open_output_stream(path + ".part") as out, ipc.new_file(out, rows.schema, options=ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(rows)
        files.move(path + ".part", path)  # a task that runs again replaces a whole file
        return pa.table({"path": [path], "frames": pa.array([rows.num_rows], pa.int64())})

    return frames.select(*schema.names, *FIELDS, "source_file").groupBy("source_file").applyInArrow(write, "path string, frames bigint")


def filesystem(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


#: What opening a file counts for, in bytes, when files are put together to partitions, as in Spark's own file sources.
OPEN_COST = 4 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix = options.get("path"), options.get("suffix", ".arrow")
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.key = options.get("metadatakey", options.get("metadataKey", "netcdf_metadata"))
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", 128 << 20)))
        if not self.path:
            raise ValueError("load() needs a path")

    def partitions(self) -> list[InputPartition]:
        files, root = filesystem(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        elif info.type == fs.FileType.Directory:
            found = sorted((f for f in files.get_file_info(fs.FileSelector(root, recursive=self.recursive)) if f.is_file and f.path.endswith(self.suffix)), key=lambda f: f.path)
        else:
            raise FileNotFoundError(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        parts, room = [], 0
        for f in found:
            if room <= 0:
                parts.append([])
                room = self.partition_bytes
            parts[-1].append(scheme + f.path)
            room -= (f.size or 0) + OPEN_COST
        return [_Files(p) for p in parts] or [_Files([])]

    def read(self, partition: _Files) -> Iterator:
        for path in partition.paths:
            yield from self._read(path)

    def _read(self, path: str) -> Iterator:
        files, path = filesystem(path)
        with files.open_input_file(path) as f:
            reader = ipc.open_file(f)
            raw = (reader.schema.metadata or {}).get(self.key.encode())
            meta = json.loads(raw) if raw else {}
            consts = [int(meta.get(k) or 0) for k in FIELDS]
            source = str(meta.get("source_file") or "")
            for i in range(reader.num_record_batches):
                b = reader.get_batch(i)
                bits = b.column("navbits")
                if not pa.types.is_binary(bits.type):  # a list of bytes per frame
                    bits = pa.array([None if x is None else bytes(x) for x in bits.to_pylist()], pa.binary())
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column("time").cast(pa.int32()), b.column("multiplicity").cast(pa.int32()), bits, *(pa.array([c] * n, pa.int32()) for c in consts), pa.array([source] * n, pa.string())],
                    ["time", "multiplicity", "navbits", *FIELDS, "source_file"],
                )


class FrameFiles(DataSource):
    """``spark.dataSource.register(FrameFiles); spark.read.format("frame_files").load(folder)``.

    Files are found in all subfolders by suffix and put together to partitions of ``partitionBytes``; the path
    must be one that executors can reach. What the file's metadata says of it becomes columns; missing numbers are 0, a missing name is ''.
    Options: suffix, recursive, metadataKey, partitionBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "time int, multiplicity int, navbits binary, year int, day_of_year int, prn int, gps_week int, source_file string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
