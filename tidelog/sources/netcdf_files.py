"""Frame files in NetCDF format, where the netCDF4 library is installed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.functions.bits import pack_words
from tidelog.sources.arrow_files import FIELDS


def read_netcdf(spark: SparkSession, folder: str, pattern: str = "*.nc") -> DataFrame:
    """time, multiplicity, navbits (38 bytes packed of ten words), and the file's scalars; missing ones are 0.

    Bits above the 30 of a word are ignored. Each file is one row of ``binaryFile``, opened in memory by its task.
    """
    try:
        import netCDF4  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading NetCDF needs the netCDF4 library on all executors") from e
    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import netCDF4

        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                with netCDF4.Dataset("in-memory", memory=content) as d:
                    n = len(d.dimensions["time"])
                    scalar = lambda k: int(d.variables[k][...]) if k in d.variables else 0  # noqa: B023, E731
                    words = [[int(w) & 0xFFFFFFFF for w in r] for r in d.variables["navbits"][:]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d.variables["time"][:].tolist(), pa.int32()), pa.array(d.variables["multiplicity"][:].tolist(), pa.int32()), pa.array(words, pa.list_(pa.int64())), *(pa.array([scalar(k)] * n, pa.int32()) for k in FIELDS), pa.array([path.rsplit("/", 1)[-1]] * n)],
                        ["time", "multiplicity", "words", *FIELDS, "source_file"],
                    )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    ddl = "time int, multiplicity int, words array<bigint>, " + ", ".join(f"{k} int" for k in FIELDS) + ", source_file string"
    return files.mapInArrow(rows, ddl).select("time", "multiplicity", pack_words(F.col("words")).alias("navbits"), *FIELDS, "source_file")
