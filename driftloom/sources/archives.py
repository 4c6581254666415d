"""Archives of arrays (``.npz``) as a Spark data source, read by row ranges and written in two phases.

``spark.read.format("array_archive").load(folder)`` has a column for each member of the archives (its first axis are the rows; further axes are
nested arrays), and the columns ``archive`` (the file's name without suffix) and ``row`` (from 0, in the archive).

* Partitions are ranges of at most ``rows_per_partition`` rows of one archive, found from the members' headers alone.
* A schema given by the user prunes columns: members that it doesn't name are never opened (``read`` does this for a list of columns).
* Filters ``archive = / IN`` and ``row`` comparisons are pushed: other archives and ranges become no partition.
* Writing: each task writes archives of at most ``rows_per_archive`` rows below a pending folder; the commit moves them and then replaces the
  folder's manifest in one rename. Readers see what the manifest lists (all archives where there is none), so a failed task or
  a broken commit leaves the folder as it was; an abort removes the pending folder. Rows with a column ``archive`` go to archives of that name.

Files are reached by pyarrow's file systems: a path's scheme decides (none: local). Driver and executors must see the same folder. One
writer at a time. Members of Python objects are refused: they are pickles.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

MANIFEST, PENDING, SUFFIX = "_manifest.json", "_pending", ".npz"
#: Between an archive's name and the number of one of its files.
PART = "~"
ROWS = 65_536
#: Rows of one Arrow batch.
BATCH = 2048


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def archive_name(file: str) -> str:
    return posixpath.basename(file)[: -len(SUFFIX)].split(PART)[0]


def listed(path: str) -> list[str]:
    """The archives of a folder that a reader may see, or the one archive that ``path`` names."""
    system, at = _system(path)
    if at.endswith(SUFFIX):
        return [at]
    manifest = f"{at}/{MANIFEST}"
    if system.get_file_info(manifest).type == pafs.FileType.File:
        with system.open_input_stream(manifest) as f:
            return [f"{at}/{name}" for name in json.loads(f.read())["files"]]
    found = system.get_file_info(pafs.FileSelector(at))
    return sorted(x.path for x in found if x.type == pafs.FileType.File and x.path.endswith(SUFFIX) and not x.base_name.startswith(("_", ".")))


@dataclass
class Member:
    name: str
    shape: tuple[int, ...]
    dtype: np.dtype


def _header(stream) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type from the head of an array file; the stream then stands at the first value."""
    version = np.lib.format.read_magic(stream)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if dtype.hasobject:
        raise ValueError("members of Python objects are not read: they are pickles")
    if fortran and len(shape) > 1:
        raise ValueError("members in column order are not read: their rows are not together")
    return shape, dtype


def members(path: str) -> list[Member]:
    """The members of an archive with a first axis, from their headers."""
    system, at = _system(path)
    out = []
    with system.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
        for info in z.infolist():
            if info.filename.endswith(".npy"):
                with z.open(info) as stream:
                    try:
                        shape, dtype = _header(stream)
                    except ValueError as e:
                        raise ValueError(f"{info.filename} in {path}: {e}") from None
                if shape:  # a single value is a mark, not a column
                    out.append(Member(info.filename[:-4], shape, dtype))
    return out


def _spark_type(m: Member) -> T.DataType:
    kind = m.dtype.kind
    one: T.DataType
    if kind in "US":
        one = T.StringType()
    elif kind == "b":
        one = T.BooleanType()
    elif kind in "iu":
        one = T.IntegerType() if m.dtype.itemsize < 4 or m.dtype == np.int32 else T.LongType()
    elif kind == "f":
        one = T.FloatType() if m.dtype.itemsize <= 4 else T.DoubleType()
    else:
        raise ValueError(f"{m.name}: no column type for {m.dtype}")
    for _ in m.shape[1:]:
        one = T.ArrayType(one, True)
    return one


def _arrow(values: np.ndarray, type_: pa.DataType) -> pa.Array:
    """Rows of an array as an Arrow column; further axes are nested lists."""
    if values.ndim > 1:
        inner = _arrow(values.reshape(-1, *values.shape[2:]), type_.value_type)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), inner).cast(type_)
    if values.dtype.kind == "S":
        values = np.char.decode(values, "utf-8")
    return pa.array(values.tolist() if values.dtype.kind == "U" else values).cast(type_)


@dataclass
class Rows(InputPartition):
    path: str
    lo: int
    hi: int


@dataclass
class _Kept:
    """What pushed filters leave: archives by name (None: all) and a range of rows."""

    names: set[str] | None = None
    lo: int = 0
    hi: int | None = None

    def take(self, f: Filter) -> bool:
        """Narrow by a filter; False if it is not one that can be pushed."""
        column = getattr(f, "attribute", None)
        if column == ("archive",) and isinstance(f, EqualTo | In):
            names = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.names = names if self.names is None else self.names & names
            return True
        if column == ("row",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, int):
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                end = f.value + (not isinstance(f, LessThan))
                self.hi = end if self.hi is None else min(self.hi, end)
            return True
        return False


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.most = schema, options["path"], int(options.get("rows_per_partition", ROWS))
        self.kept = _Kept()

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        return [f for f in filters if not self.kept.take(f)]

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for path in listed(self.path):
            if self.kept.names is not None and archive_name(path) not in self.kept.names:
                continue
            found = members(path)
            if not found:
                continue
            n = found[0].shape[0]
            if any(m.shape[0] != n for m in found):
                raise ValueError(f"the members of {path} have different numbers of rows")
            end = n if self.kept.hi is None else min(n, self.kept.hi)
            out += [Rows(path, lo, min(lo + self.most, end)) for lo in range(self.kept.lo, end, self.most)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.hi <= partition.lo:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        system, at = _system(partition.path)
        with system.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
            open_members = {}
            for name in wanted.names:
                if name in ("archive", "row"):
                    continue
                stream = z.open(f"{name}.npy")
                shape, dtype = _header(stream)
                width = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
                stream.seek(partition.lo * width, io.SEEK_CUR)
                open_members[name] = (stream, shape, dtype, width)
            for lo in range(partition.lo, partition.hi, BATCH):
                n = min(BATCH, partition.hi - lo)
                cols = []
                for f in wanted:
                    if f.name == "archive":
                        cols.append(pa.array([archive_name(partition.path)] * n, f.type))
                    elif f.name == "row":
                        cols.append(pa.array(np.arange(lo, lo + n)).cast(f.type))
                    else:
                        stream, shape, dtype, width = open_members[f.name]
                        data = stream.read(n * width)
                        if len(data) != n * width:
                            raise ValueError(f"{f.name} in {partition.path} ends early")
                        cols.append(_arrow(np.frombuffer(data, dtype).reshape(n, *shape[1:]), f.type))
                yield pa.RecordBatch.from_arrays(cols, schema=wanted)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


def _array(column: pa.ChunkedArray, name: str) -> np.ndarray:
    """A column as an array; lists of one length are further axes."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if values.null_count:
        raise ValueError(f"{name}: an array has no nulls")
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        lengths = np.diff(values.offsets.to_numpy())
        if len(lengths) and (lengths != lengths[0]).any():
            raise ValueError(f"{name}: rows of different lengths are no array")
        inner = _array(values.flatten(), name)
        return inner.reshape(len(values), int(lengths[0]) if len(lengths) else 0, *inner.shape[1:])
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        return np.array(values.to_pylist(), dtype=np.str_)
    return values.to_numpy(zero_copy_only=False)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("rows_per_archive", ROWS))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One task: rows are gathered by archive name up to ``rows_per_archive``, then written below the pending folder."""
        system, at = _system(self.path)
        folder = f"{at}/{PENDING}-{self.job}"
        system.create_dir(folder, recursive=True)
        task, done, held = uuid.uuid4().hex, Written(), {}

        def flush(name: str) -> None:
            table = pa.concat_tables(held.pop(name))
            file = f"{name}{PART}{task}-{len(done.files)}{SUFFIX}"
            with system.open_output_stream(f"{folder}/{file}") as out:
                np.savez_compressed(out, **{c: _array(table[c], c) for c in table.column_names})
            done.files.append(file)

        for batch in iterator:
            table = pa.Table.from_batches([batch])
            names = table["archive"].to_pylist() if "archive" in table.column_names else ["part"] * len(table)
            table = table.drop_columns([c for c in ("archive", "row") if c in table.column_names])
            cut = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, e in zip(cut, cut[1:], strict=False):
                if a == e:
                    continue
                if names[a] is None or PART in names[a] or "/" in names[a] or names[a].startswith(("_", ".")):
                    raise ValueError(f"no name of an archive: {names[a]!r}")
                for lo in range(a, e, self.most):
                    held.setdefault(names[a], []).append(table.slice(lo, min(self.most, e - lo)))
                    if sum(map(len, held[names[a]])) >= self.most:
                        flush(names[a])
                if sum(len(t) for ts in held.values() for t in ts) >= 4 * self.most:  # many names: the largest goes
                    flush(max(held, key=lambda k: sum(map(len, held[k]))))
        for name in list(held):
            flush(name)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _system(self.path)
        before = [] if not _exists(system, at) else [posixpath.basename(f) for f in listed(self.path)]
        files = sorted(f for m in messages if m is not None for f in m.files)
        for f in files:
            system.move(f"{at}/{PENDING}-{self.job}/{f}", f"{at}/{f}")
        now = files if self.overwrite else before + files
        with system.open_output_stream(f"{at}/{PENDING}-{self.job}/{MANIFEST}") as out:
            out.write(json.dumps({"files": now}).encode())
        system.move(f"{at}/{PENDING}-{self.job}/{MANIFEST}", f"{at}/{MANIFEST}")  # from here on readers see the new files
        system.delete_dir(f"{at}/{PENDING}-{self.job}")
        if self.overwrite:
            for f in set(before) - set(files):
                system.delete_file(f"{at}/{f}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _system(self.path)
        if _exists(system, f"{at}/{PENDING}-{self.job}"):
            system.delete_dir(f"{at}/{PENDING}-{self.job}")


def _exists(system: pafs.FileSystem, at: str) -> bool:
    return system.get_file_info(at).type != pafs.FileType.NotFound


class ArrayArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_archive"

    def schema(self) -> T.StructType:
        files = listed(self.options["path"])
        if not files:
            raise ValueError(f"no archive in {self.options['path']}")
        out = T.StructType([T.StructField("archive", T.StringType()), T.StructField("row", T.LongType())])
        for m in members(files[0]):
            out.add(m.name, _spark_type(m))
        return out

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, **options: object) -> DataFrame:
    """The archives of a folder; of ``columns`` only those members are opened."""
    register(spark)
    source = spark.read.format("array_archive").options(path=path, **options)
    if columns is not None:
        every = ArrayArchive({"path": path}).schema()
        source = source.schema(T.StructType([every[c] for c in columns]))
    return source.load()


def write(rows: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    register(rows.sparkSession)
    rows.write.format("array_archive").mode(mode).options(path=path, **options).save()


def with_fallback(newer: DataFrame, older: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``newer``, and those of ``older`` whose key it doesn't have: a bank is taken whole from the newest store."""
    return newer.unionByName(older.join(newer.select(*keys).distinct(), list(keys), "left_anti").select(*newer.columns))


def named_parts(names: DataFrame, known: DataFrame, name: str = "name", dataset: str = "dataset") -> DataFrame:
    """``names`` with dataset (the longest known one that the name begins with, up to its end or an underscore) and rest (null: none).

    Every known length gives one prefix of a name, which is joined to the known names of that length: no pair of a name and a dataset that
    doesn't match is ever a row. A name that no dataset begins has a null dataset. Known names that repeat count once.
    """
    known = known.select(F.col(dataset).alias("_known")).filter("length(_known) > 0").distinct()
    lengths = known.agg(F.array_sort(F.collect_set(F.length("_known"))).alias("_lengths"))  # as many as names have lengths
    cut = names.select(name).distinct().crossJoin(F.broadcast(lengths)).withColumn("_l", F.explode("_lengths")).filter((F.length(name) == F.col("_l")) | (F.substr(F.col(name), F.col("_l") + 1, F.lit(1)) == "_"))
    found = cut.select(name, F.substr(F.col(name), F.lit(1), F.col("_l")).alias("_known")).join(known, "_known")
    best = found.groupBy(name).agg(F.max_by("_known", F.length("_known")).alias("dataset"))
    out = names.join(best, name, "left")
    return out.withColumn("rest", F.nullif(F.substr(F.col(name), F.length("dataset") + 2), F.lit("")))
