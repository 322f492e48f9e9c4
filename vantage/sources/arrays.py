"""Files of named arrays (``.npz``) as a Spark source and sink, and folders of scenes that hold them."""

from __future__ import annotations

import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

_BATCH_BYTES = 16 << 20
_KINDS = {"i": T.LongType(), "u": T.LongType(), "b": T.BooleanType(), "U": T.StringType(), "S": T.StringType()}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[str]:
    """The file, or the ``.npz`` files below the folder, sorted. Nothing there is an error."""
    store, inner = _place(path)
    found = store.get_file_info(inner)
    if found.type == fs.FileType.File:
        return [inner]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = store.get_file_info(fs.FileSelector(inner, recursive=True))
    names = sorted(f.path for f in below if f.type == fs.FileType.File and f.path.endswith(".npz") and not f.base_name.startswith(("_", ".")))
    if not names:
        raise FileNotFoundError(f"no array files in {path}")
    return names


def _header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, order and type of the array that the stream begins with."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(stream)


def _headers(archive: zipfile.ZipFile) -> dict[str, tuple[tuple[int, ...], bool, np.dtype]]:
    out = {}
    for name in archive.namelist():
        with archive.open(name) as stream:
            out[name.removesuffix(".npy")] = _header(stream)
    return out


def _aliases(text: str | None) -> dict[str, list[str]] | None:
    """``u=row,rows;v=col`` as lists of names by column."""
    if not text:
        return None
    pairs = (part.split("=", 1) for part in text.split(";") if part)
    return {p[0].strip(): [n.strip() for n in p[-1].split(",")] for p in pairs}


def _columns(headers: dict, wanted: dict[str, list[str]] | None, where: str) -> dict[str, str]:
    """Array by column: the first of its names that is there, or, if none are asked for, all arrays as long as the longest."""
    if wanted is not None:
        out = {}
        for column, names in wanted.items():
            found = [n for n in names if n in headers]
            if not found:
                raise ValueError(f"{where} has none of the fields {', '.join(names)}")
            out[column] = found[0]
        if len({headers[n][0][:1] for n in out.values()}) > 1 or any(not headers[n][0] for n in out.values()):
            raise ValueError(f"{where}: fields {', '.join(out.values())} differ in length")
        return out
    rows = max((h[0][0] for h in headers.values() if h[0]), default=None)
    return {n: n for n, h in headers.items() if h[0] and h[0][0] == rows}


def _type(name: str, header: tuple) -> T.DataType:
    shape, _, kind = header
    if kind.kind == "f":
        own: T.DataType = T.FloatType() if kind.itemsize <= 4 else T.DoubleType()
    elif kind.kind in _KINDS:
        own = _KINDS[kind.kind]
    else:
        raise ValueError(f"array {name} holds {kind}, which is not read (objects would run code)")
    for _ in shape[1:]:
        own = T.ArrayType(own)
    return own


def _arrow(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(values.ravel().tolist() if values.dtype.kind in "US" else np.ascontiguousarray(values).ravel())
    inner = kind
    while pa.types.is_list(inner):
        inner = inner.value_type
    out = flat.cast(inner)
    for size in reversed(values.shape[1:]):
        n = len(out) // size if size else int(np.prod(values.shape[:-1]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), out)
    return out


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.wanted = schema, options["path"], _aliases(options.get("fields"))

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        """Rows in batches of bounded size: each array is a stream of its own, read on as far as the batch goes."""
        store, _ = _place(self.path)
        arrow = to_arrow_schema(self.schema)
        with store.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            headers = _headers(archive)
            names = _columns(headers, self.wanted, partition.path)
            lost = [c for c in self.schema.fieldNames() if c not in names and c != "file"]
            if lost:
                raise ValueError(f"{partition.path} has no array for {', '.join(lost)}")
            streams, width, rows = {}, 1, None
            for column, name in names.items():
                shape, turned, kind = headers[name]
                if kind.hasobject:
                    raise ValueError(f"array {name} holds objects")
                stream = archive.open(name + ".npy")
                _header(stream)
                rows = shape[0]
                if turned and len(shape) > 1:  # stored by column: rows are only there once all is read
                    stream = io.BytesIO(np.frombuffer(stream.read(), kind).reshape(shape, order="F").tobytes())
                size = kind.itemsize * int(np.prod(shape[1:]))
                streams[column], width = (stream, kind, shape[1:], size), width + size
            step = max(1, _BATCH_BYTES // width)
            for at in range(0, rows or 0, step):
                n, parts = min(step, rows - at), {}
                for column, (stream, kind, inner, size) in streams.items():
                    data = stream.read(n * size)
                    if len(data) < n * size:
                        raise ValueError(f"{partition.path} ends within {column}")
                    parts[column] = np.frombuffer(data, kind).reshape(n, *inner) if size else np.zeros((n, *inner), kind)
                own = {"file": pa.array([partition.path] * n)} if "file" not in parts else {}
                yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else _arrow(parts[f.name], f.type) for f in arrow], schema=arrow)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.rows, self.extra = int(options.get("rowsperfile", 65536)), json.loads(options.get("metadata", "{}"))
        self.job = uuid.uuid4().hex
        store, inner = _place(self.path)
        there = store.get_file_info(inner).type != fs.FileType.NotFound
        self.old = _files(self.path) if there and overwrite and any(f.path.endswith(".npz") for f in store.get_file_info(fs.FileSelector(inner, recursive=True))) else []
        store.create_dir(inner, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Files of at most ``rowsPerFile`` rows, under names that readers pass over until the job is committed."""
        from pyspark import TaskContext

        store, inner = _place(self.path)
        task = TaskContext.get()
        held, count, files = [], 0, []

        def flush() -> None:
            table = pa.Table.from_batches(held)
            data = {n: stacked(table.column(n).combine_chunks(), n) for n in table.column_names}
            name = posixpath.join(inner, f"_{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files):05d}.npz")
            buffer = io.BytesIO()
            np.savez_compressed(buffer, **data, **{k: np.array(v) for k, v in self.extra.items()})
            with store.open_output_stream(name) as out:
                out.write(buffer.getbuffer())
            files.append(name)

        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, self.rows - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == self.rows:
                    flush()
                    held, count = [], 0
        if held:
            flush()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, inner = _place(self.path)
        for old in self.old:
            store.delete_file(old)
        for n, name in enumerate(f for m in messages if m for f in m.files):
            store.move(name, posixpath.join(inner, f"part-{n:05d}-{self.job[:8]}.npz"))

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = _place(self.path)
        for name in (f for m in messages if m for f in m.files):
            store.delete_file(name)


def stacked(column: pa.Array, name: str = "column") -> np.ndarray:
    """A column as one array: lists must be of equal length, and only numbers with a fraction may be missing (as NaN)."""
    if isinstance(column, pa.ListArray):
        if column.null_count:
            raise ValueError(f"{name} has null rows")
        sizes = np.diff(column.offsets.to_numpy())
        if len(set(sizes.tolist())) > 1:
            raise ValueError(f"{name} has rows of different lengths")
        inner = stacked(column.flatten(), name)
        return inner.reshape(len(column), int(sizes[0]) if len(sizes) else 0, *inner.shape[1:])
    if column.null_count and not pa.types.is_floating(column.type):
        raise ValueError(f"{name} has null values")
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=np.str_)
    return column.to_numpy(zero_copy_only=False)


class ArrayFiles(DataSource):
    """``spark.read.format("npz")``: the rows of same-length arrays; option ``fields`` names and aliases columns."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        first = _files(self.options["path"])[0]
        store, _ = _place(self.options["path"])
        with store.open_input_file(first) as file, zipfile.ZipFile(file) as archive:
            headers = _headers(archive)
        names = _columns(headers, _aliases(self.options.get("fields")), first)
        fields = [T.StructField(c, _type(n, headers[n])) for c, n in names.items()]
        return T.StructType([*fields, *([] if "file" in names else [T.StructField("file", T.StringType())])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def read_arrays(spark: SparkSession, path: str, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of the array files at ``path``, a partition each, and ``file``; arrays of other lengths are no columns.

    ``fields`` gives each column the names it may go by. A missing path, a missing field and arrays of objects are errors.
    """
    spark.dataSource.register(ArrayFiles)
    reader = spark.read.format("npz").option("path", path)
    if fields is not None:
        reader = reader.option("fields", ";".join(f"{c}={','.join(n)}" for c, n in fields.items()))
    return reader.load()


def read_array_metadata(path: str) -> dict[str, object]:
    """What the first file holds besides its columns: single values and arrays of other lengths."""
    store, _ = _place(path)
    with store.open_input_file(_files(path)[0]) as file, np.load(file, allow_pickle=False) as data:
        rows = max((data[n].shape[0] for n in data.files if data[n].ndim), default=None)
        return {n: data[n].tolist() for n in data.files if not data[n].ndim or data[n].shape[0] != rows}


def write_arrays(df: DataFrame, path: str, metadata: dict | None = None, rows_per_file: int = 65536, mode: str = "append") -> None:
    """Columns as arrays, in compressed files of at most ``rows_per_file`` rows; ``metadata`` goes into each."""
    df.sparkSession.dataSource.register(ArrayFiles)
    out = df.write.format("npz").mode(mode).option("path", path).option("rowsPerFile", str(rows_per_file))
    out.option("metadata", json.dumps(metadata or {})).save()


def write_feature_arrays(features: DataFrame, path: str, metadata: dict | None = None, mode: str = "append") -> None:
    """``(image_name, feat)`` rows as stacked ``features`` and ``image_names``."""
    write_arrays(features.select(F.col("feat").alias("features"), F.col("image_name").alias("image_names")), path, metadata, mode=mode)


def read_feature_arrays(spark: SparkSession, path: str) -> DataFrame:
    return read_arrays(spark, path, {"feat": ["features"], "image_name": ["image_names", "names"]}).drop("file")


#: The names that a scene's fields go by, its files, and the image files that count.
EDGE_FIELDS = {"u": ["row", "rows"], "v": ["col", "cols"], "w": ["weight", "val", "vals"]}
NAME_FIELDS = ("images", "filenames")
GRAPH_FILE, INDEX_FILE, IMAGE_FOLDER, IMAGE_ENDS = "gt.npz", "image_index.json", "images", (".jpg", ".png")


def _scene(index: bytes | None, graph: bytes | None, listed: list[str] | None) -> tuple[str, list[str], dict[str, np.ndarray]]:
    """Status, image names and edge fields of one scene."""
    if graph is None:
        return f"no {GRAPH_FILE}", [], {}
    with np.load(io.BytesIO(graph), allow_pickle=False) as data:
        names = None
        if index is not None:
            found = json.loads(index.decode("utf-8"))
            if isinstance(found, list):
                names = found
            elif "id_to_name" in found:
                names = found["id_to_name"]
            elif "name_to_id" in found:
                names = sorted(found["name_to_id"], key=found["name_to_id"].get)
        if names is None:
            names = next((data[k].tolist() for k in NAME_FIELDS if k in data), None)
        if names is None and listed is not None:
            names = sorted(n for n in listed if n.lower().endswith(IMAGE_ENDS))
        if names is None:
            return "no image order", [], {}
        fields = {}
        for column, aliases in EDGE_FIELDS.items():
            key = next((k for k in aliases if k in data), None)
            if key is None:
                return f"none of the fields {', '.join(aliases)}", [], {}
            fields[column] = data[key].astype(np.float32 if column == "w" else np.int64)
    if len({len(f) for f in fields.values()}) > 1:
        return "fields differ in length", [], {}
    return ("ok" if len(names) else "no images"), [str(n) for n in names], fields


def scan_scenes(spark: SparkSession, root: str) -> DataFrame:
    """``(scene, status, names, edges)``, a row for each folder below ``root``; whatever is wrong with one is its status.

    A scene holds ``gt.npz`` with an edge list, and its images' order in ``image_index.json``, in the arrays, or as sorted names in
    ``images``. Files are listed and read by Spark; a task holds one scene at a time. ``root`` itself must be there.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise FileNotFoundError(root)
    folders = [f.getPath().getName() for f in store.listStatus(where) if f.isDirectory()]
    base = store.makeQualified(where).toUri().getPath().rstrip("/") + "/"
    scenes = spark.createDataFrame([(f,) for f in sorted(folders)], "scene string")
    schema = "scene string, status string, names array<string>, edges array<struct<u: bigint, v: bigint, w: float>>"
    if not folders:
        return spark.createDataFrame([], schema)
    inner = F.substr("path", F.locate(base, F.col("path")) + F.lit(len(base)))

    def files(glob: str, *columns) -> DataFrame:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        return rows.select(F.split_part(inner, F.lit("/"), F.lit(1)).alias("scene"), F.regexp_replace(inner, "^[^/]*/", "").alias("name"), *columns)

    own = files("{" + f"{GRAPH_FILE},{INDEX_FILE}" + "}", "content").filter(F.col("name").isin(GRAPH_FILE, INDEX_FILE))
    images = files("*", F.lit(None).cast("binary").alias("content")).filter(F.col("name").startswith(IMAGE_FOLDER + "/"))
    rows = scenes.withColumns({"name": F.lit(""), "content": F.lit(None).cast("binary")}).unionByName(own).unionByName(images)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def parse(key: tuple, table: pa.Table) -> pa.Table:
        names = table.column("name").to_pylist()
        held = {n: c for n, c in zip(names, table.column("content")) if n in (GRAPH_FILE, INDEX_FILE)}
        listed = [n.split("/", 1)[1] for n in names if n.startswith(IMAGE_FOLDER + "/") and n.count("/") == 1]
        try:
            content = {n: c.as_py() for n, c in held.items()}
            status, found, fields = _scene(content.get(INDEX_FILE), content.get(GRAPH_FILE), listed or None)
        except Exception as error:  # any broken file is a fact about its scene
            status, found, fields = f"unreadable: {type(error).__name__}: {str(error)[:200]}", [], {}
        edges = pa.StructArray.from_arrays([pa.array(fields.get(c, np.zeros(0)), t) for c, t in (("u", pa.int64()), ("v", pa.int64()), ("w", pa.float32()))], names=["u", "v", "w"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(edges)], pa.int32()), edges).cast(arrow.field("edges").type)
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([status]), pa.array([found], pa.list_(pa.string())), lists], schema=arrow)

    return rows.groupBy("scene").applyInArrow(parse, schema)


def scene_tables(scanned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(scene, n, status)`` of every folder, and ``(scene, idx, name)`` and ``(scene, u, v, w)`` of those that are fine."""
    fine = scanned.filter("status = 'ok'")
    nodes = fine.select("scene", F.posexplode("names").alias("idx", "name"))
    edges = fine.select("scene", F.inline("edges"))
    return scanned.select("scene", F.size("names").cast("long").alias("n"), "status"), nodes, edges
