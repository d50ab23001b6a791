"""Folders of files written, stored, listed and sealed by executors, with digests taken on the way.

Paths are on a file system that the driver and all executors share, as a
mounted folder: exclusive creation and renames are its own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import shutil
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyspark.sources.lineage import cut
from tallyspark.sources.tables import tasks

MANIFEST = "manifest.json"
#: Names at the top of a bundle that no file may have.
ENVELOPE = [MANIFEST, "bundle.dsse.json"]
_COPY_BYTES = 4 << 20


def local(path: str) -> str:
    """A path without file: in front."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def path_fault(path: str | None, reserved: bool = True) -> str | None:
    """Why a path is no canonical one below a bundle's root, or None: it must be relative, with / alone between its parts and without empty, . and .. ones."""
    if not path or "\x00" in path:
        return "is empty or holds a zero character"
    if "\\" in path or path.startswith("/") or path[1:2] == ":":
        return "is absolute or holds a backslash"
    if any(part in ("", ".", "..") for part in path.split("/")):
        return "has an empty, . or .. part"
    return "is a name of the bundle's own" if reserved and path in ENVELOPE else None


def _make_below(base: str, folder: str) -> None:
    """Makes a folder and its parents below a base that must be there."""
    at = base
    for part in folder.split("/") if folder else []:
        at = os.path.join(at, part)
        try:
            os.mkdir(at)
        except FileExistsError:
            pass


def _remove(folder: str) -> None:
    """Deletes a folder that tasks may still write into: moved first, so that nothing is added meanwhile."""
    gone = f"{folder}-gone"
    try:
        os.rename(folder, gone)
    except FileNotFoundError:
        return
    shutil.rmtree(gone, ignore_errors=True)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: a list of its own, by path, and how long it is."""

    listing: str
    files: int
    size: int


class BundleSource(DataSource):
    """Writes rows (path string, content binary) as files of a new folder and a manifest of their digests.

    Tasks write into a hidden folder beside the target and tell the driver
    only where their list of (path, size, sha256) is. The driver merges these
    lists into the manifest, a line at a time, and renames the folder once, so
    the target is whole or isn't there. A path that two rows carry, a path
    that is no canonical one, or a failed task leaves nothing.

    Options: path (must not exist), fields (a JSON object with the manifest's
    other fields). Files below spec/ are listed as spec_files by their path
    below it, all others as files.
    """

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if {f.name: f.dataType.typeName() for f in schema.fields} != {"path": "string", "content": "binary"}:
            raise ValueError("a bundle is written from (path string, content binary)")
        return _BundleWriter(dict(self.options))


class _BundleWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.abspath(local(options["path"]))
        self.fields = json.loads(options.get("fields", "{}"))
        if not isinstance(self.fields, dict) or {"files", "spec_files"} & set(self.fields):
            raise ValueError("fields must be a JSON object without files and spec_files")
        if os.path.lexists(self.root):
            raise FileExistsError(self.root)
        self.stage = os.path.join(os.path.dirname(self.root), f".bundle-{uuid.uuid4().hex}")
        # Only the driver makes the folder: a task that still runs when it is gone finds no place to write.
        for name in ("files", "lists"):
            os.makedirs(os.path.join(self.stage, name))

    def write(self, rows: Iterator) -> Written:
        done, size, made, files = [], 0, set(), os.path.join(self.stage, "files")
        for row in rows:
            path, content = row.path, row.content
            fault = path_fault(path)
            if fault or content is None:
                raise ValueError(f"path {path!r} {fault}" if fault else f"{path!r} has no content")
            target = os.path.join(files, path)
            if (folder := os.path.dirname(path)) not in made:
                _make_below(files, folder)
                made.add(folder)
            # A task that runs twice writes the same bytes; the last one's name is moved over the first's.
            partial = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
            with open(partial, "xb") as f:
                f.write(content)
            os.replace(partial, target)
            done.append((path, len(content), hashlib.sha256(content).hexdigest()))
            size += len(content)
        listing = os.path.join(self.stage, "lists", uuid.uuid4().hex)
        with open(listing, "x", encoding="utf-8") as f:
            f.writelines(json.dumps(x, ensure_ascii=False) + "\n" for x in sorted(done))
        return Written(listing, len(done), size)

    def _merged(self, listings: list[str]) -> Iterator[list]:
        def lines(name: str) -> Iterator[list]:
            with open(name, encoding="utf-8") as f:
                for line in f:
                    yield json.loads(line)

        before = None
        for entry in heapq.merge(*map(lines, listings)):
            if entry[0] == before:
                raise ValueError(f"two rows have the path {before!r}")
            before = entry[0]
            yield entry

    def commit(self, messages: list) -> None:
        listings = [m.listing for m in messages if m is not None]
        files = os.path.join(self.stage, "files")
        try:
            with open(os.path.join(files, MANIFEST), "x", encoding="utf-8", newline="\n") as out:
                self._manifest(out, listings)
            os.rename(files, self.root)
        finally:
            _remove(self.stage)

    def _manifest(self, out, listings: list[str]) -> None:
        """JSON with sorted keys and two spaces a level, written as it is merged."""
        parts = {key: [f"  {json.dumps(key)}: " + json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False).replace("\n", "\n  ")] for key, value in self.fields.items()}
        chosen = {"files": (lambda p: None if p.startswith("spec/") else p), "spec_files": (lambda p: p.removeprefix("spec/") if p.startswith("spec/") else None)}
        out.write("{\n")
        for n, key in enumerate(sorted([*parts, *chosen])):
            out.write(",\n" if n else "")
            if key in parts:
                out.write(parts[key][0])
                continue
            empty = True
            for path, _, digest in self._merged(listings):
                if (named := chosen[key](path)) is not None:
                    out.write((f"  {json.dumps(key)}: {{\n" if empty else ",\n") + f"    {json.dumps(named, ensure_ascii=False)}: {json.dumps(digest)}")
                    empty = False
            out.write(f"  {json.dumps(key)}: {{}}" if empty else "\n  }")
        out.write("\n}\n")

    def abort(self, messages: list) -> None:
        _remove(self.stage)


def write_bundle(files: DataFrame, path: str, fields: dict | None = None) -> None:
    """See BundleSource; files has path and content (binary, or text as UTF-8)."""
    files.sparkSession.dataSource.register(BundleSource)
    ready = files.select("path", F.col("content").cast("binary").alias("content"))
    ready.write.format("bundle").mode("append").options(path=path, fields=json.dumps(fields or {})).save()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of all files that a bundle's manifest lists."""
    raw = spark.read.text(f"{path}/{MANIFEST}", wholetext=True)
    listed = raw.select(F.from_json("value", "files map<string,string>, spec_files map<string,string>").alias("m"))
    files = listed.select(F.explode("m.files").alias("path", "sha256"))
    return files.unionByName(listed.select(F.explode("m.spec_files").alias("path", "sha256")).select(F.concat(F.lit("spec/"), "path").alias("path"), "sha256"))


def bundle_faults(spark: SparkSession, path: str) -> DataFrame:
    """(path, fault) where a bundle's folder and its manifest differ: missing, changed, extra, or no regular file. No rows for a sound one."""
    found = listing(spark, path).where(F.col("kind") != "folder").select("path", "kind")
    digests = with_digests(found.where("kind = 'file'").select("path"), path).select("path", F.col("sha256").alias("is"))
    there = found.join(digests, "path", "left").where(~F.col("path").isin(*ENVELOPE))
    joined = there.join(read_manifest(spark, path), "path", "full")
    fault = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") != "file", F.concat(F.lit("is "), "kind")).when(F.col("sha256").isNull(), "extra").when(F.col("is") != F.col("sha256"), "changed")
    return joined.select("path", fault.alias("fault")).where("fault IS NOT NULL")


def valid_cid(text: Column) -> Column:
    """Whether a text is a content address: a lower-case scheme and hex digits, 64 of them for sha256."""
    sound = text.rlike(r"^[a-z0-9]+:[0-9a-f]+\z")
    return F.coalesce(sound & (~text.startswith("sha256:") | (F.length(text) == 71)), F.lit(False))


def _stored_at(root: str, digest: str) -> str:
    return os.path.join(root, "sha256", digest[:2], digest)


def put_all(contents: DataFrame, root: str, column: str = "content") -> DataFrame:
    """Stores each content under its address, once; (cid, path, size) of what the rows name, each address once.

    A file is created only where none is: by a hard link, which fails if the
    name is taken. Equal bytes that are there already are accepted, others
    fail the task and stay as they are. Null contents are left out. Equal
    contents meet before any file is touched, so there is one look at the
    store for each address, not for each row.
    """
    root = os.path.abspath(local(root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(0):
                raw = value.as_py()
                digest = hashlib.sha256(raw).hexdigest()
                target = _stored_at(root, digest)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                if not os.path.exists(target):
                    partial = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
                    with open(partial, "xb") as f:
                        f.write(raw)
                    try:
                        os.link(partial, target)
                    except FileExistsError:
                        pass
                    finally:
                        os.unlink(partial)
                if os.path.getsize(target) != len(raw) or digest != _digest_of(target):
                    raise ValueError(f"sha256:{digest} is stored with other bytes")
                out.append((f"sha256:{digest}", os.path.relpath(target, root), len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["cid", "path", "size"])

    raw = contents.select(F.col(column).cast("binary").alias("content")).where("content IS NOT NULL").distinct()
    return cut(raw.mapInArrow(run, "cid string, path string, size long"))


def _digest_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(cid, path) of a store; files whose place is no address are left out."""
    parts = F.split("path", "/")
    named = listing(spark, root).where("kind = 'file'").where((F.size(parts) == 3) & (F.substring(parts[2], 1, 2) == parts[1]))
    return named.select(F.concat_ws(":", parts[0], parts[2]).alias("cid"), "path").where(valid_cid(F.col("cid")))


def get_all(wanted: DataFrame, root: str, cid: str = "cid") -> DataFrame:
    """wanted with the stored content; an address that is malformed, not stored, or stored with other bytes fails."""
    root = os.path.abspath(local(root))
    schema = StructType([*wanted.schema.fields]).add("content", "binary")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                name = one.column(cid)[0].as_py()
                if not re.fullmatch("sha256:[0-9a-f]{64}", name or ""):
                    raise ValueError(f"no content address: {name!r}")
                with open(_stored_at(root, name[7:]), "rb") as f:
                    raw = f.read()
                if hashlib.sha256(raw).hexdigest() != name[7:]:
                    raise ValueError(f"{name} is stored with other bytes")
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([raw], pa.binary())], names)

    return wanted.mapInArrow(run, schema)


_LISTED = "path string, kind string, size long, modified long, inode long"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, size, modified, inode) of every node below a root: file, link, folder or other. Looks, follows nothing.

    Executors list a level of folders at a time; the driver knows only how
    many levels there are.
    """
    root = os.path.abspath(local(root))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _LISTED.split(", ")]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                out = []
                with os.scandir(os.path.join(root, folder)) as nodes:
                    for node in nodes:
                        s = node.stat(follow_symlinks=False)
                        kind = "link" if stat.S_ISLNK(s.st_mode) else "folder" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
                        out.append((os.path.join(folder, node.name), kind, s.st_size, s.st_mtime_ns, s.st_ino))
                        if len(out) == 10_000:
                            yield _batch(out, names)
                            out = []
                if out:
                    yield _batch(out, names)

    parts = tasks(spark)
    levels = [cut(spark.createDataFrame([("",)], "path string").mapInArrow(look, _LISTED))]
    while not (folders := levels[-1].where("kind = 'folder'").select("path")).isEmpty():
        levels.append(cut(folders.repartition(parts, "path").mapInArrow(look, _LISTED)))
    return reduce(DataFrame.unionByName, levels)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names)


_DIGESTED = "path string, size long, sha256 string"


def with_digests(files: DataFrame, root: str) -> DataFrame:
    """(path, size, sha256) of listed regular files, read by executors a few MiB at a time."""
    return _each(files, root, None)


def sealed_copy(files: DataFrame, root: str, into: str) -> DataFrame:
    """Copies listed files into a private folder and gives (path, size, sha256) of the bytes copied.

    What is read afterwards is one set of bytes, whatever happens at the
    source. Executors copy and digest in one pass; a file that is reached
    through a link, is no regular one, or whose size, time or inode changes
    while it is copied fails the copy. The target appears whole or not at all.
    """
    target = os.path.abspath(local(into))
    if os.path.lexists(target):
        raise FileExistsError(target)
    stage = os.path.join(os.path.dirname(target), f".sealed-{uuid.uuid4().hex}")
    os.makedirs(stage)
    try:
        done = cut(_each(files, root, stage))
        os.rename(stage, target)
    except PythonException as e:
        _remove(stage)
        raise ValueError(f"not sealed: {e}") from e
    except BaseException:
        _remove(stage)
        raise
    return done


def _each(files: DataFrame, root: str, into: str | None) -> DataFrame:
    root = os.path.abspath(local(root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        real = os.path.realpath(root)
        for batch in batches:
            done = [_pass(root, real, path, into) for path in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "size", "sha256"])

    # Names are few bytes for much work, so they are dealt to all tasks, not by bytes.
    return files.select("path").repartition(tasks(files.sparkSession), "path").mapInArrow(run, _DIGESTED)


def _pass(root: str, real: str, path: str, into: str | None) -> tuple[str, int, str]:
    """Reads a file once, to its digest and perhaps a copy; the source is compared before and after. real: where the root is without links."""
    if fault := path_fault(path, reserved=False):
        raise ValueError(f"path {path!r} {fault}")
    source = os.path.join(root, path)
    if os.path.realpath(source) != os.path.join(real, path):
        raise ValueError(f"reached through a link: {path}")
    # No link is followed at the end of the path, and a pipe without a writer doesn't block.
    handle = os.open(source, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    with open(handle, "rb") as f:
        before = os.fstat(handle)
        if not stat.S_ISREG(before.st_mode):
            raise ValueError(f"not a regular file: {path}")
        digest, size, out, partial = hashlib.sha256(), 0, None, None
        if into is not None:
            folder = os.path.dirname(os.path.join(into, path))
            _make_below(into, os.path.dirname(path))
            partial = os.path.join(folder, f".{uuid.uuid4().hex}")
            out = open(partial, "xb")  # noqa: SIM115
        try:
            while piece := f.read(_COPY_BYTES):
                digest.update(piece)
                size += len(piece)
                if out:
                    out.write(piece)
        finally:
            if out:
                out.close()
        after = os.stat(source, follow_symlinks=False)
    same = lambda s: (s.st_size, s.st_mtime_ns, s.st_ino)
    if same(before) != same(after) or size != before.st_size:
        raise ValueError(f"changed while it was read: {path}")
    if partial:
        os.replace(partial, os.path.join(into, path))
    return path, size, digest.hexdigest()
