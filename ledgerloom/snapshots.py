"""Immutable generations of a catalog with compare-and-swap commits, time travel and rollback.

Relations are written as Parquet into a folder of this attempt's own; then the manifest and, last, the
next pointer are created.  Both are files that can only be created where they don't exist yet, which is
the whole of the locking: of two writers one creates the next pointer, and nothing is left behind that a
crashed one would have to release.  Readers follow the highest pointer or name an id, so they never see
half a generation.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_uri


class Conflict(RuntimeError):
    """The store has changed, or one id would name different content."""


@dataclass(frozen=True)
class Manifest:
    generation_id: str
    generated_at: str
    checksums: Mapping[str, str]
    rows: Mapping[str, int]
    parent: str | None = None
    completeness: str = "complete"
    reasons: tuple[str, ...] = field(default_factory=tuple)
    attempt: str = ""

    def same_content(self, other: Manifest) -> bool:
        return dict(self.checksums) == dict(other.checksums)


def checksum(df: DataFrame) -> tuple[str, int]:
    """(digest, number of rows) of a relation, whatever the order of its rows and columns.

    Two hashes of each row fold with XOR in one pass; nothing is sorted or collected.
    """
    columns = sorted(df.columns)
    kinds = dict(df.dtypes)
    texts = [F.to_json(F.struct(F.col(f"`{c}`"))) if kinds[c].startswith(("struct", "array", "map", "variant")) else F.col(f"`{c}`").cast("string") for c in columns]
    cells = [x for t in texts for x in (F.coalesce(t, F.lit("")), t.isNull())]
    # A row that occurs an even number of times would vanish from XOR, so each row counts its copies.
    copies = df.select(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit("second"), *cells).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    row = copies.agg(F.bit_xor(F.xxhash64("a", "n")), F.bit_xor(F.xxhash64("n", "b")), F.sum("n")).first()
    text = json.dumps([[(c, kinds[c]) for c in columns], row[0], row[1], row[2]])
    import hashlib

    return "sha256:" + hashlib.sha256(text.encode()).hexdigest(), int(row[2] or 0)


class LocalFiles:
    """Small files below a folder of a POSIX file system that all executors share."""

    def __init__(self, root: str):
        self.root = Path(root)

    def read(self, name: str) -> str | None:
        try:
            return (self.root / name).read_text(encoding="utf-8")
        except FileNotFoundError:
            return None

    def create(self, name: str, text: str) -> bool:
        """Create a file with its whole content at once; False if it exists."""
        path = self.root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        part.write_text(text, encoding="utf-8")
        try:
            os.link(part, path)
        except FileExistsError:
            return False
        finally:
            part.unlink()
        return True

    def names(self, folder: str) -> list[str]:
        try:
            return sorted(p.name for p in (self.root / folder).iterdir() if not p.name.startswith("."))
        except FileNotFoundError:
            return []

    def drop(self, folder: str) -> None:
        import shutil

        shutil.rmtree(self.root / folder, ignore_errors=True)

    def uri(self, name: str) -> str:
        return file_uri(self.root / name)


class HadoopFiles:
    """The same on any file system that Spark can reach, an object store among them.

    Creating without overwriting is atomic where the file system makes it so (HDFS, or an object store
    with conditional writes).  A file that is created but not written yet reads as absent.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or None
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.create(self._path(name), False)
        except Py4JJavaError as problem:
            if "AlreadyExists" in str(problem.java_exception):
                return False
            raise
        stream.write(text.encode())
        stream.close()
        return True

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def drop(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"


class GenerationStore:
    """A store below a folder that all executors share, named by a path or by a URI of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        local = root.removeprefix("file://")
        self.files = HadoopFiles(spark, root) if "://" in local else LocalFiles(local)

    @staticmethod
    def _folder(generation_id: str) -> str:
        if not generation_id or "/" in generation_id or generation_id.startswith("."):
            raise ValueError(f"invalid generation id {generation_id!r}")
        return f"generations/{generation_id}"

    def _pointer(self) -> tuple[int, str | None]:
        """(number, generation id) of the last pointer; (0, None) in an empty store."""
        for name in reversed(self.files.names("pointers")):
            if text := self.files.read(f"pointers/{name}"):
                return int(name), text.strip()
        return 0, None

    def _advance(self, number: int, generation_id: str) -> None:
        if not self.files.create(f"pointers/{number + 1:020d}", generation_id):
            raise Conflict("another commit came first")

    def current_id(self) -> str | None:
        return self._pointer()[1]

    def manifest(self, generation_id: str) -> Manifest:
        text = self.files.read(f"{self._folder(generation_id)}/manifest.json")
        if text is None:
            raise KeyError(generation_id)
        return Manifest(**json.loads(text))

    def generations(self) -> list[str]:
        return [n for n in self.files.names("generations") if "manifest.json" in self.files.names(f"generations/{n}")]

    def commit(self, generation_id: str, generated_at: str, relations: Mapping[str, DataFrame], expected: str | None, **facts) -> Manifest:
        """Write a generation and make it the current one, if the current one is `expected`.

        The same id with the same content again changes nothing; with other content it is a Conflict.
        Each relation is computed once; its checksum is that of what was written.
        """
        attempt = f"{self._folder(generation_id)}/{uuid.uuid4().hex}"
        sums = {}
        for name, df in relations.items():
            target = self.files.uri(f"{attempt}/{name}")
            df.write.parquet(target)
            sums[name] = checksum(self.spark.read.parquet(target))
        made = Manifest(generation_id, generated_at, {n: s for n, (s, _) in sums.items()}, {n: k for n, (_, k) in sums.items()}, parent=expected, attempt=attempt, **facts)
        number, current = self._pointer()
        try:
            known = self.manifest(generation_id)
        except KeyError:
            known = None
        if not known and current == expected and not self.files.create(f"{self._folder(generation_id)}/manifest.json", json.dumps(asdict(made))):
            known = self.manifest(generation_id)  # another writer of the same id came first
        if known or current != expected:
            self.files.drop(attempt)
        if known and not known.same_content(made):
            raise Conflict(f"generation {generation_id!r} has other content")
        if current == generation_id:
            return known or made
        if current != expected:
            raise Conflict(f"expected {expected!r}, found {current!r}")
        self._advance(number, generation_id)
        return known or made

    def activate(self, generation_id: str) -> bool:
        """Move the pointer to a retained generation; False if it is there already."""
        self.manifest(generation_id)
        number, current = self._pointer()
        if current == generation_id:
            return False
        self._advance(number, generation_id)
        return True

    def read(self, name: str, generation_id: str | None = None) -> DataFrame:
        """A relation of a generation, by default of the current one."""
        generation_id = generation_id or self.current_id()
        if generation_id is None:
            raise KeyError("the store is empty")
        return self.spark.read.parquet(self.files.uri(f"{self.manifest(generation_id).attempt}/{name}"))

    def read_if_changed(self, name: str, known_id: str | None) -> DataFrame | None:
        return None if self.current_id() == known_id else self.read(name)

    def verify(self, generation_id: str) -> list[str]:
        """Names of relations whose content doesn't have the checksum of the manifest."""
        kept = self.manifest(generation_id)
        return [n for n, s in kept.checksums.items() if checksum(self.read(n, generation_id))[0] != s]
