"""Files as a driver handles them: bundles and transfer archives, Arrow streams, split shards by name, atomic small files.

Only metadata and single archives pass through the driver; rows stay in Spark. Paths here are local ones, or on a shared mount.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import tarfile
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = 1 << 20


def sha256_of(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(_BLOCK):
            digest.update(block)
    return digest.hexdigest()


@contextmanager
def atomic_writer(path: str | Path) -> Iterator[io.TextIOBase]:
    """A text file that replaces path when it is complete and on disk; after an error path is as it was."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            yield f
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def atomic_json(path: str | Path, value: object) -> None:
    with atomic_writer(path) as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
        f.write("\n")


@contextmanager
def failure_report(path: str | Path, **known) -> Iterator[dict]:
    """Runs a publication; if it fails, what is known and the error go to path's .failed.json, and the error is raised. The body may add to the dictionary."""
    try:
        yield known
    except Exception as e:
        atomic_json(Path(path).with_suffix(".failed.json"), known | {"status": "FAIL", "error": f"{type(e).__name__}: {e}"})
        raise


def split_shards(folder: str, split: str) -> list[str]:
    """The files split_<number>.parquet of a folder, in order; none, or a link to outside, is an error."""
    root = Path(folder).resolve(strict=True)
    found = sorted(p for p in root.iterdir() if re.fullmatch(rf"{re.escape(split)}_\d+\.parquet", p.name))
    if not found:
        raise ValueError(f"{root} has no {split}_<number>.parquet")
    if outside := [p.name for p in found if not p.resolve().is_relative_to(root.parent)]:
        raise ValueError(f"links to outside: {outside}")
    return [str(p) for p in found]


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The rows of split_shards(), of which no text may be blank."""
    df = spark.read.parquet(*split_shards(folder, split))
    blank = F.raise_error(F.concat(F.lit("blank text in "), F.col("_metadata.file_path"))).cast("string")
    return df.withColumn("text", F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0, F.col("text")).otherwise(blank))


def arrow_stream(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(line): the records of an Arrow IPC stream as JSON with sorted keys, for a file of bounded size; sha256, if given, must be the file's."""
    if sha256 is not None and sha256_of(path) != sha256:
        raise ValueError(f"{path} isn't the pinned file")
    with pa.memory_map(path) as source, pa.ipc.open_stream(source) as reader:
        table = reader.read_all()
    lines = [json.dumps(r, ensure_ascii=False, sort_keys=True, default=str) for r in table.to_pylist()]
    return spark.createDataFrame([(x,) for x in lines], "line string")


def unchanged(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame], use: Callable[[DataFrame], object]):
    """use(read(path)), an error if any file below path changed meanwhile: the inventory is taken before and after."""
    from corpusloom.sources.readers import files

    before = sorted(map(tuple, files(spark, path).select("path", "sha256").collect()))
    out = use(read(spark, path))
    if sorted(map(tuple, files(spark, path).select("path", "sha256").collect())) != before:
        raise ValueError(f"files below {path} changed while they were read")
    return out


def zip_sentences(spark: SparkSession, path: str, suffix: str = ".conllu", mark: str = "# text = ") -> DataFrame:
    """(text): the lines after mark of the files in zip archives. An archive is read by one task."""

    @F.udf("array<string>")
    def lines(content):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [x[len(mark) :] for n in sorted(z.namelist()) if n.endswith(suffix) for x in z.read(n).decode("utf-8").splitlines() if x.startswith(mark)]

    return spark.read.format("binaryFile").load(path).select(F.explode(lines("content")).alias("text"))


def inventory(root: str | Path) -> list[dict]:
    """path (relative), bytes and sha256 of each file below root, by path; links are refused."""
    root = Path(root)
    out = []
    for p in sorted(root.rglob("*")):
        if p.is_symlink():
            raise ValueError(f"{p} is a link")
        if p.is_file():
            out.append({"path": p.relative_to(root).as_posix(), "bytes": p.stat().st_size, "sha256": sha256_of(p)})
    return out


class _Parts(io.RawIOBase):
    """Writes to files path.000, path.001, ... of size bytes."""

    def __init__(self, path: Path, size: int):
        self.path, self.size, self.parts, self.now = path, size, [], None

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        view = memoryview(data)
        at = 0
        while at < len(view):
            if self.now is None or self.now.tell() >= self.size:
                self._close_part()
                name = self.path.with_name(f"{self.path.name}.{len(self.parts):03d}")
                self.now = name.open("xb")
                self.parts.append(name)
            at += self.now.write(view[at : at + self.size - self.now.tell()])
        return at

    def _close_part(self) -> None:
        if self.now is not None:
            self.now.close()
            self.now = None

    def close(self) -> None:
        self._close_part()
        super().close()


def export_bundle(root: str, out: str, name: str = "bundle", *, part_bytes: int = 1 << 30, level: int = 19, extra: dict | None = None) -> dict:
    """Packs the files below root into out/name.tar.zst in parts, the same bytes for the same files: sorted, without times or owners. The manifest beside
    them lists files and parts with their hashes."""
    target, files = Path(out), inventory(root)
    if not files:
        raise ValueError(f"{root} has no files")
    target.mkdir(parents=True, exist_ok=True)
    sink = _Parts(target / f"{name}.tar.zst", part_bytes)
    with zstandard.ZstdCompressor(level=level).stream_writer(sink, closefd=False) as packed, tarfile.open(fileobj=packed, mode="w|", format=tarfile.PAX_FORMAT) as tar:
        for f in files:
            info = tarfile.TarInfo(f["path"])
            info.size, info.mtime, info.mode = f["bytes"], 0, 0o644
            with (Path(root) / f["path"]).open("rb") as source:
                tar.addfile(info, source)
    sink.close()
    manifest = {"schema": 1, "files": files, "parts": [{"path": p.name, "bytes": p.stat().st_size, "sha256": sha256_of(p)} for p in sink.parts]} | (extra or {})
    atomic_json(target / f"{name}.json", manifest)
    return manifest


class _Joined(io.RawIOBase):
    def __init__(self, paths: list[Path]):
        self.left, self.now = list(paths), None

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.now is None:
                if not self.left:
                    return 0
                self.now = self.left.pop(0).open("rb")
            n = self.now.readinto(buffer)
            if n:
                return n
            self.now.close()
            self.now = None


def restore_bundle(folder: str, out: str, name: str = "bundle", rows: Callable[[str], int] | None = None) -> dict:
    """Unpacks a bundle into the new folder out: parts are verified first, members must be plain files within out, and the files must be the listed ones. If
    rows is given, rows(out) must be the manifest's rows. Nothing is left behind on an error."""
    source, target = Path(folder), Path(out)
    manifest = json.loads((source / f"{name}.json").read_text())
    for p in manifest["parts"]:
        if sha256_of(source / p["path"]) != p["sha256"]:
            raise ValueError(f"part {p['path']} isn't the listed one")
    if target.exists():
        raise FileExistsError(out)
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}."))
    try:
        joined = io.BufferedReader(_Joined([source / p["path"] for p in manifest["parts"]]), _BLOCK)
        with zstandard.ZstdDecompressor().stream_reader(joined) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
            for member in tar:
                if not member.isfile() or not (stage / member.name).resolve().is_relative_to(stage.resolve()):
                    raise ValueError(f"unsafe member {member.name}")
                tar.extract(member, stage, filter="data")
        if inventory(stage) != manifest["files"]:
            raise ValueError("the files aren't the listed ones")
        if rows is not None and rows(str(stage)) != manifest["rows"]:
            raise ValueError("the number of rows isn't the listed one")
        os.replace(stage, target)
    except BaseException:
        import shutil

        shutil.rmtree(stage, ignore_errors=True)
        raise
    return manifest
