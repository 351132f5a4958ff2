"""Single files on any Hadoop file system, read and written by the driver; bytes are copied inside the JVM where they can be."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


@contextmanager
def create(spark: SparkSession, path: str, gzip: bool = False):
    """A stream that writes a new file; a file that is there is replaced when the new one is complete."""
    fs, at = place(spark, path)
    part = at.suffix(".part")
    out = fs.create(part, True)
    stream = spark._jvm.java.util.zip.GZIPOutputStream(out) if gzip else out
    try:
        yield stream
    except BaseException:
        stream.close()
        fs.delete(part, False)
        raise
    stream.close()
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"{part} cannot become {at}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, None if there is none."""
    fs, at = place(spark, path)
    if not fs.exists(at):
        return None
    return "".join(r.value + "\n" for r in spark.read.text(path).collect())


def parts(spark: SparkSession, folder: str) -> list:
    """Paths of a folder's part files that are not empty, in order."""
    fs, at = place(spark, folder)
    found = [s for s in fs.listStatus(at) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
    return [s.getPath() for s in sorted(found, key=lambda s: s.getPath().getName())]


def join(spark: SparkSession, folder: str, path: str, before: bytes = b"", after: bytes = b"", skip: int = 0) -> None:
    """A folder's part files as one file; the first `skip` bytes of the first are left out."""
    fs, _ = place(spark, folder)
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    with create(spark, path) as out:
        out.write(bytearray(before))
        for k, part in enumerate(parts(spark, folder)):
            source = fs.open(part)
            try:
                if k == 0 and skip:
                    source.seek(skip)
                copy(source, out, 1 << 20, False)
            finally:
                source.close()
        out.write(bytearray(after))


def unzip(spark: SparkSession, path: str, folder: str, wanted: tuple[str, ...]) -> list[str]:
    """Files of an archive whose names (without their folders) are wanted, copied to a folder."""
    fs, at = place(spark, path)
    jvm, out = spark._jvm, []
    archive = jvm.java.util.zip.ZipInputStream(fs.open(at))
    try:
        for entry in iter(archive.getNextEntry, None):
            name = entry.getName().rsplit("/", 1)[-1]
            if entry.isDirectory() or name not in wanted or "__MACOSX" in entry.getName():
                continue
            with create(spark, f"{folder}/{name}") as to:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(archive, to, 1 << 16, False)
            out.append(name)
    finally:
        archive.close()
    return sorted(out)


def folders(spark: SparkSession, path: str) -> Iterator[str]:
    """Names of the folders below a path."""
    fs, at = place(spark, path)
    if fs.exists(at):
        yield from sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
