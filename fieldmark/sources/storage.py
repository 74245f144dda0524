"""Files and folders by Hadoop's file API: a path may lie on this machine or in any store that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..session import build_session


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or build_session()


def _at(path: str):
    """The file system of a path, and the path as it takes it."""
    spark = _spark()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(path: str) -> bool:
    fs, where = _at(path)
    return fs.exists(where)


def modified(path: str) -> int | None:
    """Milliseconds since 1970; None if there is no such file."""
    fs, where = _at(path)
    return fs.getFileStatus(where).getModificationTime() if fs.exists(where) else None


def folders(path: str, prefix: str = "") -> list[str]:
    """Names of the folders in a folder that begin with prefix; none if it doesn't exist."""
    fs, where = _at(path)
    found = fs.listStatus(where) if fs.exists(where) else []
    return sorted(s.getPath().getName() for s in found if s.isDirectory() and s.getPath().getName().startswith(prefix))


def files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of all files below a path, sorted; those that Spark hides (leading _ or .) are left out."""
    fs, where = _at(path)
    if not fs.exists(where):
        return []
    out, each = [], fs.listFiles(where, True)
    while each.hasNext():
        status = each.next()
        name = status.getPath().getName()
        if name.endswith(suffix) and name[0] not in "_.":
            out.append((_plain(status.getPath().toString()), status.getLen()))
    return sorted(out)


def _plain(path: str) -> str:
    """Local files by their path alone."""
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def delete(path: str) -> None:
    fs, where = _at(path)
    fs.delete(where, True)


def make_folder(path: str) -> None:
    fs, where = _at(path)
    fs.mkdirs(where)


def rename(old: str, new: str) -> None:
    """Moves a file or folder to a path that must be free; its parent is made. An error if it did not happen."""
    fs, where = _at(old)
    to = _at(new)[1]
    if fs.exists(to):
        raise FileExistsError(new)
    fs.mkdirs(to.getParent())
    if not fs.rename(where, to):
        raise OSError(f"{old} could not be moved to {new}")


def read_text(path: str) -> str | None:
    """None if there is no such file."""
    fs, where = _at(path)
    if not fs.exists(where):
        return None
    source = fs.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write_text(path: str, text: str) -> None:
    """Replaces a file: readers see the old text or the new one.

    The new text is written beside it and renamed over it in one step where the file system can do that.
    """
    fs, where = _at(path)
    fs.mkdirs(where.getParent())
    part = _at(f"{path}.{uuid.uuid4().hex}.part")[1]
    out = fs.create(part, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    spark = _spark()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(part), fs.makeQualified(where), options)
