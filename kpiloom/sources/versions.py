"""Tables that are replaced as a whole without a moment in which they are missing.

Each load writes a folder of its own below the table's path; a one-file pointer names the
folder that counts and is put in place last, by a rename over the old one. A load that
fails leaves the pointer, and so the old rows, alone. A reader resolves the pointer once
and finishes on the version it began with; old versions stay until ``drop_old``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_POINTER = "_current"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def read_note(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    files, place = _file_system(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of the one before, by a rename over it."""
    jvm = spark._jvm
    files, fresh = _file_system(spark, f"{path}-{uuid.uuid4().hex}")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(fresh), files.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), how)


def source_mark(spark: SparkSession, paths: Iterable[str]) -> str:
    """What changes when one of the files (or files of a folder) does: their names, sizes and times."""
    seen = []
    for path in paths:
        files, place = _file_system(spark, path)
        listed = files.listFiles(place, True)
        while listed.hasNext():
            status = listed.next()
            name = status.getPath().toString()
            if not name.endswith(".crc"):
                seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the table's rows now: a version, or the path itself without a pointer."""
    name = read_note(spark, f"{path}/{_POINTER}")
    return path if name is None else f"{path}/{name.strip()}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now; later replacements do not change the frame."""
    return spark.read.parquet(current(spark, path))


def publish(df: DataFrame, path: str) -> str:
    """Write ``df`` as a new version and let it count once it is complete; the version's folder back.

    ``df`` may read the table it replaces. Of two loads at a time the last to end counts.
    """
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    write_note(spark, f"{path}/{_POINTER}", name)
    return f"{path}/{name}"


def drop_old(spark: SparkSession, path: str) -> list[str]:
    """Delete all versions but the current one, when no reader is on them any more; their names back."""
    files, place = _file_system(spark, path)
    keep = current(spark, path).rsplit("/", 1)[-1]
    found = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    old = sorted(n for n in found if n.startswith("v-") and n != keep)
    for name in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return old
