"""Small helpers of the training-data operators: words, row numbers, table access, shared files."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words are runs of anything but these six characters; ``bytes.split()`` splits at the same six.
SPACE = r"[\x20\x09-\x0D]"


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for a context: their Python workers import it."""
    context = spark.sparkContext
    if getattr(context, "_regrowth_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "regrowth.zip"  # read by the driver only, which serves it
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    context._regrowth_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def crc_bucket(column: str, n: int):
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")), F.lit(n))


def hash_share(column, share: float):
    """True for about this share of the keys, the same keys every time."""
    return F.pmod(F.xxhash64(column, F.lit(7)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)


def write_whole(uri: str, data: bytes | list) -> None:
    """One file in the shared store, visible only when complete: a retried or doubled task replaces it with the same bytes."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{os.path.dirname(path)}/_{os.path.basename(path)}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for piece in data if isinstance(data, list) else [data]:
            out.write(piece)
    fs.move(own, path)


def open_shared(uri: str):
    """Random-access reader of a file in the shared store."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
