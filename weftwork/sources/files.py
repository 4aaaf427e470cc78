"""Directories, frame logs and transcripts as tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators.rules import ignored

#: Extensions of code, and marker files of projects in rising priority.
CODE = "go py ts tsx js jsx tf hcl sql proto graphql gql rs java cpp cc h hpp cs swift kt kts zig wat wasm wit rb php ex exs".split()
MARKERS = (("go.mod", "go"), ("package.json", "node"), ("pyproject.toml", "python"), ("requirements.txt", "python"), ("Cargo.toml", "rust"), ("pom.xml", "java"), ("build.gradle", "java"), ("Dockerfile", "docker"), ("main.tf", "terraform"))


def scan_directory(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """path, size, modified, content, is_code of all files below a directory that no rule ignores."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:(?://)?", ""), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    out = df.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    if rules:
        out = out.filter(~ignored(F.col("path"), F.lit(False), rules))
    return out.withColumn("is_code", classify(F.col("path")))


def classify(path):
    """Whether a path is code: by extension, or a Dockerfile."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*CODE) | F.rlike(path, F.lit(r"(?i)(?:^|/)(?:Dockerfile(?:\.\w+)?|\w+\.dockerfile)$"))


def project_kinds(files: DataFrame) -> DataFrame:
    """dir, kind: by marker files, the one latest in MARKERS decides."""
    rank = F.coalesce(*[F.when(F.element_at(F.split("path", "/"), -1) == m, F.lit(i)) for i, (m, _) in enumerate(MARKERS)])
    kind = F.coalesce(*[F.when(F.col("r") == i, F.lit(k)) for i, (_, k) in enumerate(MARKERS)])
    return files.select(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("dir"), rank.alias("r")).filter("r is not null").groupBy("dir").agg(F.max("r").alias("r")).select("dir", kind.alias("kind"))


MAGIC = b"WFL1"
BEGIN, PUT, COMMIT = 1, 2, 3


def frame(kind: int, payload: bytes) -> bytes:
    """[magic 4][kind 1][length 4][crc32 4][payload], big-endian."""
    return MAGIC + struct.pack(">BII", kind, len(payload), zlib.crc32(payload)) + payload


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(number, kind, payload) up to the first bad magic, short frame or wrong checksum."""
    at, n = 0, 0
    while at + 13 <= len(data) and data[at:at + 4] == MAGIC:
        kind, size, crc = struct.unpack(">BII", data[at + 4:at + 13])
        body = data[at + 13:at + 13 + size]
        if len(body) < size or zlib.crc32(body) != crc:
            return
        yield n, kind, body
        at += 13 + size
        n += 1


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        rows = [(p, n, k, b.decode(errors="replace")) for p, c in zip(f["path"], f["content"], strict=True) for n, k, b in frames(bytes(c))]
        yield pd.DataFrame(rows, columns=["path", "frame_no", "kind", "payload"])


def committed_frames(files: DataFrame) -> DataFrame:
    """path, frame_no, payload of the data frames whose group was committed; replay stops at the first damage."""
    from pyspark.sql import Window as W

    rows = files.select("path", "content").mapInPandas(_parse, "path string, frame_no int, kind int, payload string")
    after = W.partitionBy("path").orderBy("frame_no").rowsBetween(0, W.unboundedFollowing)
    marked = rows.withColumn("next_end", F.first(F.when(F.col("kind") != PUT, F.col("kind")), True).over(after))
    return marked.filter((F.col("kind") == PUT) & (F.col("next_end") == COMMIT)).select("path", "frame_no", "payload")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Steps of JSONL transcripts under an explicit schema; damaged lines are dropped."""
    schema = "type string, status string, content string, thinking string, tool_calls array<struct<name: string, args: string>>, _bad string"
    df = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.withColumn("source_file", F.input_file_name()).filter("_bad is null").drop("_bad")


def export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_tar(df: DataFrame, path: str) -> int:
    """path and content rows as a gzipped tar file in path order, streamed through the driver one partition at a time. Returns the number of files."""
    import io
    import tarfile

    n = 0
    with tarfile.open(path, "w:gz") as tar:
        for r in df.select("path", F.col("content").cast("binary").alias("content")).filter("path is not null").orderBy("path").toLocalIterator():
            data = bytes(r.content or b"")
            info = tarfile.TarInfo(r.path)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
            n += 1
    return n


def export_flags(new: DataFrame, old: DataFrame) -> DataFrame:
    """path, is_new, modified of an export against what is there already (path, sha256)."""
    j = new.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("h")).join(old.select("path", "sha256"), "path", "left")
    return j.select("path", F.col("sha256").isNull().alias("is_new"), F.coalesce(F.col("sha256") != F.col("h"), F.lit(False)).alias("modified"))
