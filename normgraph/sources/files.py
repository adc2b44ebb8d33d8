"""Documents from files: text, HTML, archives and XML."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normgraph.functions.text import html_text


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, text): one row per file; the first line is the title."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return t.select("path", F.trim(F.split_part(F.regexp_replace("text", r"^\s+", ""), F.lit("\n"), F.lit(1))).alias("title"), "text")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    return t.select("path", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), html_text(F.col("html")).alias("text"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            if zipfile.is_zipfile(io.BytesIO(content)):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield pa.RecordBatch.from_pydict({"path": [path], "member": [i.filename], "content": pa.array([z.read(i)], pa.binary())})
            else:
                with tarfile.open(fileobj=io.BytesIO(content)) as z:
                    for m in z:
                        if m.isfile():
                            yield pa.RecordBatch.from_pydict({"path": [path], "member": [m.name], "content": pa.array([z.extractfile(m).read()], pa.binary())})


def read_archives(spark: SparkSession, path: str, glob: str = "*.{zip,tar,tgz,gz}") -> DataFrame:
    """(path, member, content) of ZIP and tar archives, one row per file in them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(_members, "path string, member string, content binary")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Rows of an XML file, one per ``row_tag``, e.g. the sections of a code or the votes of a session."""
    r = spark.read.format("xml").option("rowTag", row_tag)
    return (r.schema(schema) if schema else r).load(path)


def preprocess_lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with words hyphenated at line ends rejoined and lone page numbers dropped."""
    c = F.regexp_replace(documents[text], r"(\p{Ll})-\r?\n(\p{Ll})", "$1$2")
    return documents.select(documents[key].alias(key), F.regexp_replace(c, r"(?m)^[ \t]*(?:\[?[Pp]age )?\d+\]?[ \t]*\r?\n", "").alias("text"))
