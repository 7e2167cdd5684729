"""Sources and sinks with explicit schemas; what can't be read becomes a row with an error, never a failed job."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Letters of a piece, bytes of a file, kinds of files that are taken, letters from which a page can be read.
PIECE, MOST_BYTES, LEAST_LETTERS = 3_500, 40 << 20, 20
ADMITTED = ("pdf", "docx", "jpg", "jpeg", "png")
#: Bytes that the parts of one packed file may have when unpacked.
MOST_UNPACKED = 8 * MOST_BYTES


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def pieces(text: str, size: int = PIECE) -> list[str]:
    """Whole lines packed into pieces of at most ``size`` characters; a longer line is a piece of its own."""
    out: list[str] = []
    for line in text.split("\n"):
        if out and len(out[-1]) + 1 + len(line) <= size:
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def office_text(name: str, data: bytes) -> str:
    """The text of a .docx (a line a paragraph) or .xlsx (a line a row, cells joined by `` | ``).

    A file whose parts are too large when unpacked is refused before any is.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(part.file_size for part in z.infolist()) > MOST_UNPACKED:
            raise OverflowError(name)
        if name.endswith(".docx"):
            root = ElementTree.fromstring(z.read("word/document.xml"))
            return "\n".join("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p"))
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if s.tag.endswith("}si")]
        lines = []
        for sheet in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in (r for r in ElementTree.fromstring(z.read(sheet)).iter() if r.tag.endswith("}row")):
                cells = []
                for c in (c for c in row if c.tag.endswith("}c")):
                    v = "".join(x.text or "" for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t"))
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                lines.append(" | ".join(cells))
        return "\n".join(lines)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, piece, text, error of the office files under a folder: unsupported, too_large, protected, damaged or null.

    Files over the limit are told by their length alone, so their content is never read.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    if not name.lower().endswith((".docx", ".xlsx")):
                        rows.append((name, 0, None, "unsupported"))
                    else:
                        rows += [(name, i, p, None) for i, p in enumerate(pieces(office_text(name.lower(), bytes(data))))]
                except OverflowError:
                    rows.append((name, 0, None, "too_large"))
                except RuntimeError:
                    rows.append((name, 0, None, "protected"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
                    rows.append((name, 0, None, "damaged"))
            yield pd.DataFrame(rows, columns=["path", "piece", "text", "error"])

    found = spark.read.format("binaryFile").load(path)
    small = found.filter(F.col("length") <= MOST_BYTES).select("path", "content").mapInPandas(read, "path string, piece int, text string, error string")
    large = found.filter(F.col("length") > MOST_BYTES).select("path", F.lit(0).alias("piece"), F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("error"))
    return small.union(large)


def admission(files: DataFrame) -> DataFrame:
    """``files`` (path, length) with ``refused``: wrong_type, too_large or null, told without reading any file."""
    ending = F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1))
    return files.withColumn("refused", F.when(~ending.isin(*ADMITTED), "wrong_type").when(F.col("length") > MOST_BYTES, "too_large"))


def readable(pages: DataFrame) -> DataFrame:
    """doc and readable: whether some page of ``pages`` (doc, text) has twenty letters or more."""
    letters = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\p{L}]", ""))
    return pages.groupBy("doc").agg((F.max(letters) >= LEAST_LETTERS).alias("readable"))


def lookup(table: DataFrame, key: str, value: object, fold: bool = False) -> DataFrame:
    """The rows of one key; a plain comparison reaches the files' statistics, one whatever the case reads the column."""
    return table.filter(F.lower(key) == str(value).lower()) if fold else table.filter(F.col(key) == F.lit(value))


def replace_whole(df: DataFrame, path: str, version: int) -> None:
    """Write all rows of a list anew, as a version of its own: readers see the old list until the new one is whole."""
    df.write.mode("overwrite").parquet(f"{path}/v{version:012d}")


def read_whole(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version of a list; None where there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(there):
        return None
    whole = sorted(str(s.getPath()) for s in system.listStatus(there) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(whole[-1]) if whole else None


def append(df: DataFrame, path: str) -> None:
    """History is only ever added to."""
    df.write.mode("append").parquet(path)


def write_month(df: DataFrame, path: str, month: Column, current: str) -> None:
    """Overwrite the current month's partition; a frame with rows of an earlier month is refused, since those are frozen."""
    df = df.withColumn("month", month)
    if not df.filter(F.col("month") < current).isEmpty():
        raise ValueError("earlier months are frozen")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def without_document(rows: DataFrame, lineage: str, document: str) -> DataFrame:
    """Rows whose lineage (JSON) doesn't cite the document."""
    return rows.filter(~F.coalesce(F.get_json_object(lineage, "$.document_id") == document, F.lit(False)))
