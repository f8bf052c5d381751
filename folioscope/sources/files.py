"""Files to text: txt, md, csv by Spark's own readers; docx, xlsx and pdf from their bytes in Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TEXT, CSV, PACKED = ("txt", "md"), ("csv",), ("docx", "xlsx", "xlsm", "pdf")
#: Bytes of one upload, all files together.
UPLOAD_CAP = 100 * 1024 * 1024
#: What the pipeline's own output looks like; such files are no input.
DERIVED = (r"(?m)^# Overall synopsis\s*$", r"(?m)^Reasoning check:", r"(?m)^# Human evidence appendix\b")
_READ = StructType([StructField("text", StringType()), StructField("fault", StringType())])
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processing file, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))


def xlsx_text(content: bytes) -> str:
    """Rows of a workbook's sheets in order, cells parted by tabs, sheets by a blank line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        sheets = []
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v, inline = c.find(f"{_S}v"), "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    raw = v.text if v is not None else inline
                    cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw or "")
                rows.append("\t".join(cells))
            sheets.append("\n".join(rows))
    return "\n\n".join(sheets)


def pdf_text(content: bytes) -> str:
    """Pages of a PDF under page markers; needs a reader library that is not part of this installation."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF reader is installed") from e
    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
    return "\n\n".join(f"[Page {i}]\n{t}" for i, t in enumerate(pages, 1) if t.strip())


@F.pandas_udf(_READ)
def _packed_text(content: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    rows = []
    for c, s in zip(content, suffix):
        try:
            rows.append(({"docx": docx_text, "pdf": pdf_text}.get(s, xlsx_text)(bytes(c)), None))
        except Exception as e:  # a broken file is a row with its fault, not the end of the job
            rows.append((None, f"{type(e).__name__}: {e}"[:200]))
    return pd.DataFrame(rows, columns=["text", "fault"])


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def load_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, suffix, text, fault) of every file of a folder with a known suffix; an unreadable file has a null text and a fault."""
    globs = lambda kinds: "*.{" + ",".join(kinds) + "}"
    read = spark.read.option("recursiveFileLookup", "true")
    plain = read.option("pathGlobFilter", globs((*TEXT, *CSV))).text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    plain = plain.select("path", _suffix(F.col("path")).alias("suffix"), "text", F.lit(None).cast("string").alias("fault"))
    packed = read.option("pathGlobFilter", globs(PACKED)).format("binaryFile").load(folder).select("path", _suffix(F.col("path")).alias("suffix"), "content")
    packed = packed.withColumn("r", _packed_text("content", "suffix")).select("path", "suffix", "r.text", "r.fault")
    return plain.unionByName(packed)


def within_upload_cap(files: DataFrame, cap: int = UPLOAD_CAP) -> DataFrame:
    """df(upload_id, path, length) of those uploads whose files together keep to the cap."""
    total = F.sum("length").over(Window.partitionBy("upload_id"))
    return files.withColumn("total_length", total).filter(F.col("total_length") <= cap)


def is_derived(text: Column) -> Column:
    """True for the pipeline's own output."""
    hit = F.lit(False)
    for p in DERIVED:
        hit = hit | F.coalesce(text.rlike(p), F.lit(False))
    return hit


def page_text(pages: Column) -> Column:
    """Pages joined by blank lines, empty ones left out."""
    return F.array_join(F.filter(pages, lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), "\n\n")


def source_status(text: Column) -> Column:
    """retrieved, or why not: failed where there is no text at all, empty where it is blank."""
    return F.when(text.isNull(), "not_retrieved: failed").when(F.trim(text) == "", "not_retrieved: empty").otherwise("retrieved")


def vision_state(rendered: Column, transcription: Column) -> Column:
    """State of one page's reading from its picture."""
    plain = F.lower(F.trim(F.regexp_replace(transcription, r"[.\s]+$", "")))
    return F.when(~rendered, "render_failed").when(transcription.isNull(), "vision_failed").when(plain == "", "vision_empty").when(plain.isin("no table", "no tables", "no table on this page"), "no_table").otherwise("transcribed")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, text) of the markdown notes of a folder but for licences; the title is a heading at the very start, else the file's name."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    heading = F.regexp_extract("text", r"^#{1,6}\s+(\S[^\n]*)", 1)
    title = F.regexp_replace(F.when(heading != "", heading).otherwise(stem), r"[*_`]", "")
    return files.filter(~F.upper(stem).startswith("LICEN")).select("path", F.substring(F.trim(title), 1, 60).alias("title"), "text")
