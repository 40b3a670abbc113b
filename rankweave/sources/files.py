"""Documents from files: plain text with an encoding fallback, Word files, and archives of either."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.operators.layout import with_sections

#: Sections that count for a text's quality.
HITS = ("summary", "experience", "education", "skills", "certifications")
#: Fixed values.
SUPPORTED = (".pdf", ".docx", ".doc", ".txt", ".rtf")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*SUPPORTED)


def safe_name(name: Column) -> Column:
    """A file name of letters and digits of any script and ._- ()[] only."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^\p{L}\p{N}._\- ()\[\]]", "_")


def decoded(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of supported files; one row per version of a file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.where(supported(F.col("path")) | F.lower("path").endswith(".zip")).dropDuplicates(["path", "modificationTime", "length"])


def expand_archives(files: DataFrame) -> DataFrame:
    """files (path, content), archives among them, to (path, name, content): flat names, none outside, repeats numbered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if not path.lower().endswith(".zip"):
                    yield pd.DataFrame({"path": [path], "name": [re.sub(r".*/", "", path)], "content": [content]})
                    continue
                used: dict[str, int] = {}
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for entry in archive.infolist():
                    name = entry.filename.replace("\\", "/").rsplit("/", 1)[-1]
                    hidden = entry.is_dir() or name.startswith(".") or "__MACOSX" in entry.filename or ".." in entry.filename.split("/")
                    if hidden or not name.lower().endswith(SUPPORTED):
                        continue
                    used[name] = used.get(name, 0) + 1
                    if used[name] > 1:
                        stem, dot, ext = name.rpartition(".")
                        name = f"{stem}_{used[name] - 1}{dot}{ext}"
                    yield pd.DataFrame({"path": [path], "name": [name], "content": [archive.read(entry)]})

    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def word_text(content: bytes) -> str:
    """Paragraphs, then table rows with cells joined by bars."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    text = lambda node: "".join(t.text or "" for t in node.iter(WORD + "t"))
    body = root.find(WORD + "body")
    rows = [] if body is None else [text(p) for p in body.findall(WORD + "p")]
    rows += [" | ".join(text(c) for c in r.findall(WORD + "tc")) for r in root.iter(WORD + "tr")]
    return "\n".join(r for r in rows if r.strip())


def texts(files: DataFrame) -> DataFrame:
    """files (path, name, content) to path, name, text: plain files by column expressions, Word files by a vectorised UDF."""
    word = F.pandas_udf(lambda batch: batch.map(word_text), "string")
    kind = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
    return files.select("path", "name", F.when(kind == ".docx", word(F.col("content"))).when(kind == ".txt", decoded(F.col("content"))).alias("text"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the one that driver and executors share; a temporary one only where none is set and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and (spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local")):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return f"{base or tempfile.gettempdir()}/{name}-{uuid.uuid4().hex}"


def documents(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per document of a folder or the store, with text, sections, quality and where the text is from.

    listing: path, name, modified, length, text of the files that are there. stored: path, modified, length, text of earlier
    reads. A file that hasn't changed keeps its stored text; a new or changed one gives its own; one that is gone its stored
    text with medium quality at best; a row without either is empty, of low quality.
    """
    new = listing.select(F.col("path").alias("n_path"), "name", F.col("modified").alias("n_modified"), F.col("length").alias("n_length"), F.col("text").alias("n_text"))
    both = new.join(stored, F.col("n_path") == stored["path"], "full")
    there, known = F.col("n_path").isNotNull(), F.coalesce(F.col("text"), F.lit("")) != ""
    same = there & F.col("path").isNotNull() & (F.col("n_modified") == F.col("modified")) & (F.col("n_length") == F.col("length"))
    method = F.when(F.coalesce(same, F.lit(False)) & known, "cached").when(there, "read").when(known, "cached_text")
    path = F.coalesce("n_path", "path")
    chosen = both.select(
        path.alias("path"),
        F.coalesce("name", F.regexp_extract(path, r"([^/]*)$", 1)).alias("name"),
        method.alias("method"),
        F.coalesce(F.when(method == "read", F.col("n_text")).when(method.isNotNull(), F.col("text")), F.lit("")).alias("text"),
        F.when(there, F.col("n_modified")).otherwise(F.col("modified")).alias("modified"),
        F.when(there, F.col("n_length")).otherwise(F.col("length")).alias("length"),
    )
    chosen = chosen.withColumn("text", T.clean(F.col("text")))
    cut = with_sections(chosen, "text").withColumn("section_hits", F.filter(F.transform("parts", lambda p: F.when(p["body"] != "", p["section"])), lambda s: s.isin(*HITS)))
    graded = cut.withColumn("quality", T.quality_grade(F.col("text"), F.size("section_hits")))
    held = F.when(F.col("method") == "cached_text", F.when(F.col("quality") == "high", "medium").otherwise(F.col("quality"))).otherwise(F.col("quality"))
    return graded.withColumns({"quality": held, "text_chars": F.length(F.regexp_replace("text", r"\s", ""))})
