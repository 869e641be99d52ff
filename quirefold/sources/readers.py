"""Sources and sinks of the document model: Word files, model JSON, word lists, and seams for what needs outside software."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ELEMENT = "doc_id bigint, page int, idx int, kind string, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string, size double"
MODEL = (
    "source string, source_type string, page_count int, unit string, fonts array<string>, pages array<struct<page:int,width:double,height:double,flow:boolean,"
    "elements:array<struct<kind:string,bbox:array<double>,text:string,font:string,size:double,style:struct<italic:boolean,bold:boolean,serifed:boolean>,sentences:array<string>,image_b64:string,image_ext:string>>>>"
)


def docx_paragraphs(data: bytes) -> list[str]:
    """Non-blank paragraphs of a Word file; [] if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    found = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return [x for x in found if x]


def _docx(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(d, 1, i, "text", {"x0": 0.0, "y0": 0.0, "x1": 595.0, "y1": 0.0}, t, 11.0) for d, c in zip(f.doc_id, f.content) for i, t in enumerate(docx_paragraphs(bytes(c)))]
        yield pd.DataFrame(rows, columns=["doc_id", "page", "idx", "kind", "bbox", "text", "size"])


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Elements of Word files, one flow page each; doc_id is the hash of the path."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "content")
    return files.mapInPandas(_docx, ELEMENT)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """Elements of model JSON files, one document a file; doc_id is the hash of the path, idx the place on the page."""
    m = spark.read.schema(MODEL).option("multiLine", True).json(path).withColumn("doc_id", F.xxhash64(F.col("_metadata.file_path")))
    p = m.select("doc_id", F.explode("pages").alias("p"))
    e = p.select("doc_id", F.col("p.page").alias("page"), F.posexplode("p.elements").alias("idx", "e"))
    box = F.struct(*[F.try_element_at("e.bbox", F.lit(i + 1)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    return e.select("doc_id", "page", "idx", "e.kind", box.alias("bbox"), "e.text", "e.font", "e.size", "e.style", "e.sentences", F.unbase64("e.image_b64").alias("image"), "e.image_ext")


def write_model(elements: DataFrame, pages: DataFrame, path: str) -> None:
    """One JSON object per document: its pages with their elements in order."""
    box = F.array(*[F.col(f"bbox.{c}") for c in ("x0", "y0", "x1", "y1")])
    row = F.struct("idx", "kind", box.alias("bbox"), "text", "font", "size", "style", "sentences")
    per_page = elements.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row), lambda a, b: a.idx - b.idx).alias("elements"))
    sized = per_page.join(pages.groupBy("doc_id", "page").agg(F.max("width").alias("width"), F.max("height").alias("height")), ["doc_id", "page"], "left")
    docs = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "width", "height", "elements")), lambda a, b: a.page - b.page).alias("pages"))
    docs.write.mode("overwrite").json(path)


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select(F.lower("word").alias("word"), T.trimmed(F.coalesce("phonetic", F.lit(""))).alias("p"), T.format_pos("pos").alias("t"), T.first_lines("translation").alias("m"))


def read_word_list(spark: SparkSession, path: str, max_rank: int = 0) -> DataFrame:
    """Entries of a word list in CSV (word, phonetic, -, translation, pos, flag, flag, -, -, rank): ranked or flagged words,
    the last line of a word wins; a header and lines that are too short are skipped."""
    names = ["word", "phonetic", "definition", "translation", "pos", "c5", "c6", "c7", "c8", "frq"]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("multiLine", True).option("escape", '"').csv(path)
    r = raw.withColumn("_n", F.monotonically_increasing_id()).withColumn("rank", F.coalesce(F.expr("try_cast(frq as int)"), F.lit(0)))
    r = r.filter(F.col("word").isNotNull() & (F.col("word") != "") & ~((F.col("word") == "word") & (F.col("phonetic") == "phonetic")))
    if max_rank:
        r = r.filter(F.col("rank") <= max_rank)
    r = r.filter((F.col("rank") != 0) | (F.coalesce("c5", F.lit("")) != "") | (F.coalesce("c6", F.lit("")) != ""))
    last = r.withColumn("_k", F.row_number().over(Window.partitionBy(F.lower("word")).orderBy(F.col("_n").desc()))).filter("_k = 1")
    return _entries(last)


def read_word_base(spark: SparkSession, path: str, max_rank: int = 0, chunk: int = 100_000) -> DataFrame:
    """Entries of an SQLite word list (table stardict), read by row ranges in parallel; the file must be reachable from all executors."""
    with sqlite3.connect(path) as con:
        top = con.execute("SELECT coalesce(max(rowid), 0) FROM stardict").fetchone()[0]
    starts = spark.range(0, top + 1, chunk)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            with sqlite3.connect(path) as con:
                for a in f.id:
                    yield pd.read_sql_query("SELECT rowid AS n, word, phonetic, translation, pos, CAST(frq AS TEXT) AS frq FROM stardict WHERE rowid >= ? AND rowid < ?", con, params=(int(a), int(a) + chunk))

    r = starts.mapInPandas(load, "n bigint, word string, phonetic string, translation string, pos string, frq string").withColumn("rank", F.coalesce(F.expr("try_cast(frq as int)"), F.lit(0)))
    r = r.filter("word <> ''")
    if max_rank:
        r = r.filter(F.col("rank") <= max_rank)
    return _entries(r.withColumn("_k", F.row_number().over(Window.partitionBy(F.lower("word")).orderBy(F.col("n").desc()))).filter("_k = 1"))


def upsert_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Lookup cache with fresh entries laid over it."""
    both = cache.withColumn("_t", F.lit(0)).unionByName(fresh.withColumn("_t", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_k", F.row_number().over(Window.partitionBy("word").orderBy(F.col("_t").desc()))).filter("_k = 1").drop("_t", "_k")


def through(rows: DataFrame, worker: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None, schema: str, parallel: int = 0) -> DataFrame:
    """The seam for outside software (PDF extraction, recognition of letters in images, dictionaries on a network): a worker
    over batches, at most `parallel` at a time; without one the result is empty with the same schema."""
    if worker is None:
        return rows.sparkSession.createDataFrame([], schema)
    return (rows.repartition(parallel) if parallel else rows).mapInPandas(worker, schema)
