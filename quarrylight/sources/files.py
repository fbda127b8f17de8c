"""Sources: files by handler, tables, manifests, web results. A handler turns (path, bytes) into pages."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Handler = Callable[[bytes], list[tuple[int | None, str]]]
_handlers: dict[str, Handler] = {}
SUFFIX = r"\.([A-Za-z0-9]+)$"


def register_handler(extension: str, handler: Handler) -> None:
    """``extension`` without its dot; a later registration replaces an earlier one."""
    _handlers[extension.lower().lstrip(".")] = handler


def decode_text(data: bytes) -> list[tuple[int | None, str]]:
    for encoding in ("utf-8-sig", "utf-8", "latin-1"):
        try:
            return [(None, data.decode(encoding))]
        except UnicodeDecodeError:
            continue
    return []


for _e in ("txt", "md", "markdown", "csv"):
    register_handler(_e, decode_text)


def supported(extension: Column) -> Column:
    return F.lower(extension).isin(sorted(_handlers))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``extension``, ``size``, ``modified`` of supported files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    f = f.select("path", F.lower(F.regexp_extract("path", SUFFIX, 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return f.where(supported(F.col("extension")))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, ``page``, ``text``, ``hash``: files by their extension's handler. An unknown extension is an error of the caller's filter, a broken file gives no page."""
    handlers = dict(_handlers)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content").where(supported(F.regexp_extract("path", SUFFIX, 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    found = handlers[path.rsplit(".", 1)[-1].lower()](bytes(data))
                except (KeyError, ValueError, IndexError, zipfile.BadZipFile, ElementTree.ParseError):
                    continue  # not a file of its kind
                rows += [(path, page, text, hashlib.sha256(data).hexdigest()) for page, text in found]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "hash"])

    return f.mapInPandas(run, "path string, page int, text string, hash string")


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV or TSV file with a header; pass the schema where it is known, else it is inferred."""
    r = spark.read.option("header", True).option("sep", "\t" if path.lower().endswith(".tsv") else ",")
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def gold_questions(spark: SparkSession, path: str) -> DataFrame:
    """``question``, ``expected_documents``, ``should_find`` of a JSON file ``{"questions": [...]}``."""
    schema = "questions array<struct<question string, expected_documents array<string>, expected_pages array<int>, should_find boolean>>"
    q = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")
    return q.withColumn("should_find", F.coalesce("should_find", F.lit(True)))


def web_results(raw: DataFrame, column: str = "payload", most: int = 10) -> DataFrame:
    """``label``, ``url``, ``title``, ``content`` of a provider's JSON answer: items under any of the usual names, fields by any of theirs; only http(s) addresses."""
    item = "array<map<string,string>>"
    paths = ("$.results", "$.organic_results", "$.items", "$.web.results", "$.webPages.value", "$.data", "$.documents")
    items = F.coalesce(*[F.from_json(F.get_json_object(column, p), item) for p in paths], F.from_json(column, item))
    rows = raw.select(F.posexplode(items).alias("pos", "m"))
    first = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at("m", F.lit(k))), F.lit("")) for k in keys])
    out = rows.select("pos", first("url", "link", "href").alias("url"), first("title", "name", "heading").alias("title"), first("content", "snippet", "description", "text", "body", "abstract", "raw_content").alias("content")).where(F.col("url").rlike("^https?://"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("pos"))
    return out.withColumn("n", n).where(F.col("n") <= most).select(F.concat(F.lit("W"), F.col("n").cast("string")).alias("label"), "url", F.coalesce("title", "url").alias("title"), F.coalesce("content", F.lit("")).alias("content"))


def public_url(url: Column) -> Column:
    """Whether an address is plain http(s) without credentials and names no local or private host; names are not resolved."""
    host = F.lower(F.regexp_extract(url, "^https?://([^/?#]*)", 1))
    bare = F.regexp_replace(host, ":[0-9]+$", "")
    private = bare.rlike(r"^(localhost|.*\.local|.*\.internal|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|\[.*\])$")
    return (bare != "") & ~F.contains(host, F.lit("@")) & ~private
