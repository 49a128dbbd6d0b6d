"""Files of a library folder as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from archivolt import fixed
from archivolt.functions import html, paths
from archivolt.functions.text import _col
from archivolt.sources import files


def _root_uri(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/") + "/"


def is_library_file(rel_path, extensions: list[str] | None = None) -> Column:
    """Wanted extension, and no folder that is hidden or to be ignored."""
    folders = F.split(paths.folder(rel_path), "/")
    ignored = F.exists(folders, lambda d: d.startswith(".") | d.isin(fixed.IGNORED_DIRS))
    return paths.extension(rel_path).isin(extensions or fixed.INDEX_EXTENSIONS) & ~ignored


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Path, size and time of every library file below ``root``.

    File bodies are not read: the ``content`` column is never selected.
    Spark itself leaves out files whose own name starts with ``_`` or ``.``.
    """
    base = _root_uri(spark, root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _relative(found.select("path", "length", "modificationTime"), base).filter(
        is_library_file("rel_path", extensions))


def _relative(files: DataFrame, base: str) -> DataFrame:
    rest = [c for c in files.columns if c not in ("path", "length", "modificationTime")]
    return files.select(
        F.substring(F.col("path"), len(base) + 1, F.lit(1 << 20)).alias("rel_path"),
        F.col("length").alias("size_bytes"),
        F.unix_micros("modificationTime").alias("modified_us"),
        *rest,
    )


def read_bodies(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """Bodies of the files in ``wanted`` (rel_path, and size_bytes where known), joined with its columns.

    Only those files are opened, by tasks that are dealt about equal bytes; see
    :func:`files.read_files`.  Without a list all library files are read.  In a
    store that tasks cannot open files in, Spark's reader lists the folder and
    opens the files whose time lies in the range of the wanted ones.
    """
    base = _root_uri(spark, root)
    if wanted is not None and files.reachable(files.place_of(spark, root)):
        return files.read_files(spark, root, wanted)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime", "content")
    if wanted is None:
        return _relative(found, base).filter(is_library_file("rel_path"))
    first, last = wanted.agg(F.min("modified_us"), F.max("modified_us")).first()
    if first is None:
        found = found.limit(0)
    else:
        found = found.filter(F.col("modificationTime").between(F.timestamp_micros(F.lit(first)), F.timestamp_micros(F.lit(last))))
    return _relative(found, base).join(wanted.drop("modified_us", "size_bytes"), "rel_path")


def decode_text(content) -> Column:
    """UTF-8 text of a binary column; bytes that are no UTF-8 are dropped."""
    return F.replace(F.make_valid_utf8(_col(content).cast("string")), F.lit("�"), F.lit(""))


def load_documents(bodies: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """Text of each body, or the reason there is none; no row stops the job.

    Plain text, Markdown and HTML are read here.  Texts of other kinds come
    from ``extracted`` (rel_path, text), the output of the user's own reader.
    """
    kind = paths.extension("rel_path")
    plain, web = kind.isin(".txt", ".md"), kind.isin(".html", ".htm")
    decoded = decode_text("content")
    # Only web rows reach the HTML reader's Python worker with content.
    text = bodies.withColumn("_html", html.document_text(F.when(web, decoded)))
    text = text.withColumn("text", F.when(plain, decoded).when(web, F.col("_html"))).drop("_html", "content")
    if extracted is not None:
        given = extracted.select("rel_path", F.col("text").alias("_given"))
        text = text.join(given, "rel_path", "left").withColumn("text", F.coalesce("text", "_given")).drop("_given")
    return envelope(text)


def envelope(df: DataFrame) -> DataFrame:
    """Adds name, folder, size in KiB, ``ok`` and ``error`` to rel_path, text, size_bytes."""
    unsupported = F.concat(F.lit("[Tipo de archivo no soportado: "), paths.extension("rel_path"), F.lit("]"))
    text = F.coalesce(F.col("text"), unsupported)
    bad = text.startswith("[Error") | text.startswith("[Tipo de archivo no soportado")
    return df.select(
        *[c for c in df.columns if c != "text"],
        paths.base_name("rel_path").alias("name"),
        paths.folder("rel_path").alias("category"),
        F.bround(F.col("size_bytes") / 1024, 2).alias("size_kb"),
        (~bad).alias("ok"),
        F.when(~bad, text).alias("text"),
        F.when(bad, text).alias("error"),
    )


def folders(files: DataFrame, default: str = "03_Conocimiento/General") -> DataFrame:
    """Distinct first- and second-level folders, the default when there is none."""
    found = files.select(F.explode(paths.folder_levels("rel_path")).alias("folder")).distinct()
    some = found.agg(F.count(F.lit(1)).alias("n"))
    fallback = some.filter("n = 0").select(F.lit(default).alias("folder"))
    return found.unionByName(fallback)


def inventory(files: DataFrame) -> DataFrame:
    """Files per folder by kind: Markdown, PDF, other."""
    name = paths.base_name("rel_path")
    md, pdf = name.endswith(".md"), name.endswith(".pdf")
    return files.groupBy(F.when(paths.folder("rel_path") == "", "raiz").otherwise(paths.folder("rel_path")).alias("folder")).agg(
        F.count_if(md).alias("md"), F.count_if(pdf).alias("pdf"),
        F.count_if(~md & ~pdf & ~name.endswith(".pyc")).alias("other"))


def extraction_route(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: pages, pages with text, and whether they need recognition."""
    from archivolt.functions.text import strip

    with_text = F.length(strip(F.coalesce(F.col(text), F.lit("")))) > fixed.PAGE_TEXT_CHARS
    counted = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages"), F.count_if(with_text).alias("text_pages"))
    direct = F.col("text_pages") > F.col("pages") * F.lit(fixed.DIRECT_PAGE_SHARE)
    return counted.select(
        doc, "pages", "text_pages",
        F.when(direct, "direct").otherwise("recognise").alias("route"),
        F.when(direct, F.lit(0)).otherwise(F.least(F.col("pages"), F.lit(fixed.OCR_MAX_PAGES))).cast("long").alias("recognise_pages"),
    )
