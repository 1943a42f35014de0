"""Files as rows: what they are, whether they can be read, and why not. One bad file never stops the others."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioscan.config import Config
from folioscan.sources.office_reader import store_of

#: Files that a task opens, and bytes of theirs that it passes on together, if they are named.
TASK_FILES, READ_BYTES = 4096, 8 << 20

#: Extensions, old formats, the mark of old binary documents, and what is said of files that can't be read.
KINDS = {"docx": "Word", "xlsx": "Excel", "xlsm": "Excel", "pdf": "PDF"}
LEGACY = {"doc": "旧版 Word 格式", "xls": "旧版 Excel 格式"}
OLE = "D0CF11E0A1B11AE1"
EMPTY = "文件为空（0 字节），内容已损坏"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def file_type(name: Column) -> Column:
    return F.coalesce(*(F.when(extension(name) == e, k) for e, k in KINDS.items()), F.lit("不支持"))


def unsupported(name: Column) -> Column:
    """Why a file of this name is not looked at."""
    ext = extension(name)
    legacy = F.coalesce(*(F.when(ext == e, F.lit(f"{t}（.{e}）不受支持，请另存为 .docx / .xlsx 后重新检测")) for e, t in LEGACY.items()))
    return F.coalesce(legacy, F.when(ext == "", F.lit("文件无扩展名，无法识别格式")), F.concat(F.lit("不支持的文件格式（."), ext, F.lit("），当前仅支持 .docx / .xlsx")))


def _ooxml_problem(raw: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if (bad := z.testzip()) is not None:
                return f"压缩包内部损坏（首个损坏部件：{bad}）"
            names = set(z.namelist())
    except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError, zipfile.zlib.error):
        return "文件不是有效的压缩包结构，文档已损坏"
    if "EncryptedPackage" in names:
        return "文档已设置打开密码，加密文档无法解析"
    return None if "[Content_Types].xml" in names else "缺少 [Content_Types].xml，文档结构损坏"


@F.pandas_udf(T.StringType())
def ooxml_problem(contents: pd.Series) -> pd.Series:
    return contents.map(lambda raw: _ooxml_problem(bytes(raw or b"")))


@F.pandas_udf(T.StringType())
def pdf_problem(contents: pd.Series) -> pd.Series:
    def problem(raw: bytes | None) -> str | None:
        raw = bytes(raw or b"")
        if not raw.lstrip()[:5] == b"%PDF-":
            return "PDF 解析失败（可能已损坏）：no header"
        return "PDF 已设置打开密码，加密文档无法解析" if b"/Encrypt" in raw else None

    return contents.map(problem)


def _empty_files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """Files of 0 bytes, which Spark's file sources leave out: only their names and times go through the driver."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    listing = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(fs_path, recursive)
    found = []
    while listing.hasNext():
        if not (f := listing.next()).getLen() and not f.getPath().getName().startswith("_"):
            found.append((f.getPath().toUri().toString(), f.getModificationTime()))
    rows = spark.createDataFrame(found, "path string, at long")
    return rows.select("path", F.timestamp_millis("at").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """doc_id, path, file_name, file_type, file_size, content of the files in a folder; temporary and hidden ones are left out.

    Files are gone through one by one on the driver only if Spark, which counts them over tasks, leaves some out as empty.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if raw.select("path").count() < len(raw._jdf.inputFiles()):
        raw = raw.unionByName(_empty_files(spark, path, recursive))
    return _described(raw, F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))))


def read_files(files: DataFrame) -> DataFrame:
    """What ``list_files`` says of files, given their names (``file``) and plain paths or URIs (``path``): tasks open them, some thousands each, and no listing goes through the driver."""
    shape = T.StructType.fromDDL("file string, path string, modificationTime timestamp, length long, content binary")
    schema, spark = to_arrow_schema(shape), files.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = store_of(path)
                with store.open_input_file(at) as source:
                    content = source.read()
                rows.append((file, path, store.get_file_info(at).mtime, len(content), content))
                size += len(content)
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    tasks = max(spark.sparkContext.defaultParallelism, files.count() // TASK_FILES + 1)
    return _described(files.select("file", "path").repartition(tasks, "path").mapInArrow(run, shape), F.col("file"))


def _described(raw: DataFrame, name: Column) -> DataFrame:
    rows = raw.select(F.xxhash64("path").alias("doc_id"), "path", name.alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content")
    return rows.where(~F.startswith("file_name", F.lit("~$")) & ~F.startswith("file_name", F.lit(".")) & ~F.col("path").rlike(r"/\.[^/]+/")).withColumn("file_type", file_type(F.col("file_name")))


def guarded(files: DataFrame, config: Config | None = None) -> DataFrame:
    """``files`` with error_message: the first reason for which a file can't be read, null if it can."""
    config = config or Config()
    kind, size = F.col("file_type"), F.col("file_size")
    legacy = extension(F.col("file_name")).isin(list(LEGACY))
    mb = F.format_string("%.1f", size / (1 << 20))
    magic = F.hex(F.substring("content", 1, 8))
    office = kind.isin("Word", "Excel")
    reason = (
        F.when(legacy, F.lit("旧版格式兼容解析已开启，但当前环境未集成 .doc/.xls 解析组件，建议另存为 .docx/.xlsx 后重试") if config.enable_legacy else unsupported(F.col("file_name")))
        .when(kind == "不支持", unsupported(F.col("file_name")))
        .when((kind == "PDF") & F.lit(not config.enable_pdf), "PDF 检测已在后台设置中关闭，本次跳过 PDF 解析")
        .when(size > config.max_file_size_mb * (1 << 20), F.concat(F.lit("文件体积 "), mb, F.lit(f" MB 超过配置上限 {config.max_file_size_mb} MB，已跳过")))
        .when(size == 0, EMPTY)
        .when(office & F.startswith(magic, F.lit(OLE)), "文档已加密或为旧版二进制格式（OLE 复合文档），无法解析")
        .when(office & ~F.startswith(magic, F.lit("504B")), "文件结构异常，非有效的 Office OOXML 文档（可能已损坏）")
    )
    first = files.withColumn("error_message", reason)
    open_ = F.col("error_message").isNull()
    deep = F.when(open_ & office, ooxml_problem(F.when(open_ & office, F.col("content")))).when(open_ & (kind == "PDF"), pdf_problem(F.when(open_ & (kind == "PDF"), F.col("content"))))
    return first.withColumn("error_message", F.coalesce("error_message", deep))


def expired(files: DataFrame, days: int) -> DataFrame:
    """Files that were last changed more than ``days`` days ago."""
    return files.where(F.col("modified") < F.current_timestamp() - F.expr(f"interval {days} days"))


def sizes(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


@F.pandas_udf(T.StringType())
def decoded(contents: pd.Series) -> pd.Series:
    """Text of bytes: UTF-8 with or without its mark, GB18030, UTF-16, or what is left of UTF-8."""

    def text(raw: bytes | None) -> str:
        raw = bytes(raw or b"")
        for code in ("utf-8-sig", "gb18030", "utf-16"):
            try:
                return raw.decode(code)
            except (UnicodeDecodeError, ValueError):
                continue
        return raw.decode("utf-8", errors="ignore")

    return contents.map(text)
