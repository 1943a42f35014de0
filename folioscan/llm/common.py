"""What the training-data operators share: tables, staged tables in the shared folder, positions of matches inside a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.staging import stage  # noqa: F401  the operators take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores put before it a name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression named inside a lambda would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array<int>, inside the row.

    Blocks of ``block`` values keep the work at n * block rather than n squared, so one text with very many matches stays cheap.
    """
    in_blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: _total(F.slice(v, b * block + 1, block)))
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("a"))
    before = lambda b: F.aggregate(b, start, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")), lambda acc: acc["a"])
    sums = lambda v, bases: F.transform(v, lambda _, i: F.get(bases, F.floor(i / block).cast("int")) + _total(F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block)))
    return F.when(F.size(values) > 0, let(values, lambda v: let(before(in_blocks(v)), lambda bases: sums(v, bases)))).otherwise(F.array().cast("array<long>"))


def furthest(values: Column, block: int = 256) -> Column:
    """For each value of an array<bigint> the greatest of those before it, -1 for none, inside the row; in blocks, as ``prefix_sums``."""
    most = lambda v: F.coalesce(F.array_max(v), F.lit(-1).cast("long"))
    in_blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: most(F.slice(v, b * block + 1, block)))
    start = F.struct(F.lit(-1).cast("long").alias("m"), F.array().cast("array<long>").alias("a"))
    before = lambda b: F.aggregate(b, start, lambda acc, v: F.struct(F.greatest(acc["m"], v).alias("m"), F.concat(acc["a"], F.array(acc["m"])).alias("a")), lambda acc: acc["a"])
    each = lambda v, bases: F.transform(v, lambda _, i: F.greatest(F.get(bases, F.floor(i / block).cast("int")), most(F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block))))
    return F.when(F.size(values) > 0, let(values, lambda v: let(before(in_blocks(v)), lambda bases: each(v, bases)))).otherwise(F.array().cast("array<long>"))


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a Java regex as array<struct<start, stop, hit>>, in code points; ``hit`` is the given group.

    The pieces between matches (``split``) and the matches (``regexp_extract_all``) alternate, so running lengths give positions.
    """

    def spans(gaps: Column, hits: Column, parts: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        return let(lengths, lambda n: let(prefix_sums(n), lambda before: F.transform(hits, lambda h, i: F.struct((F.get(before, i) + F.get(n, i) - F.length(h)).alias("start"), (F.get(before, i) + F.get(n, i)).alias("stop"), F.get(parts, i).alias("hit")))))

    hits, parts = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    found = let(F.split(text, pattern, -1), lambda gaps: let(hits, lambda h: spans(gaps, h, h) if not group else let(parts, lambda p: spans(gaps, h, p))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,hit:string>>"))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], Sequence]], made: str, keep: Sequence[str] = ("doc_id",), rows: int = 256, column: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs``, untouched, and those of the DDL ``made`` that a function computes of a few texts (or other values of ``column``) at a time.

    ``make`` is called once a task and returns the function: texts, null as empty, to one sequence per column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T.StructType.fromDDL(made)
    shape = T.StructType([*(docs.schema[k] for k in keep), *added])
    kinds, names, keep = [f.type for f in to_arrow_schema(added)], shape.names, list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                got = fn([t or "" for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))], names=names)

    return docs.select(*keep, docs[column].alias("_text")).mapInArrow(run, shape)
