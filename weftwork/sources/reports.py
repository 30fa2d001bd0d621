"""Crawl and error reports: one ordered JSON document put together from parts that executors write.

A section of many rows is sorted and written in parts by as many tasks; the
document is then the parts' bytes in order, copied from one stream to another, so
the driver holds a buffer and no rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.storage import fresh_path

#: Bytes copied at once.
BUFFER = 1 << 16


def _json(value: Column) -> Column:
    """A value by itself as JSON."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return text.substr(F.lit(6), F.length(text) - 6)  # without {"v": and }


def _parts(rows: DataFrame, key: str, value: Column, kind: str) -> str:
    """The folder of the parts: for each row ``"key": value``, led by a comma but for the first row of all."""
    first = rows.agg(F.min(key)).first()[0]
    lead = F.when(F.col(key) == F.lit(first), F.lit("    ")).otherwise(F.lit("  , "))
    path = fresh_path(rows.sparkSession, kind)
    rows.orderBy(key).select(F.concat(lead, _json(F.col(key)), F.lit(": "), F.regexp_replace(value, "\n", "\n    ")).alias("value")).write.text(path)
    return path


def _object(rows: DataFrame) -> Column:
    """All columns but the url as an object."""
    return F.to_json(F.struct(*[x for x in rows.columns if x != "url"]), {"pretty": "true", "ignoreNullFields": "false"})


def _assembled(spark: SparkSession, target: str, pieces: list[str | tuple[str]]) -> None:
    """Texts, and the part files of folders (as 1-tuples), in order, to one file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out_path = jvm.org.apache.hadoop.fs.Path(target)
    partial = jvm.org.apache.hadoop.fs.Path(f"{target}.partial")
    files = out_path.getFileSystem(conf)
    out = files.create(partial, True)
    try:
        for piece in pieces:
            if isinstance(piece, str):
                out.write(bytearray(piece.encode()))
                continue
            folder = jvm.org.apache.hadoop.fs.Path(piece[0])
            source = folder.getFileSystem(conf)
            for status in sorted(source.listStatus(folder), key=lambda x: x.getPath().getName()):
                if status.getPath().getName().startswith("part-"):
                    stream = source.open(status.getPath())
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, BUFFER, False)
                    stream.close()
            source.delete(folder, True)
    finally:
        out.close()
    files.delete(out_path, False)
    if not files.rename(partial, out_path):
        raise OSError(f"{target} could not be written")


def _indented(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2).replace("\n", "\n  ")


def save_crawl_results(target: str, results: DataFrame, failed: DataFrame, statistics: Mapping[str, object]) -> str:
    """One document of results (by url, the other columns), failed_urls (url, reason) and statistics; each url once."""
    spark = results.sparkSession
    pieces: list[str | tuple[str]] = ['{\n  "results": {\n', (_parts(results, "url", _object(results), "results"),), '  },\n  "failed_urls": {\n', (_parts(failed, "url", _json(F.col("reason")), "failed"),), f'  }},\n  "statistics": {_indented(dict(statistics))}\n}}\n']
    _assembled(spark, target, pieces)
    return target


def save_error_report(target: str, errors: DataFrame, statistics: Mapping[str, object]) -> str:
    """One document of errors (by url, the other columns) and statistics; each url once."""
    _assembled(errors.sparkSession, target, ['{\n  "errors": {\n', (_parts(errors, "url", _object(errors), "errors"),), f'  }},\n  "statistics": {_indented(dict(statistics))}\n}}\n'])
    return target
