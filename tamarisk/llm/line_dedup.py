"""Removal of lines that many documents share.

Texts are cut at ``\\n``; a null or empty text is one empty line.  A line's key is the line
without space and 0x09-0x0D at both ends, A-Z lower-cased.  The lines are exploded with
their positions and the MD5 of their key.  Keys of at least ``least_chars`` code points
found in at least ``least_docs`` documents lose their lines everywhere but in the largest
id that holds them.  What stays is put together by position.

Defined results:

* Rows of one id are one document: their lines count once and stay or go together.  Rows
  without an id are together one document, smaller than all others.
* Repeated rows give repeated result rows.  Empty tables give empty results.
* Columns other than id and text are not looked at; their names may be any.

Distinct (key, id) pairs are counted in two steps, so a line that a third of all documents
hold reaches its last task as one row per map task; only such hot keys, a bounded number,
are broadcast to their lines.  A text is held by one task at a time, never a group of texts.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.llm.skew import join_statistics
from tamarisk.operators.lineage import written

_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
#: texts that are held at once
_ROWS = 256


@dataclass(frozen=True)
class LineParams:
    least_chars: int = 20
    least_docs: int = 3


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def exploded_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """(id, row, pos, key): the lines long enough to count; ``row`` is the MD5 of the text."""
    lines = docs.select(
        "id", F.unhex(F.md5("text")).alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    ).withColumn("line", line_key(F.col("line")))
    return lines.where(F.char_length("line") >= params.least_chars).select(
        "id", "row", "pos", F.unhex(F.md5("line")).alias("key")
    )


def shared_keys(lines: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """(key, n_docs, keeper): keys of enough documents and the largest id of each."""
    per_doc = lines.groupBy("key", "id").agg(F.count("*").alias("n"))
    per_key = per_doc.groupBy("key").agg(
        F.count("*").alias("n_docs"), F.max("id").alias("keeper"), F.sum("n").alias("n_lines")
    )
    return per_key.where(F.col("n_docs") >= params.least_docs)


def _reassemble(batches):
    """Texts without the lines at the positions to drop."""
    for whole in batches:
        for first in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(first, _ROWS)
            n_lines, n_dropped, texts = [], [], []
            for text, drop in zip(batch.column("text"), batch.column("drop").to_pylist(), strict=True):
                text = text.as_py()
                lines = text.split("\n")
                if drop:
                    gone = set(drop)
                    text = "\n".join([line for at, line in enumerate(lines) if at not in gone])
                texts.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(drop or ()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())],
                names=["id", "n_lines", "n_dropped", "kept_text"],
            )


def drop_shared_lines(
    docs: DataFrame, params: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text), one row per input row."""
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = written(exploded_lines(docs, params), "lines")
    shared = written(shared_keys(lines, params), "shared-lines")
    total = shared.agg(F.sum("n_lines")).head()[0] or 0
    # only lines of shared keys go on: the semi join is on the same key
    marked = join_statistics(lines, shared, "key", "n_lines", total)
    drop = (
        marked.where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "row").agg(F.collect_set("pos").alias("drop"))
    )
    whole = docs.withColumn("row", F.unhex(F.md5("text"))).alias("d").join(
        drop.alias("x"), F.col("d.id").eqNullSafe(F.col("x.id")) & (F.col("d.row") == F.col("x.row")), "left"
    ).select("d.id", "d.text", "x.drop")
    out = T.StructType([
        T.StructField("id", kind), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
        T.StructField("kept_text", T.StringType()),
    ])
    return whole.mapInArrow(_reassemble, out).withColumnRenamed("id", id_col)
