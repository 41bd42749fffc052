"""Drops lines that many documents share."""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes that stand for the stripped, lower-cased line; None where it has under min_chars code points."""
    line = line.strip().translate(common.LOWER)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode(errors="replace")) < min_chars):
        return None
    return blake2b(line, digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(key, id) once for each id and long line that it has."""

    def make():
        def f(piece: pa.RecordBatch):
            keys = [list({k for line in t.split(b"\n") if (k := line_key(line, min_chars))}) for t in common.encoded(common.column(piece, "t"))]
            return [common.column(piece, "k"), pa.array(keys, pa.list_(pa.binary()))]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    rows = common.over_batches(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")), make, f"k {kind}, keys array<binary>", "t")
    return rows.select(F.explode("keys").alias("key"), F.col("k").alias("id")).distinct()


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that at least min_docs of them share, except in the one with the largest id.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased; shorter keys than min_chars stay. Adds
    n_lines (before) and n_dropped, in place of such columns; all other columns pass through. Null text becomes one empty
    line. Rows that share an id are one document when lines are counted and lose the same lines; null ids are one
    document, smaller than all others. Rows are never lost: a text may become empty. Bytes that are not UTF-8 become U+FFFD. An empty table gives an empty one.

    Only 16-byte keys and ids move for the counts: first made distinct, then counted with partial sums, so a line that
    all documents hold is one row from each task. Texts move once, to meet the list of their dropped keys."""
    spark = docs.sparkSession
    keys = common.Scratch(spark, "lines").put(line_keys(docs, min_chars, id_col, text_col))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).select(F.col("key").alias("shared"), "last", "n")
    held = common.joined_by_weight(keys, shared, lambda a, b: a["key"] == b["shared"], "n", keys.count())
    drop, drop_id = common.fresh(docs, "drop", "drop_id")
    drops = held.where(~F.col("id").eqNullSafe(F.col("last"))).groupBy(F.col("id").alias(drop_id)).agg(F.collect_list("key").alias(drop))
    fields = [x for x in docs.schema.fields if x.name not in ("n_lines", "n_dropped")]
    given = docs.select([F.col(f"`{x.name}`") for x in fields])
    joined = given.join(drops, given[id_col].eqNullSafe(drops[drop_id]), "left").drop(drop_id)
    schema = StructType([StructField(x.name, StringType() if x.name == text_col else x.dataType) for x in fields] + [StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    names, out = [x.name for x in fields], to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for piece in common.pieces(batch, text_col):
                kept, n_lines, n_dropped = [], [], []
                for text, lost in zip(common.encoded(common.column(piece, text_col)), common.column(piece, drop).to_pylist(), strict=True):
                    lines = text.split(b"\n")
                    n_lines.append(len(lines))
                    if lost:
                        gone = set(lost)
                        lines = [x for x in lines if line_key(x, min_chars) not in gone]
                        text = b"\n".join(lines)
                    n_dropped.append(n_lines[-1] - len(lines))
                    kept.append(text.decode(errors="replace"))
                columns = [pa.array(kept, pa.string()).cast(out.field(n).type) if n == text_col else common.column(piece, n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema=out)

    return joined.mapInArrow(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.doc_id, a.line, a.pos, (s.k IS NOT NULL AND a.doc_id <> s.last) AS gone FROM keyed a LEFT JOIN shared s ON a.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
