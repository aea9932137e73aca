"""Fill-in-the-middle transformation of texts, in DuckDB inside the tasks.

Spark deals the rows; each task registers its Arrow batches with a DuckDB connection of its own, whose SQL cuts the
texts into lines, draws cuts and form from a hash of the id, and builds the output. restore() turns outputs back into
the exact texts the same way. No Python touches single rows, and a repeated task gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseforge.llm import common

#: Marks before prefix, suffix and middle; percent of texts that are transformed, and of these with the suffix first; seed of the draws.
MARKS, RATE, SPM, SEED = ("<P>", "<S>", "<M>"), 100, 50, 7
#: Bytes of text that one SQL statement handles (a single longer text is still handled whole).
LOT = 4 << 20

#: A unit is a line with its line end, or the rest after the last one.
UNIT = r"[^\n]*\n|[^\n]+"

CUT_SQL = """
WITH t AS (
  SELECT nr, coalesce(text, '') AS text, sha256($seed || ':' || coalesce(key, '')) AS h FROM lot
), u AS (
  SELECT nr, text, regexp_extract_all(text, $unit) AS units,
         ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
         ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4
  FROM t
), c AS (
  SELECT nr, text, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
         CASE WHEN text = '' OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR h3 % 100 >= $rate THEN 'plain'
              WHEN h4 % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM u
), x AS (
  SELECT nr, text, n, form, array_to_string(list_slice(units, 1, a), '') AS prefix,
         array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix
  FROM c
)
SELECT nr, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       CASE form WHEN 'plain' THEN text WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle ELSE $s || suffix || $p || prefix || $m || middle END AS output
FROM x ORDER BY nr
"""

#: A text with a mark in it stays plain, so the first mark of each kind is the one that was set.
RESTORE_SQL = """
WITH t AS (
  SELECT nr, form, output, length($p)::BIGINT AS lp, length($s)::BIGINT AS ls, length($m)::BIGINT AS lm, strpos(output, $p) AS p, strpos(output, $s) AS s, strpos(output, $m) AS m FROM lot
), r AS (
  SELECT nr, CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, p + lp, s - p - lp) || substr(output, m + lm) || substr(output, s + ls, m - s - ls)
    WHEN 'spm' THEN substr(output, p + lp, m - p - lp) || substr(output, m + lm) || substr(output, s + ls, p - s - ls) END AS text
  FROM t
)
SELECT nr, text, sha256(text) AS text_sha256 FROM r ORDER BY nr
"""


def in_duckdb(rows: DataFrame, cols: list[str], text: str, sql: str, values: dict, found: str, kept: list[str]) -> DataFrame:
    """The columns `kept` of rows beside those that sql finds for each lot of rows (a DDL string); sql reads the view `lot` and keeps its rows in the order of `nr`."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    names = [part.split()[0] for part in found.split(", ")]

    def run(batches):
        import duckdb
        import pyarrow as pa

        # one thread, as a task has one core; nothing is read or written but what is registered
        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False})
        con.execute("SET enable_external_access = false")
        for lot in common.arrays(batches, [*cols, *kept], text, LOT):
            con.register("lot", pa.RecordBatch.from_arrays([pa.array(range(len(lot[0])), pa.int64()), *lot[: len(cols)]], names=["nr", *cols]))
            table = con.execute(sql, {k: v for k, v in values.items() if f"${k}" in sql}).to_arrow_table().combine_chunks()
            con.unregister("lot")
            parts = [table.column(c).combine_chunks() for c in names]
            parts = [p.cast(pa.string()) if pa.types.is_large_string(p.type) else p for p in parts]
            yield pa.RecordBatch.from_arrays([*lot[len(cols) :], *parts], names=[*kept, *names])
        con.close()

    return rows.mapInArrow(common.lean(run), f"{kinds}, {found}")


def values(marks: tuple[str, str, str] = MARKS, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> dict:
    """The parameters of the SQL; marks must be different, not empty, and none may overlap itself or another."""
    if len(set(marks)) < 3 or any(not a or any(a in b and a != b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))) for b in marks) for a in marks):
        raise ValueError("marks must be three different texts that don't overlap")
    return {"p": marks[0], "s": marks[1], "m": marks[2], "rate": rate, "spm": spm, "seed": str(seed), "unit": UNIT}


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars and output of each row's text.

    A text of n lines is cut at two places, drawn from the hash of seed and id: prefix, middle, suffix (each may be
    empty). `rate` percent of the texts are transformed, `spm` percent of these with the suffix first; empty texts and
    those that hold a mark stay plain, with null prefix_chars and middle_chars. A null text counts as empty, a null id
    as no digits; rows of one id get the same draws, each for its own text. Other columns aren't read; an empty table
    gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    out = in_duckdb(rows, ["key", "text"], "text", CUT_SQL, values(marks, rate, spm, seed), "n long, form string, prefix_chars long, middle_chars long, output string", ["id"])
    return out.withColumnRenamed("id", id_col)


def restore(df: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """df without its column output, with the text that output and form stand for and its sha256 (lowercase hex of UTF-8), in the columns text and text_sha256.

    A null output, or a form that isn't plain, psm or spm, gives nulls.
    """
    kept = [c for c in df.columns if c not in ("output", "text", "text_sha256")]
    return in_duckdb(df, ["form", "output"], "output", RESTORE_SQL, values(marks), "text string, text_sha256 string", kept)


def op12_infill(spark, sf_dir: str) -> DataFrame:
    """All documents in fill-in-the-middle form, with digests of the outputs and of the texts rebuilt from them."""
    out = fill_in_middle(common.table(spark, sf_dir, "documents"))
    back = restore(out.withColumn("output_sha256", F.sha2("output", 256)))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("text_sha256").alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts, h FROM d
), l AS (
  SELECT doc_id, text, h, CASE WHEN parts[-1] = '' THEN list_transform(parts[:-2], lambda x: x || chr(10))
    ELSE list_concat(list_transform(parts[:-2], lambda x: x || chr(10)), [parts[-1]]) END AS lines FROM u
), c AS (
  SELECT doc_id, text, h, lines, len(lines) AS n, CAST(('0x' || h[1:8]) AS BIGINT) % (len(lines) + 1) AS c1,
    CAST(('0x' || h[9:16]) AS BIGINT) % (len(lines) + 1) AS c2, CAST(('0x' || h[25:32]) AS BIGINT) % 100 < 50 AS spm,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM l
), p AS (
  SELECT doc_id, text, n, spm, plain, array_to_string(lines[1:least(c1, c2)], '') AS a,
    array_to_string(lines[least(c1, c2) + 1:greatest(c1, c2)], '') AS b, array_to_string(lines[greatest(c1, c2) + 1:n], '') AS c FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE '<P>' || a || '<S>' || c || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
