"""Line dedup: lines that many documents hold stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_of, written

#: ASCII white space, stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """Columns doc_id, body (a hash of the text), pos, h1, h2 for every line whose key has ``least_chars`` code points.

    The two hashes have seeds of their own, so that 128 bits tell keys apart.
    """
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("body"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "body", "pos", line_key(F.col("line")).alias("line_key")).where(F.length("line_key") >= least_chars)
    return keys.select("doc_id", "body", "pos", F.xxhash64("line_key").alias("h1"), F.xxhash64(F.lit(1), "line_key").alias("h2"))


def common_lines(lines: DataFrame, least_documents: int) -> DataFrame:
    """Columns h1, h2, keeper (the smallest doc_id) of the lines that ``least_documents`` documents hold.

    Rows are made distinct by line and document first, so a line that every document holds is counted in many tasks.
    """
    held = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
    return held.agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where(F.col("n") >= least_documents).drop("n")


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = (), least_chars: int = 10, least_documents: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``keep``, text without its repeated lines, n_lines (before), n_dropped.

    A key (see ``line_key``) of ``least_chars`` code points that ``least_documents`` documents hold stays in
    the smallest doc_id that holds it, with all its lines there; everywhere else its lines go.  The other
    lines are joined again by \\n in their order.

    Null and empty texts are one empty line, which is too short to go.  Rows that share a doc_id are one
    document: none of them loses a line to another of them.  Rows without id are one document, too, which
    comes after all others.  Texts of any length are taken whole; a text's lines are in one task, as the text
    is.  An empty table gives no rows.  Other columns are ignored; ``keep`` may not name text, n_lines or n_dropped.
    """
    clear_of(keep, "doc_id", "text", "n_lines", "n_dropped")
    lines = line_hashes(docs, least_chars)
    # written, so that both sides of the join have exchanges of their own and Spark can split a line that every document holds
    met = lines.join(written(common_lines(lines, least_documents), "lines"), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = met.groupBy(F.col("doc_id").alias("of_id"), F.col("body").alias("of_body")).agg(F.collect_set("pos").alias("gone_at"))
    own = docs.select("doc_id", *(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.coalesce("text", F.lit("")).alias("text"))
    both = own.join(gone, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.xxhash64("text") == F.col("of_body")), "left")
    return both.select(
        "doc_id", *(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), F.when(F.col("gone_at").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone_at"))).alias("text"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size("gone_at"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _without(text: Column, at: Column) -> Column:
    """The text without the lines at the given positions: the slices between them, each copied once."""

    def between(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(x["at"], i - 1))
        after = F.when(i == F.size(x["at"]), F.size(x["lines"])).otherwise(F.get(x["at"], i))
        return F.slice(x["lines"], before + 2, after - before - 1)

    # the array of one element binds what all slices share
    once = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), F.sort_array(at).alias("at")))
    return F.transform(once, lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["at"])), lambda i: between(x, i))), "\n"))[0]


def line_digest(kept: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the text that ``dedup_lines`` kept."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The same over ``documents`` in DuckDB; ids are unique there.
SQL = r"""WITH l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
 k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 c AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
 d AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN c USING (key))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""
