"""Cross-site boilerplate lines, found by HyperLogLog spread and removed.

A line (blanks at its ends cut off, at least ``min_chars`` characters) is boilerplate if it stands in
texts of at least ``min_sites`` distinct sites. Lines are told apart by a 64-bit hash, and sites of a
line by a sketch per hash: sketches merge by aggregation, so a line that a third of all texts hold sends
one sketch per task. Where an estimate is within ``BAND`` of the threshold the sites of that line are
counted exactly; beyond it the sketch's error (1.6 % at 12 bits, exact for few sites) cannot decide
wrongly. Lines found fewer times than ``min_sites`` cannot be in that many sites and get no sketch.

Of a boilerplate line its first place stays: the smallest ``doc_id``, then the earliest line. Texts that
lose nothing stay as they are, byte for byte. A null text stays null and an empty one empty; a null site
is no site. Repeated rows lose the same lines; a null ``doc_id`` comes after all others. A text may have
any number of lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chatloom.llm.base import sha256_text, stored

MIN_SITES = 10
MIN_CHARS = 1
SKETCH_BITS = 12
BAND = 0.2
BLANKS = " \t\r\x0b\x0c"


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def lines_of(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """``doc_id, text_key, site, at, line`` of the lines that count; ``line`` is the hash."""
    split = F.posexplode(F.split("text", "\n")).alias("at", "raw")
    rows = docs.filter("text is not null").select("doc_id", _text_key(F.col("text")).alias("text_key"), F.col(site).alias("site"), split)
    line = F.trim(F.col("raw"), F.lit(BLANKS))
    return rows.filter(F.length(line) >= min_chars).select("doc_id", "text_key", "site", "at", F.xxhash64(line).alias("line"))


def boilerplate_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """``line, first`` of the lines in at least ``min_sites`` sites; ``first`` is the place that stays."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "at")
    often = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    often = stored(often.filter(F.col("n") >= min_sites).select("line", "first"), "frequent-lines")
    among = lines.select("line", "site").join(often.select("line"), "line")
    spread = among.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    spread = spread.select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = stored(spread.filter(F.col("sites") >= min_sites * (1 - BAND)), "line-spread")
    sure = spread.filter(F.col("sites") > min_sites * (1 + BAND)).select("line")
    near = spread.filter(F.col("sites") <= min_sites * (1 + BAND)).select("line")
    exact = lines.select("line", "site").join(near, "line").filter("site is not null").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    wide = sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("line"))
    return often.join(wide, "line")


def removed_places(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_key, places``: line numbers each text loses, for texts that lose any."""
    lines = lines_of(docs, site, min_chars)
    marked = stored(boilerplate_lines(lines, min_sites), "boilerplate-lines")
    hits = lines.select("doc_id", "text_key", "at", "line").join(marked, "line")
    first = F.col("first")
    stays = first["doc_id"].eqNullSafe(F.col("doc_id")) & (first["text_key"] == F.col("text_key")) & (first["at"] == F.col("at"))
    return hits.filter(~stays).groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("places"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, places: pd.Series) -> pd.Series:
    def cut(text, gone):
        if gone is None:
            return text
        gone = set(gone)
        return "\n".join(line for at, line in enumerate(text.split("\n")) if at not in gone)

    return pd.Series([cut(t, g) for t, g in zip(texts, places)], dtype=object)


def dedup_lines(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, removed: str = "_removed"
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``removed``, the number of lines lost.

    All other columns stay. Texts move once, to meet the line numbers by document.
    """
    gone = removed_places(docs, site, min_sites, min_chars).select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), "places")
    # the row travels in one struct: its columns may have any names
    rows = docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text")), "left")
    columns = [_without("row.text", "places").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias(removed))


def line_dedup_summary(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every row; null texts have no lines and no digest."""
    slim = docs.select("doc_id", "text", F.col("source"), F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))
    out = dedup_lines(slim, **parameters)
    lines = F.when(F.col("text").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("n_lines"))
    return out.select("doc_id", lines.alias("n_lines"), F.col("_removed").alias("n_removed"), sha256_text(F.col("text")).alias("kept_sha256"))


#: The same rows for DuckDB.
ORACLE = f"""
WITH split AS (
  SELECT rowid AS r, doc_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
trimmed AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM split),
wide AS (
  SELECT line, min({{'d': doc_id, 'p': pos}}) AS first FROM trimmed WHERE length(line) >= {MIN_CHARS}
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
flagged AS (
  SELECT t.*, w.line IS NOT NULL AND NOT (w.first.d = t.doc_id AND w.first.p = t.pos) AS gone
  FROM trimmed t LEFT JOIN wide w USING (line)),
kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM flagged GROUP BY r)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(k.text) END AS kept_sha256
FROM (SELECT row_number() OVER () AS r, * FROM documents) d LEFT JOIN kept k USING (r)
"""
