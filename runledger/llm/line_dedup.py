"""Line dedup by site-relative frequency.

Pages are grouped by host; a line that more than RATIO of the host's pages contain (MIN_PAGES at least) is boilerplate
and dropped. A host has at most (lines of its mean page / RATIO) such lines, so they fit in one row a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed

RATIO, MIN_PAGES = 0.3, 3
#: Bytes of boilerplate lines up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: White space inside a line.
BLANKS = " \t\r\x0b\x0c"


def visible_lines(html: str = "html") -> Column:
    """Lines of what a page shows: scripts, styles, comments and tags become line ends; blanks around lines go."""
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        text = F.regexp_replace(text, pattern, "\n")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, bad: the host's boilerplate lines, from rows of (host, lines)."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    each = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    bad = each.join(totals, "host").where(F.col("n") > F.col("pages") * ratio)
    return bad.groupBy("host").agg(F.collect_list("line").alias("bad"))


def without_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows of (page_id, host, lines) with lines, kept: the lines that stay, in order.

    Pages without lines count for their host; null lines give null. A null host is the host ''; repeated rows count
    each; an empty table stays empty. Other columns are kept, but one named kept is replaced. A host too large to be
    joined by broadcast is a skewed join side, which adaptive execution splits."""
    home = F.coalesce(F.col("host").cast("string"), F.lit(""))
    rows = cut(packed(pages, home=home))
    bad = cut(boilerplate(rows.select(F.col("home").alias("host"), F.col("row.lines").alias("lines")), ratio, min_pages))
    size = bad.agg(F.sum(F.octet_length(F.array_join("bad", "\n")) + F.octet_length("host") + 32)).first()[0] or 0
    known = rows.join(F.broadcast(bad) if size <= BROADCAST_BYTES else bad, F.col("home") == F.col("host"), "left")
    stays = F.filter("row.lines", lambda x: ~F.array_contains("bad", x))
    columns = [F.col("home").alias("host") if c == "host" else F.col("row").getField(c).alias(c) for c in pages.columns if c != "kept"]
    return known.select(*columns, F.when(F.col("bad").isNull(), F.col("row.lines")).otherwise(stays).alias("kept"))


def digest(rows: DataFrame) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_sha256 of the rows of without_boilerplate()."""
    text = F.array_join("kept", "\n")
    return rows.select("page_id", "host", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH shown AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^\s*[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script[^>]*>.*?</script>', chr(10), 'g'), '(?is)<style[^>]*>.*?</style>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'),
      chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM shown GROUP BY host),
each AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM shown) GROUP BY ALL),
bad AS (SELECT host, list(line) AS bad FROM each JOIN totals USING (host) WHERE n >= 3 AND n > pages * 0.3 GROUP BY host),
kept AS (SELECT page_id, host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM shown LEFT JOIN bad USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM kept
"""
