"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a host if it stands on more than ``ratio`` of the host's
pages, and on ``least`` pages at least: a line of a single page repeats nothing. On
hosts of any size that repeat a line the ratio alone decides.
Lines are counted by hashes, once per page, and combined in each task before they
move, so neither a hot host nor a hot line meets in one task. As each boilerplate
line takes more than ``ratio`` of the pages, a host has at most its mean number of
lines per page divided by ``ratio`` of them; that small set joins the pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemap.llm.common import keep

RATIO, LEAST = 0.1, 2


def _key(line):
    """96 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _lines(text):
    return F.split(text, "\n")


def drop_boilerplate(
    pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, least: int = LEAST
) -> DataFrame:
    """``pages`` with ``text`` less its boilerplate lines, and the counts ``n_lines``
    and ``n_dropped``.

    Lines end with a line feed and are compared as they are; blank lines stay and
    are no boilerplate. A null text stays null and has no lines, but its page
    counts; pages of a null host share one. A repeated row is a page of its own.
    All rows and other columns stay; of clashing names the result's own win.
    """
    pages = pages.drop("n_lines", "n_dropped")
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    seen = F.filter(F.array_distinct(_lines(F.col(text))), lambda x: F.trim(x) != "")
    keys = pages.select(site.alias("site"), F.explode(F.transform(seen, _key)).alias("key"))
    counts = keys.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    totals = pages.groupBy(site.alias("site")).agg(F.count(F.lit(1)).alias("pages"))
    frequent = counts.join(totals, "site").where(F.col("n") > ratio * F.col("pages"))
    # Written, so that its size is known when the join is planned.
    found = keep(frequent.groupBy("site").agg(F.collect_list("key").alias("drop")), "boilerplate")
    own = {c: f"c{i}" for i, c in enumerate(pages.columns)}
    numbered = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], site.alias("site"))
    joined = numbered.join(found, "site", "left")
    lines = _lines(F.col(own[text]))
    kept = F.filter(
        lines, lambda x: F.col("drop").isNull() | (F.trim(x) == "") | ~F.array_contains("drop", _key(x))
    )
    result = joined.select(*own.values(), lines.alias("lines"), kept.alias("kept"))
    return result.select(
        *[
            (F.array_join("kept", "\n") if c == text else F.col(n)).alias(c)
            for c, n in own.items()
        ],
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


#: Fixed patterns, read alike by Spark and by the SQL they are checked against.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKS = (
    r"(?i)</?(p|li|div|h[1-6]|ul|ol|nav|article|section|header|footer|table|tr|title|head|body|html|br)\b[^>]*>"
)
TAGS = r"<[^>]*>"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, host and the text lines of ``url`` and ``html``; no blank lines."""
    text = F.col("html")
    for pattern, by in ((HIDDEN, ""), (BREAKS, "\n"), (TAGS, "")):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by))
    lines = F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select(
        "page_id",
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"),
        F.array_join(lines, "\n").alias("text"),
    )


PAGES_SQL = f"""
    WITH page AS (
        SELECT page_id,
               lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
               list_filter(list_transform(string_split(
                   regexp_replace(regexp_replace(regexp_replace(html,
                       '{HIDDEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'),
                   chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
        FROM pages
    ), totals AS (
        SELECT host, count(*) AS pages FROM page GROUP BY host
    ), counts AS (
        SELECT host, line, count(*) AS n
        FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM page) GROUP BY host, line
    ), found AS (
        SELECT host, list(line) AS found
        FROM counts JOIN totals USING (host)
        WHERE n >= {LEAST} AND n > {RATIO} * pages GROUP BY host
    ), kept AS (
        SELECT page_id, host, lines,
               list_filter(lines, lambda x: found IS NULL OR NOT list_contains(found, x)) AS kept
        FROM page LEFT JOIN found USING (host)
    )
    SELECT page_id, host, array_to_string(kept, chr(10)) AS text,
           CAST(len(lines) AS BIGINT) + CAST(len(lines) = 0 AS BIGINT) AS n_lines,
           CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped
    FROM kept
"""
