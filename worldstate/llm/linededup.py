"""Boilerplate lines by their frequency within a site.

For each host and line: the pages of the host that hold the line, divided by all pages of the
host. Lines above ``ratio`` are boilerplate there and are dropped from that host's pages only.

A line is what stands between line feeds, compared without blanks at its ends; blank lines are
always kept. A line counts once per page however often the page repeats it, and repeated rows
count as pages. Null host is a host of its own. Null text stays null, an emptied text is ``''``;
no page is dropped. A line on one page only (fewer than ``min_pages``) is no boilerplate, however small the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldstate.llm.numbering import key_text
from worldstate.session import cut_lineage

RATIO = 0.05
MIN_PAGES = 2


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def _filled(line: Column) -> Column:
    return F.trim(line) != ""


def boilerplate_lines(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host_key, line (digest), pages, host_pages`` of the lines above ``ratio`` of their host's pages."""
    keyed = pages.select(key_text(host).alias("host_key"), text.alias("body"))
    totals = keyed.groupBy("host_key").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = F.array_distinct(F.transform(F.filter(F.split("body", "\n"), _filled), _digest))
    found = keyed.select("host_key", F.explode(lines).alias("line")).groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("pages"))
    return (
        found.filter(F.col("pages") >= min_pages)
        .join(totals, "host_key")
        .filter(F.col("pages") > ratio * F.col("host_pages"))
    )


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    dropped: str | None = None,
) -> DataFrame:
    """The pages with ``text`` freed of boilerplate lines; ``dropped`` names a column for their number.

    A host has at most (mean lines per page / ``ratio``) such lines, so its list fits one row.
    """
    listed = boilerplate_lines(pages, F.col(host), F.col(text), ratio, min_pages)
    lists = cut_lineage(listed.groupBy("host_key").agg(F.collect_list("line").alias("__lines")), "lines")
    lists = lists.withColumnRenamed("host_key", "__host")
    joined = pages.withColumn("__host", key_text(F.col(host))).join(lists, "__host", "left")
    lines = F.split(F.col(text), "\n")
    kept = F.when(
        F.col("__lines").isNotNull(),
        F.filter(lines, lambda line: ~(_filled(line) & F.array_contains(F.col("__lines"), _digest(line)))),
    ).otherwise(lines)
    joined = joined.withColumn("__kept", kept).withColumn("__gone", F.size(F.split(F.col(text), "\n")) - F.size("__kept"))
    clean = F.when(F.col("__gone") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text))
    outputs = {text: clean} | ({dropped: F.coalesce(F.col("__gone"), F.lit(0))} if dropped else {})
    return joined.withColumns(outputs).drop("__host", "__lines", "__kept", "__gone")


def line_report(docs: DataFrame) -> DataFrame:
    """Per document of its source: number of lines, lines dropped, digest of what remains."""
    counted = docs.select("doc_id", "source", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    clean = drop_boilerplate(counted, dropped="n_dropped")
    return clean.select(
        "doc_id", "source", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"),
    )


LINE_SQL = f"""
with lines as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line from documents),
pages as (select source, count(*) as host_pages from documents group by source),
bad as (
  select l.source, trim(l.line, ' ') as line
  from (select distinct doc_id, source, trim(line, ' ') as line from lines where trim(line, ' ') <> '') l
  join pages p on p.source is not distinct from l.source
  group by l.source, trim(l.line, ' '), p.host_pages
  having count(*) >= {MIN_PAGES} and count(*) > {RATIO}e0 * p.host_pages),
per as (select source, list(line) as gone from bad group by source),
cut as (
  select d.doc_id, d.source, string_split(d.text, chr(10)) as all_lines,
    list_filter(string_split(d.text, chr(10)), lambda x: not list_contains(coalesce(p.gone, []), trim(x, ' '))) as kept
  from documents d left join per p on p.source is not distinct from d.source)
select doc_id, source, cast(len(all_lines) as bigint) as n_lines, cast(len(all_lines) - len(kept) as bigint) as n_dropped,
  md5(array_to_string(kept, chr(10))) as kept_md5
from cut
"""
