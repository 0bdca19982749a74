"""Software listings from already crawled HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NO_DESCRIPTION = "No description available"


def _text(html: Column) -> Column:
    """Trimmed text of a small piece of HTML."""
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def app_links(pages: DataFrame, link_class: str | None = "link_ttl", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per application link: address, title and the description that follows it."""
    attribute = rf"""[^>]*class="{link_class}"[^>]*""" if link_class else "[^>]*"
    # each match starts at a link and ends before the next one
    pattern = rf"""(?s)<a(?=\s)({attribute}>.*?</a>.*?)(?=<a(?=\s){attribute}>|\z)"""
    pieces = F.regexp_extract_all("html", F.lit(pattern), 1)
    rows = pages.select(*keep, F.posexplode(pieces).alias("position", "piece"))
    block = F.regexp_extract("piece", r"""(?s)<div[^>]*class="description"[^>]*>(.*?)</div>""", 1)
    paragraph = F.regexp_extract("piece", r"(?s)<p(?:\s[^>]*)?>(.*?)</p>", 1)
    described = F.coalesce(F.nullif(_text(block), F.lit("")), F.nullif(_text(paragraph), F.lit("")), F.lit(NO_DESCRIPTION))
    return rows.select(*keep, "position", F.regexp_extract("piece", r"""href="([^"]*)\"""", 1).alias("href"),
                       _text(F.regexp_extract("piece", r"(?s)^[^>]*>(.*?)</a>", 1)).alias("title"),
                       described.alias("description"))


def application_details(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """File name, size, MD5, check date and download link of application pages in ``pages(url, html, ...)``.

    The first four stand on the report page that an application page links to ("see the report"), another row of ``pages``; of several
    rows with its address the greatest counts. Pages without report or download link, or whose report is not there, are left out.
    """
    report = F.regexp_extract("html", r"""(?s)<a\s[^>]*href="([^"]+)"[^>]*>\s*see the report\s*</a>""", 1)
    info = F.regexp_extract("html", r"""(?s)<p[^>]*class="file_info"[^>]*>(.*?)</p>""", 1)
    spans = F.transform(F.regexp_extract_all(info, F.lit(r"(?s)<span[^>]*>(.*?)</span>"), 1),
                        lambda s: F.try_element_at(F.split(_text(s), ": "), F.lit(2)))
    button = F.regexp_extract("html", r"""(<a\s[^>]*class="download_btn"[^>]*>)""", 1)
    link = F.regexp_extract(button, r"""href="([^"]+)\"""", 1)
    apps = pages.select(*keep, report.alias("report_link"), link.alias("download_link")).filter("report_link <> '' AND download_link <> ''")
    reports = pages.filter(info != "").groupBy(F.col("url").alias("report_link")).agg(F.max(spans).alias("s"))
    details = apps.join(reports, "report_link").select(*keep, *(F.get("s", F.lit(i)).alias(n) for i, n in
                                    enumerate(("file_name", "file_size", "md5", "last_checked"))), "report_link", "download_link")
    return details.dropna(subset=["file_name", "file_size", "md5", "last_checked"]).drop("report_link")
