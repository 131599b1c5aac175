"""Sources that are tables of texts: markdown, manifests, folders, links, source spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folder_of, resolve_relative

c = F.col
SECTION_CAP = 8192


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, hash): SHA-256 of the content."""
    return files.select("path", F.sha2(c(content).cast("binary"), 256).alias("hash"))


def markdown_headings(files: DataFrame) -> DataFrame:
    """(path, level, title, start_line, end_line, prose) of headings 1 to 6 outside code fences. files: (path, text).

    A section ends before the next heading of its level or above; its prose ends before the next heading at all.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("n", c("pos") + 1)
    by_file = Window.partitionBy("path").orderBy("n")
    fence = F.sum(c("line").rlike(r"^\s{0,3}(```|~~~)").cast("int")).over(by_file)
    heading = c("line").rlike(r"^#{1,6}\s+\S") & (c("fences") % 2 == 0)
    marked = lines.withColumn("fences", fence).withColumn("heading", heading)
    heads = marked.where("heading").select("path", c("n").alias("start_line"), F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+\s+|\s+#*\s*$", "")).alias("title"))
    after = Window.partitionBy("path").orderBy("start_line").rowsBetween(1, Window.unboundedFollowing)
    stop = F.least(*(F.when(c("level") >= k, F.min(F.when(c("level") == k, c("start_line"))).over(after)) for k in range(1, 7)))
    ends = lines.groupBy("path").agg(F.max("n").alias("last"))
    heads = heads.withColumn("stop", stop).withColumn("body_stop", F.lead("start_line").over(Window.partitionBy("path").orderBy("start_line"))).join(ends, "path")
    text = files.select("path", F.split("text", "\n").alias("all"))
    body = F.slice("all", c("start_line") + 1, F.coalesce("body_stop", c("last") + 1) - c("start_line") - 1)
    return heads.join(text, "path").select("path", "level", "title", "start_line", (F.coalesce("stop", c("last") + 1) - 1).alias("end_line"), F.substring(F.trim(F.array_join(body, "\n")), 1, SECTION_CAP).alias("prose"))


def markdown_links(files: DataFrame) -> DataFrame:
    """(path, target): local links, resolved."""
    found = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))).alias("link"))
    return found.where(~c("link").rlike(r"^([a-z][a-z0-9+.-]*:|#|//)")).select("path", resolve_relative("path", "link").alias("target")).distinct()


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): the targets of the links of raw pages. pages: (page_id, html)."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("href=\"([^\"]*)\""), F.lit(1))).alias("link"))


def package_dependencies(manifests: DataFrame) -> DataFrame:
    """(path, name, version, dev, optional) of JSON manifests. manifests: (path, text)."""
    kinds = (("dependencies", False, False), ("devDependencies", True, False), ("optionalDependencies", False, True))
    parsed = manifests.select("path", F.from_json("text", "struct<" + ",".join(f"{k}:map<string,string>" for k, *_ in kinds) + ">").alias("m"))
    out = None
    for k, dev, optional in kinds:
        part = parsed.select("path", F.explode(f"m.{k}").alias("name", "version"), F.lit(dev).alias("dev"), F.lit(optional).alias("optional"))
        out = part if out is None else out.unionByName(part)
    return out


def folders(files: DataFrame) -> DataFrame:
    """(folder, parent, depth, files, languages): every ancestor folder with its files in all depths. files: (path, language)."""
    parts = files.select("path", "language", F.split(folder_of("path"), "/").alias("s")).where(c("s")[0] != "")
    up = parts.select("path", "language", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.array_join(F.slice(c("s"), F.lit(1), n), "/"))).alias("folder"))
    by_language = up.groupBy("folder", "language").agg(F.count("*").alias("n"))
    total = by_language.groupBy("folder").agg(F.sum("n").alias("files"), F.array_sort(F.collect_list(F.struct("language", "n"))).alias("l"))
    return total.select("folder", folder_of("folder").alias("parent"), F.size(F.split("folder", "/")).alias("depth"), "files", F.map_from_entries(F.filter("l", lambda x: x["language"].isNotNull())).alias("languages"))


def capture_source(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, code): the lines of each node's span, clamped; the whole file without a span. files: (path, text)."""
    t = files.select(c("path").alias("file"), F.split("text", "\n").alias("all"))
    start = F.greatest(c("start_line"), F.lit(1)).cast("int")
    code = F.when(c("start_line").isNull(), F.array_join("all", "\n")).otherwise(F.array_join(F.slice("all", start, F.greatest(F.coalesce(c("end_line"), c("start_line")) - start + 1, F.lit(0)).cast("int")), "\n"))
    return nodes.join(t, "file").select("id", code.alias("code"))
