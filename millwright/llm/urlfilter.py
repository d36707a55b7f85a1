"""URL filter by host and path rules, and by a tree of path templates that is learnt from labelled pages.

Paths of a host are merged into templates from the root down. A segment that is a number, a date, a
hexadecimal name or a mixture of letters and digits becomes a typed wildcard at once. At each node the
remaining named branches are compared with the node's own share of bad pages: a branch that differs
significantly keeps its name, all others are statistically alike and are merged into `*`. A template is
rejected if the smoothed share of bad pages among its labelled pages exceeds a threshold; the share is
drawn to the host's, and the host's to that of all labelled pages, so that few labels decide little.

URLs are counted by host and typed path before anything is joined, and the verdicts are joined back with
each such group spread over many tasks, so a host that holds a third of all pages is no hot key.

Cases: a null url, or one without `://`, has an empty host and path; a null label is no label; without
any labelled page nothing is rejected; repeated rows are judged alike and count as often as they occur;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import attach_group, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, between `://` and the next `/`, `?` or `#`; path from there up to `?` or `#`."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], what: str) -> Column:
    """The rule (what: `rule`, its host and path) or its verdict (`verdict`) of the longest rule that fits; else null."""
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.lit(verdict if what == "verdict" else rule_host + rule_path)
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("string") if found is None else found


def typed_path(path: Column) -> Column:
    """The path with typed wildcards for its variable segments, `/` before each segment."""

    def kind(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), F.lit("{date}"))
            .when(s.rlike(r"^\d+$"), F.lit("{num}"))
            .when(s.rlike(r"^\d+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{num}."), F.lower(F.substring_index(s, ".", -1))))
            .when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
            .when(s.rlike(r"\d"), F.lit("{id}"))
            .otherwise(s)
        )

    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    kept = F.transform(segments, kind)
    return F.concat(F.array_join(F.transform(kept, lambda s: F.concat(F.lit("/"), s)), ""), F.when(path.endswith("/") & (F.size(segments) > 0), "/").otherwise(""))


def templates(paths: DataFrame, significance: float = 1.96) -> DataFrame:
    """paths (host, typed, labelled, bad, more) with the column template, level by level.

    Each level adds a segment to the paths that have one. Where none of a node's paths is labelled, or there is one path only
    (which cannot differ from its node with z > 1), all named branches are alike, so such paths get the rest of their
    template at once; there are as many levels as labelled paths share with others. A node or branch may hold most
    paths: it is spread over salts.
    """
    columns = paths.columns
    columns = columns
    paths = materialise(paths.withColumns({"segments": F.filter(F.split("typed", "/"), lambda s: s != ""), "template": F.lit("")}), "paths")
    done, level = [], 0
    while True:
        whole = F.size("segments") <= level
        done.append(paths.filter(whole))
        paths = paths.filter(~whole).withColumn("segment", F.get("segments", F.lit(level)))
        node = {"all_l": (F.sum("labelled"), F.sum), "all_b": (F.sum("bad"), F.sum), "all_n": (F.count("*"), F.sum)}
        paths = materialise(attach_group(paths, ["host", "template"], node, spread_by=["typed"]), "paths")
        rest = F.transform(F.slice("segments", level + 1, F.size("segments")), lambda x: F.when(x.startswith("{"), x).otherwise("*"))
        settled = F.col("all_l") == 0 if significance < 1 else (F.col("all_l") == 0) | (F.col("all_n") == 1)
        alike = paths.filter(settled).withColumn("template", F.concat("template", F.lit("/"), F.array_join(rest, "/")))
        done.append(alike.drop("segment", "all_l", "all_b", "all_n"))
        paths = paths.filter(~settled)
        if paths.isEmpty():
            break
        paths = attach_group(paths, ["host", "template", "segment"], {"l": (F.sum("labelled"), F.sum), "b": (F.sum("bad"), F.sum)}, spread_by=["typed"])
        p = (F.col("all_b") + 1) / (F.col("all_l") + 2)
        z = F.abs(F.col("b") - F.col("l") * p) / F.sqrt(F.greatest(F.col("l"), F.lit(1)) * p * (1 - p))
        keep = F.col("segment").startswith("{") | ((F.col("l") > 0) & (z > significance))
        paths = paths.withColumn("template", F.concat("template", F.lit("/"), F.when(keep, F.col("segment")).otherwise("*")))
        paths, level = materialise(paths.drop("segment", "all_l", "all_b", "all_n", "l", "b"), "paths"), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*columns, "template")


def judge_urls(
    pages: DataFrame, bad: Column, rules: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url",
    weight: float = 8.0, threshold: float = 0.5, significance: float = 1.96,
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row for each row of pages.

    bad: true, false or null (no label), over the columns of pages; rules: (verdict, host, path);
    weight: labels that a parent's share counts for; threshold: a template whose smoothed share of bad
    pages exceeds it is blocked.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.monotonically_increasing_id().alias("row"), host.alias("host"), path.alias("path"), bad.alias("is_bad"))
    rows = materialise(rows.withColumn("typed", typed_path(F.col("path"))), "urls")
    labelled, total = rows.agg(F.count("is_bad"), F.count_if("is_bad")).first()
    prior = (total + 1) / (labelled + 2)

    def purity(groups: DataFrame) -> DataFrame:
        found = templates(groups, significance)
        found = attach_group(found, ["host"], {"hl": (F.sum("labelled"), F.sum), "hb": (F.sum("bad"), F.sum)}, spread_by=["typed"])
        found = attach_group(found, ["host", "template"], {"tl": (F.sum("labelled"), F.sum), "tb": (F.sum("bad"), F.sum)}, spread_by=["typed"])
        host_share = (F.col("hb") + weight * prior) / (F.col("hl") + weight)
        share = (F.col("tb") + weight * host_share) / (F.col("tl") + weight)
        found = found.withColumn("purity", 1 - share).withColumn("reject", share > threshold)
        return found.drop("labelled", "bad", "hl", "hb", "tl", "tb")

    counts = {"labelled": (F.count("is_bad"), F.sum), "bad": (F.count_if("is_bad"), F.sum)}
    out = attach_group(rows, ["host", "typed"], counts, spread_by=["row"], extend=purity)
    learnt = F.when(F.col("reject") & F.lit(labelled > 0), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules, "rule").alias("rule"),
        F.coalesce(rule_for(F.col("host"), F.col("path"), rules, "verdict"), learnt).alias("verdict"), "template", "purity",
    )


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path: bad if toxic or of low quality."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    number = F.expr(r"try_cast(regexp_extract(url, '/(\\d{1,18})(?:\\.[a-z]+)?/?(?:[?#].*)?$', 1) as bigint)")
    joined = pages.join(labels, number == F.col("doc_id"), "left")
    return judge_urls(joined, F.col("bad"), RULES)


QUERIES = {"op2_urlfilter": op2_urlfilter}
ORACLE_SQL: dict[str, str] = {}
