"""Judges urls by rules and by a tree of path templates, with DataFrame functions alone.

For each host the paths form a tree. From the root on, segments that vary without bound become wildcards, and sibling
branches that look alike and whose labelled shares do not differ more than chance explains are merged. What remains of
a path is its template; templates whose smoothed share of bad labels is high are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are put into the plan as they are, at most; more are joined.
INLINE_RULES = 200


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and without ``://``."""
    return F.translate(F.regexp_extract(_after(url), r"\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def with_rules(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Adds rule string and rule_action string: the longest rule (verdict, ``host/path``) that fits, or null.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of equally long ones that with the
    longer host wins, then block. A DataFrame of (verdict, rule) is joined by host suffix: one row for each label.
    """
    if isinstance(rules, list) and len(rules) <= INLINE_RULES:
        best = F.lit(None).cast("struct<verdict:string,rule:string>")
        for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].split("/")[0]), r[0] == "block")):
            host, slash, path = rule.partition("/")
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
            best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(best)
        return pages.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "rule_action": F.col("_best.verdict")}).drop("_best")
    if isinstance(rules, list):
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, rule string")
    at = F.instr("rule", "/")
    known = rules.select("verdict", "rule", F.when(at > 0, F.substring("rule", F.lit(1), at - 1)).otherwise(F.col("rule")).alias("suffix"), F.when(at > 0, F.substring(F.col("rule"), at, F.length("rule"))).otherwise(F.lit("")).alias("start"))
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (
        urls.withColumn("suffix", F.explode(suffixes))
        .join(known, "suffix")
        .where(F.col("path").startswith(F.col("start")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.length("suffix").alias("m"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_action"))
    )
    return pages.join(found, ["host", "path"], "left")


def segments(path: Column) -> Column:
    """All segments of a path; a closing slash is an empty segment."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, r"\A/", ""), "/"))


def shape(segment: Column) -> Column:
    """Runs of digits as 9, of hexadecimal digits with a digit among them as 9, of letters as a."""
    return F.regexp_replace(F.regexp_replace(segment, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{6,}\b|[0-9]+", "9"), r"\p{L}+", "a")


def templates(urls: DataFrame, fan_out: int = 20, per_branch: float = 3.0, z: float = 1.96) -> DataFrame:
    """The template of each row of ``urls`` (host, path, n, labelled, bad; a row for each distinct url).

    Level by level a segment becomes ``*`` if its node has ``fan_out`` branches or more with fewer than ``per_branch``
    urls on average, and ``*shape`` if siblings of its shape, with like shapes behind them, exist and its share of bad
    labels is within ``z`` standard errors of theirs; else it stays. A level is a sum by branch, joined back by
    (host, prefix, segment); a host with a third of the urls is spread over its segments, and Spark splits hot ones.

    Where a node has one branch its segment stays, so the node's urls go on at once to where two of them differ, however many
    segments that is; a url alone ends there. So there are as many levels as a path has forks, not segments, and each takes
    on only the urls that go on. Each level is a written table; those that ended are read from all of them at once.
    """
    node, paths = ["host", "prefix"], []
    rows = urls.withColumns({"segs": segments(F.col("path")), "prefix": F.lit("")})
    while True:
        paths.append(written(rows, "url-tree"))
        rows = urls.sparkSession.read.schema(rows.schema).parquet(paths[-1])
        here = rows.where(F.size("segs") > 0).withColumns({"seg": F.get("segs", F.lit(0)), "behind": shape(F.array_join(F.slice("segs", F.lit(2), F.size("segs")), "/"))})
        branches = here.groupBy("host", "prefix", "seg").agg(F.count(F.lit(1)).alias("urls"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.min("behind").alias("low"), F.max("behind").alias("high")).withColumn("shape", shape(F.col("seg")))
        branches = stored(branches, "url-branches")
        if branches.isEmpty():
            break
        nodes = branches.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("fan"), F.sum("urls").alias("node_urls"))
        alike = branches.groupBy("host", "prefix", "shape", "low", "high").agg(F.count(F.lit(1)).alias("members"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        pooled = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
        off = F.abs(F.col("bad") - F.col("labelled") * pooled) / F.sqrt(pooled * (1 - pooled) * F.greatest("labelled", F.lit(1)))
        token = (
            F.when((F.col("fan") >= fan_out) & (F.col("node_urls") < per_branch * F.col("fan")), F.lit("*"))
            .when((F.col("members") > 1) & (off <= z), F.concat(F.lit("*"), F.col("shape")))
            .otherwise(F.col("seg"))
        )
        chosen = branches.join(nodes, node).join(alike, ["host", "prefix", "shape", "low", "high"]).select("host", "prefix", "seg", token.alias("token"), "fan")
        met = stored(here.drop("behind").join(chosen, ["host", "prefix", "seg"], "left"), "url-tokens")
        forks = met.where("fan > 1").withColumns({"prefix": F.concat_ws("/", "prefix", "token"), "segs": F.slice("segs", F.lit(2), F.size("segs"))})
        rows = forks.select(*rows.columns).unionByName(_to_the_fork(met.where("fan = 1").select(*rows.columns)))
    return urls.sparkSession.read.schema(rows.schema).parquet(*paths).where(F.size("segs") == 0).withColumnRenamed("prefix", "template").drop("segs")


def _to_the_fork(rows: DataFrame) -> DataFrame:
    """Rows of nodes with one branch, moved on over all segments that the node's urls have in common. A node's urls are compared with
    its greatest; one that it begins with ends on the way, and none goes on where no two differ."""
    node = ["host", "prefix"]
    greatest = rows.groupBy(*node).agg(F.max("segs").alias("greatest"))
    compared = rows.join(greatest, node)
    at = F.array_position(F.zip_with("segs", "greatest", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    differs = F.when((at > 0) & (at <= F.size("segs")), at - 1)
    compared = compared.withColumn("differs", differs).drop("greatest")
    first = compared.groupBy(*node).agg(F.min("differs").alias("fork"))
    taken = F.coalesce(F.least(F.col("fork"), F.size("segs")), F.size("segs")).cast("int")
    moved = compared.join(first, node).withColumn("taken", taken)
    prefix = F.concat_ws("/", "prefix", F.array_join(F.slice("segs", F.lit(1), F.col("taken")), "/"))
    return moved.withColumns({"prefix": prefix, "segs": F.slice("segs", F.col("taken") + 1, F.size("segs"))}).select(*rows.columns)


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] | DataFrame, least_labels: int = 5, purity: float = 0.6, smoothing: float = 4.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_share) of every row of ``pages`` (page_id, url).

    labels: (page_id, bad 0/1); several rows for a page count once, as bad if one is. A template is rejected if it has
    ``least_labels`` labels or more and the share of bad ones, smoothed towards its host's share (and that towards the
    share of all) with the weight of ``smoothing`` labels, reaches ``purity``. The verdict is the rule's, else block for
    rejected templates and allow for all others. A null url, or one without ``://``, has an empty host and path and is
    judged as such. Repeated rows each get a row; a null page_id has no label; other columns are ignored.
    """
    flat = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    flat = stored(flat.join(marks, "page_id", "left"), "urls")
    urls = flat.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = stored(templates(urls), "templates")
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    total = tree.agg(((F.sum("bad") + 1) / (F.sum("labelled") + 2)).alias("share")).first()["share"]
    prior = (F.col("h_bad") + smoothing * F.lit(total if total is not None else 0.5)) / (F.col("h_labelled") + smoothing)
    share = (F.col("bad") + smoothing * prior) / (F.col("labelled") + smoothing)
    judged = sums.join(hosts, "host").select("host", "template", share.alias("bad_share"), ((F.col("labelled") >= least_labels) & (share >= purity)).alias("rejected"))
    verdicts = tree.select("host", "path", "template").join(judged, ["host", "template"])
    out = with_rules(flat.select("page_id", "host", "path"), rules).join(verdicts, ["host", "path"], "left")
    verdict = F.coalesce("rule_action", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "bad_share")
