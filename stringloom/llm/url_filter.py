"""URL filters: rules first, then a tree of path templates for each host whose purity comes from labelled URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import stash

#: (verdict, rule): a host and the beginning of a path. The longest rule that fits a URL decides.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Standard errors within which the share of blocked URLs of a branch counts as that of its siblings.
ERRORS = 2.0
#: Strength of the prior, its purity for hosts without labels, and the purity from which a template is rejected. What a host's
#: labels say about its unlabelled paths is one observation for each first segment, however many URLs it has.
STRENGTH, PRIOR, REJECT = 4.0, 0.25, 0.7


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end.
    Both are empty for null and for a URL without `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fits(rule: str, host: Column, path: Column) -> Column:
    """A rule fits its host and all subdomains if the path starts with the rule's."""
    domain, slash, rest = rule.partition("/")
    return ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)


def decided(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones the first by name."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        hit = fits(own, host, path)
        rule, verdict = F.when(hit, F.lit(own)).otherwise(rule), F.when(hit, F.lit(what)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Segments of a path, those that vary by their form generalised: numbers, hexadecimal ids, and names that hold a
    number, whose digits become `#`."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    form = lambda x: F.when(x.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("<id>")).otherwise(F.regexp_replace(x, r"[0-9]+", "#"))
    return F.transform(parts, form)


def templates(urls: DataFrame, errors: float = ERRORS) -> DataFrame:
    """(host, parts, template, ...) for each distinct (host, parts) of `urls` (host, parts, n, blocked, allowed: URLs, and
    those labelled). The tree grows from the host down, to the end of every path. Branches of a node merge on evidence only:

    - those with labels become `*` where the share of blocked URLs lies within `errors` standard errors of that of all
      labelled siblings; a branch that differs, or that alone has labels, keeps its name;
    - those without labels become `*`, too, if two labelled branches that did have the same children (depths, first and last
      name), however many branches there are; the others keep their names.

    What all paths of a node begin with is taken at once, so there are as many rounds as places where paths part."""
    nodes = urls.select("*", F.lit("").alias("template"), F.lit(0).alias("level"))
    while True:
        deep = F.size("parts") > F.col("level")
        if nodes.where(deep).isEmpty():
            return nodes.drop("level")
        open_ = nodes.where(deep).select("*", F.slice("parts", F.col("level") + 1, F.size("parts")).alias("rest"))
        ends = open_.groupBy("host", "template").agg(F.min("rest").alias("a"), F.max("rest").alias("b"))
        differs = F.array_position(F.zip_with("a", "b", lambda x, y: ~x.eqNullSafe(y)), True)
        ends = ends.select("host", "template", F.slice("a", 1, F.when(differs == 0, F.size("a")).otherwise(differs - 1).cast("int")).alias("common"))
        # One step: the common beginning where there is one, else the branch's name.
        below = F.get("rest", F.lit(1))
        under = open_.groupBy("host", "template", F.get("rest", F.lit(0)).alias("segment"))
        branches = under.agg(
            F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"),
            F.struct(F.min(F.size("rest")), F.max(F.size("rest")), F.coalesce(F.min(below), F.lit("")), F.coalesce(F.max(below), F.lit(""))).cast("string").alias("shape"),
        )
        whole = branches.groupBy("host", "template").agg(F.sum("blocked").alias("all_blocked"), F.sum("allowed").alias("all_allowed"))
        seen, all_seen = F.col("blocked") + F.col("allowed"), F.col("all_blocked") + F.col("all_allowed")
        rest_seen, rest_blocked = all_seen - seen, F.col("all_blocked") - F.col("blocked")
        pooled = (F.col("all_blocked") + 1) / (all_seen + 2)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(seen, F.lit(1)) + 1 / F.greatest(rest_seen, F.lit(1))))
        apart = F.abs(F.col("blocked") / F.greatest(seen, F.lit(1)) - rest_blocked / F.greatest(rest_seen, F.lit(1)))
        alike = (seen > 0) & (rest_seen > 0) & (apart <= errors * error)
        judged = stash(branches.join(whole, ["host", "template"]).select("host", "template", "segment", "shape", (seen > 0).alias("labelled"), alike.alias("alike")), "branches")
        kin = judged.where("alike").groupBy("host", "template", "shape").agg((F.count("*") > 1).alias("kin"))
        name = F.when(F.col("alike"), "*").when(~F.col("labelled") & F.col("kin"), "*").otherwise(F.col("segment"))
        named = judged.join(kin, ["host", "template", "shape"], "left").join(ends, ["host", "template"]).select("host", "template", "segment", F.when(F.size("common") > 0, F.col("common")).otherwise(F.array(name)).alias("names"))
        nodes = nodes.withColumn("segment", F.when(deep, F.get("parts", F.col("level")))).join(named, ["host", "template", "segment"], "left")
        grown = F.concat("template", F.lit("/"), F.array_join("names", "/"))
        nodes = nodes.select(*urls.columns, F.when(deep, grown).otherwise(F.col("template")).alias("template"), F.when(deep, F.col("level") + F.size("names")).otherwise(F.col("level")).alias("level"))
        nodes = stash(nodes, "nodes")


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template and purity.

    The rule's verdict holds where one fits. The URLs that rules decide are also the labels of the tree: a template's
    purity is the share of blocked URLs among its labelled ones, smoothed towards that of its host: the mean of the shares
    of its labelled first segments, smoothed towards PRIOR. So one blocked branch does not block what lies beside it.
    Templates that reach REJECT are blocked, all others allowed.

    A null URL and one without `://` have empty host and path, fit no rule and are allowed unless that template is
    rejected. Repeated rows and ids give a row each; a null id stays null; a null or empty table is no error; paths of any
    length and depth are read whole; other columns are not carried.

    Rows of a host are never brought together: URLs are first counted by host and form of the path."""
    host, path = host_and_path(F.col("url"))
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), segments(F.col("path")).alias("parts"))
    count = lambda what: F.count(F.when(F.col("ruled") == what, 1))
    forms = rows.groupBy("host", "parts").agg(F.count("*").alias("n"), count("block").alias("blocked"), count("allow").alias("allowed"))
    placed = templates(stash(forms, "forms"))
    by_branch = placed.groupBy("host", F.get("parts", F.lit(0)).alias("first")).agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    share = F.when(F.col("blocked") + F.col("allowed") > 0, F.col("blocked") / (F.col("blocked") + F.col("allowed")))
    by_host = by_branch.groupBy("host").agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("bad"), F.count(share).alias("labelled"))
    host_purity = (F.col("bad") + STRENGTH * PRIOR) / (F.col("labelled") + STRENGTH)
    by_template = placed.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")).join(by_host, "host")
    purity = (F.col("blocked") + STRENGTH * host_purity) / (F.col("blocked") + F.col("allowed") + STRENGTH)
    known = by_template.select("host", "template", purity.alias("purity"))
    found = stash(placed.select("host", "parts", "template").join(known, ["host", "template"]).select("host", "parts", "template", "purity"), "purities")
    return rows.join(found, ["host", "parts"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity"
    )
