"""URL filters by a path-template tree.

Per host, paths are walked a segment at a time. A segment that looks variable (digits, hex, dates), or that fewer than
LEAST_ROWS urls of its branch have, becomes the wildcard `*`; any other stays. What lies below the depth of the tree
is one last segment, its variable parts masked, which stays or becomes `**` alike. Sibling branches that lead to the
same template, and whose labelled rates do not differ by more than chance, are merged into one wildcard. A template is
rejected when its labelled purity, smoothed by the rate of all labels, is high enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stage

#: (host and path, verdict): fixed values; of those that fit a url the longest wins.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: Segments walked one by one, and urls that a literal segment needs.
DEPTH, LEAST_ROWS = 8, 5
#: Labelled urls that a template needs, weight of the overall rate, and purity from which it is rejected.
LEAST_LABELS, PRIOR_WEIGHT, PURITY = 5, 5.0, 0.8
#: Squared deviation, in units of chance, up to which siblings are alike (5 % of alike ones are kept apart).
ALIKE = 3.84

_VARIABLE = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?:\.[A-Za-z0-9]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ://, and the path up to ? or #; both empty where there is none."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule = verdict = None
    for r in sorted(rules, key=len):
        at = r.index("/")
        fits = ((host == r[:at]) | host.endswith("." + r[:at])) & path.startswith(r[at:])
        rule = F.when(fits, F.lit(r)).otherwise(rule if rule is not None else F.lit(None).cast("string"))
        verdict = F.when(fits, F.lit(rules[r])).otherwise(verdict if verdict is not None else F.lit(None).cast("string"))
    return rule, verdict


#: Stands for the slashes of the last segment.
_INNER = "\x1f"


def templates(paths: DataFrame, depth: int = DEPTH, least_rows: int = LEAST_ROWS) -> DataFrame:
    """host, path, template. paths: host, path and n, the number of urls, one row for each pair."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    tail = F.transform(F.slice(parts, depth + 1, 1 << 20), lambda s: F.when(s.rlike(_VARIABLE), "*").otherwise(s))
    steps = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.array_join(tail, _INNER)))).otherwise(parts)
    now = paths.select("host", "path", "n", steps.alias("parts"), F.lit("").alias("template"))
    longest = now.agg(F.max(F.size("parts"))).first()[0] or 0  # depth + 1 at most
    for d in range(longest):
        held = stage(now, f"tree{d}")
        segment = F.element_at("parts", d + 1)
        deep = held.filter(F.size("parts") > d)
        plain = deep.filter(~segment.rlike(_VARIABLE)).groupBy("host", "template", segment.alias("segment")).agg(F.sum("n").alias("own"))
        kept = stage(plain.filter(F.col("own") >= least_rows).select("host", "template", "segment"), f"kept{d}")
        joined = held.withColumn("segment", F.when(F.size("parts") > d, segment)).join(kept.withColumn("literal", F.lit(True)), ["host", "template", "segment"], "left")
        step = F.when(F.size("parts") <= d, "").when(F.col("literal"), F.concat(F.lit("/"), "segment")).otherwise("/*" if d < depth else "/**")
        now = joined.select("host", "path", "n", "parts", F.concat("template", step).alias("template"))
    # a template ends as its paths do: a leaf and a folder of one name stay apart
    end = F.when(F.col("path").endswith("/"), "/").otherwise("")
    return now.select("host", "path", F.concat("template", end).alias("template"))


def merged(counts: DataFrame, alike: float = ALIKE) -> DataFrame:
    """host, template, merged: siblings below one wildcard position that are statistically alike share a template.

    counts: host, template, labelled, bad. Positions are tried from the deepest to the first, each template being
    pooled with those that differ from it there alone.
    """
    now = counts.select("host", "template", F.col("template").alias("merged"), "labelled", "bad")
    deepest = now.agg(F.max(F.size(F.split("template", "/")))).first()[0] or 1  # bounded by the depth of the tree
    for d in range(deepest - 1, 0, -1):
        held = stage(now, f"merge{d}")
        parts = F.split("merged", "/")
        masked = F.when((F.size(parts) > d) & (F.element_at(parts, F.least(F.lit(d + 1), F.size(parts))) != ""), F.array_join(F.concat(F.slice(parts, 1, d), F.array(F.lit("*")), F.slice(parts, d + 2, 1000)), "/"))
        held = held.withColumn("masked", F.coalesce(masked, "merged"))
        pool = held.groupBy("host", "masked").agg(F.count_distinct("merged").alias("siblings"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        own = held.groupBy("host", "merged").agg(F.sum("labelled").alias("own_labelled"), F.sum("bad").alias("own_bad"))
        both = held.join(pool, ["host", "masked"]).join(own, ["host", "merged"])
        rate = F.col("all_bad") / F.greatest("all_labelled", F.lit(1))
        expected = F.col("own_labelled") * rate
        chance = expected * (1 - rate)
        close = (F.col("own_bad") - expected) * (F.col("own_bad") - expected) <= alike * chance
        # a branch without labels shows nothing that sets it apart
        joins = (F.col("siblings") > 1) & ((F.col("own_labelled") == 0) | close)
        now = both.select("host", "template", F.when(joins, F.col("masked")).otherwise(F.col("merged")).alias("merged"), "labelled", "bad")
    return now.select("host", "template", "merged")


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (the rule's, else the method's), template, purity.

    pages: page_id, url; labels: page_id, bad (0 or 1; nulls are left out, of several the largest holds); other
    columns are left out. A url that is null or has no :// has empty host and path, which form a template of their
    own. Rows that repeat each give a row; a null page_id stays null and has no label. Without any labels every
    purity is 0.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad")).dropna().groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = own.join(known, "page_id", "left")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    paths = stage(paths, "paths")
    tree = stage(templates(paths), "templates")
    counted = tree.join(paths, ["host", "path"]).groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    counted = stage(counted, "counted")
    joined = stage(merged(counted), "merged")
    total = counted.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    overall = (total.bad or 0) / (total.labelled or 1)
    pooled = counted.join(joined, ["host", "template"]).groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + PRIOR_WEIGHT * overall) / (F.col("labelled") + PRIOR_WEIGHT)
    # written before the paths of a hot host join it, so that Spark can split them
    verdicts = stage(pooled.select("host", "merged", purity.alias("purity"), ((F.col("labelled") >= LEAST_LABELS) & (purity >= PURITY)).alias("rejected")), "purity")
    by_path = stage(tree.join(joined, ["host", "template"]).join(verdicts, ["host", "merged"]).select("host", "path", F.translate("merged", _INNER, "/").alias("template"), "purity", "rejected"), "verdicts")
    release(paths, tree, counted, joined, verdicts)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = own.join(by_path, ["host", "path"])
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")
