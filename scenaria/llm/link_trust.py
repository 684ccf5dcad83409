"""URL filter: listed rules, and link-graph propagation for the rest.

A rule (host, path, verdict) fits a url whose host is the rule's or one of its subdomains and whose path starts with the
rule's; the longest rule (host and path together) wins. A url without a rule gets its host's verdict:

* seeds: a host's trust seed is the share of its urls that allow rules decide, its distrust seed the share under block
  rules that hold for a whole host (path ``/``); a block rule for one path says nothing about the others;
* trust flows along links (personalised PageRank from the trust seeds), distrust against them (from the distrust seeds:
  who links to blocked hosts is suspect). Scores are in units of a seed: an isolated seed of 1 scores 1;
* a host is blocked when its distrust exceeds its trust by more than ``threshold``.

Links are the absolute references of the pages' anchors to other hosts, counted once for each pair of hosts and page.
Propagation runs ``rounds`` times at most and stops when no score moves by ``epsilon``.

A null url, or one without ``://``, has an empty host and path, no rule and no links. Null html has no links.
Repeated pages count each. Rules with equal host and path: block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria.llm.common import store

#: The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LINK = r"(?i)<a\b[^<>]*?\bhref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>\\]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules of it and of its parent domains."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (hosts.select("host", F.explode(parents).alias("rule_host")).join(rules.withColumnRenamed("host", "rule_host"), "rule_host")
            .groupBy("host").agg(F.collect_set(F.struct("rule_host", "path", "verdict")).alias("rules")))


def chosen_rule(rules: Column, path: Column) -> Column:
    """The longest of a host's rules that fits the path, block first among equals; null without one."""
    fits = F.filter(rules, lambda r: path.startswith(r["path"]))
    best = F.array_sort(F.transform(fits, lambda r: F.struct((-(F.length(r["rule_host"]) + F.length(r["path"]))).alias("n"),
                                                            F.when(r["verdict"] == "block", 0).otherwise(1).alias("o"),
                                                            r["rule_host"].alias("rule_host"), r["path"].alias("path"), r["verdict"].alias("verdict"))))
    return F.get(best, F.lit(0))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, epsilon: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and edges (src, dst, n), n links from src to dst."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    # one table of flows: trust from src to dst by the share of src's links, distrust from dst to src by the share of dst's
    flows = store(edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
                  .unionByName(edges.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("total")).alias("d"))),
                  "trust-flows")
    seeds = store(seeds, "trust-seeds")
    scores = seeds
    if flows.isEmpty():
        return scores
    for k in range(rounds):
        inflow = (flows.join(scores, "host").groupBy(F.col("to").alias("host"))
                  .agg(F.sum(F.col("t") * F.col("trust")).alias("it"), F.sum(F.col("d") * F.col("distrust")).alias("id")))
        was = scores.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        new = (seeds.join(inflow, "host", "left").join(was, "host")
               .select("host", (F.col("trust") + damping * F.coalesce("it", F.lit(0.0))).alias("trust"),
                       (F.col("distrust") + damping * F.coalesce("id", F.lit(0.0))).alias("distrust"), "t0", "d0"))
        new = store(new, f"trust-{k}")
        scores = new.select("host", "trust", "distrust")
        moved = new.agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t0")), F.abs(F.col("distrust") - F.col("d0"))))).first()[0]
        if moved is None or moved < epsilon:
            break
    return scores


def judged_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, threshold: float = 0.5, damping: float = 0.85,
                rounds: int = 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    links = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda x: lower_ascii(F.regexp_replace(x, r"^.*@", "")))
    edges = store(pages.select(host.alias("src"), F.explode(F.array_distinct(links)).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
                  .groupBy("src", "dst").agg(F.count("*").alias("n")), "trust-edges")
    # host and path pairs are counted before anything is joined to them; a host may hold any share of the pages
    counted = store(base.groupBy("host").agg(F.count("*").alias("n")), "trust-hosts")
    hosts = counted.select("host").union(edges.select("dst")).distinct()
    ruled = store(rules_of_hosts(hosts, rules), "trust-rules")
    at = F.when(F.col("path") == "", "/").otherwise(F.col("path"))  # for seeds, a url without a path stands for the host's root
    decided = (base.join(ruled, "host").withColumn("r", chosen_rule(F.col("rules"), at)).groupBy("host")
               .agg(F.count(F.when(F.col("r.verdict") == "allow", 1)).alias("allowed"),
                    F.count(F.when((F.col("r.verdict") == "block") & (F.col("r.path") == "/"), 1)).alias("blocked")))
    # a host known from links only has the seeds of the rules for whole hosts
    whole = ruled.select("host", chosen_rule(F.col("rules"), F.lit("/"))["verdict"].alias("whole"))
    seeds = (hosts.join(counted, "host", "left").join(decided, "host", "left").join(whole, "host", "left")
             .select("host", F.coalesce(F.col("allowed") / F.col("n"), (F.col("whole") == "allow").cast("double"), F.lit(0.0)).alias("trust"),
                     F.coalesce(F.col("blocked") / F.col("n"), (F.col("whole") == "block").cast("double"), F.lit(0.0)).alias("distrust")))
    scores = propagate(seeds, edges, damping, rounds)
    of_host = store(scores.join(ruled, "host", "left"), "trust-scores")
    rule = chosen_rule(F.col("rules"), F.col("path"))
    return (base.join(of_host, "host", "left").withColumn("r", rule)
            .select("page_id", "host", "path", F.concat("r.rule_host", "r.path").alias("rule"),
                    F.coalesce("r.verdict", F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")).alias("verdict"),
                    "trust", "distrust"))
