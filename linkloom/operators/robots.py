"""Robots rules: parse texts, pick the group of an agent, test URLs.

Precedence follows RFC 9309: the longest matching rule decides, allow wins a
tie, ``*`` matches any run of characters, a final ``$`` anchors the end. Rules
of a host become one array on one row, so testing keeps one row per URL
whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.urls import decoded, parsable, url_hostname, url_path
from linkloom.operators.dedup import first_per_key
from linkloom.operators.rows import per_element


def parse_robots(texts: DataFrame, agent: str, max_bytes: int | None = None) -> DataFrame:
    """Rules that apply to ``agent``, from rows ``(domain, status_code, body)``.

    Gives ``(domain, agent, pos, allow, path, crawl_delay)``: the group whose
    name is the longest prefix of the agent name, else ``*``. Hosts with a
    status other than 200 or without such a group give no rows; a group
    without rules gives one row with a NULL path. Texts are read whole; with
    ``max_bytes`` a longer one counts as not fetched.
    """
    usable = texts.filter(F.col("status_code") == 200)
    if max_bytes is not None:
        usable = usable.filter(F.octet_length("body") <= max_bytes)
    one_text = first_per_key(usable.select(F.lower("domain").alias("domain"), "body"), ["domain"], ["body"])
    raw = per_element(one_text, ["domain"], F.split("body", r"\r\n|\r|\n"), "line", "pos")
    text = F.regexp_replace("line", r"#.*$", "")
    lines = raw.select(
        "domain",
        "pos",
        F.lower(F.trim(F.regexp_extract(text, r"^\s*([^:]*):", 1))).alias("field"),
        F.regexp_extract(text, r"^[^:]*:\s*(.*?)\s*$", 1).alias("value"),
    ).filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))

    in_order = Window.partitionBy("domain").orderBy("pos")
    names_agent = F.col("field") == "user-agent"
    opens = names_agent & F.coalesce(F.lag("field").over(in_order) != "user-agent", F.lit(True))
    name = F.lower("value")
    fit = F.when(names_agent & (name == "*"), 0).when(
        names_agent & (name != "") & F.startswith(F.lit(agent.lower()), name), F.length(name)
    )
    grouped = lines.withColumn("group", F.sum(opens.cast("int")).over(in_order)).withColumn("fit", fit)
    best = grouped.withColumn("best", F.max("fit").over(Window.partitionBy("domain")))
    chosen = best.withColumn(
        "chosen", F.max(F.col("fit") == F.col("best")).over(Window.partitionBy("domain", "group"))
    ).filter("chosen AND group > 0")

    per_host = Window.partitionBy("domain")
    delay = F.expr("try_cast(value AS DOUBLE)")
    rule = F.col("field").isin("allow", "disallow") & (F.col("value") != "")
    out = chosen.select(
        "domain",
        F.max(F.when(F.col("fit") == F.col("best"), name)).over(per_host).alias("agent"),
        "pos",
        (F.col("field") == "allow").alias("allow"),
        F.when(rule, F.col("value")).alias("path"),
        F.coalesce(
            F.max_by(F.when(F.col("field") == "crawl-delay", delay), F.when(F.col("field") == "crawl-delay", F.col("pos")))
            .over(per_host),
            F.lit(0.0),
        ).alias("crawl_delay"),
        F.sum(rule.cast("int")).over(per_host).alias("_rules"),
        F.min("pos").over(per_host).alias("_first"),
    )
    # A host without rules keeps one row, for its crawl delay.
    kept = out.filter("path IS NOT NULL OR (_rules = 0 AND pos = _first)")
    return kept.drop("_rules", "_first")


def rules_by_host(rules: DataFrame) -> DataFrame:
    """One row per host: its rules as an array (bounded by the robots text) and its crawl delay."""
    path = F.col("path")
    open_ended = F.when(F.endswith(path, F.lit("$")), F.expr("substr(path, 1, length(path) - 1)")).otherwise(
        F.concat(path, F.lit("*"))
    )
    pieces = F.transform(F.split(open_ended, r"\*"), decoded)
    rule = F.when(path.isNotNull(), F.struct(F.length(path).alias("len"), "allow", pieces.alias("pieces")))
    return rules.groupBy("domain").agg(
        F.collect_list(rule).alias("rules"), F.max("crawl_delay").alias("crawl_delay")
    )


def _decision(rules: str, path: str) -> Column:
    """The allow flag of the longest rule matching the path; NULL when none matches."""
    first, last = "element_at(r.pieces, 1)", "element_at(r.pieces, -1)"
    # Pieces between the first and the last are located left to right; 0 marks a miss.
    reached = (
        f"aggregate(slice(r.pieces, 2, greatest(size(r.pieces) - 2, 0)), length({first}) + 1, (at, piece) -> "
        f"CASE WHEN at = 0 OR piece = '' THEN at WHEN locate(piece, {path}, at) = 0 THEN 0 "
        f"ELSE locate(piece, {path}, at) + length(piece) END)"
    )
    matches = (
        f"CASE WHEN size(r.pieces) = 1 THEN {path} = {first} ELSE startswith({path}, {first}) "
        f"AND endswith({path}, {last}) AND {reached} BETWEEN 1 AND length({path}) - length({last}) + 1 END"
    )
    return F.expr(
        f"array_max(transform(filter({rules}, r -> {matches}), r -> named_struct('len', r.len, 'allow', r.allow))).allow"
    )


def check_urls(urls: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed`` and ``crawl_delay`` to rows with a URL; a malformed one, no host, no rules or no match means allowed.

    The join has no hint: Spark broadcasts the host table only while its
    measured size allows it. Otherwise adaptive execution splits a hot host,
    which it can only do when both sides come straight from a shuffle; joining
    on a computed host, not the grouping column of the table, sees to that.
    """
    hosts = hosts.select(F.lower("domain").alias("_host"), "rules", "crawl_delay")
    host = F.when(parsable(url), F.lower(url_hostname(F.col(url))))
    keyed = urls.withColumn("_host", host).withColumn("_path", url_path(F.col(url)))
    joined = keyed.join(hosts, "_host", "left")
    return joined.select(
        *urls.columns,
        F.coalesce(_decision("rules", "_path"), F.lit(True)).alias("allowed"),
        F.coalesce("crawl_delay", F.lit(0.0)).alias("crawl_delay"),
    )
