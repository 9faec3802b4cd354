"""robots.txt corpora as rule tables, and access decisions as joins on the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry.functions.expr import explode_items, trim_wide
from webquarry.functions.urls import host_with_port, pathname, search
from webquarry.operators.skew import join_one_per_key
from webquarry.session import drop_durable, durable


def robots_lines(robots: DataFrame) -> DataFrame:
    """Directives of ``host, text`` with the group each belongs to.

    Consecutive user-agent lines open one group; any other directive ends that
    run.  Group 0 collects rules that come before every agent and stands for
    all agents.  The window covers one host's file, which is small.
    """
    lines = explode_items(
        robots.select("host", F.split("text", r"\r?\n").alias("lines")), ["host"], "lines", "line", "raw"
    )
    line = trim_wide(F.substring_index("raw", "#", 1))
    directives = (
        lines.withColumn("text", line)
        .where(F.instr("text", ":") > 0)
        .select(
            "host",
            "line",
            F.lower(trim_wide(F.substring_index("text", ":", 1))).alias("field"),
            trim_wide(F.substr("text", F.instr("text", ":") + 1)).alias("value"),
        )
    )
    order = Window.partitionBy("host").orderBy("line")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))
    return directives.withColumn("opens", opens.cast("int")).withColumn(
        "group_no", F.sum("opens").over(order).cast("int")
    ).drop("opens")


def robots_rules(lines: DataFrame) -> DataFrame:
    """Rules ``host, group_no, line, allow, path``; an empty allow is no rule."""
    return lines.where(
        (F.col("field") == "disallow") | ((F.col("field") == "allow") & (F.col("value") != ""))
    ).select(
        "host", "group_no", "line", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path")
    )


def robots_sitemaps(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("field") == "sitemap").select("host", "line", F.col("value").alias("url"))


def robots_groups(lines: DataFrame, agent: str) -> DataFrame:
    """The one group each host gives us: ``host, group_no, crawl_delay, rules``.

    The longest agent token contained in ours wins, then the first ``*`` group.
    An empty token is contained in every name and beats ``*``.
    """
    ours = F.lit(agent.lower())
    token = F.lower("value")
    candidates = lines.where(F.col("field") == "user-agent").where(
        (token == "*") | F.contains(ours, token)
    ).select(
        "host",
        "group_no",
        F.struct(
            F.when(token == "*", 1).otherwise(-F.length(token)).alias("rank"),
            F.col("line").alias("line"),
        ).alias("key"),
    )
    implicit = lines.where(
        (F.col("group_no") == 0) & F.col("field").isin("allow", "disallow", "crawl-delay")
    ).select(
        "host", "group_no", F.struct(F.lit(1).alias("rank"), F.lit(-1).alias("line")).alias("key")
    )
    chosen = (
        candidates.unionByName(implicit)
        .groupBy("host")
        .agg(F.min_by("group_no", "key").alias("group_no"))
    )
    number = F.expr(
        r"try_cast(regexp_extract(value, '\\A([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) as double)"
    )
    is_rule = (F.col("field") == "disallow") | ((F.col("field") == "allow") & (F.col("value") != ""))
    per_group = lines.groupBy("host", "group_no").agg(
        F.max_by(number, F.when((F.col("field") == "crawl-delay") & number.isNotNull(), F.col("line"))).alias(
            "crawl_delay"
        ),
        F.array_sort(
            F.collect_list(
                F.when(
                    is_rule,
                    F.struct(
                        F.col("line"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("path")
                    ),
                )
            )
        ).alias("rules"),
    )
    return chosen.join(per_group, ["host", "group_no"])


#: Hosts with more rules than this have them looked up by prefix instead of carried along as an array.
INLINE_RULES = 64
RULE = "struct<length:int, line:int, allow:boolean, head:string, middle:array<string>, tail:string, whole:boolean>"


def compiled_rule(rule: Column) -> Column:
    """A rule ``line, allow, path`` taken apart at its wildcards.

    ``*`` is any run of characters and a final ``$`` the end.  What a URL must begin with is the
    ``head``; the ``middle`` pieces follow in order, and a rule that ends with ``$`` has a ``tail``, or is the ``whole`` target
    where it has no wildcard.
    """
    path = rule["path"]
    anchored = F.endswith(path, F.lit("$"))
    body = F.when(anchored, F.substr(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    pieces = F.split(body, r"\*")
    last = F.when(anchored, F.size(pieces) - 1).otherwise(F.size(pieces))
    middle = F.filter(F.slice(pieces, F.lit(2), F.greatest(last - 1, F.lit(0))), lambda x: x != "")
    return F.struct(
        F.length(path).alias("length"),
        rule["line"].alias("line"),
        rule["allow"].alias("allow"),
        F.element_at(pieces, 1).alias("head"),
        middle.alias("middle"),
        F.when(anchored & (F.size(pieces) > 1), F.element_at(pieces, -1)).alias("tail"),
        (anchored & (F.size(pieces) == 1)).alias("whole"),
    ).cast(RULE)


def rule_matches(target: Column, rule: Column) -> Column:
    """Whether a compiled rule fits; its pieces are located one behind the other, the earliest place first."""

    def behind(at: Column, piece: Column) -> Column:
        # Null once a piece is missing: nothing is located from an unknown place on.
        return F.nullif(F.call_function("locate", piece, target, at), F.lit(0)) + F.length(piece)

    end = F.aggregate(rule["middle"], F.length(rule["head"]) + 1, behind)
    tail = rule["tail"]
    ends = F.endswith(target, tail) & (F.length(target) - F.length(tail) + 1 >= end)
    rest = F.when(F.size(rule["middle"]) > 0, end.isNotNull()).otherwise(F.lit(True)) & F.when(tail.isNull(), True).otherwise(F.coalesce(ends, F.lit(False)))
    return F.startswith(target, rule["head"]) & F.when(rule["whole"], target == rule["head"]).otherwise(rest)


def verdict_of(rule: Column) -> Column:
    """What ranks matching rules: the longest decides, the first of equals."""
    return F.struct(rule["length"].alias("length"), (-rule["line"]).alias("first"), rule["allow"].alias("allow"))


class RobotsIndex:
    """Rules ready to be matched, written once and used for any number of URL tables.

    ``few`` has a row per host with its rules as an array, for hosts of up to ``inline_rules``.  The rules of larger
    hosts are rows of ``many``, found by what a URL must begin with; ``lengths`` has the lengths such beginnings have on a host.
    """

    def __init__(self, groups: DataFrame, inline_rules: int = INLINE_RULES):
        # An empty path is no rule.
        rules = F.transform(F.filter("rules", lambda r: r["path"] != ""), compiled_rule)
        self.hosts = hosts = durable(groups.select("host", rules.alias("rules")))
        self.few = hosts.where(F.size("rules") <= inline_rules)
        large = hosts.where(F.size("rules") > inline_rules)
        self.has_many = not large.isEmpty()
        if self.has_many:
            self.many = durable(large.select("host", F.explode("rules").alias("rule")).select("host", F.col("rule.head").alias("head"), "rule"))
            heads = large.select("host", F.array_distinct(F.transform("rules", lambda r: F.length(r["head"]))).alias("lengths"))
            self.lengths = durable(heads)

    def drop(self) -> None:
        """Delete the tables; what was decided with them must be stored by then."""
        for table in [self.hosts, *([self.many, self.lengths] if self.has_many else [])]:
            drop_durable(table)


def robots_index(groups: DataFrame, inline_rules: int = INLINE_RULES) -> RobotsIndex:
    return RobotsIndex(groups, inline_rules)


def _looked_up(hosted: DataFrame, index: RobotsIndex) -> DataFrame:
    """``url, found`` of the URLs on large hosts that some rule fits.

    A URL meets the rules that begin as it does, through a join by equality on host and beginning; it costs the
    beginnings that occur as rule lengths, however many rules the host has.
    """
    targets = hosted.select("url", "host", "target").distinct()
    cut = join_one_per_key(targets, index.lengths, "host", how="inner").select(
        "url", "host", "target", F.explode(F.filter("lengths", lambda n: n <= F.length("target"))).alias("n")
    )
    beginnings = cut.withColumn("head", F.substr(F.col("target"), F.lit(1), F.col("n"))).drop("n")
    met = beginnings.join(index.many, ["host", "head"]).where(rule_matches(F.col("target"), F.col("rule")))
    return met.groupBy("url").agg(F.max(verdict_of(F.col("rule"))).alias("looked_up"))


def robots_allowed(urls: DataFrame, groups: DataFrame | RobotsIndex, respect: bool = True) -> DataFrame:
    """Add ``allowed`` to a table with canonical ``url``.

    Few rules travel as one row per host, so the join adds one small array to each
    URL; many are looked up by prefix.  A host holding a third of all URLs is split when the joins run.
    """
    if not respect:
        return urls.withColumn("allowed", F.lit(True))
    index = groups if isinstance(groups, RobotsIndex) else robots_index(groups)
    url = F.col("url")
    hosted = urls.withColumn("host", host_with_port(url)).withColumn("target", F.concat(pathname(url), search(url)))
    joined = join_one_per_key(hosted, index.few, "host")
    fitting = F.filter("rules", lambda r: rule_matches(F.col("target"), r))
    joined = joined.withColumn("found", F.array_max(F.transform(fitting, verdict_of)))
    if index.has_many:
        joined = join_one_per_key(joined, _looked_up(hosted, index), "url").withColumn("found", F.coalesce("found", "looked_up"))
    return joined.withColumn("allowed", F.coalesce("found.allow", F.lit(True))).select(*urls.columns, "allowed")


def host_delay(hosts: DataFrame, groups: DataFrame, base_ms: int) -> DataFrame:
    """Milliseconds between requests per host: the larger of ours and robots.txt's."""
    robots_ms = F.coalesce(F.col("crawl_delay") * 1000, F.lit(0.0))
    return (
        hosts.select("host")
        .distinct()
        .join(groups.select("host", "crawl_delay"), "host", "left")
        .select("host", F.greatest(F.lit(float(base_ms)), robots_ms).alias("delay_ms"))
    )

