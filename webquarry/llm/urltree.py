"""URL filter: explicit rules first, then a path-template tree judged by labels.

Per host, the paths form a tree of segments.  Going down, segments that vary
become wildcards, and so does all below a node with few rows; going back up, branches whose labels do not differ
significantly from their siblings' are merged into one.  A template is rejected
where its smoothed share of bad labels reaches a threshold.  Everything is
counted over all rows; equal paths are aggregated first, so a hot host moves as
its different paths only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry.llm.common import drop_table
from webquarry.session import durable, new_folder

#: A segment that is a number, with or without an extension, is never a fixed one.
NUMBER = r"^[0-9]+(?:\.[A-Za-z]+)?$"
TAIL = "**"
SALTS = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ``://``."""
    known = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(known, r"(?s)^(?:(?!://).)*+://([^/?#]*)", 1)
    path = F.regexp_extract(known, r"(?s)^(?:(?!://).)*+://[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        name, start = text[:at], text[at:]
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _common_start(least: Column, most: Column) -> Column:
    """How many items the least and the greatest of some arrays, and so all of them, begin with alike."""
    differs = F.array_position(F.zip_with(least, most, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs > 0, differs - 1).otherwise(F.size(least)).cast("int")


def _grow(paths: DataFrame, max_kids: int, min_share: float, min_rows: int) -> DataFrame:
    """Generalise the segments of every path from the top; ``parts`` become ``template``.

    A step reads only the paths that have segments left.  What all paths behind a
    segment have in common is taken along with it, so that steps follow the
    branchings of the tree and not its depth.
    """
    spark, columns = paths.sparkSession, [c for c in paths.columns if c != "parts"]
    none = F.array().cast("array<string>")
    ended = new_folder(spark, "templates")
    rows = durable(paths.select(*columns, none.alias("template"), F.col("parts").alias("rest")))
    while True:
        rows.where(F.size("rest") == 0).drop("rest").write.mode("append").parquet(ended)
        going = rows.where(F.size("rest") > 0)
        if going.isEmpty():
            drop_table(rows)
            return spark.read.schema(rows.drop("rest").schema).parquet(ended)
        going = going.withColumn("segment", F.get("rest", F.lit(0))).withColumn("rest", F.slice("rest", F.lit(2), F.size("rest")))
        kids = going.groupBy("host", "template", "segment").agg(
            F.sum("n").alias("kid_n"), F.min("rest").alias("least"), F.max("rest").alias("most")
        )
        nodes = kids.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("kid_n").alias("node_n"))
        thin = F.col("node_n") < min_rows
        often = (F.col("kids") <= max_kids) | (F.col("kid_n") >= min_share * F.col("node_n"))
        fixed = often & ~F.col("segment").rlike(NUMBER)
        alike = F.when(F.col("kid_n") >= min_rows, _common_start(F.col("least"), F.col("most"))).otherwise(0)
        shared = F.slice("least", F.lit(1), alike)
        named = F.transform(shared, lambda x: F.when(x.rlike(NUMBER), F.lit("*")).otherwise(x))
        steps = (
            kids.join(nodes, ["host", "template"])
            .where(thin | fixed)
            .select(
                "host",
                "template",
                "segment",
                F.when(thin, F.array(F.lit(TAIL))).otherwise(F.concat(F.array("segment"), named)).alias("step"),
                F.when(~thin, F.size(shared)).alias("taken"),
            )
        )
        alone = F.col("step").isNull()
        rest = F.when(alone, F.col("rest")).when(F.col("taken").isNull(), none).otherwise(
            F.slice("rest", F.coalesce("taken", F.lit(0)) + 1, F.size("rest"))
        )
        template = F.concat("template", F.coalesce("step", F.array(F.lit("*"))))
        stepped = going.join(steps, ["host", "template", "segment"], "left").select(*columns, template.alias("template"), rest.alias("rest"))
        before, rows = rows, durable(stepped)
        drop_table(before)


def _with_segment(template: str, level: int, segment: Column) -> Column:
    """A template with another segment at ``level``."""
    return F.transform(template, lambda x, i: F.when(i == level, segment).otherwise(x))


def _branching(templates: DataFrame) -> list[int]:
    """The levels at which some node has two children or more, the deepest first."""
    places = F.transform(
        "template", lambda x, i: F.struct(F.xxhash64(F.slice("template", F.lit(1), i)).alias("above"), x.alias("segment"))
    )
    kids = templates.select("host", F.posexplode(places).alias("level", "at")).groupBy("host", "level", "at.above")
    many = kids.agg(F.min("at.segment").alias("least"), F.max("at.segment").alias("most")).where("least <> most")
    return sorted((r["level"] for r in many.select("level").distinct().collect()), reverse=True)


def _merge(templates: DataFrame, z_limit: float) -> DataFrame:
    """Merge sibling branches from the bottom; adds ``merged``, the template that each one ends in.

    Siblings are ordered by their share of bad labels; a new branch begins where
    two neighbours differ by more than ``z_limit`` standard errors.  Unlabelled
    siblings join the branch of the best known one.  One branch for all is a
    wildcard, otherwise it is named by its members.  After generalisation a node
    has at most ``max_kids + 1 / min_share`` children, which bounds the windows.
    Levels where no node branches have nothing to merge and are passed over; a
    template enters at the first level above its end.
    """
    start = templates.withColumn("merged", F.col("template"))
    deep = F.size("template")
    rows, last = None, None
    for level in _branching(templates):
        entering = start.where(deep > level if last is None else (deep > level) & (deep <= last))
        before, rows = rows, entering if rows is None else rows.union(entering)
        last = level
        own = rows.groupBy("host", "merged").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("bad"))
        own = own.withColumn("wild", _with_segment("merged", level, F.lit("*")))
        own = own.withColumn("name", F.get("merged", F.lit(level))).withColumn("share", F.try_divide("bad", "n"))
        siblings = Window.partitionBy("host", "wild")
        ordered = siblings.orderBy(F.col("share").asc_nulls_last(), "merged")
        n0, bad0 = F.lag("n").over(ordered), F.lag("bad").over(ordered)
        pooled = F.try_divide(F.col("bad") + bad0, F.col("n") + n0)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("n")) + F.try_divide(F.lit(1), n0)))
        gap = F.col("share") - F.try_divide(bad0, n0)
        own = own.withColumn("starts", F.coalesce((gap >= z_limit * error) & (error > 0), F.lit(False)).cast("int"))
        branch = F.when(F.col("n") > 0, F.sum("starts").over(ordered))
        own = own.withColumn("branch", branch)
        best = F.first("branch", ignorenulls=True).over(siblings.orderBy(F.desc("n"), "merged"))
        own = own.withColumn("branch", F.coalesce("branch", best, F.lit(0)))
        names = F.array_join(F.array_sort(F.collect_set("name").over(Window.partitionBy("host", "wild", "branch"))), "|")
        whole = F.max("branch").over(siblings) == 0
        segment = F.when(whole & (F.count("*").over(siblings) > 1), F.lit("*")).otherwise(names)
        moves = own.withColumn("segment", segment).select(
            "host", "merged", _with_segment("merged", level, F.col("segment")).alias("next")
        )
        moved = rows.join(moves, ["host", "merged"], "left").withColumn("merged", F.coalesce("next", "merged"))
        rows = durable(moved.select(*start.columns))
        if before is not None:
            drop_table(before)
    return start if rows is None else rows.union(start.where(deep <= last))


def judge_urls(
    urls: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    bad_col: str | None = "bad",
    max_kids: int = 32,
    min_share: float = 0.02,
    min_rows: int = 10,
    z_limit: float = 1.96,
    prior_rows: float = 10.0,
    reject_share: float = 0.5,
) -> DataFrame:
    """One row per row of ``urls``: ``id, host, path, rule, verdict, template, bad_share``.

    ``bad_col`` holds 1 for a bad and 0 for a good labelled row, null without a
    label.  The verdict is that of the longest fitting rule (an action and
    ``host/path``), else ``block`` where the template's share of bad labels,
    smoothed towards its host's and that towards the whole table's by
    ``prior_rows`` rows each, is at least ``reject_share``, else ``allow``.  A node
    of the tree is divided while ``min_rows`` rows or more go on below it; what is
    left of fewer becomes one wildcard tail, ``**``.  URLs that are null or without
    ``://`` have an empty host and path and form one template.  Very long paths
    are read whole.  Rows stay apart whatever their id; an empty table gives an empty
    result, and other columns are not read.
    """
    host, path = split_url(F.col(url_col).cast("string"))
    bad = F.col(bad_col).cast("int") if bad_col else F.lit(None).cast("int")
    rows = durable(urls.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"), bad.alias("bad")))
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    grown = _grow(paths.withColumn("parts", parts), max_kids, min_share, min_rows)
    templates = grown.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    merged = _merge(durable(templates), z_limit)
    leaves = merged.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("host_n"), F.sum("bad").alias("host_bad"))
    whole = hosts.agg(F.coalesce(F.try_divide(F.sum("host_bad"), F.sum("host_n")), F.lit(0.0)).alias("rate"))
    rate = float(whole.first()["rate"] or 0.0)
    host_rate = (F.col("host_bad") + prior_rows * rate) / (F.col("host_n") + prior_rows)
    shares = leaves.join(hosts, "host").select(
        "host", "merged", ((F.col("bad") + prior_rows * host_rate) / (F.col("labelled") + prior_rows)).alias("bad_share")
    )
    by_template = merged.select("host", "template", "merged").join(shares, ["host", "merged"])
    # A third of all paths may end in one template, so every template is dealt to SALTS tasks.
    salted = grown.select("host", "path", "template", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    dealt = by_template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_path = salted.join(dealt, ["host", "template", "salt"]).drop("template", "salt")
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_share") >= reject_share, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("id", "host", "path").join(by_path, ["host", "path"], "left").select(
        "id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(action, by_method).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"),
        "bad_share",
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, url, bad``: the quality label of the document whose number is the last number in the path."""
    numbered = pages.select("page_id", "url", split_url(F.col("url"))[1].alias("p")).select(
        "page_id", "url", F.regexp_extract("p", r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1).try_cast("long").alias("number")
    )
    marks = labels.groupBy(F.col("doc_id").alias("number")).agg(F.max(1 - F.col("quality")).alias("bad"))
    return numbered.join(marks, "number", "left").select("page_id", "url", "bad")
