"""Match graph of each date: nodes, links, measures, metrics and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdiff.operators.groups import MATCHED_TYPES
from corpusdiff.operators.grouping import connected_components
from corpusdiff.session import cut_lineage

METRICS = ("nodes", "links", "left_nodes", "right_nodes", "matched_nodes", "isolated_nodes", "matched_groups")


def is_matched_type(match_type: Column) -> Column:
    return match_type.isin(*MATCHED_TYPES)


def node_id(side: str | Column, article: str | Column) -> Column:
    return F.concat_ws(":", side, article)


def graph_nodes(articles: DataFrame, members: DataFrame) -> DataFrame:
    """One node per article of an issue or of a group; the issue's row wins."""
    known = articles.select("issue_date", "side", F.col("id").alias("article_id"), "page_number", "title", F.lit(0).alias("prio"))
    extra = members.select(
        "issue_date", "side", "article_id", F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("string").alias("title"), F.lit(1).alias("prio"),
    )
    first = Window.partitionBy("issue_date", "side", "article_id").orderBy("prio")
    return (
        known.unionByName(extra).withColumn("n_", F.row_number().over(first)).filter("n_ = 1").drop("n_", "prio")
        .withColumn("node_id", node_id("side", "article_id"))
    )


def group_cross_pairs(groups: DataFrame) -> DataFrame:
    """Left × right members of each matched group, at most four pairs by the group bounds."""
    matched = groups.filter(is_matched_type(F.col("match_type")))
    return matched.select(
        "issue_date", "group_id", "confidence", "shared_terms", F.explode("left_articles").alias("l_article"), "right_articles"
    ).select("issue_date", "group_id", "confidence", "shared_terms", "l_article", F.explode("right_articles").alias("r_article"))


def graph_links(cross_pairs: DataFrame) -> DataFrame:
    """One link per article pair; weight counts the groups that hold it."""
    finite = F.when(F.col("confidence").isNull() | F.isnan("confidence"), F.lit(0.0)).otherwise(F.col("confidence"))
    pairs = cross_pairs.withColumn("c_", finite)
    return pairs.groupBy("issue_date", "l_article", "r_article").agg(
        F.count("*").alias("weight"),
        F.avg("c_").alias("confidence"),
        F.min("c_").alias("confidence_min"),
        F.max("c_").alias("confidence_max"),
        F.array_sort(F.collect_set("group_id")).alias("group_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("shared_terms")))).alias("shared_terms"),
    ).withColumns({"source": node_id(F.lit("left"), "l_article"), "target": node_id(F.lit("right"), "r_article")})


def valid_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("issue_date", "node_id")
    return links.join(ids.withColumnRenamed("node_id", "source"), ["issue_date", "source"], "left_semi").join(
        ids.withColumnRenamed("node_id", "target"), ["issue_date", "target"], "left_semi"
    )


def node_measures(nodes: DataFrame, links: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Weighted degree, number of distinct neighbours, isolation, and group ids of each node."""
    ends = links.select("issue_date", F.col("source").alias("node_id"), F.col("target").alias("other"), "weight").union(
        links.select("issue_date", "target", "source", "weight")
    )
    degree = ends.groupBy("issue_date", "node_id").agg(
        F.sum("weight").alias("degree"), F.count_distinct("other").alias("matched_degree")
    )
    out = nodes.join(degree, ["issue_date", "node_id"], "left").na.fill(0, ["degree", "matched_degree"])
    if members is not None:
        own = members.withColumn("node_id", node_id("side", "article_id")).groupBy("issue_date", "node_id").agg(
            F.array_sort(F.collect_set("group_id")).alias("group_ids")
        )
        out = out.join(own, ["issue_date", "node_id"], "left")
    return out.withColumn("isolated", F.col("matched_degree") == 0)


def graph_metrics(measured: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """Seven counts per date. Every part is aggregated to dates before the joins."""
    nodes = measured.groupBy("issue_date").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("side") == "left").alias("left_nodes"),
        F.count_if(F.col("side") == "right").alias("right_nodes"),
        F.count_if(~F.col("isolated")).alias("matched_nodes"),
        F.count_if("isolated").alias("isolated_nodes"),
    )
    n_links = links.groupBy("issue_date").agg(F.count("*").alias("links"))
    n_groups = groups.filter(is_matched_type(F.col("match_type"))).groupBy("issue_date").agg(F.count("*").alias("matched_groups"))
    return (
        nodes.join(n_links, "issue_date", "left").join(n_groups, "issue_date", "left").na.fill(0, ["links", "matched_groups"])
        .select("issue_date", *METRICS)
    )


def order_graph(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("issue_date", F.when(F.col("side") == "left", 0).otherwise(1), "page_number", "title", "article_id")


def order_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links in the order of their left node, then their right node."""
    place = nodes.select("issue_date", "node_id", F.struct("page_number", "title", "article_id").alias("place"))
    left = place.select("issue_date", F.col("node_id").alias("source"), F.col("place").alias("left_place"))
    right = place.select("issue_date", F.col("node_id").alias("target"), F.col("place").alias("right_place"))
    return (
        links.join(left, ["issue_date", "source"], "left").join(right, ["issue_date", "target"], "left")
        .orderBy("issue_date", "left_place", "right_place", "source", "target").drop("left_place", "right_place")
    )


def normalize_metric(value: Column) -> Column:
    """Missing is .45; values from 1 up are put on a log scale, so exactly 1 becomes .25."""
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.log2(value + 1) / 4))
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(0.45))
        .when(value >= 1, scaled)
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.08), value)))
    )


def graph_summary(measured: DataFrame, links: DataFrame) -> DataFrame:
    """Counts and mean normalised link confidence per date."""
    score = normalize_metric(F.col("confidence"))
    per_links = links.groupBy("issue_date").agg(
        F.count("*").alias("links"), F.avg(F.when(score > 0, score)).alias("mean_confidence")
    )
    per_nodes = measured.groupBy("issue_date").agg(
        F.count("*").alias("nodes"), F.count_if(~F.col("isolated")).alias("linked_nodes")
    )
    return per_nodes.join(per_links, "issue_date", "left").na.fill(0, ["links"])


def graph_components(measured: DataFrame, links: DataFrame) -> DataFrame:
    """``component``, its size and whether it is linked, for every node; unlinked nodes stand alone."""
    edges = links.select(
        F.concat_ws("|", F.col("issue_date").cast("string"), "source").alias("a"),
        F.concat_ws("|", F.col("issue_date").cast("string"), "target").alias("b"),
    )
    found = connected_components(edges)
    vertex = F.concat_ws("|", F.col("issue_date").cast("string"), "node_id")
    labelled = measured.withColumn("node", vertex).join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    sizes = labelled.groupBy("component").agg(F.count("*").alias("component_size"))
    return labelled.join(sizes, "component").withColumn("linked", F.col("component_size") > 1).drop("node")


def resolve_members(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups that hold id lists only → members; ids without a node drop out."""
    ids = None
    for side in ("left", "right"):
        rows = groups.select("issue_date", "group_id", F.lit(side).alias("side"), F.posexplode(f"{side}_ids").alias("pos", "article_id"))
        ids = rows if ids is None else ids.unionByName(rows)
    return ids.join(nodes.select("issue_date", "side", "article_id"), ["issue_date", "side", "article_id"], "left_semi")


def resolve_date(*candidates: Column) -> Column:
    return F.coalesce(*[c.cast("string") for c in candidates], F.lit("unknown-date"))


def trend_metrics(index: DataFrame) -> DataFrame:
    """Graph metrics of each index entry. An entry without seven valid numbers falls back to its article counts."""
    valid = F.lit(True)
    for name in METRICS:
        value = F.col(f"graph.{name}").cast("double")
        valid = valid & value.isNotNull() & ~F.isnan(value)
    left_all = F.col("matched_left") + F.col("left_only")
    right_all = F.col("matched_right") + F.col("right_only")
    matched = F.col("matched_left") + F.col("matched_right")
    fallback = {
        "nodes": left_all + right_all, "links": F.col("matched_groups"), "left_nodes": left_all, "right_nodes": right_all,
        "matched_nodes": matched, "isolated_nodes": left_all + right_all - matched, "matched_groups": F.col("matched_groups"),
    }
    return index.select(
        "issue_date",
        F.coalesce(valid, F.lit(False)).alias("from_graph"),
        *[F.when(valid, F.col(f"graph.{m}").cast("long")).otherwise(fallback[m].cast("long")).alias(m) for m in METRICS],
    )


def date_navigation(dates: DataFrame, radius: int = 4) -> DataFrame:
    """Previous and next date, position and neighbours; ``dates`` has one row per date of the archive.

    The dates are range partitioned. A part gets the nearest ``radius`` dates of the parts around it as border rows, found by joining the parts with their places in the order, so
    each window stays inside one part and no step sees all dates.
    """
    ranged = cut_lineage(dates.select("issue_date").repartitionByRange("issue_date").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per partition
    before, parts = 0, []
    for row in sizes:
        parts.append((row["part"], before, row["n"]))
        before += row["n"]
    spark = dates.sparkSession
    starts = spark.createDataFrame(parts, "part int, before long, n long")
    inside = Window.partitionBy("part").orderBy("issue_date")
    placed = ranged.join(F.broadcast(starts), "part").select("part", "issue_date", (F.col("before") + F.row_number().over(inside)).alias("position"))
    # every part that this row's place, give or take the radius, reaches into
    needs = [(p, max(1, b + 1 - radius), b + n + radius) for p, b, n in parts]
    reach = spark.createDataFrame([(p, q) for p, low, high in needs for q, b, n in parts if b + n >= low and b + 1 <= high], "to int, part int")
    bounds = spark.createDataFrame(needs, "to int, low long, high long")
    sent = placed.join(F.broadcast(reach), "part").join(F.broadcast(bounds), "to").filter(F.col("position").between(F.col("low"), F.col("high")))
    own = F.col("part") == F.col("to")
    in_order = Window.partitionBy("to").orderBy("position")
    near = in_order.rowsBetween(-radius, radius)
    found = sent.select(
        "issue_date",
        F.lag("issue_date").over(in_order).alias("previous_date"),
        F.lead("issue_date").over(in_order).alias("next_date"),
        "position",
        F.collect_list("issue_date").over(near).alias("neighbours"),
        own.alias("own"),
    )
    return found.filter("own").drop("own")
