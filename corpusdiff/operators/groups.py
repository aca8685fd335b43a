"""Match groups: assembly from grouped pairs, unmatched articles, order and display form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdiff.operators.candidates import SHOWN_TERMS
from corpusdiff.operators.ranks import distributed_rank
from corpusdiff.operators.scoring import REASON_TYPE, match_reasons, short_reasons
from corpusdiff.operators.signals import term_weight
from corpusdiff.rules import RuleSet

MATCHED_TYPES = (
    "matched", "same_event", "same_policy", "policy_to_military", "same_slogan_different_case", "syndicated_or_reprint",
)
TYPE_ORDER = (
    "same_event", "policy_to_military", "same_policy", "same_slogan_different_case", "uncertain", "left_only", "right_only",
)

# Explanations of the leading group reason.
GROUP_DETAIL = {
    "component": "採用済みペアを連結し、N対Mのグループとして表示。1対1の全文差分ではなく、同一トピック内の表現差を見るための束です。",
    "exact": "正規化タイトルが一致したため、高精度MATCHEDとして採用。",
    "strong": "タイトル内の固有政策名・固有トピックが強く一致したため、MATCHEDとして採用。",
    "local": "LLMを使えないため、共有語と高いヒューリスティック信頼度でMATCHED候補化。",
}


def _in_order(value: Column) -> Column:
    """Values of a group in pair order; a group has at most eight pairs."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("pair_order").alias("o"), value.alias("v"))))
    return F.transform(listed, lambda s: s["v"])


def _reason(basis: str, signal: Column, score: Column, weight: float, detail: Column, terms: Column) -> Column:
    return F.struct(
        F.lit(basis).alias("basis"), signal.alias("signal"), score.alias("score"), F.lit(weight).alias("weight"),
        detail.alias("detail"), terms.alias("terms"),
    )


def assemble_groups(accepted: DataFrame, grouped: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per match group with its articles, type, scores, reasons and terms."""
    rows = accepted.join(grouped, ["issue_date", "pair_id"])
    shown = F.slice("useful_terms", 1, SHOWN_TERMS)
    decided = F.when(
        F.col("decision_matched"),
        F.array(
            _reason("narrative", F.lit("llm_adjudication"), F.col("decision_confidence") / 100, 0.72, F.col("decision_reason"), shown)
        ),
    ).otherwise(F.array().cast(REASON_TYPE))
    article = "struct<page:int,id:string>"
    merged = rows.withColumns({"reasons_": match_reasons(), "decided_": decided}).groupBy("issue_date", "group_key").agg(
        F.max("accepted_confidence").alias("confidence"),
        F.max("lexical").alias("lexical"),
        F.max("narrative").alias("narrative"),
        F.slice(F.array_distinct(F.flatten(_in_order(shown))), 1, 12).alias("shared_terms"),
        F.slice(F.array_distinct(F.flatten(_in_order(F.col("l_only")))), 1, 8).alias("left_only_terms"),
        F.slice(F.array_distinct(F.flatten(_in_order(F.col("r_only")))), 1, 8).alias("right_only_terms"),
        F.array_distinct(_in_order(F.col("l_article"))).alias("left_in_order"),
        F.array_distinct(_in_order(F.col("r_article"))).alias("right_in_order"),
        F.array_sort(F.collect_set(F.struct(F.col("l_page").alias("page"), F.col("l_article").alias("id")).cast(article))).alias("left_articles"),
        F.array_sort(F.collect_set(F.struct(F.col("r_page").alias("page"), F.col("r_article").alias("id")).cast(article))).alias("right_articles"),
        F.flatten(_in_order(F.col("decided_"))).alias("decided"),
        F.bool_or(F.coalesce("decision_matched", F.lit(False))).alias("any_decided"),
        F.bool_or(F.coalesce(F.col("title_kind") == "exact", F.lit(False))).alias("any_exact"),
        F.bool_or(F.coalesce(F.col("title_kind") == "strong_phrase", F.lit(False))).alias("any_strong"),
        F.bool_or(F.coalesce(F.col("topic_family") == F.lit(rules.policy_family), F.lit(False))).alias("any_family"),
        F.min_by(F.struct("title_kind", "match_type", "decision_matched", "decision_reason", "reasons_"), "pair_order").alias("top"),
    )
    several = (F.size("left_articles") > 1) | (F.size("right_articles") > 1)
    top_kind = F.col("top.title_kind")
    adjudicated = F.col("top.decision_matched").isNotNull()
    signal = (
        F.when(several & F.col("any_decided"), F.lit("llm_topic_component"))
        .when(several, F.lit("anchor_topic_component"))
        .when(top_kind == "exact", F.lit("exact_title_match"))
        .when(top_kind == "strong_phrase", F.lit("strong_title_phrase_match"))
        .when(adjudicated, F.lit("llm_adjudication"))
        .otherwise(F.lit("local_high_precision_match"))
    )
    detail = (
        F.when(several, F.lit(GROUP_DETAIL["component"]))
        .when(top_kind == "exact", F.lit(GROUP_DETAIL["exact"]))
        .when(top_kind == "strong_phrase", F.lit(GROUP_DETAIL["strong"]))
        .otherwise(F.coalesce(F.col("top.decision_reason"), F.lit(GROUP_DETAIL["local"])))
    )
    kind = (
        F.when(F.col("any_exact"), F.lit("same_event"))
        .when(F.col("any_family"), F.lit("same_policy"))
        .when(F.col("any_strong"), F.lit("same_event"))
        .otherwise(F.col("top.match_type"))
    )
    lead = F.array(_reason("narrative", signal, F.col("confidence"), 1.0, detail, F.col("shared_terms")))
    return merged.select(
        F.concat(
            F.lit("matched:"), F.array_join("left_in_order", "+"), F.lit(":"), F.array_join("right_in_order", "+")
        ).alias("group_id"),
        "issue_date",
        kind.alias("match_type"),
        "confidence",
        "lexical",
        "narrative",
        F.concat(lead.cast(REASON_TYPE), F.col("decided").cast(REASON_TYPE), F.col("top.reasons_")).alias("reasons"),
        "shared_terms",
        "left_only_terms",
        "right_only_terms",
        F.transform("left_articles", lambda s: s["id"]).alias("left_articles"),
        F.transform("right_articles", lambda s: s["id"]).alias("right_articles"),
        F.coalesce(F.get("left_articles", F.lit(0))["page"], F.get("right_articles", F.lit(0))["page"]).alias("page_number"),
    )


def expand_copies(groups: DataFrame, identified: DataFrame) -> DataFrame:
    """Groups of copy classes as groups of articles, each copy in one group and no side above its bound of two.

    A group holds one or two classes a side. Its n-th layer takes the n-th copies: one of each class where a side has two, two
    where it has one. Layers with copies on both sides are groups; copies beyond the shorter side have no counterpart left. Layers follow from ranks,
    so copies never meet as pairs.
    """
    key = ["issue_date", "side", "fingerprint"]
    named = groups.select("issue_date", "group_id", F.lit("left").alias("side"), F.posexplode("left_articles").alias("class_", "id"), F.size("left_articles").alias("classes_"))
    named = named.unionByName(
        groups.select("issue_date", "group_id", F.lit("right").alias("side"), F.posexplode("right_articles").alias("class_", "id"), F.size("right_articles").alias("classes_"))
    )
    articles = identified.select(*key, "id", "pos", "page_number")
    heads = named.join(articles.select(*key, "id"), ["issue_date", "side", "id"]).drop("id")
    ranked = distributed_rank(articles.join(heads.select(*key), key, "left_semi"), key, ["pos", "id"])
    placed = ranked.join(heads, key).withColumn("layer_", F.floor((F.col("rank") - 1) / F.when(F.col("classes_") > 1, 1).otherwise(2)))
    entry = F.struct(F.col("page_number").alias("page"), "id")
    in_order = F.struct("class_", "pos", "id")

    def ids(side: str, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, value))), lambda s: s["id"])

    layers = placed.groupBy("issue_date", "group_id", "layer_").agg(
        ids("left", entry).alias("left_"), ids("right", entry).alias("right_"), ids("left", in_order).alias("lo_"), ids("right", in_order).alias("ro_"),
        F.coalesce(F.min(F.when(F.col("side") == "left", F.col("page_number"))), F.min("page_number")).alias("page_"),
    ).filter((F.size("left_") > 0) & (F.size("right_") > 0))
    return groups.join(layers, ["issue_date", "group_id"]).select(
        F.concat(F.lit("matched:"), F.array_join("lo_", "+"), F.lit(":"), F.array_join("ro_", "+")).alias("group_id"),
        *(F.col({"left_articles": "left_", "right_articles": "right_", "page_number": "page_"}.get(c, c)).alias(c) for c in groups.columns if c != "group_id"),
    )


def group_members(groups: DataFrame) -> DataFrame:
    """``(issue_date, group_id, side, article_id, pos)``."""

    def side(name: str) -> DataFrame:
        return groups.select(
            "issue_date", "group_id", F.lit(name).alias("side"), F.posexplode(f"{name}_articles").alias("pos", "article_id")
        )

    return side("left").unionByName(side("right"))


def unmatched(articles: DataFrame, members: DataFrame) -> DataFrame:
    """Articles in no group."""
    used = members.select("issue_date", "side", F.col("article_id").alias("id"))
    return articles.join(used, ["issue_date", "side", "id"], "left_anti")


def _page_key() -> Column:
    return F.concat(
        F.when(F.col("page_number") == 2_147_483_647, F.lit("unknown")).otherwise(F.col("page_number").cast("string")),
        F.lit(":"),
        F.coalesce(F.nullif("page_name", F.lit("")), F.lit("page")),
    )


# Fixed value: why a group stands on one side only.
UNMATCHED_DETAIL = "側にのみ残った記事群。対応する候補が閾値を超えなかったため、面ごとに集約して表示する。"


def explained_unmatched(groups: DataFrame, unmatched_signals: DataFrame, rules: RuleSet, by_page: bool = True, n: int = 8) -> DataFrame:
    """One-sided ``groups`` with ``top_terms``, the ``n`` most useful explicit terms of their articles, and ``reasons``, the one reason they have.

    ``unmatched_signals``: the articles that stand in no group, with ``explicit`` terms (and ``page_name``, where groups are pages). The best terms of a page are found by a rank limit
    that Spark applies before the shuffle, so a page of any size sends no more than ``n`` terms a task.
    """
    kind = F.concat("side", F.lit("_only"))
    key = _page_key() if by_page else F.col("id")
    rows = unmatched_signals.select("issue_date", "side", F.concat(kind, F.lit(":"), key).alias("group_id"), F.explode("explicit").alias("term")).distinct()
    weight = term_weight(F.col("term"), rules)
    order = Window.partitionBy("issue_date", "group_id").orderBy(F.desc(weight), F.desc(F.length("term")), "term")
    best = rows.withColumn("rank_", F.row_number().over(order)).filter(F.col("rank_") <= n)
    listed = best.groupBy("issue_date", "group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_", "term"))), lambda x: x["term"]).alias("top_terms"))
    side = F.regexp_replace("match_type", "_only$", "")
    name = F.coalesce(*[F.when(side == code, F.lit(text)) for (k, code), text in rules.labels.items() if k == "source"], side)
    reason = F.struct(
        F.lit("metadata").alias("basis"), F.lit("unmatched").alias("signal"), F.lit(1.0).alias("score"), F.lit(1.0).alias("weight"),
        F.concat(name, F.lit(UNMATCHED_DETAIL)).alias("detail"), F.col("top_terms").alias("terms"),
    )
    found = groups.join(listed, ["issue_date", "group_id"], "left")
    return found.withColumn("top_terms", F.coalesce("top_terms", F.array().cast("array<string>"))).withColumn("reasons", F.array(reason))


def unmatched_groups(unmatched_articles: DataFrame, by_page: bool = True) -> DataFrame:
    """One-sided groups: one per article, or one per date, side and page.

    Page groups keep counts and the page key. The article lists of a page stay rows (:func:`unmatched_members`), so a
    page of any size is never gathered into one value. :func:`explained_unmatched` adds terms and reasons.
    """
    kind = F.concat("side", F.lit("_only"))
    if by_page:
        return (
            unmatched_articles.withColumn("page_key", _page_key())
            .groupBy("issue_date", "side", "page_key")
            .agg(F.count("*").alias("n_articles"), F.min("page_number").alias("page_number"))
            .select(
                F.concat(kind, F.lit(":"), "page_key").alias("group_id"), "issue_date", kind.alias("match_type"),
                F.lit(0.0).alias("confidence"), "n_articles", "page_number",
            )
        )
    return unmatched_articles.select(
        F.concat(kind, F.lit(":"), "id").alias("group_id"), "issue_date", kind.alias("match_type"),
        F.lit(0.0).alias("confidence"), F.lit(1).cast("long").alias("n_articles"), "page_number",
    )


def unmatched_members(unmatched_articles: DataFrame) -> DataFrame:
    return unmatched_articles.select(
        "issue_date", F.concat("side", F.lit("_only:"), "id").alias("group_id"), "side", F.col("id").alias("article_id")
    )


def page_terms(unmatched_signals: DataFrame, rules: RuleSet, n: int = 8) -> DataFrame:
    """The ``n`` most useful explicit terms of each date, side and page."""
    terms = unmatched_signals.select("issue_date", "side", "page_number", F.explode("explicit").alias("term")).distinct()
    order = Window.partitionBy("issue_date", "side", "page_number").orderBy(
        F.desc(term_weight(F.col("term"), rules)), F.desc(F.length("term")), "term"
    )
    return terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def union_groups(matched: DataFrame, *one_sided: DataFrame) -> DataFrame:
    out = matched.withColumn("n_articles", (F.size("left_articles") + F.size("right_articles")).cast("long"))
    for groups in one_sided:
        out = out.unionByName(groups, allowMissingColumns=True)
    return out


def display_rank() -> Column:
    return (
        F.when(F.col("match_type").isin("left_only", "right_only"), 3)
        .when(F.col("match_type") == "uncertain", 2)
        .when(F.col("confidence") < 0.48, 1)
        .otherwise(0)
    )


def type_priority() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in TYPE_ORDER]), F.col("match_type"))


def order_display(groups: DataFrame) -> DataFrame:
    """Report order inside each date."""
    return groups.orderBy(
        "issue_date", display_rank(), type_priority(), F.desc("confidence"), F.asc_nulls_last("page_number"), "group_id"
    )


def order_by_page(groups: DataFrame) -> DataFrame:
    source_rank = F.when(F.col("match_type") == "left_only", 1).when(F.col("match_type") == "right_only", 2).otherwise(0)
    return groups.orderBy("issue_date", F.asc_nulls_last("page_number"), source_rank, F.desc("confidence"), "group_id")


def filter_view(groups: DataFrame, view: str = "all") -> DataFrame:
    one_sided = F.col("match_type").isin("left_only", "right_only")
    if view == "matched":
        return groups.filter(~one_sided)
    return groups.filter(one_sided) if view == "only" else groups


def confidence_band(c: Column) -> Column:
    percent = F.concat(F.floor(c * 100 + 0.5).cast("int").cast("string"), F.lit("%"))
    return (
        F.when(c >= 0.72, F.concat(F.lit("高信頼 "), percent))
        .when(c >= 0.48, F.concat(F.lit("中信頼 "), percent))
        .when(c > 0, F.concat(F.lit("低信頼 "), percent))
        .otherwise(F.lit("未照合"))
    )


def display_groups(groups: DataFrame, rules: RuleSet) -> DataFrame:
    """Report form: folded type, method, reason text, size label and uncertainty notes."""

    def percent(name: str) -> Column:
        return F.concat(F.floor(F.coalesce(name, F.lit(0.0)) * 100 + 0.5).cast("int").cast("string"), F.lit("%"))

    one_sided = F.col("match_type").isin("left_only", "right_only")
    signals = F.transform(F.coalesce("reasons", F.array().cast(REASON_TYPE)), lambda r: r["signal"])

    def has(*names: str) -> Column:
        return F.arrays_overlap(signals, F.array(*[F.lit(x) for x in names]))

    method = (
        F.when(one_sided, F.lit("not matched after adjudication"))
        .when(has("llm_topic_component", "anchor_topic_component"), F.lit("N-to-M match"))
        .when(has("exact_title_match"), F.lit("exact-title match"))
        .when(has("strong_title_phrase_match"), F.lit("strong-title phrase match"))
        .when(has("llm_adjudication"), F.lit("llm-adjudicated match"))
        .otherwise(F.lit("high-precision heuristic"))
    )
    band = confidence_band(F.col("confidence"))
    first_two = F.slice("short_", 1, 2)
    shared = F.when(
        F.size("shared_terms") > 0, F.concat(F.lit("共有語: "), F.array_join(F.slice("shared_terms", 1, 4), "、"), F.lit("。"))
    ).otherwise(F.lit(""))
    basis = F.coalesce(F.nullif(F.array_join(first_two, " / "), F.lit("")), F.lit("共通語候補をLLM/高精度ルールで採用。"))
    only = F.concat(
        F.when(F.col("match_type") == "left_only", F.lit("left only ")).otherwise(F.lit("right only ")),
        F.col("n_articles").cast("string"),
        F.lit("本。共通語候補をLLM/高精度ルールで確認した後、MATCHEDに採用されなかった記事です。"),
    )
    similar = F.concat(F.lit("語彙類似 "), percent("lexical"), F.lit(" / ナラティブ類似 "), percent("narrative"))
    many = (F.size("left_articles") > 1) | (F.size("right_articles") > 1)
    notes = F.concat(
        F.array(similar),
        F.when(one_sided, F.array(F.lit("MATCHED採用されなかった記事を、記事単位でONLYとして表示しています。"))).otherwise(
            F.array(F.lit("共通語候補をLLMまたは高精度ヒューリスティックで採否判定しています。"))
        ),
        F.when(~one_sided & many, F.array(F.lit("N対MのMATCHEDグループです。各記事が全記事と1対1対応するとは限りません。"))).otherwise(
            F.array().cast("array<string>")
        ),
        F.coalesce(first_two, F.array().cast("array<string>")),
    )
    n = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))
    return groups.withColumn("short_", short_reasons(F.col("reasons"), rules)).select(
        "group_id",
        "issue_date",
        F.when(one_sided, F.col("match_type")).otherwise(F.lit("matched")).alias("match_type"),
        "confidence",
        F.when(one_sided, only).otherwise(F.concat(F.lit("MATCHED（"), band, F.lit("）。"), shared, basis)).alias("reason"),
        method.alias("method"),
        F.concat(band, F.lit(" / lexical "), percent("lexical"), F.lit(" / narrative "), percent("narrative")).alias("message"),
        F.concat(n("left_articles").cast("string"), F.lit(":"), n("right_articles").cast("string")).alias("size_label"),
        notes.alias("uncertainty_notes"),
        "shared_terms",
        "left_only_terms",
        "right_only_terms",
        "left_articles",
        "right_articles",
        "page_number",
    )




def title_groups(titles: DataFrame, per_side: int = 2, min_length: int = 8) -> DataFrame:
    """Groups of all articles whose canonical titles are equal, without forming their pairs.

    ``titles`` holds (issue_date, side, id, pos, page_number, ctitle, cyear, ignorable). Without decisions every pair of
    one title has the same confidence, and splitting the complete set of pairs in article order under the group bounds
    keeps the k-th two articles of the left with the k-th two of the right. So the groups follow from ranks alone, for
    any number of articles. A title that occurs with several leading years is grouped per year.
    """
    usable = titles.filter((F.length("ctitle") >= min_length) & ~F.col("ignorable"))
    several = (
        usable.filter("cyear IS NOT NULL").groupBy("issue_date", "ctitle").agg(F.count_distinct("cyear").alias("years_"))
        .filter("years_ > 1")
    )
    usable = usable.join(several, ["issue_date", "ctitle"], "left").withColumn(
        "cyear", F.when(F.col("years_").isNotNull(), F.coalesce("cyear", F.lit(""))).otherwise(F.lit(""))
    )
    key = ["issue_date", "ctitle", "cyear"]
    ranked = distributed_rank(usable.select(*key, "side", "pos", "id", "page_number"), [*key, "side"], ["pos", "id"])
    numbered = ranked.withColumn("part", F.floor((F.col("rank") - 1) / per_side))
    item = F.struct("page_number", "id")
    groups = numbered.groupBy(*key, "part").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "left", item))).alias("l"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "right", item))).alias("r"),
    )
    ids = lambda c: F.transform(c, lambda s: s["id"])
    return groups.filter((F.size("l") > 0) & (F.size("r") > 0)).select(
        F.concat(F.lit("matched:"), F.array_join(ids("l"), "+"), F.lit(":"), F.array_join(ids("r"), "+")).alias("group_id"),
        "issue_date",
        F.lit("same_event").alias("match_type"),
        F.lit(0.92).alias("confidence"),
        F.array("ctitle").alias("shared_terms"),
        ids("l").alias("left_articles"),
        ids("r").alias("right_articles"),
        F.coalesce(F.get("l", F.lit(0))["page_number"], F.get("r", F.lit(0))["page_number"]).alias("page_number"),
    )
