"""The queries of the operators for language-model data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranklake.functions.text import is_missing, notice_number
from ranklake.llm.batch_dedup import History, check_batch, signatures
from ranklake.llm.canonical_map import map_to_list, mapped_rows, reference_names
from ranklake.llm.mixing import BLOCK_TOKENS, selection, shares
from ranklake.llm.packing import packed, packing_report
from ranklake.llm.tokens import TOKENIZER, n_tokens
from ranklake.llm.truncation import cut_rates, endings, hidden_limits
from ranklake.operators.packed_values import packed_values
from ranklake.plans.records import color_names
from ranklake.plans.registry import Registry, table
from ranklake.session import bounded_rows, cut, stored

LLM = Registry()

# Ways to say that any place will do.
NO_PREFERENCE = (
    "any", "anywhere", "no preference", "무관", "상관없음", "상관 없음", "아무데나", "아무 데나", "어디든", "어디나",
    "제한 없음", "없음",
)


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field, row_id, value`` of every typed value that is not missing."""
    items = table(spark, sf_dir, "notice_items")
    colors = packed_values(F.col("color"), color_names(spark, sf_dir))
    from_items = items.select(
        F.col("item_id").alias("row_id"),
        F.explode(
            F.array(
                F.struct(F.lit("breed").alias("field"), F.when(~is_missing(F.col("breed")), F.col("breed")).alias("value")),
                F.struct(F.lit("color").alias("field"), F.when(F.size(colors) == 1, colors[0]).alias("value")),
            )
        ).alias("v"),
    ).select("v.field", "row_id", "v.value")
    region = F.col("preferred_region")
    from_profiles = table(spark, sf_dir, "appearance_profiles").select(
        F.lit("preferred_region").alias("field"),
        F.col("profile_id").alias("row_id"),
        F.when(~is_missing(region, NO_PREFERENCE), region).alias("value"),
    )
    both = from_items.unionByName(from_profiles).where("value IS NOT NULL")
    return both.where(~is_missing(F.col("value")))


@LLM.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = typed_values(spark, sf_dir)
    names = reference_names(table(spark, sf_dir, "ref_values"), ("preferred_region",))
    mapping = map_to_list(values.select("field", "value"), names)
    return mapped_rows(values, mapping).select(F.col("field").alias("field_name"), "row_id", "ref_id")


@LLM.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted history, then the new batches, in order of the items' ids, against what the history left accepted."""
    items = table(spark, sf_dir, "notice_items")
    is_new = F.when(F.coalesce(F.col("batch_no"), F.lit(0)) == 0, 0).otherwise(1)
    signed = signatures(
        items,
        F.col("item_id"),
        notice_number(F.col("notice_id")),
        F.col("image_urls"),
        table(spark, sf_dir, "stock_images").select("image_url"),
        is_new,
    )
    signed = stored(signed, "signed", ["batch"])
    old_pairs, history = check_batch(signed.where("batch = 0"), History.new(spark))
    new_pairs, _ = check_batch(signed.where("batch = 1"), history)
    return old_pairs.unionByName(new_pairs)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


@LLM.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endings(documents(spark, sf_dir)).where("is_cut").select("doc_id")


@LLM.add("p8_rates")
def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_rates(endings(documents(spark, sf_dir)))


@LLM.add("p8_limits")
def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_limits(documents(spark, sf_dir).where("text IS NOT NULL")).withColumn(
        "n_before", F.round("n_before", 6)
    )


def document_sizes(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", n_tokens(F.col("text"), tokenizer).alias("n_tokens"))


def _budgets(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = bounded_rows(table(spark, sf_dir, "token_budgets").select("budget_name", "capacity_tokens"), 100)
    return sorted((r.budget_name, r.capacity_tokens) for r in rows)


def _packings(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, DataFrame]]:
    sizes = cut(document_sizes(spark, sf_dir).select("doc_id", "n_tokens"))
    return [(name, c, packed(sizes, F.col("doc_id"), F.col("n_tokens"), c)) for name, c in _budgets(spark, sf_dir)]


@LLM.add("p6_containers")
def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [
        p.select(
            F.lit(name).alias("budget_name"), "container_no", F.col("item_id").alias("doc_id"), "part_no",
            F.col("start").alias("start_token"), F.col("length").alias("n_tokens"),
        )
        for name, _, p in _packings(spark, sf_dir)
    ]
    return reduce(DataFrame.unionByName, each)


@LLM.add("p6_report")
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [
        packing_report(p, c).withColumn("budget_name", F.lit(name)).withColumn("capacity_tokens", F.lit(c))
        for name, c, p in _packings(spark, sf_dir)
    ]
    return reduce(DataFrame.unionByName, each)


@LLM.add(
    "p6_invariants",
    """SELECT budget_name, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_lost, 0 AS n_over, 0 AS n_split
    FROM token_budgets""",
)
def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: every token of every document once, none over capacity, none split that fits."""
    sizes = cut(document_sizes(spark, sf_dir).select("doc_id", F.col("n_tokens").cast("long").alias("size")))
    each = []
    for name, capacity in _budgets(spark, sf_dir):
        placed = cut(packed(sizes, F.col("doc_id"), F.col("size"), capacity))
        of_doc = placed.groupBy("item_id").agg(F.sum("length").alias("got"), F.count(F.lit(1)).alias("parts"))
        met = sizes.join(of_doc, F.col("item_id") == F.col("doc_id"), "full_outer")
        docs = met.agg(
            F.count("item_id").alias("n_docs"),
            F.count(F.when(~F.col("got").eqNullSafe(F.col("size")), 1)).alias("n_lost"),
            F.count(F.when((F.col("parts") > 1) & (F.col("size") <= capacity), 1)).alias("n_split"),
        )
        filled = placed.where("container_no > 0").groupBy("container_no").agg(F.sum("length").alias("filled"))
        over = filled.agg(F.count(F.when(F.col("filled") > capacity, 1)).alias("n_over"))
        each.append(docs.join(F.broadcast(over), F.lit(True)).withColumn("budget_name", F.lit(name)))
    return reduce(DataFrame.unionByName, each)


@LLM.add("p7_selection")
def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(document_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


@LLM.add("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return shares(selection(document_sizes(spark, sf_dir), targets), targets)


@LLM.add(
    "p7_invariants",
    """SELECT mix_name, count(*) AS n_sources, 0 AS n_over_repeats, 0 AS n_off_target FROM mix_targets t WHERE target_share > 0
    AND EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0) GROUP BY mix_name""",
)
def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a selection: no part of a document used too often, every source that has documents within two
    blocks of its target."""
    targets = table(spark, sf_dir, "mix_targets")
    chosen = cut(selection(document_sizes(spark, sf_dir), targets))
    uses = chosen.groupBy("mix_name", "source", "doc_id", "start").agg(F.count(F.lit(1)).alias("uses"))
    limits = targets.select("mix_name", "source", "max_repeats")
    over = uses.join(limits, ["mix_name", "source"]).groupBy("mix_name", "source").agg(
        F.count(F.when(F.col("uses") > F.col("max_repeats"), 1)).alias("over")
    )
    got = shares(chosen, targets).where("n_tokens > 0").join(over, ["mix_name", "source"])
    whole = Window.partitionBy("mix_name")
    wanted = F.col("target_share") / F.sum("target_share").over(whole) * F.sum("n_tokens").over(whole)
    got = got.withColumn("off", F.abs(F.col("n_tokens") - wanted) > 2 * BLOCK_TOKENS)
    return got.groupBy("mix_name").agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum("over").alias("n_over_repeats"), F.count(F.when(F.col("off"), 1)).alias("n_off_target")
    )
