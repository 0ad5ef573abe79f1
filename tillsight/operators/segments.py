"""Cost tiers, customer segments and RFM scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight import labels
from tillsight.functions import as_of_date, exact_mean, first_matching_band, month_diff
from tillsight.plans import exact_tiles


def cost_range(cost: Column, cuts: tuple[int, int, int, int] = labels.COST_CUTS) -> Column:
    """Tier label of a cost. NULL and values between two tiers fall into the last one."""
    low, low_end, high, high_end = cuts
    return first_matching_band(
        [
            (cost < low, f"BELOW ${low}"),
            (cost.between(low, low_end), f"${low} - ${low_end}"),
            (cost.between(high, high_end), f"${high} - ${high_end}"),
        ],
        f"ABOVE ${high_end + 1}",
    )


def cost_segments(products: DataFrame, cuts: tuple[int, int, int, int] = labels.COST_CUTS) -> DataFrame:
    return (
        products.groupBy(cost_range(F.col("cost"), cuts).alias("cost_range"))
        .agg(F.count("product_id").alias("total_products"))
        .orderBy(F.desc("total_products"), "cost_range")
    )


def customer_segment(
    lifespan: Column, spend: Column, min_months: int = labels.MIN_MONTHS, vip_spend: float = labels.VIP_SPEND
) -> Column:
    """VIP and REGULAR need ``min_months`` of history; a NULL on either side gives NEW."""
    tenured = lifespan >= min_months
    return first_matching_band(
        [(tenured & (spend > vip_spend), labels.VIP), (tenured & (spend <= vip_spend), labels.REGULAR)], labels.NEW
    )


def customer_segments(
    fact: DataFrame,
    min_months: int = labels.MIN_MONTHS,
    vip_spend: float = labels.VIP_SPEND,
    tenure_avg: str = "truncate",
) -> DataFrame:
    """Customers, mean spend and mean tenure per segment.

    Undated orders count here. ``tenure_avg`` is 'truncate' (whole months) or
    'mean' (one decimal).
    """
    per_customer = (
        fact.groupBy("customer_key")
        .agg(
            F.min("order_date").alias("first_order"),
            F.max("order_date").alias("last_order"),
            F.sum("sales_amount").alias("total_spend"),
        )
        .withColumn("lifespan_months", month_diff("first_order", "last_order"))
    )
    tenure = exact_mean("lifespan_months")
    if tenure_avg == "truncate":
        tenure = tenure.cast("int")
    elif tenure_avg == "mean":
        tenure = F.round(tenure, 1)
    else:
        raise ValueError(f"tenure_avg must be 'truncate' or 'mean', not {tenure_avg!r}")
    segment = customer_segment(F.col("lifespan_months"), F.col("total_spend"), min_months, vip_spend)
    return (
        per_customer.groupBy(segment.alias("customer_segment"))
        .agg(
            F.count("customer_key").alias("total_customers"),
            F.round(exact_mean("total_spend"), 2).alias("avg_spend_per_customer"),
            tenure.alias("avg_tenure_months"),
        )
        .orderBy(F.desc("total_customers"), "customer_segment")
    )


def rfm_segment(total: Column, cuts: tuple[int, int, int] = labels.RFM_CUTS) -> Column:
    champion, loyal, at_risk = cuts
    return first_matching_band(
        [(total >= champion, labels.CHAMPION), (total >= loyal, labels.LOYAL), (total >= at_risk, labels.AT_RISK)],
        labels.LOST,
    )


def rfm(
    fact: DataFrame,
    as_of: dt.date | str | Column | None = None,
    buckets: int = labels.RFM_BUCKETS,
    cuts: tuple[int, int, int] = labels.RFM_CUTS,
) -> DataFrame:
    """Recency, frequency and monetary quantile scores per customer, best total first.

    Equal measures are ordered by customer key, so that scores are repeatable.
    """
    base = (
        fact.filter(F.col("order_date").isNotNull())
        .groupBy("customer_key")
        .agg(
            F.max("order_date").alias("_last_order"),
            F.countDistinct("order_number").alias("frequency"),
            F.sum("sales_amount").alias("monetary"),
        )
        .select(
            "customer_key",
            month_diff("_last_order", as_of_date(as_of)).alias("recency_months"),
            "frequency",
            "monetary",
        )
    )
    scored = exact_tiles(
        base,
        {"r_score": ("recency_months", False), "f_score": ("frequency", True), "m_score": ("monetary", True)},
        "customer_key",
        buckets,
    )
    key = F.col("customer_key").asc_nulls_first()
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return (
        scored.withColumn("rfm_total_score", total)
        .withColumn("rfm_segment", rfm_segment(F.col("rfm_total_score"), cuts))
        .orderBy(F.desc("rfm_total_score"), key)
    )
