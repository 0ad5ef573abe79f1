"""The star model as saved tables of the session catalog, and the reports as permanent SQL views over them.

Tables and views belong to the catalog, not to the session that made them: other
sessions read them by name, and with a lasting catalog other applications do. A view
is stored as SQL and inlined where it is used, so filters reach the scans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from tillsight import labels


def save_model(spark: SparkSession, tables: dict[str, DataFrame], database: str, location: str | None = None) -> None:
    """Write ``tables`` as Parquet tables of ``database``, which is created if need be, at ``location`` if given."""
    place = f" location '{location}'" if location else ""
    spark.sql(f"create database if not exists `{database}`{place}")
    for name, df in tables.items():
        df.write.mode("overwrite").format("parquet").saveAsTable(f"`{database}`.`{name}`")


def _months(start: str, end: str) -> str:
    return f"((year({end}) - year({start})) * 12 + month({end}) - month({start}))"


def _per(total: str, count: str) -> str:
    return f"cast({total} as double) / nullif(cast({count} as double), 0d)"


def _today(as_of: dt.date | str | None) -> str:
    return f"date '{as_of}'" if as_of is not None else "current_date()"


def customer_report_sql(
    database: str,
    as_of: dt.date | str | None = None,
    min_months: int = labels.MIN_MONTHS,
    vip_spend: float = labels.VIP_SPEND,
    age_cuts: tuple[int, ...] = labels.AGE_CUTS,
) -> str:
    """``operators.reports.report_customers`` as a statement over the saved tables. Without a date, ages follow the day of reading."""
    today = _today(as_of)
    ages = " ".join(f"when age between {a} and {b - 1} then '{a}-{b - 1}'" for a, b in zip(age_cuts, age_cuts[1:]))
    return f"""
with totals as (
    select c.customer_key, sum(sales_amount) as total_sales, sum(quantity) as total_quantity,
           min(order_date) as first_order_date, max(order_date) as last_order_date,
           count(distinct order_number) as total_orders, count(distinct product_key) as total_products
    from `{database}`.fact_sales f left join `{database}`.dim_customers c on c.customer_key = f.customer_key
    where order_date is not null
    group by c.customer_key
),
told as (
    select t.*, d.customer_number, concat(coalesce(d.first_name, ''), ' ', coalesce(d.last_name, '')) as customer_name,
           year({today}) - year(d.birthdate) as age, {_months('first_order_date', 'last_order_date')} as lifespan_months
    from totals t left join `{database}`.dim_customers d on d.customer_key = t.customer_key
)
select customer_key, customer_number, customer_name, age,
       case when age < {age_cuts[0]} then 'UNDER {age_cuts[0]}' {ages} else '{age_cuts[-1]}+' end as age_group,
       case when lifespan_months >= {min_months} and total_sales > {vip_spend} then '{labels.VIP}'
            when lifespan_months >= {min_months} and total_sales <= {vip_spend} then '{labels.REGULAR}'
            else '{labels.NEW}' end as customer_segment,
       total_orders, total_sales, total_quantity, total_products, first_order_date, last_order_date, lifespan_months,
       {_months('last_order_date', today)} as recency_months,
       case when total_orders = 0 then 0d else {_per('total_sales', 'total_orders')} end as avg_order_value,
       case when lifespan_months = 0 then cast(total_sales as double) else {_per('total_sales', 'lifespan_months')} end
         as avg_monthly_spend
from told"""


def product_report_sql(
    database: str, as_of: dt.date | str | None = None, high: float = labels.HIGH_SALES, mid: float = labels.MID_SALES
) -> str:
    """``operators.reports.report_products`` as a statement over the saved tables."""
    price = _per("total_sales", "total_quantity")
    return f"""
with totals as (
    select p.product_key, sum(sales_amount) as total_sales, sum(quantity) as total_quantity,
           min(order_date) as first_sale_date, max(order_date) as last_sale_date,
           count(distinct order_number) as total_orders, count(distinct customer_key) as total_customers
    from `{database}`.fact_sales f left join `{database}`.dim_products p on p.product_key = f.product_key
    where order_date is not null
    group by p.product_key
),
told as (
    select t.*, d.product_name, d.category, d.subcategory, d.cost,
           {_months('first_sale_date', 'last_sale_date')} as lifespan_months
    from totals t left join `{database}`.dim_products d on d.product_key = t.product_key
)
select product_key, product_name, category, subcategory, cost,
       case when total_sales > {high} then '{labels.HIGH_PERFORMER}' when total_sales >= {mid} then '{labels.MID_PERFORMER}'
            else '{labels.LOW_PERFORMER}' end as product_performance,
       first_sale_date, last_sale_date, lifespan_months, {_months('last_sale_date', _today(as_of))} as recency_months,
       total_orders, total_customers, total_sales, total_quantity,
       case when total_orders = 0 then 0d else {_per('total_sales', 'total_orders')} end as avg_order_revenue,
       case when lifespan_months = 0 then cast(total_sales as double) else {_per('total_sales', 'lifespan_months')} end
         as avg_monthly_revenue,
       case when total_quantity = 0 then 0d else round({price}, 2) end as avg_revenue_per_unit,
       case when total_quantity <> 0 or total_quantity is null
            then round(({price} - cast(cost as double)) / nullif({price}, 0d) * 100, 2) end as estimated_margin_pct
from told"""


def create_report_views(
    spark: SparkSession, database: str, as_of: dt.date | str | None = None, customers: dict | None = None, products: dict | None = None
) -> None:
    """Both reports as permanent views ``report_customers`` and ``report_products`` of the database of a saved model.

    ``customers`` and ``products`` are further arguments of the two statements.
    """
    spark.sql(f"create or replace view `{database}`.report_customers as {customer_report_sql(database, as_of, **customers or {})}")
    spark.sql(f"create or replace view `{database}`.report_products as {product_report_sql(database, as_of, **products or {})}")
