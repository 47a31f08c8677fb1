"""Date expression helpers: calendar attributes, lenient parsing, backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference TO_CHAR 'Day' / 'Month' pad names with blanks to 9 characters.
NAME_WIDTH = 9


def iso_dow(d: Column) -> Column:
    """ISO day of week, Monday = 1 .. Sunday = 7."""
    return (F.weekday(d) + 1).cast("int")


def week_of_month(d: Column) -> Column:
    """TO_CHAR(d, 'W'): days 1-7 are week 1 (Spark rejects pattern 'W')."""
    return F.ceil(F.dayofmonth(d) / F.lit(7.0)).cast("int")


def iso_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d).cast("int")


def calendar_columns(d: Column) -> list[Column]:
    """The reference's 25 calendar columns for a date column ``d``.
    ``year_actual`` is the ISO year, as in the reference."""
    q_start = F.trunc(d, "quarter")
    dow = iso_dow(d)
    quarter = F.quarter(d)
    return [
        d.alias("date"),
        F.rpad(F.date_format(d, "EEEE"), NAME_WIDTH, " ").alias("day_name"),
        dow.alias("day_of_week"),
        F.dayofmonth(d).cast("int").alias("day_of_month"),
        (F.datediff(d, q_start) + 1).cast("int").alias("day_of_quarter"),
        F.dayofyear(d).cast("int").alias("day_of_year"),
        week_of_month(d).alias("week_of_month"),
        F.weekofyear(d).cast("int").alias("week_of_year"),
        F.month(d).cast("int").alias("month_actual"),
        F.rpad(F.date_format(d, "MMMM"), NAME_WIDTH, " ").alias("month_name"),
        F.date_format(d, "MMM").alias("month_name_abbreviated"),
        quarter.cast("int").alias("quarter_actual"),
        F.when(quarter == 1, "First").when(quarter == 2, "Second")
         .when(quarter == 3, "Third").when(quarter == 4, "Fourth").alias("quarter_name"),
        iso_year(d).alias("year_actual"),
        F.date_add(d, 1 - dow).alias("first_day_of_week"),
        F.date_add(d, 7 - dow).alias("last_day_of_week"),
        F.trunc(d, "month").alias("first_day_of_month"),
        F.last_day(d).alias("last_day_of_month"),
        q_start.alias("first_day_of_quarter"),
        F.date_add(F.add_months(q_start, 3), -1).alias("last_day_of_quarter"),
        F.trunc(d, "year").alias("first_day_of_year"),
        F.make_date(F.year(d), F.lit(12), F.lit(31)).alias("last_day_of_year"),
        F.date_format(d, "MMyyyy").alias("mmyyyy"),
        F.date_format(d, "MMddyyyy").alias("mmddyyyy"),
        (dow >= 6).alias("weekend_indr"),
    ]


def calendar_sql(d: str) -> str:
    """The same 25 columns in DuckDB SQL (oracle side)."""
    return ", ".join([
        f"{d} AS date",
        f"rpad(dayname({d}), 9, ' ') AS day_name",
        f"CAST(isodow({d}) AS INT) AS day_of_week",
        f"CAST(day({d}) AS INT) AS day_of_month",
        f"CAST({d} - CAST(date_trunc('quarter', {d}) AS DATE) + 1 AS INT) AS day_of_quarter",
        f"CAST(dayofyear({d}) AS INT) AS day_of_year",
        f"CAST(ceil(day({d}) / 7.0) AS INT) AS week_of_month",
        f"CAST(weekofyear({d}) AS INT) AS week_of_year",
        f"CAST(month({d}) AS INT) AS month_actual",
        f"rpad(monthname({d}), 9, ' ') AS month_name",
        f"strftime({d}, '%b') AS month_name_abbreviated",
        f"CAST(quarter({d}) AS INT) AS quarter_actual",
        f"CASE quarter({d}) WHEN 1 THEN 'First' WHEN 2 THEN 'Second' WHEN 3 THEN 'Third' "
        f"WHEN 4 THEN 'Fourth' END AS quarter_name",
        f"CAST(isoyear({d}) AS INT) AS year_actual",
        f"CAST({d} + CAST(1 - isodow({d}) AS INT) AS DATE) AS first_day_of_week",
        f"CAST({d} + CAST(7 - isodow({d}) AS INT) AS DATE) AS last_day_of_week",
        f"CAST(date_trunc('month', {d}) AS DATE) AS first_day_of_month",
        f"last_day({d}) AS last_day_of_month",
        f"CAST(date_trunc('quarter', {d}) AS DATE) AS first_day_of_quarter",
        f"CAST(date_trunc('quarter', {d}) + INTERVAL 3 MONTH AS DATE) - 1 AS last_day_of_quarter",
        f"CAST(date_trunc('year', {d}) AS DATE) AS first_day_of_year",
        f"make_date(year({d}), 12, 31) AS last_day_of_year",
        f"strftime({d}, '%m%Y') AS mmyyyy",
        f"strftime({d}, '%m%d%Y') AS mmddyyyy",
        f"isodow({d}) IN (6, 7) AS weekend_indr",
    ])


def parse_date_prefix(text: Column) -> Column:
    """``TO_DATE(substring(v,1,10),'YYYY-MM-DD')`` made total: NULL when the
    first ten characters are not an ISO date (plain to_date raises)."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def initial_backoff(age_days: Column) -> Column:
    """``max(int(log2(age_days*24)) - 1, 0)``; age <= 0 or NULL -> 0."""
    raw = F.floor(F.log2(age_days * 24)) - 1
    return F.when(age_days > 0, F.greatest(raw, F.lit(0))).otherwise(F.lit(0)).cast("int")
