"""Production time series: null-safe volumes, half-open periods, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of field production, the measure each becomes, and what it is multiplied with; money is not.
FIELD_MEASURES = {
    "prfPrdOilNetMillSm3": ("oilNetVolumeSm3", 1e6),
    "prfPrdOilGrossMillSm3": ("oilGrossVolumeSm3", 1e6),
    "prfPrdGasNetBillSm3": ("gasNetVolumeSm3", 1e9),
    "prfPrdGasGrossBillSm3": ("gasGrossVolumeSm3", 1e9),
    "prfPrdNGLNetMillSm3": ("nglNetVolumeSm3", 1e6),
    "prfPrdCondensateNetMillSm3": ("condensateNetVolumeSm3", 1e6),
    "prfPrdCondensateGrossMillSm3": ("condensateGrossVolumeSm3", 1e6),
    "prfPrdOeNetMillSm3": ("oilEquivalentNetVolumeSm3", 1e6),
    "prfPrdOeGrossMillSm3": ("oilEquivalentGrossVolumeSm3", 1e6),
    "prfPrdProducedWaterInFieldMillS": ("waterVolumeSm3", 1e6),
}
INVESTMENT = ("prfInvestmentsMillNOK", "investmentMillionNok")


def number(c: Column) -> Column:
    """A number from text: null for null, blank and "NULL"; null also for what is no finite number. Zero stays zero."""
    text = F.trim(c.cast("string"))
    plain = F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.upper(text).isin("", "NULL"), F.lit(None)).otherwise(F.when(F.abs(plain) < float("inf"), plain))


def number_problem(c: Column) -> Column:
    """True where text stands for neither a number nor a missing one."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return ~F.upper(text).isin("", "NULL") & number(c).isNull()


def excel_day(serial: Column) -> Column:
    """The date of a spreadsheet's serial day."""
    return F.date_add(F.to_date(F.lit("1899-12-30")), serial.cast("int"))


def daily(df: DataFrame, entity: Column, day: Column, volumes: dict[str, Column]) -> DataFrame:
    """Daily records with a stable uid and the half-open period [day, day + 1)."""
    uid = F.concat(F.lit("urn:production:daily:"), entity.cast("string"), F.lit(":"), F.date_format(day, "yyyy-MM-dd"))
    return df.select(uid.alias("uid"), entity.alias("entity"), day.alias("period_start"), F.date_add(day, 1).alias("period_end"), *(c.alias(n) for n, c in volumes.items()))


def monthly(df: DataFrame, entity: Column, year: Column, month: Column, volumes: dict[str, Column]) -> DataFrame:
    """Monthly records; a month outside 1 to 12 has no period and is left out."""
    start = F.when(month.between(1, 12), F.try_to_date(F.format_string("%04d-%02d-01", year, month)))
    uid = F.concat(F.lit("urn:production:monthly:"), entity.cast("string"), F.lit(":"), F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))
    found = df.select(uid.alias("uid"), entity.alias("entity"), start.alias("period_start"), F.add_months(start, 1).cast("date").alias("period_end"), *(c.alias(n) for n, c in volumes.items()))
    return found.where("period_start is not null")


def reconcile(left: DataFrame, right: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """(key, measure, left_sum, right_sum, agrees): sums with null as 0 agree within max(1e-6, 1e-12 |x|)."""
    def sums(df: DataFrame, side: str) -> DataFrame:
        wide = df.groupBy(key).agg(*(F.sum(F.coalesce(F.col(m), F.lit(0.0)).cast("decimal(38,6)")).cast("double").alias(m) for m in measures))
        return wide.unpivot([key], measures, "measure", side)

    both = sums(left, "left_sum").join(sums(right, "right_sum"), [key, "measure"], "full_outer").fillna(0.0, ["left_sum", "right_sum"])
    near = F.abs(F.col("left_sum") - F.col("right_sum")) <= F.greatest(F.lit(1e-6), F.abs("left_sum") * 1e-12)
    return both.withColumn("agrees", near)


def field_months(df: DataFrame, entity: Column, year: Column, month: Column) -> DataFrame:
    """Monthly records of a field in standard cubic metres, from columns named as in FIELD_MEASURES in millions or billions.

    A column that df does not have, and a cell without a number, gives null, never zero; the unit column names the unit. A
    month outside 1 to 12 is left out.
    """
    volumes = {into: number(F.col(c)) * F.lit(factor) if c in df.columns else F.lit(None).cast("double") for c, (into, factor) in FIELD_MEASURES.items()}
    volumes[INVESTMENT[1]] = number(F.col(INVESTMENT[0])) if INVESTMENT[0] in df.columns else F.lit(None).cast("double")
    return monthly(df, entity, year, month, volumes).withColumn("unit", F.lit("Sm3"))
