"""Bank transfer files as graph tables: raw columns, derived banks, accounts, alerts and channels.

Everything is a DataFrame over the input file, so any size of file is read in parallel. Ids of
banks and accounts are 63-bit hashes of their keys: no global numbering, equal in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Country code, name, risk level, region, on the blacklist.
COUNTRIES = [
    ("US", "United States", "LOW", "Americas", "false"),
    ("GB", "United Kingdom", "LOW", "Europe", "false"),
    ("DE", "Germany", "LOW", "Europe", "false"),
    ("CH", "Switzerland", "MEDIUM", "Europe", "false"),
    ("HK", "Hong Kong", "MEDIUM", "Asia", "false"),
    ("SG", "Singapore", "LOW", "Asia", "false"),
    ("AE", "UAE", "MEDIUM", "Middle East", "false"),
    ("NG", "Nigeria", "HIGH", "Africa", "false"),
    ("KY", "Cayman Islands", "HIGH", "Americas", "true"),
    ("PA", "Panama", "HIGH", "Americas", "true"),
]
#: Raw columns by place.
RAW = ("timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "receiving_currency", "amount_paid", "payment_currency", "payment_format", "is_laundering")
NORMAL = ("from_bank", "from_account", "to_bank", "to_account", "amount_paid", "payment_currency", "payment_format", "timestamp", "is_laundering", "transaction_id")


def raw(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """The eleven raw columns of a CSV file with a header, as text, of at most ``max_rows`` rows if that is given.

    A row with fewer columns goes; of a row with more the first eleven stay.
    """
    rows = spark.read.schema(", ".join(f"{c} string" for c in RAW)).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE")
    rows = rows.where(F.col(RAW[-1]).isNotNull())
    return rows if max_rows is None else rows.limit(max_rows)


def normalised(df: DataFrame) -> DataFrame:
    """The ten columns of the loader's format; ids follow the file's order, with gaps between its splits."""
    cleaned = df.select(*(F.trim(c).alias(c) for c in RAW if c in NORMAL))
    return cleaned.withColumn("transaction_id", (F.monotonically_increasing_id() + 1).cast("string")).select(*NORMAL)


def hashed_modulo(text: Column, m: int) -> Column:
    """The MD5 of a text as a whole number, modulo m."""
    half = lambda at: F.conv(F.substring(F.md5(text), at, 16), 16, 10).cast("decimal(38,0)")
    return ((half(1) % m * (2**64 % m) + half(17) % m) % m).cast("int")


def _id(*key) -> Column:
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << 63) - 1))


def _country(bank) -> Column:
    return hashed_modulo(F.col(bank), len(COUNTRIES)) + 1


def graph_tables(spark: SparkSession, t: DataFrame) -> dict[str, DataFrame]:
    """Countries, banks, accounts, transfers, alerts and the edges between them."""
    countries = spark.createDataFrame([(i + 1, *c) for i, c in enumerate(COUNTRIES)], "id long, country_code string, country_name string, risk_level string, region string, fatf_blacklist string")
    code = F.element_at(F.array(*(F.lit(c[0]) for c in COUNTRIES)), _country("bank_id"))
    ends = t.select(F.explode(F.array(F.struct(F.col("from_bank").alias("bank_id"), F.col("from_account").alias("account_id"), "is_laundering"), F.struct(F.col("to_bank").alias("bank_id"), F.col("to_account").alias("account_id"), "is_laundering"))).alias("e")).select("e.*")
    banks = ends.select("bank_id").distinct()
    banks = banks.select(_id("bank_id").alias("id"), "bank_id", F.concat(F.lit("Bank-"), "bank_id").alias("bank_name"), code.alias("country_code"), F.concat(F.lit("SWIFT"), _id("bank_id")).alias("swift_code"), F.lit("TIER1").alias("tier"))
    both = ends.groupBy("bank_id", "account_id").agg(F.max(F.col("is_laundering") == "1").alias("flagged"))
    key = F.concat_ws(":", "bank_id", "account_id")
    bucket, score = hashed_modulo(key, 100), lambda low, m: F.round(F.lit(low) + hashed_modulo(key, m) / 100, 2)
    accounts = both.select(
        _id("bank_id", "account_id").alias("id"), "account_id", "bank_id",
        F.when(hashed_modulo(key, 3) == 0, "BUSINESS").otherwise("PERSONAL").alias("account_type"),
        F.when(bucket < 5, score(0.85, 15)).when(bucket < 20, score(0.71, 14)).otherwise(score(0.05, 65)).alias("risk_score"),
        F.when(bucket < 5, "true").otherwise("false").alias("is_blocked"),
        F.when(hashed_modulo(F.col("account_id"), 100) * 11 % 100 >= 30, "2020-01-01").otherwise("").alias("opened_date"),
    )
    form = F.coalesce(F.nullif(F.trim("payment_format"), F.lit("")), F.lit("UNKNOWN"))
    transfers = t.select(
        _id("transaction_id").alias("id"), _id("from_bank", "from_account").alias("from_account_id"), _id("to_bank", "to_account").alias("to_account_id"), "transaction_id",
        F.col("amount_paid").try_cast("double").alias("amount"), F.col("payment_currency").alias("currency"), form.alias("payment_format"), F.col("timestamp").alias("event_time"), "is_laundering",
    )
    channel = t.select(_id("transaction_id").alias("id"), _id("transaction_id").alias("transfer_id"), _country("from_bank").cast("long").alias("country_id"), F.when(F.lower(form).contains("wire"), "WIRE").otherwise("DIGITAL").alias("channel_type"), F.col("timestamp").alias("routed_at"))
    alerted = both.where("flagged").select(_id("bank_id", "account_id").alias("id"))
    return {
        "aml_countries": countries,
        "aml_banks": banks,
        "aml_accounts": accounts,
        "aml_transfers": transfers,
        "aml_transfer_channel": channel,
        "aml_bank_country": banks.select("id", F.col("id").alias("bank_id"), _country("bank_id").cast("long").alias("country_id"), F.lit("true").alias("is_headquarters")),
        "aml_account_bank": both.select(_id("bank_id", "account_id").alias("id"), _id("bank_id", "account_id").alias("account_id"), _id("bank_id").alias("bank_id"), F.lit("2020-01-01").alias("since"), F.lit("true").alias("is_primary")),
        "aml_alerts": alerted.select("id", F.concat(F.lit("ALERT-"), "id").alias("alert_id"), F.lit("SUSPICIOUS_TRANSFER").alias("alert_type"), F.lit("HIGH").alias("severity"), F.lit("OPEN").alias("status"), F.lit("2022-09-01").alias("raised_at")),
        "aml_account_alert": alerted.select("id", F.col("id").alias("account_id"), F.col("id").alias("alert_id"), F.lit("2022-09-01").alias("flagged_at"), F.lit("Laundering flag").alias("reason")),
    }


def _write(df: DataFrame, target: str, name: str, form: str) -> DataFrame:
    """Write a table and read it again."""
    if form == "iceberg":
        df.writeTo(f"{target}.{name}").using("iceberg").createOrReplace()
        return df.sparkSession.table(f"{target}.{name}")
    path = f"{target}/{name}.{form}"
    df.write.mode("overwrite").format(form).save(path)
    return df.sparkSession.read.format(form).load(path)


def seed(spark: SparkSession, csv_path: str, target: str, form: str = "parquet", max_rows: int | None = None) -> list[str]:
    """Write a raw file's graph tables below ``target`` (``<target>/<table>.<form>``), or, for form ``iceberg``, as tables of the catalog namespace ``target``.

    The normalised rows are written first, as ``aml_normalised``, and all tables derive from that
    one table, so they agree in their rows and in the ids of transactions. Hashed ids are checked:
    two accounts or banks of one id are an error.
    """
    normal = _write(normalised(raw(spark, csv_path, max_rows)), target, "aml_normalised", form)
    tables = graph_tables(spark, normal)
    for name, df in tables.items():
        kept = _write(df, target, name, form)
        if name in ("aml_accounts", "aml_banks", "aml_transfers") and kept.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise ValueError(f"two rows of {name} have one hashed id")
    return list(tables)
