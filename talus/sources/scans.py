"""Scans: CSV and Parquet with partitions, the newest partition, JSON, point and list lookups, tolerant loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.functions import clean

# The seven raw tables.
SCHEMAS = {
    "user_info": "user_id bigint, status int, sex string, birthday date, career string, income_source string, confirmed_at timestamp, level1_finished_at timestamp, level2_finished_at timestamp, user_source string, kyc_level int",
    "twd_transfer": "created_at timestamp, user_id bigint, kind int, ori_samount double, source_ip string, bank_code string, status int",
    "crypto_transfer": "created_at timestamp, user_id bigint, kind int, sub_kind int, ori_samount double, twd_srate double, currency string, protocol string, from_wallet string, to_wallet string, relation_user_id bigint, source_ip string, tx_hash string, status int",
    "usdt_twd_trading": "updated_at timestamp, user_id bigint, is_buy boolean, trade_samount double, twd_srate double, is_market boolean, source string, source_ip string",
    "usdt_swap": "created_at timestamp, user_id bigint, kind int, twd_samount double, currency_samount double, currency string",
    "train_label": "user_id bigint, status int",
    "predict_label": "user_id bigint",
}


def schema_of(name: str) -> T.StructType:
    """A raw table's schema; an unknown table is only sure to have user_id."""
    return T.StructType.fromDDL(SCHEMAS.get(name, "user_id bigint"))


def csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV file or a folder of dt= partitions, all columns as text but for the partition's."""
    return spark.read.option("header", header).option("recursiveFileLookup", False).csv(path)


def raw_table(spark: SparkSession, path: str, name: str, scale: bool = True) -> DataFrame:
    """A raw table from CSV, typed, with amounts scaled once."""
    df = csv(spark, f"{path}/{name}")
    return clean.enforce(clean.scale_amounts(df) if scale else df, schema_of(name))


def latest_partition(df: DataFrame, column: str = "dt") -> DataFrame:
    """The rows of the newest partition; the filter is a scalar subquery on the partition column."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def parquet(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge).parquet(path)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def by_key(df: DataFrame, key: str, value, columns: list[str] | None = None) -> DataFrame:
    out = df.where(F.col(key) == F.lit(value))
    return out.select(*columns) if columns else out


def by_keys(df: DataFrame, key: str, values: list) -> DataFrame:
    """A row per asked value in the asked order; nulls where a value isn't there. The list is the caller's."""
    asked = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias("pos", key))
    return asked.join(df, key, "left").orderBy("pos")


def snapshot(df: DataFrame, column: str, key: str, n: int | None = None) -> DataFrame:
    """The rows of the greatest value of the column; with n, the first n of them in the order of the key."""
    out = df.where(F.col(column) == df.agg(F.max(column)).scalar())
    return out.orderBy(key).limit(n) if n is not None else out


def predictions(df: DataFrame, prefix: str = "shap_", fixed: tuple[str, ...] = ("user_id", "probability", "status")) -> DataFrame:
    """Wide rows to id, probability, a map of contributions (columns with the prefix) and a map of features."""
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    shap = [x for c in df.columns if c.startswith(prefix) for x in (F.lit(c.removeprefix(prefix)), number(c))]
    rest = [x for c in df.columns if not c.startswith(prefix) and c not in fixed for x in (F.lit(c), number(c))]
    empty = F.create_map().cast("map<string,double>")
    return df.select(*[F.col(c) for c in fixed if c in df.columns], (F.create_map(*shap) if shap else empty).alias("contributions"), (F.create_map(*rest) if rest else empty).alias("features"))


def load_all(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables that can be opened; those that can't are left out."""
    found = {}
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}.parquet")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
    return found


def register(spark: SparkSession, name: str, path: str, columns: str, partitions: str) -> DataFrame:
    """A catalog table over a folder of Parquet files, with partition keys; all partitions there are found.

    A table of that name that is there already is replaced; its files stay.
    """
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    keys = ", ".join(part.split()[0] for part in partitions.split(","))
    spark.sql(f"CREATE TABLE {name} ({columns}, {partitions}) USING parquet PARTITIONED BY ({keys}) LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)
