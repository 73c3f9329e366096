"""Prices of models and the cost of token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: US dollars for a million input and output tokens.
PRICES = {"gpt-4": (30.0, 60.0), "gpt-4-turbo": (10.0, 30.0), "gpt-4-turbo-preview": (10.0, 30.0), "gpt-3.5-turbo": (0.5, 1.5), "gpt-3.5-turbo-16k": (3.0, 4.0), "text-embedding-3-small": (0.02, 0.0), "text-embedding-3-large": (0.13, 0.0), "text-embedding-ada-002": (0.1, 0.0)}
FALLBACK = (30.0, 60.0)


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in (PRICES if prices is None else prices).items()], "model string, input_price double, output_price double")


def load_prices(path: str) -> dict[str, tuple[float, float]]:
    """Prices from a YAML file on the driver; the built-in ones if it is missing or broken."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return {m: (float(p["input"]), float(p["output"])) for m, p in yaml.safe_load(f)["models"].items()}
    except Exception:  # noqa: BLE001  any fault means the built-in prices
        return dict(PRICES)


def with_prices(df: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Adds input_price and output_price: by the model's name, else by its first two parts, else the fallback.

    The price list is a handful of rows, so it is broadcast.
    """
    p = F.broadcast(prices)
    exact = p.select(F.col("model").alias("_m1"), F.col("input_price").alias("_i1"), F.col("output_price").alias("_o1"))
    short = p.select(F.col("model").alias("_m2"), F.col("input_price").alias("_i2"), F.col("output_price").alias("_o2"))
    joined = df.join(exact, df[model] == F.col("_m1"), "left").join(short, F.substring_index(df[model], "-", 2) == F.col("_m2"), "left")
    return joined.withColumns({"input_price": F.coalesce("_i1", "_i2", F.lit(FALLBACK[0])), "output_price": F.coalesce("_o1", "_o2", F.lit(FALLBACK[1]))}).drop("_m1", "_i1", "_o1", "_m2", "_i2", "_o2")


def costs(df: DataFrame, prices: DataFrame, model: str = "model", inputs: str = "input_tokens", outputs: str = "output_tokens") -> DataFrame:
    """Adds total_tokens and input, output and total cost; each is rounded by itself, the total from unrounded parts."""
    priced = with_prices(df, prices, model)
    a, b = F.col(inputs) / 1e6 * F.col("input_price"), F.col(outputs) / 1e6 * F.col("output_price")
    return priced.withColumns({"total_tokens": F.col(inputs) + F.col(outputs), "input_cost": F.round(a, 6), "output_cost": F.round(b, 6), "total_cost": F.round(a + b, 6)})


def summary() -> Column:
    """A readable line for each row of costs()."""
    return F.format_string("Model: %s\nTokens: %d input + %d output = %d total\nCost: $%.6f input + $%.6f output = $%.6f total", "model", "input_tokens", "output_tokens", "total_tokens", "input_cost", "output_cost", "total_cost")
