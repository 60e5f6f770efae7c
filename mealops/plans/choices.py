"""Store choice table: each order's store against the user's last different store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.choice import choice_set
from ..operators.joins import attach_stats, left_lookup, previous_distinct
from ..operators.windows import prior_purchases

#: A store of the restaurant master: one id can have several phones and addresses.
STORE_KEYS = ["sup_id", "from_tel", "from_addr"]
ATTRIBUTES = ["name", "taste", "envir", "service", "avgexp_lo", "avgexp_up", "tag1"]


def store_choices(orders: DataFrame, stores: DataFrame, required: list[str] = ("taste", "envir", "service", "avgexp"),
                  keys: list[str] = STORE_KEYS) -> DataFrame:
    """Users with more than one order; rows ``chosen`` 1/0 with the attributes of the store
    they stand for, complete sets only: one chosen row and an alternative."""
    keys = list(keys)
    dim = stores.select(*keys, *ATTRIBUTES).withColumn(
        "avgexp", (F.col("avgexp_lo") + F.col("avgexp_up")) / 2)
    o = attach_stats(orders, ["user_id"], u_n_tt=F.count(F.lit(1)), u_price_avg=F.avg("price"))
    o = previous_distinct(prior_purchases(o.filter(F.col("u_n_tt") > 1)))
    base = ["id", "user_id", "price", "rider_income", "place_tm", "finish_tm", "u_n_tt", "u_price_avg"]
    chosen = left_lookup(o.select(*base, *keys, "ss", "ss_b4"), dim, keys, null_safe=True)
    # the alternative carries the purchase history it had when it was ordered
    past = o.select(F.col("id").alias("alt_id"), *keys, "ss", "ss_b4")
    alt = left_lookup(o.filter(F.col("alt_id").isNotNull()).select(*base, "alt_id"), past, "alt_id").drop("alt_id")
    return choice_set(chosen, left_lookup(alt, dim, keys, null_safe=True), list(required))
