"""Restaurant list and master table from orders and scraped blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import coalesce_blank, match_rule, norm_edit_distance, normalise_address, parse_details, split_phones, suffix
from ..operators.aggregates import freq
from ..operators.joins import join_null_safe, left_lookup
from ..operators.ranking import best_match, keep_first

STORE_KEYS = ["sup_id", "from_tel", "from_addr"]


def store_list(orders: DataFrame) -> DataFrame:
    """Distinct stores with their phone numbers taken apart."""
    return split_phones(orders.select("sup_id", "from_addr", "from_tel").distinct(), "from_tel")


def clean_store_addresses(orders: DataFrame, col: str = "from_addr") -> DataFrame:
    """Every order with its cleaned store address and supplement: the address is cleaned
    once per distinct text and looked up."""
    address, supplement = normalise_address(col)
    cleaned = orders.select(col).distinct().select(col, address.alias("cleaned"), supplement.alias("supple"))
    return left_lookup(orders, cleaned, [col], null_safe=True)


def suffix_profile(df: DataFrame, col: str, n: int) -> DataFrame:
    """How often each ending of n characters occurs over the distinct texts."""
    return freq(df.select(col).distinct().filter(F.col(col).isNotNull())
                .select(suffix(col, n).alias("ending")), "ending")


def score_candidates(parsed: DataFrame) -> DataFrame:
    long, short = norm_edit_distance("from_addr", "from_addr_xms")
    return (parsed.withColumn("adist_long", long).withColumn("adist_short", short)
            .withColumn("match_rule", match_rule("adist_long", "adist_short")))


def restaurant_master(raw: DataFrame, tags: DataFrame | None = None, mode: str = "intended") -> DataFrame:
    """One scraped record per restaurant.

    ``raw`` has ``sup_id, from_addr, from_tel, from_tel_alt, details``; ``tags`` has the
    same keys plus ``details`` and ``tag1..tag4``; of several tags of one block the least count.
    The texts of the blocks move once, to their stores; only the blocks picked are taken apart
    again and looked up, by 128 bits of hash of their keys.
    """
    filled = raw.withColumn("from_tel", coalesce_blank("from_tel", "from_tel_alt")).drop("from_tel_alt")
    parsed = parse_details(filled)
    scored = score_candidates(parsed)
    if mode == "intended":
        # the first by details of each address, then the nearest address, in one order
        best = scored.groupBy(*STORE_KEYS).agg(F.min(F.struct(
            *[x for c in ("adist_long", "from_addr_xms", "details") for x in (F.col(c).isNull().alias(f"_n_{c}"), F.col(c))],
            *[c for c in filled.columns if c not in (*STORE_KEYS, "details")])).alias("_b"))
        best = score_candidates(parse_details(best.select(
            *[F.col(c) if c in STORE_KEYS else F.col(f"_b.{c}").alias(c) for c in filled.columns])))
    else:
        best = best_match(keep_first(scored, [*STORE_KEYS, "from_addr_xms"], ["details"]), STORE_KEYS, mode=mode)
    if tags is None:
        return best
    keys = ["sup_id", "from_addr", "from_tel", "details"]
    rest = [c for c in tags.columns if c not in keys]
    hashes = [F.xxhash64(F.lit(seed), *[x for k in keys for x in (F.col(k).isNull(), F.col(k))]).alias(f"_h{seed}") for seed in (0, 1)]
    tagged = (tags.filter(F.col("tag1").isNotNull()).select(*hashes, F.struct(*rest).alias("_t"))
              .groupBy("_h0", "_h1").agg(F.min("_t").alias("_t")))
    found = join_null_safe(best.select("*", *hashes), tagged, ["_h0", "_h1"])
    scores = ["adist_long", "adist_short", "match_rule"]
    return found.select(*[c for c in best.columns if c not in scores], *[F.col(f"_t.{c}").alias(c) for c in rest], *scores)
