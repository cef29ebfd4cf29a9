"""Decoding of hexadecimal logs into typed columns: shape and range checks, no UDF.

Logs have address, topics (array of 0x words) and data (0x hex).  Every log gets one row of a wide
table; error is null, `unsupported_topic` or what is malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import words

#: The first topic of each event.
POOL_TOPICS = {
    "0xdd466e674ea557f56295e2d0218a125ea4b4f0f6f3307b95f85e6110838d6438": "Initialize",
    "0x40e9cecb9f5f1f1c5b9c97dec2917b7ee92e57ba5563708daca94dd84ad7112f": "Swap",
    "0xf208f4912782fd25c7f114ca3723a2d5dd6f3bcc3ac8db5af63baa85f711d5ec": "ModifyLiquidity",
}
LAUNCH_TOPICS = {
    "0x8d4aad4953d0ca700d468f3753aa14432d1b35b43ec6409f051fb6aa43a89607": "TokenLaunched",
    "0xcdb72f157fd3666758a6ce201387ffb52038c7562e4fff352828da1096c4b6b4": "LaunchSwept",
    "0xa0a18f5bf205becee8b268d7cf69addab8548ae8ef361791464cf0e0e17c1361": "TokensLocked",
    "0x0a44ef75df69c534f43cd6c1aa3ef8983065fe5fe79ef9e79f6494e6f258c259": "PoolGraduated",
}
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


def _kind(topics: dict[str, str]) -> Column:
    topic = F.lower(F.get("topics", F.lit(0)))
    out = F.lit(None).cast("string")
    for value, name in topics.items():
        out = F.when(topic == value, name).otherwise(out)
    return out


def _word(i: int) -> Column:
    return F.substring(F.lower(F.col("data")), 3 + 64 * i, 64)


def _topic(i: int) -> Column:
    return F.substring(F.lower(F.get("topics", F.lit(i))), 3, 64)


def _address(word: Column) -> Column:
    return F.concat(F.lit("0x"), F.substring(word, 25, 40))


def _shape(kind: str, topics: int, data: int) -> Column:
    """Whether a log of the kind has another number of topics or words, or isn't hexadecimal."""
    sized = (F.size("topics") == topics) & F.forall("topics", lambda t: F.coalesce(F.lower(t).rlike("^0x[0-9a-f]{64}$"), F.lit(False)))
    return (F.col("event_type") == kind) & ~F.coalesce(sized & F.lower(F.col("data")).rlike(f"^0x[0-9a-f]{{{64 * data}}}$"), F.lit(False))


def _bad(kind: str, rules: list[Column]) -> Column:
    ok = F.lit(True)
    for rule in rules:
        ok = ok & rule
    return (F.col("event_type") == kind) & ~ok


def _padded(word: Column) -> Column:
    return F.substring(word, 1, 24) == "0" * 24


def decode_pool_logs(logs: DataFrame) -> DataFrame:
    """Initialize, Swap and ModifyLiquidity logs as one wide table; wide values stay words."""
    u, s, w = words.fits_unsigned, words.fits_signed, _word
    df = logs.withColumn("event_type", _kind(POOL_TOPICS))
    malformed = _shape("Initialize", 4, 5) | _shape("Swap", 3, 6) | _shape("ModifyLiquidity", 3, 4)
    outside = (
        _bad("Initialize", [_padded(_topic(2)), _padded(_topic(3)), u(w(0), 24), s(w(1), 24), _padded(w(2)), u(w(3), 160), s(w(4), 24)])
        | _bad("Swap", [_padded(_topic(2)), s(w(0), 128), s(w(1), 128), u(w(2), 160), u(w(3), 128), s(w(4), 24), u(w(5), 24)])
        | _bad("ModifyLiquidity", [_padded(_topic(2)), s(w(0), 24), s(w(1), 24)])
    )
    df = df.withColumn("error", F.when(F.col("event_type").isNull(), "unsupported_topic").when(malformed, "malformed_log").when(outside, "value_out_of_range"))
    good = F.col("error").isNull()
    is_ = lambda *kinds: good & F.col("event_type").isin(*kinds)
    pick = lambda **by: F.coalesce(*[F.when(is_(k), v) for k, v in by.items()])
    return df.select(
        *[c for c in logs.columns if c not in ("topics", "data")], "event_type", "error",
        F.when(good, F.concat(F.lit("0x"), _topic(1))).alias("pool_id"),
        F.when(is_("Swap", "ModifyLiquidity"), _address(_topic(2))).alias("sender"),
        F.when(is_("Initialize"), _address(_topic(2))).alias("currency0"), F.when(is_("Initialize"), _address(_topic(3))).alias("currency1"),
        pick(Initialize=words.to_long(w(0)), Swap=words.to_long(w(5))).alias("fee"), F.when(is_("Initialize"), words.to_long(w(1))).alias("tick_spacing"),
        F.when(is_("Initialize"), _address(w(2))).alias("hooks"), pick(Initialize=w(3), Swap=w(2)).alias("sqrt_price_x96"), pick(Initialize=words.to_long(w(4)), Swap=words.to_long(w(4))).alias("tick"),
        F.when(is_("Swap"), w(0)).alias("amount0"), F.when(is_("Swap"), w(1)).alias("amount1"), F.when(is_("Swap"), w(3)).alias("liquidity"),
        F.when(is_("ModifyLiquidity"), words.to_long(w(0))).alias("tick_lower"), F.when(is_("ModifyLiquidity"), words.to_long(w(1))).alias("tick_upper"), F.when(is_("ModifyLiquidity"), w(2)).alias("liquidity_delta"),
    )


def decode_launch_logs(logs: DataFrame, factory: str | None = None) -> DataFrame:
    """Launch, sweep, lock and graduation logs: token, deployer and the event's amounts as words in order."""
    df = logs.withColumn("event_type", _kind(LAUNCH_TOPICS))
    malformed = _shape("TokenLaunched", 4, 3) | _shape("LaunchSwept", 2, 2) | _shape("TokensLocked", 2, 1) | _shape("PoolGraduated", 2, 3)
    emitter = F.lit(False) if factory is None else F.coalesce(F.lower("address") != factory.lower(), F.lit(False))
    padding = ~_padded(_topic(1)) | ((F.col("event_type") == "TokenLaunched") & ~(_padded(_topic(2)) & _padded(_topic(3)) & _padded(_word(0))))
    df = df.withColumn("error", F.when(emitter, "unexpected_emitter").when(F.col("event_type").isNull(), "unsupported_topic").when(malformed, "malformed_log").when(padding, "value_out_of_range"))
    good, launched = F.col("error").isNull(), F.col("error").isNull() & (F.col("event_type") == "TokenLaunched")
    count = F.when(F.col("event_type") == "LaunchSwept", 2).when(F.col("event_type") == "TokensLocked", 1).otherwise(3)
    amounts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(F.lower(F.col("data")), 3 + 64 * i, F.lit(64)))
    return df.select(*[c for c in logs.columns if c not in ("topics", "data")], "event_type", "error", F.when(good, _address(_topic(1))).alias("token"), F.when(launched, _address(_topic(3))).alias("deployer"), F.when(good, amounts).alias("amounts"))


def decode_transfers(receipts: DataFrame, tx: str = "tx", logs: str = "logs") -> DataFrame:
    """(tx, position, asset, sender, recipient, amount word) of every well-formed Transfer log of the receipts."""
    # The outer form only keeps Spark from working the logs out a second time, to filter by their number; a null log isn't sound.
    one = receipts.select(tx, F.posexplode_outer(logs).alias("position", "log")).select(tx, "position", "log.*")
    sound = (F.lower(F.get("topics", F.lit(0))) == TRANSFER_TOPIC) & (F.size("topics") == 3) & F.lower(F.col("data")).rlike("^0x[0-9a-f]{64}$")
    return one.where(F.coalesce(sound, F.lit(False))).select(tx, "position", F.lower("address").alias("asset"), _address(_topic(1)).alias("sender"), _address(_topic(2)).alias("recipient"), _word(0).alias("amount"))
