"""Share messages: JSON text to columns and back, and the typed share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sharelode.functions.amounts import COST, DIFFICULTY, decimal_text, parse_decimal
from sharelode.functions.times import from_epoch_ms, to_epoch_ms
from sharelode.schemas import SHARE_COLUMNS, SHARE_FOUND, TEXT_LIMITS, WIRE_COLUMNS

_DEFAULTS = {"shareDate": 0, "cHrate": 0, "aHrate": 0, "isSolo": False}
_TYPES = {key: kind.upper() for key, kind in (f.split() for f in SHARE_FOUND.split(","))}
_VALUES = {"STRING": r'"[^"\\]*"', "BIGINT": r"-?\d{1,18}", "BOOLEAN": "(?:true|false)"}
# The text as a producer writes it: fields of a message in their order, each at most once,
# of the right kind, without spaces and escapes, and nothing before or behind.
_USUAL = r"^\{" + "".join(f'(?:"{key}":{_VALUES[kind]},?)?' for key, kind in _TYPES.items()) + r"\}$"
_CORRUPT = "_corrupt_record"


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Replace the JSON text in `value` by one column per message field.

    A missing or null field becomes its zero value. Keys are matched exactly. `malformed`
    marks text that is not one message: other text before or after it, a second object, a field
    of another type, a key that is there twice, single quotes, more than 16 MB. `malformed_text`
    holds it, and its fields have their zero values. Other columns of `messages` are kept.

    Every text is parsed once. One in the usual form goes straight to typed fields: the form
    leaves only its commas and numbers to check. Any other becomes a variant, which fields and
    their kinds are taken from.
    """
    kept = [c for c in messages.columns if c != value]
    usual = F.coalesce(F.col("_text").rlike(_USUAL), F.lit(False))
    typed = F.when(F.col("_usual"), F.from_json(
        "_text", f"{SHARE_FOUND}, {_CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    # A parser stops at the end of the first value. Behind the message stands a number
    # that depends on the whole text, so no text can bring it along and end early.
    mark = F.xxhash64("_text")
    listed = F.when(~F.col("_usual"), F.try_parse_json(
        F.concat(F.lit("["), F.col("_text"), F.lit(","), mark.cast("string"), F.lit("]"))))
    message = F.try_variant_get("_list", "$[0]", "variant")
    alone = F.try_variant_get("_list", "$[1]", "bigint") == mark
    whole = F.when(F.col("_usual"), F.col("_typed")[_CORRUPT].isNull()).otherwise(
        F.coalesce(F.col("_alone") & _right_kinds(F.col("_message")), F.lit(False)))
    other = F.when(F.col("_whole"), F.try_variant_get("_message", "$", f"struct<{SHARE_FOUND}>"))
    found = [
        F.when(F.col("_whole"), F.coalesce(F.col("_typed")[key], F.col("_other")[key], zero))
        .otherwise(zero).alias(name)
        for key, name in WIRE_COLUMNS.items() for zero in [F.lit(_DEFAULTS.get(key, ""))]
    ]
    return (
        messages.select(*kept, F.col(value).cast("string").alias("_text"))
        .select(*kept, "_text", usual.alias("_usual"))
        .select(*kept, "_text", "_usual", typed.alias("_typed"), listed.alias("_list"))
        .select(*kept, "_text", "_usual", "_typed", message.alias("_message"), alone.alias("_alone"))
        .select(*kept, "_text", "_typed", "_message", whole.alias("_whole"))
        .select(*kept, "_text", "_typed", "_whole", other.alias("_other"))
        .select(*kept, *found, (~F.col("_whole")).alias("malformed"),
                F.when(~F.col("_whole"), F.col("_text")).alias("malformed_text"))
    )


def _right_kinds(message: Column) -> Column:
    """Whether it is an object and its fields of a message have the right types; others may have any."""
    right = F.schema_of_variant(message).startswith("OBJECT<")
    for key, kind in _TYPES.items():
        own = F.schema_of_variant(F.try_variant_get(message, f"$.{key}", "variant"))
        right = right & F.coalesce(own, F.lit("VOID")).isin(kind, "VOID")
    return right


def encode(found: DataFrame) -> Column:
    """JSON text of a message, from the columns `decode` gives."""
    return F.to_json(F.struct(*[found[name].alias(key) for key, name in WIRE_COLUMNS.items()]))


def project_share(found: DataFrame) -> DataFrame:
    """The message fields a share keeps; its ids are still unset."""
    unset = F.lit(0).cast("bigint")
    return found.select(
        "uuid", "server_id", unset.alias("coin_id"), unset.alias("worker_id"),
        unset.alias("wallet_id"), "share_date_ms", "difficulty", "sharedif",
        "nonce", "is_solo", "reward_method", "cost",
    )


def typed_columns() -> dict[str, Column]:
    """The three amounts and the time of a share in their stored types."""
    return {
        "share_date": from_epoch_ms(F.col("share_date_ms")),
        "difficulty": parse_decimal(F.col("difficulty"), DIFFICULTY),
        "sharedif": parse_decimal(F.col("sharedif"), DIFFICULTY),
        "cost": parse_decimal(F.col("cost"), COST),
    }


def bad_amount() -> Column:
    """Name of the first amount that is not a number that fits, else NULL."""
    typed = typed_columns()
    return F.coalesce(
        *[
            F.when(typed[name].isNull(), F.lit(f"bad {name}"))
            for name in ("difficulty", "sharedif", "cost")
        ]
    )


def too_long() -> Column:
    """Name of the first field that does not fit its stored column, else NULL.

    A wallet's and a worker's name are parts of `workerfull`.
    """
    return F.coalesce(*[
        F.when(F.char_length(name) > size, F.lit(f"{name} too long")) for name, size in TEXT_LIMITS.items()
    ])


def arrival_order(found: DataFrame) -> Column:
    """A whole number by which messages came: time, then partition, then offset."""
    order = F.col("share_date_ms").cast("decimal(38,0)")
    if "arrival" not in found.columns:
        return order
    if not {"partition", "offset"} <= set(found.columns):
        return F.coalesce(F.col("arrival").cast("decimal(38,0)"), order)
    digits = F.concat(
        F.lpad(F.col("arrival").cast("string"), 16, "0"),
        F.lpad(F.coalesce("partition", F.lit(0)).cast("string"), 6, "0"),
        F.lpad(F.coalesce("offset", F.lit(0)).cast("string"), 16, "0"),
    )
    return F.coalesce(digits.cast("decimal(38,0)"), order)


def type_shares(shares: DataFrame) -> DataFrame:
    """Shares in the types of the stored table; an unparsable amount fails the job."""
    checked = enforce(shares.withColumn("reject_reason", bad_amount()))
    return checked.withColumns(typed_columns()).select(*SHARE_COLUMNS)


def share_text(shares: DataFrame, trim_zeros: bool = False) -> DataFrame:
    """Stored shares with their time in milliseconds and their amounts as text."""
    return shares.select(
        "uuid", "server_id", "coin_id", "worker_id", "wallet_id",
        to_epoch_ms(F.col("share_date")).alias("share_date_ms"),
        *[decimal_text(F.col(c), trim_zeros).alias(c) for c in ("difficulty", "sharedif")],
        "nonce", "is_solo", "reward_method",
        decimal_text(F.col("cost"), trim_zeros).alias("cost"),
    )


def enforce(judged: DataFrame) -> DataFrame:
    """Fail the job at the first row with a `reject_reason`, and drop that column."""
    stop = F.raise_error(
        F.concat(F.lit("share '"), F.col("uuid"), F.lit("': "), F.col("reject_reason"))
    ).cast("boolean")
    passed = F.when(F.col("reject_reason").isNull(), F.lit(True)).otherwise(stop)
    return judged.filter(passed).drop("reject_reason")
