from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sharelode.operators import messages
from sharelode.sinks.messages import to_records
from shares import frame, message


def decoded(spark, *texts):
    return messages.decode(frame(spark, texts)).collect()


def test_decode(spark):
    (row,) = decoded(spark, message(extra=1))
    assert row.uuid == "u" and row.coin_symbol == "ALPH" and row.share_date_ms == 1734885835318
    assert row.is_solo is False and row.difficulty == "0.002649" and row.malformed is False


def test_missing_and_null_fields_get_zero_values_of_their_own_row(spark):
    full, empty, null = decoded(spark, message(), "{}", '{"uuid": null, "isSolo": null}')
    for row in (empty, null):
        assert (row.uuid, row.share_date_ms, row.is_solo, row.difficulty) == ("", 0, False, "")
        assert row.malformed is False
    assert full.uuid == "u"


@pytest.mark.parametrize("text", [
    "{broken", "[]", "", "text", '{"shareDate": "soon"}', None, "null", "{'uuid': 'u'}",
    message() + message(), message() + " x", message() + "}", message() + ',"x":' + message(),
    message() + "]", message() + "],[" + message(), message() + ',"end":true}', "[" + message() + "]",
    message(workerfull=7), message(workerfull={"x": 1}), message(nonce=["a"]), message(uuid=True),
    '{"\\u0075uid": 5}', '{"uuid": "a", "uuid": 5}', '{"uuid": "a", "\\u0075uid": "b"}', message(shareDate=1.5),
    message(shareDate=1 << 63), message(isSolo="true"), message(cHrate="1"), message(more=1, cost=2),
    message() + ",7]", message() + ",7],[8", message().replace(", ", ",").replace(": ", ":") + "}",
    '{"uuid":"a"}{"uuid":"b"}', '{"uuid":"a","uuid":"b"}', '{"uuid":"a""nonce":"b"}', '{"uuid":"a",}', '{"shareDate":012}',
    '{"uuid":"a\nb"}', '{"uuid":"a","cost":1}', '{"isSolo":truefalse}', '{"uuid":"a"}\n{', "{,}",
    '{"uuid": "a"', "7", '"text"', message() + ",",
])
def test_malformed(spark, text):
    (row,) = decoded(spark, text)
    assert row.malformed is True and row.malformed_text == text
    assert (row.uuid, row.share_date_ms, row.is_solo, row.workerfull) == ("", 0, False, "")


@pytest.mark.parametrize("text", [
    "  " + message() + "\n", message(other={"uuid": 5}), message(nonce='"uuid": 5'), message(more=[1, {"x": 2}]),
    message(**{"cost: BIGINT, x": None, "OBJECT<": 1, "a>": {"b": [1.5, None]}}), message(cHrate=None, nonce=None),
    message(shareDate=(1 << 63) - 1, aHrate=-5), '{"uuid":"u","shareDate":-7,"isSolo":true}', '{"cost":"{}","uuid":"u"}',
    '{"uuid":"u","nonce":"{\\"uuid\\":5}"}', '{"uuid":"u","nonce":"}{"}', '{"uuid":"u"}\n', '{"\\u0075uid": "u"}',
])
def test_well_formed(spark, text):
    (row,) = decoded(spark, text)
    assert row.malformed is False and row.uuid == "u" and row.malformed_text is None


def test_malformed_text_is_kept(spark):
    for text in ("{broken", message() + message(), message(workerfull=7)):
        (row,) = decoded(spark, text)
        assert row.malformed_text == text


def test_bytes_and_other_columns(spark):
    df = frame(spark, [message()]).select(F.col("value").cast("binary"), F.lit(7).alias("arrival"))
    row = messages.decode(df).first()
    assert row.uuid == "u" and row.arrival == 7


def test_encode_is_the_inverse_of_decode(spark):
    found = messages.decode(frame(spark, [message(), message(uuid="v", isSolo=True, cost="1.5")]))
    again = messages.decode(to_records(found).select("value"))
    assert again.collect() == found.collect()


def test_records_are_keyed_by_uuid(spark):
    header = F.array(F.struct(F.lit("k").alias("key"), F.lit(b"v").alias("value")))
    row = to_records(messages.decode(frame(spark, [message()])), header).first()
    assert row.key == "u" and row.headers[0].key == "k"


def test_projection_drops_what_a_share_does_not_keep(spark):
    share = messages.project_share(messages.decode(frame(spark, [message()])))
    assert share.columns == [
        "uuid", "server_id", "coin_id", "worker_id", "wallet_id", "share_date_ms", "difficulty",
        "sharedif", "nonce", "is_solo", "reward_method", "cost",
    ]
    assert share.select("coin_id", "worker_id", "wallet_id").first() == (0, 0, 0)


def test_typing(spark):
    share = messages.project_share(messages.decode(frame(spark, [message(cost="0.00124")])))
    row = messages.type_shares(share).withColumn(
        "share_date", F.col("share_date").cast("timestamp_ntz")
    ).first()
    assert row.share_date == datetime(2024, 12, 22, 16, 43, 55, 318000)
    assert row.difficulty == Decimal("0.0026490000")
    assert row.cost == Decimal("0.00124").quantize(Decimal(10) ** -20)


@pytest.mark.parametrize("field", ["difficulty", "sharedif", "cost"])
def test_one_bad_amount_fails_the_batch_whatever_the_ansi_setting(spark, field):
    texts = [message(), message(**{field: "much"})]
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            share = messages.project_share(messages.decode(frame(spark, texts)))
            with pytest.raises(Exception, match=f"bad {field}"):
                messages.type_shares(share).collect()
        finally:
            spark.conf.set("spark.sql.ansi.enabled", "true")
