"""Hand-made messages."""

from __future__ import annotations

import json

FIELDS = dict(
    uuid="u", blockType="share_found", serverId="EU-1", coinSymbol="ALPH", workerfull="w.a",
    shareDate=1734885835318, cHrate=0, aHrate=0, difficulty="0.002649", sharedif="0.003806",
    nonce="9c44", minerIp="127.0.0.1", isSolo=False, rewardMethod="PPLNS", cost="0.000000",
)


def message(**changes) -> str:
    return json.dumps({**FIELDS, **changes})


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def batch():
    """38 messages of 27 workers; one message is there 12 times."""
    single = [
        message(uuid=f"u{i}", workerfull=f"w{i % 9}.rig{i}", shareDate=1734885835318 + i * 1000,
                difficulty=f"0.00{i:02d}")
        for i in range(26)
    ]
    return single + [message(uuid="again", workerfull="w0.rig99")] * 12
