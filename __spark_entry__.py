"""Queries over the driver's tables, and the SQL each must agree with.

The tables hold no shares, so views give `events` and `lineitem` the shape of
shares. Every query reads a whole table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from sharelode.functions.amounts import decimal_text
from sharelode.functions.headers import headers_map
from sharelode.functions.names import wallet_name, worker_name
from sharelode.functions.times import bucket_start, month_key, to_epoch_ms
from sharelode.operators import analytics, hashrate, lookup, members, messages
from sharelode.plans import ingest, sums
from sharelode.schemas import WALLET_KEY, WALLETS, WORKER_KEY, WORKERS
from sharelode.session import configure, settle, shared_dir
from sharelode.sinks import compaction, tables as sinks
from sharelode.sinks.messages import publish_to_files, to_records
from sharelode.sources import progress
from sharelode.sources.messages import file_batch, file_stream
from sharelode.sources.tables import empty_table, read_dimension, read_shares, seed_coins
from sharelode.streaming.job import Tables, ingest_batch, start_ingest

START = datetime(2024, 1, 1)
END = datetime(2024, 2, 1)
# Wallets and workers seen before this moment are the known ones.
FIRST_DAY = datetime(2024, 1, 2)


# --- views ------------------------------------------------------------------

EVENTS = """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
    value double, props string"""
LINEITEM = """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
    l_quantity double, l_extendedprice double, l_discount double, l_tax double,
    l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as decoded share messages; `arrival` is their order."""
    return events(spark, sf_dir).selectExpr(
        "event_id AS arrival",
        "cast(event_id AS string) AS uuid",
        "'share_found' AS block_type",
        "concat('EU-', cast(event_id % 3 AS string)) AS server_id",
        """CASE event_type WHEN 'view' THEN 'ALPH' WHEN 'click' THEN 'KAS'
             WHEN 'purchase' THEN 'NEXA' WHEN 'signup' THEN 'DNX' ELSE 'HYP' END AS coin_symbol""",
        "concat('wallet', cast(user_id % 50 AS string), '.rig', cast(user_id AS string)) AS workerfull",
        "unix_millis(cast(ts AS timestamp)) AS share_date_ms",
        "user_id AS c_hrate",
        "event_id AS a_hrate",
        "cast(cast(value AS decimal(12,2)) AS string) AS difficulty",
        "cast(cast(value AS decimal(12,2)) * 3 AS string) AS sharedif",
        "md5(cast(event_id AS string)) AS nonce",
        "concat('10.0.0.', cast(event_id % 7 AS string)) AS miner_ip",
        "user_id % 4 = 0 AS is_solo",
        "CASE WHEN user_id % 4 = 0 THEN 'SOLO' ELSE 'PPLNS' END AS reward_method",
        "cast(cast(cast(value AS decimal(12,2)) * 0.01 AS decimal(12,4)) AS string) AS cost",
        "false AS malformed",
    )


MESSAGES_SQL = """
    SELECT event_id AS arrival, cast(event_id AS varchar) AS uuid,
      'share_found' AS block_type,
      'EU-' || cast(event_id % 3 AS varchar) AS server_id,
      CASE event_type WHEN 'view' THEN 'ALPH' WHEN 'click' THEN 'KAS'
        WHEN 'purchase' THEN 'NEXA' WHEN 'signup' THEN 'DNX' ELSE 'HYP' END AS coin_symbol,
      CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 8
        WHEN 'purchase' THEN 9 WHEN 'signup' THEN 10 ELSE 11 END::bigint AS coin_id,
      'wallet' || cast(user_id % 50 AS varchar) || '.rig' || cast(user_id AS varchar) AS workerfull,
      'wallet' || cast(user_id % 50 AS varchar) AS name,
      'rig' || cast(user_id AS varchar) AS worker,
      epoch_us(ts) // 1000 AS share_date_ms, date_trunc('milliseconds', ts) AS share_date,
      user_id AS c_hrate, event_id AS a_hrate,
      cast(cast(value AS decimal(12,2)) AS varchar) AS difficulty,
      cast(cast(value AS decimal(12,2)) * 3 AS varchar) AS sharedif,
      md5(cast(event_id AS varchar)) AS nonce,
      '10.0.0.' || cast(event_id % 7 AS varchar) AS miner_ip,
      user_id % 4 = 0 AS is_solo,
      CASE WHEN user_id % 4 = 0 THEN 'SOLO' ELSE 'PPLNS' END AS reward_method,
      cast(cast(cast(value AS decimal(12,2)) * 0.01 AS decimal(12,4)) AS varchar) AS cost
    FROM events
"""


def event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as stored shares with ids."""
    return events(spark, sf_dir).selectExpr(
        "cast(event_id AS string) AS uuid",
        """cast(CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 8
             WHEN 'purchase' THEN 9 WHEN 'signup' THEN 10 ELSE 11 END AS bigint) AS coin_id""",
        "user_id % 50 + 1 AS wallet_id",
        "user_id + 1 AS worker_id",
        "ts AS share_date",
        "CASE WHEN user_id % 4 = 0 THEN 'SOLO' ELSE 'PPLNS' END AS reward_method",
        "cast(cast(value AS decimal(12,2)) AS decimal(25,10)) AS difficulty",
    )


SHARES_SQL = """
    SELECT cast(event_id AS varchar) AS uuid,
      CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 8
        WHEN 'purchase' THEN 9 WHEN 'signup' THEN 10 ELSE 11 END::bigint AS coin_id,
      user_id % 50 + 1 AS wallet_id, user_id + 1 AS worker_id, ts AS share_date,
      CASE WHEN user_id % 4 = 0 THEN 'SOLO' ELSE 'PPLNS' END AS reward_method,
      cast(cast(value AS decimal(12,2)) AS decimal(25,10)) AS difficulty
    FROM events
"""


def item_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as typed shares of seven years; their uuids repeat."""
    items = configure(spark).read.schema(LINEITEM).parquet(f"{sf_dir}/lineitem.parquet")
    return items.selectExpr(
        "concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS uuid",
        "concat('EU-', cast(l_linenumber AS string)) AS server_id",
        "cast(CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 8 ELSE 9 END AS bigint) AS coin_id",
        "l_partkey AS worker_id",
        "l_suppkey AS wallet_id",
        "cast(l_shipdate AS timestamp) AS share_date",
        "cast(cast(l_extendedprice AS decimal(12,2)) AS decimal(25,10)) AS difficulty",
        "cast(cast(l_quantity AS decimal(12,2)) AS decimal(25,10)) AS sharedif",
        "md5(cast(l_orderkey AS string)) AS nonce",
        "l_linestatus = 'F' AS is_solo",
        "CASE WHEN l_linestatus = 'F' THEN 'SOLO' ELSE 'PPLNS' END AS reward_method",
        "cast(cast(l_tax AS decimal(12,2)) AS decimal(30,20)) AS cost",
    )


ITEMS_SQL = """
    SELECT cast(l_orderkey AS varchar) || '-' || cast(l_linenumber AS varchar) AS uuid,
      'EU-' || cast(l_linenumber AS varchar) AS server_id,
      CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 8 ELSE 9 END::bigint AS coin_id,
      l_partkey AS worker_id, l_suppkey AS wallet_id, l_shipdate AS share_date,
      cast(cast(l_extendedprice AS decimal(12,2)) AS decimal(25,10)) AS difficulty,
      cast(cast(l_quantity AS decimal(12,2)) AS decimal(25,10)) AS sharedif,
      md5(cast(l_orderkey AS varchar)) AS nonce, l_linestatus = 'F' AS is_solo,
      CASE WHEN l_linestatus = 'F' THEN 'SOLO' ELSE 'PPLNS' END AS reward_method,
      cast(cast(l_tax AS decimal(12,2)) AS decimal(30,20)) AS cost
    FROM lineitem
"""

# A sum leaves as text and is read as a double, so both sides round once.
SUM_SQL = "cast(cast(sum(difficulty) AS varchar) AS double)"


def _bucket_sql(seconds: int, column: str = "share_date") -> str:
    width = seconds * 1_000_000
    return f"make_timestamp(epoch_us({column}) // {width} * {width})"


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _plain(shares: DataFrame) -> DataFrame:
    """Stored shares in types both engines print alike."""
    text = {c: decimal_text(F.col(c)) for c in ("difficulty", "sharedif", "cost")}
    return shares.withColumns({**text, "share_date": F.col("share_date").cast("timestamp_ntz")})


def _known_wallets(found: DataFrame) -> DataFrame:
    """The wallets table as it is after the first day."""
    spark = found.sparkSession
    early = lookup.coin_ids(found, seed_coins(spark)).filter(_is_early())
    made = members.get_or_create_wallets(early, empty_table(spark, WALLETS), "arrival")
    path = _scratch(spark, "wallets")
    sinks.append_dimension(made.created, path, 0)
    return read_dimension(spark, path, WALLETS)


def _known_workers(found: DataFrame) -> DataFrame:
    """The workers table as it is after the first day."""
    spark = found.sparkSession
    early = lookup.coin_ids(found, seed_coins(spark)).filter(_is_early())
    made = members.get_or_create_workers(early, empty_table(spark, WORKERS), "arrival")
    path = _scratch(spark, "workers")
    sinks.append_dimension(made.created, path, 0)
    return read_dimension(spark, path, WORKERS)


def _is_early():
    return F.col("share_date_ms") < int((FIRST_DAY - datetime(1970, 1, 1)).total_seconds() * 1000)


def _ids_sql(kind: str, key: str, attributes: str) -> str:
    """CTEs: `m` messages, `{kind}_known` of the first day, `{kind}_all` with new ones."""
    hashed = f"md5(concat_ws('|', {key}))"
    return f"""
      {kind}_known AS (
        SELECT *, row_number() OVER (ORDER BY {hashed}, {key}) AS id
        FROM (SELECT {key}, {attributes} FROM m
              WHERE share_date_ms < epoch_ms(TIMESTAMP '{FIRST_DAY}') GROUP BY {key})),
      {kind}_all AS (
        SELECT *, false AS is_new FROM {kind}_known
        UNION ALL
        SELECT *, (SELECT max(id) FROM {kind}_known)
                  + row_number() OVER (ORDER BY {hashed}, {key}) AS id, true AS is_new
        FROM (SELECT {key}, {attributes} FROM m
              WHERE ({key}) NOT IN (SELECT ({key}) FROM {kind}_known) GROUP BY {key}))
    """


WALLET_IDS_SQL = _ids_sql("wallet", "name, coin_id, reward_method",
                          "arg_min(is_solo, arrival) AS is_solo")
WORKER_IDS_SQL = _ids_sql(
    "worker", "workerfull, coin_id, reward_method",
    "min(name) AS wallet, min(worker) AS worker, arg_min(server_id, arrival) AS server_id, "
    "arg_min(miner_ip, arrival) AS ip, arg_min(is_solo, arrival) AS is_solo",
)


# --- decoding and projections -----------------------------------------------

def headers_map_query(spark, sf_dir):
    """Message headers with a repeated key, as a map."""
    def header(key, value):
        return F.struct(F.lit(key).alias("key"), value.cast("binary").alias("value"))

    listed = F.array(
        header("trace", F.col("event_type")),
        header("user", F.col("user_id").cast("string")),
        header("trace", F.md5(F.col("event_id").cast("string"))),
    )
    found = events(spark, sf_dir).select("event_id", headers_map(listed).alias("h"))
    return found.select(
        "event_id", F.col("h")["trace"].alias("trace"), F.col("h")["user"].alias("user_header"),
        F.size("h").alias("n_headers"),
    )


WIRE = [
    "uuid", "block_type", "server_id", "coin_symbol", "workerfull", "share_date_ms", "c_hrate",
    "a_hrate", "difficulty", "sharedif", "nonce", "miner_ip", "is_solo", "reward_method", "cost",
]


def decode_share_json(spark, sf_dir):
    records = to_records(event_messages(spark, sf_dir)).select("value")
    return messages.decode(records).select(*WIRE, "malformed")


def share_to_json(spark, sf_dir):
    """Messages written as JSON lines and read back."""
    folder = _scratch(spark, "messages")
    publish_to_files(to_records(event_messages(spark, sf_dir)), folder)
    return messages.decode(file_batch(spark, folder)).select(*WIRE)


def message_defaults(spark, sf_dir):
    """Messages that lack fields (no key for the nulls) get zero values, row by row."""
    found = event_messages(spark, sf_dir)
    gone = F.col("event_type_missing")
    found = found.withColumn("event_type_missing", F.col("coin_symbol") == "HYP")
    partial = found.withColumns({
        c: F.when(~gone, F.col(c)) for c in ("share_date_ms", "miner_ip", "is_solo", "cost")
    })
    records = partial.select(messages.encode(partial).alias("value"))
    return messages.decode(records).select("uuid", "share_date_ms", "miner_ip", "is_solo", "cost")


def strict_messages(spark, sf_dir):
    """Texts that are one message, and texts that only begin like one."""
    source = event_messages(spark, sf_dir)
    clean = messages.encode(source)
    uuid = F.col("uuid")
    forms = [
        clean,
        F.concat(clean, F.lit(" x")),
        F.concat(clean, clean),
        F.concat(clean, F.lit(","), clean),
        F.concat(F.lit('{"uuid":"'), uuid, F.lit('","workerfull":7}')),
        F.concat(F.lit('{"workerfull" : {"x":1},"uuid":"'), uuid, F.lit('"}')),
        F.concat(F.lit("{'uuid':'"), uuid, F.lit("'}")),
        F.concat(clean, F.lit(',"x":'), clean),
        F.concat(F.lit("  "), clean, F.lit("\n")),
        F.concat(clean, F.lit("}")),
        F.concat(clean, F.lit(',"end":true}{')),
        F.concat(F.lit('{"nonce":"\\"uuid\\": 5","uuid":"'), uuid, F.lit('"}')),
        F.concat(F.lit('{"other":{"uuid":5},"uuid":"'), uuid, F.lit('"}')),
    ]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(F.col("arrival") % len(forms) == i, form).otherwise(text)
    sent = source.select(F.col("arrival").alias("event_id"), text.alias("value"), text.alias("sent"))
    found = messages.decode(sent)
    good = ~F.col("malformed")
    return found.select(
        "event_id", "malformed", F.when(good, F.col("uuid")).alias("uuid"),
        (F.col("malformed_text") == F.col("sent")).alias("text_kept"))


def wallet_worker_split(spark, sf_dir):
    """Names with none, one and two dots."""
    user = F.col("user_id").cast("string")
    full = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("w"), user))
        .when(F.col("event_type") == "click", F.concat(F.lit("w"), user, F.lit(".a.b")))
        .when(F.col("event_type") == "signup", F.lit(""))
        .otherwise(F.concat(F.lit("w"), user, F.lit(".rig"), user))
    )
    named = events(spark, sf_dir).select("event_id", full.alias("workerfull"))
    return named.select(
        "event_id", "workerfull",
        wallet_name(F.col("workerfull")).alias("wallet"),
        worker_name(F.col("workerfull")).alias("worker"),
    )


def share_projection(spark, sf_dir):
    return messages.project_share(event_messages(spark, sf_dir))


def share_typing(spark, sf_dir):
    typed = messages.type_shares(
        messages.project_share(event_messages(spark, sf_dir))
    )
    return _plain(typed)


def share_row_text(spark, sf_dir):
    """Amounts as text and the time as milliseconds, for every share."""
    typed = messages.type_shares(messages.project_share(event_messages(spark, sf_dir)))
    trimmed = decimal_text(F.col("cost").cast("decimal(30,20)"), trim_zeros=True)
    return messages.share_text(typed).withColumn("cost_trimmed", trimmed)


def time_buckets(spark, sf_dir):
    """Bucket starts of every share for widths that do and do not divide a day."""
    shares = event_shares(spark, sf_dir).select("uuid", "share_date")
    minutes = shares.withColumn("minute", bucket_start(F.col("share_date"), 60))
    return minutes.withColumn("seven", bucket_start(F.col("share_date"), 7)).drop("share_date")


# --- lookups ----------------------------------------------------------------

def coin_id_lookup(spark, sf_dir):
    coins = seed_coins(spark)
    found = lookup.coin_ids(event_messages(spark, sf_dir), coins)
    values = ["average_round_diff", "coins_in_block", "current_effort"]
    found = lookup.attach(found, coins.withColumnRenamed("id", "coin_id"), ["coin_id"], values)
    text = [decimal_text(F.col(c)).alias(c) for c in values]
    return found.select("uuid", "coin_symbol", "coin_id", *text)


def wallet_id_lookup(spark, sf_dir):
    found = event_messages(spark, sf_dir)
    named = lookup.coin_ids(found, seed_coins(spark)).withColumn(
        "name", wallet_name(F.col("workerfull"))
    )
    ids = lookup.known_ids(named, _known_wallets(found), WALLET_KEY, "wallet_id")
    return ids.select("uuid", *WALLET_KEY, "wallet_id")


def worker_id_lookup(spark, sf_dir):
    found = event_messages(spark, sf_dir)
    named = lookup.coin_ids(found, seed_coins(spark))
    ids = lookup.known_ids(named, _known_workers(found), WORKER_KEY, "worker_id")
    return ids.select("uuid", *WORKER_KEY, "worker_id")


def wallet_get_or_create(spark, sf_dir):
    found = event_messages(spark, sf_dir)
    named = lookup.coin_ids(found, seed_coins(spark))
    made = members.get_or_create_wallets(named, _known_wallets(found), "arrival")
    return made.ids.join(made.created.select("id", "is_solo"), "id", "left").select(
        *WALLET_KEY, "id", "is_new", "is_solo"
    )


def worker_get_or_create(spark, sf_dir):
    found = event_messages(spark, sf_dir)
    named = lookup.coin_ids(found, seed_coins(spark))
    made = members.get_or_create_workers(named, _known_workers(found), "arrival")
    rows = made.created.select("id", "wallet", "worker", "server_id", "ip", "is_solo")
    return made.ids.join(rows, "id", "left").select(*WORKER_KEY, "is_new", *rows.columns)


def normalize_shares(spark, sf_dir):
    found = event_messages(spark, sf_dir)
    result = ingest.normalize(
        found, seed_coins(spark), _known_wallets(found), _known_workers(found)
    )
    return _plain(result.shares)


def rejected_shares(spark, sf_dir):
    """Messages that cannot be stored, by reason; the others become shares."""
    found = event_messages(spark, sf_dir).withColumn(
        "coin_symbol", F.when(F.col("coin_symbol") == "HYP", "hyp").otherwise(F.col("coin_symbol"))
    ).withColumn(
        "cost", F.when(F.col("reward_method") == "SOLO", "none").otherwise(F.col("cost"))
    )
    found = found.withColumn("server_id", F.when(
        F.col("server_id") == "EU-2", F.repeat(F.lit("s"), 33)).otherwise(F.col("server_id")))
    found = found.withColumn("workerfull", F.when(
        F.col("c_hrate") % 5 == 0, F.repeat(F.lit("w"), 256)).otherwise(F.col("workerfull")))
    text = F.when(F.col("coin_symbol") == "DNX", F.lit("{broken")).otherwise(messages.encode(found))
    result = ingest.normalize_messages(
        found.select(text.alias("value")), seed_coins(spark), empty_table(spark, WALLETS),
        empty_table(spark, WORKERS), on_error=ingest.QUARANTINE,
    )
    bad = result.rejected.groupBy("reject_reason").agg(F.count("*").alias("n"))
    good = result.shares.agg(F.lit("stored").alias("reject_reason"), F.count("*").alias("n"))
    return bad.unionByName(good)


# --- filters and aggregations -----------------------------------------------

def share_by_uuid(spark, sf_dir):
    return analytics.share_by_uuid(event_shares(spark, sf_dir), "123").withColumn(
        "difficulty", decimal_text(F.col("difficulty"))
    )


RANGE_START = datetime(2024, 1, 3, 7, 30)


def range_difficulty_sum(spark, sf_dir):
    return analytics.range_difficulty_sum(
        event_shares(spark, sf_dir), RANGE_START, END, 4, "PPLNS"
    )


def range_difficulty_sum_empty(spark, sf_dir):
    return analytics.range_difficulty_sum(event_shares(spark, sf_dir), START, END, 4, "PPS")


def interval_global(spark, sf_dir):
    return analytics.interval_global(event_shares(spark, sf_dir), START, END, 3600, 4, "PPLNS")


def interval_global_minutes(spark, sf_dir):
    return analytics.interval_global(event_shares(spark, sf_dir), START, END, 60, 4, "SOLO")


def interval_global_years(spark, sf_dir):
    """Days of seven years of shares."""
    return analytics.interval_global(
        item_shares(spark, sf_dir), datetime(1995, 1, 1), datetime(2002, 1, 1), 86400, 4, "SOLO"
    ).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def interval_wallet(spark, sf_dir):
    return analytics.interval_wallet(event_shares(spark, sf_dir), START, END, 3600, 4, 8, "PPLNS")


def interval_worker(spark, sf_dir):
    return analytics.interval_worker(event_shares(spark, sf_dir), START, END, 3600, 4, 8, "PPLNS")


def interval_wallet_and_worker(spark, sf_dir):
    return analytics.interval_group(
        event_shares(spark, sf_dir), START, END, 3600, 8, "PPLNS", wallet_id=8, worker_id=8
    )


def interval_series(spark, sf_dir):
    """The two lists of each span, side by side again as rows with their position."""
    return _points(analytics.interval_series(
        event_shares(spark, sf_dir), START, END, 3600, 4, "PPLNS", points=100))


def interval_series_seconds(spark, sf_dir):
    """A month in buckets of a second."""
    return _points(analytics.interval_series(event_shares(spark, sf_dir), START, END, 1, 4, "PPLNS"))


def _points(series):
    zipped = series.select("part", F.posexplode(F.arrays_zip("times", "sums")).alias("pos", "point"))
    return zipped.select(
        "part", "pos", F.col("point.times").alias("time"), F.col("point.sums").alias("sum"))


AS_OF = datetime(2024, 1, 20)
WINDOW = 14 * 86400


def coin_hashrate(spark, sf_dir):
    return hashrate.coin_hashrate(
        event_shares(spark, sf_dir), seed_coins(spark), "alph", AS_OF, WINDOW, 4294967296.0
    )


def wallet_hashrate(spark, sf_dir):
    return hashrate.wallet_hashrate(event_shares(spark, sf_dir), 8, AS_OF, WINDOW, 65536.0)


def worker_hashrate(spark, sf_dir):
    return hashrate.worker_hashrate(event_shares(spark, sf_dir), 8, AS_OF, WINDOW, 65536.0)


# --- storage and streaming --------------------------------------------------

def _stored_items(spark, sf_dir) -> str:
    path = _scratch(spark, "shares")
    sinks.append_shares(item_shares(spark, sf_dir), path, 0)
    return path


def batch_insert(spark, sf_dir):
    """All messages as one batch of typed shares, appended and counted per folder."""
    path = _scratch(spark, "shares")
    typed = messages.type_shares(messages.project_share(event_messages(spark, sf_dir)))
    sinks.append_shares(typed, path, 7)
    stored = read_shares(spark, path, keep_layout=True)
    return stored.groupBy("share_month", "ingest_batch").agg(
        F.count("*").alias("cnt"), F.sum("difficulty").cast("double").alias("sumdif"),
        F.max(to_epoch_ms(F.col("share_date"))).alias("last_ms"),
    )


def share_roundtrip(spark, sf_dir):
    """All shares written by month, twice under one batch number, and read back."""
    path = _stored_items(spark, sf_dir)
    sinks.append_shares(item_shares(spark, sf_dir), path, 0)
    return _plain(read_shares(spark, path))


def share_month_counts(spark, sf_dir):
    stored = read_shares(spark, _stored_items(spark, sf_dir), keep_layout=True)
    return stored.groupBy("share_month").agg(
        F.count("*").alias("cnt"),
        F.sum((month_key(F.col("share_date")) != F.col("share_month")).cast("bigint")).alias("misplaced"),
    )


def stored_range_scan(spark, sf_dir):
    """A range sum over the stored table, reading only the months of the range."""
    stored = read_shares(spark, _stored_items(spark, sf_dir), STORED_START, STORED_END)
    return analytics.range_difficulty_sum(stored, STORED_START, STORED_END, 8, "PPLNS")


STORED_START, STORED_END = datetime(1998, 2, 27), datetime(1999, 5, 1)


def stored_share_by_uuid(spark, sf_dir):
    """The shares of the uuid that comes first, found in the stored table by its bloom filters."""
    first = item_shares(spark, sf_dir).agg(F.min("uuid")).first()[0]
    found = read_shares(spark, _stored_items(spark, sf_dir)).filter(F.col("uuid") == first)
    return _plain(found)


def stored_interval_wallet(spark, sf_dir):
    stored = read_shares(spark, _stored_items(spark, sf_dir), STORED_START, STORED_END)
    found = analytics.interval_wallet(stored, STORED_START, STORED_END, 86400, 8, 3, "PPLNS")
    return found.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def stored_coin_hashrate(spark, sf_dir):
    """Hashrate over the last 400 days of the period."""
    stored = read_shares(spark, _stored_items(spark, sf_dir), STORED_START, STORED_END)
    return hashrate.coin_hashrate(stored, seed_coins(spark), "kas", STORED_END, 400 * 86400, 65536.0)


def _stored_sums(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The shares of `events` as stored in two batches, one of them twice, and their partial sums."""
    shares = event_shares(spark, sf_dir).withColumns({
        "share_date": F.col("share_date").cast("timestamp"), "server_id": F.lit("EU-1"), "nonce": F.lit(""),
        "sharedif": F.col("difficulty"), "cost": F.lit(0).cast("decimal(30,20)"),
        "is_solo": F.col("reward_method") == "SOLO",
    })
    stored, partial = _scratch(spark, "shares"), _scratch(spark, "sums")
    odd = F.col("uuid").cast("bigint") % 3 == 0
    for batch, rows in ((0, shares.filter(odd)), (1, shares.filter(~odd)), (0, shares.filter(odd))):
        sinks.append_shares(rows, stored, batch)
        sums.append_sums(rows, partial, batch)
    return sums.read_sums(spark, partial, SUMS_START, SUMS_END), read_shares(spark, stored, SUMS_START, SUMS_END)


# Neither end is a whole minute.
SUMS_START, SUMS_END = datetime(2024, 1, 3, 7, 30, 13, 500_000), datetime(2024, 1, 29, 11, 59, 58, 250_000)


def sums_range_difficulty(spark, sf_dir):
    """The difficulty of a range, from partial sums and the shares at its ends."""
    return sums.range_difficulty_sum(*_stored_sums(spark, sf_dir), SUMS_START, SUMS_END, 4, "PPLNS")


def sums_interval_wallet(spark, sf_dir):
    found = sums.interval_wallet(*_stored_sums(spark, sf_dir), SUMS_START, SUMS_END, 1800, 4, 8, "PPLNS")
    return found.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def sums_interval_global_years(spark, sf_dir):
    """Days of seven years, from partial sums."""
    partial = _scratch(spark, "sums")
    shares = item_shares(spark, sf_dir)
    sums.append_sums(shares, partial, 0)
    found = sums.interval_global(
        sums.read_sums(spark, partial, YEARS_START, YEARS_END), shares, YEARS_START, YEARS_END, 86400, 4, "SOLO")
    return found.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


YEARS_START, YEARS_END = datetime(1995, 1, 1), datetime(2002, 1, 1)


def replay_progress(spark, sf_dir):
    """What batches of a topic have stored, by partition, and the offsets they lack or have twice.

    Messages of `events` lie in five partitions. Batches of 150 offsets hold all but every
    seventh; every ninth reads 40 offsets of the one before again.
    """
    place = events(spark, sf_dir).select(
        F.lit("shares").alias("topic"), (F.col("event_id") % 5).cast("int").alias("partition"),
        F.expr("event_id div 5").alias("offset"))
    batch = F.expr("offset div 150")
    first = place.withColumn("ingest_batch", batch)
    again = place.filter(F.col("offset") % 150 >= 110).withColumn("ingest_batch", batch + 1).filter("ingest_batch % 9 = 4")
    read = first.unionByName(again).filter("(ingest_batch + partition) % 7 != 3")
    path = _scratch(spark, "progress")
    rows = progress.batch_progress(read, "ingest_batch")
    sinks.replace_batch(sinks.by_batch(rows)).partitionBy("ingest_batch").parquet(path)
    # The files of all batches are opened once.
    known = settle(progress.read_progress(spark, path).hint("rebalance"))
    listed = progress.breaks(known).groupBy("topic", "partition").agg(
        F.count_if(F.col("kind") == progress.GAP).alias("gaps"),
        F.count_if(F.col("kind") == progress.OVERLAP).alias("overlapping"),
        F.sum(F.when(F.col("kind") == progress.OVERLAP, F.col("to_offset") - F.col("from_offset") + 1)).alias("twice"))
    return (
        progress.folded(known).join(listed, ["topic", "partition"], "left")
        .join(progress.next_offsets(known, first_gap=True), ["topic", "partition"])
        .withColumns({name: F.coalesce(name, F.lit(0).cast("bigint")) for name in ("gaps", "overlapping", "twice")})
    )


def compacted_scan(spark, sf_dir):
    """Months of a table, before and after one of them moved to the archive."""
    live, archive, archived = (_scratch(spark, n) for n in ("shares", "archive", "archived"))
    shares = item_shares(spark, sf_dir)
    for batch, solo in enumerate((True, False)):
        sinks.append_shares(shares.filter(F.col("is_solo") == solo), live, batch)
    compaction.create_archive(spark, archive, archived)
    compaction.compact_month(spark, live, archive, archived, 199803, 0)
    compaction.compact_month(spark, live, archive, archived, 199803, 1)
    compaction.compact_month(spark, live, archive, archived, 199804, 0)
    return compaction.read_compacted(spark, live, archive, archived).groupBy(
        month_key(F.col("share_date")).alias("share_month"), "reward_method"
    ).agg(F.count("*").alias("cnt"), F.sum("difficulty").cast("double").alias("sumdif"))


def stream_ingest(spark, sf_dir):
    """The ingest job over files of messages in several micro-batches.

    Ids depend on how messages fall into batches, so the names behind them are
    shown; every id must lead to exactly one name.
    """
    folder, root = _scratch(spark, "messages"), _scratch(spark, "pool")
    found = event_messages(spark, sf_dir)
    publish_to_files(to_records(found.repartition(4, "uuid")), folder)
    pool = Tables(root).create(configure(spark))
    job = start_ingest(
        file_stream(spark, folder, files_per_batch=2), pool, seed_coins(spark),
        f"{root}/checkpoint", trigger={"availableNow": True},
    )
    job.awaitTermination()
    wallets = read_dimension(spark, pool.wallets, WALLETS).select(
        F.col("id").alias("wallet_id"), F.col("name").alias("wallet"),
        F.col("coin_id").alias("wallet_coin"),
    )
    workers = read_dimension(spark, pool.workers, WORKERS).select(
        F.col("id").alias("worker_id"), "workerfull", F.col("coin_id").alias("worker_coin"),
    )
    shares = _plain(read_shares(spark, pool.shares))
    return (
        shares.join(wallets, "wallet_id").join(workers, "worker_id")
        .select("uuid", "coin_id", "wallet_coin", "worker_coin", "wallet", "workerfull",
                "reward_method", "share_date", "difficulty", "cost")
    )


def backfill_ingest(spark, sf_dir):
    """The same tables loaded in one bulk batch, written twice."""
    pool = Tables(_scratch(spark, "pool")).create(configure(spark))
    records = to_records(event_messages(spark, sf_dir)).select("value")
    for _ in range(2):
        ingest_batch(records, 0, pool, seed_coins(spark))
    return read_shares(spark, pool.shares).groupBy("wallet_id", "worker_id", "coin_id").agg(
        F.count("*").alias("cnt"), F.sum("difficulty").cast("double").alias("sumdif")
    )


# --- contract ---------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    return interval_global(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**share_queries(), **_text_part("queries")}


def oracle_sql() -> dict[str, str]:
    return {**share_sql(), **_text_part("oracle_sql")}


def _text_part(what: str) -> dict:
    """What the subpackage for training text adds, if it is there."""
    try:
        from sharelode.llm import queries as text_queries
    except ImportError:
        return {}
    return getattr(text_queries, what)()


def share_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "headers_map": headers_map_query,
        "decode_share_json": decode_share_json,
        "share_to_json": share_to_json,
        "message_defaults": message_defaults,
        "strict_messages": strict_messages,
        "wallet_worker_split": wallet_worker_split,
        "share_projection": share_projection,
        "share_typing": share_typing,
        "share_row_text": share_row_text,
        "time_buckets": time_buckets,
        "coin_id_lookup": coin_id_lookup,
        "wallet_id_lookup": wallet_id_lookup,
        "worker_id_lookup": worker_id_lookup,
        "wallet_get_or_create": wallet_get_or_create,
        "worker_get_or_create": worker_get_or_create,
        "normalize_shares": normalize_shares,
        "rejected_shares": rejected_shares,
        "share_by_uuid": share_by_uuid,
        "range_difficulty_sum": range_difficulty_sum,
        "range_difficulty_sum_empty": range_difficulty_sum_empty,
        "interval_global": interval_global,
        "interval_global_minutes": interval_global_minutes,
        "interval_global_years": interval_global_years,
        "interval_wallet": interval_wallet,
        "interval_worker": interval_worker,
        "interval_wallet_and_worker": interval_wallet_and_worker,
        "interval_series": interval_series,
        "interval_series_seconds": interval_series_seconds,
        "coin_hashrate": coin_hashrate,
        "wallet_hashrate": wallet_hashrate,
        "worker_hashrate": worker_hashrate,
        "batch_insert": batch_insert,
        "share_roundtrip": share_roundtrip,
        "share_month_counts": share_month_counts,
        "stored_range_scan": stored_range_scan,
        "stored_share_by_uuid": stored_share_by_uuid,
        "stored_interval_wallet": stored_interval_wallet,
        "stored_coin_hashrate": stored_coin_hashrate,
        "sums_range_difficulty": sums_range_difficulty,
        "sums_interval_wallet": sums_interval_wallet,
        "sums_interval_global_years": sums_interval_global_years,
        "replay_progress": replay_progress,
        "compacted_scan": compacted_scan,
        "stream_ingest": stream_ingest,
        "backfill_ingest": backfill_ingest,
    }


def _interval_sql(where: str, seconds: int = 3600, view: str = SHARES_SQL,
                  start: datetime = START, end: datetime = END) -> str:
    return f"""
      SELECT {_bucket_sql(seconds)} AS bucket_start, count(*) AS cnt, {SUM_SQL} AS sumdif
      FROM ({view}) WHERE share_date >= TIMESTAMP '{start}' AND share_date < TIMESTAMP '{end}'
        AND {where}
      GROUP BY 1 ORDER BY 1
    """


def _series_sql(seconds: int, points: int) -> str:
    return f"""
      SELECT {_bucket_sql(seconds * points, "bucket_start")} AS part, bucket_start AS time, sumdif AS sum,
        cast(row_number() OVER (PARTITION BY part ORDER BY bucket_start) - 1 AS integer) AS pos
      FROM ({_interval_sql("coin_id = 4 AND reward_method = 'PPLNS'", seconds)})"""


def _range_sql(where: str, start: datetime, end: datetime, view: str = SHARES_SQL) -> str:
    return f"""
      SELECT coalesce({SUM_SQL}, 0.0::double) AS sumdif, count(*) AS cnt FROM ({view})
      WHERE share_date > TIMESTAMP '{start}' AND share_date <= TIMESTAMP '{end}' AND {where}
    """


def _hashrate_sql(where: str, factor: float) -> str:
    return f"""
      SELECT coalesce({SUM_SQL}, 0.0::double) * {factor}::double / {WINDOW}::double AS hashrate
      FROM ({SHARES_SQL})
      WHERE share_date > TIMESTAMP '{AS_OF}' - INTERVAL {WINDOW} SECOND
        AND share_date <= TIMESTAMP '{AS_OF}' AND {where}
    """


TYPED_SQL = """cast(cast(difficulty AS decimal(25,10)) AS varchar) AS difficulty,
      cast(cast(sharedif AS decimal(25,10)) AS varchar) AS sharedif,
      cast(cast(cost AS decimal(30,20)) AS varchar) AS cost"""


def share_sql() -> dict[str, str]:
    wire = ", ".join(WIRE)
    stored = "difficulty, sharedif, cost"
    items_text = ", ".join(f"cast({c} AS varchar) AS {c}" for c in stored.split(", "))
    return {
        "headers_map": """
          SELECT event_id, md5(cast(event_id AS varchar)) AS trace,
            cast(user_id AS varchar) AS user_header, 2::integer AS n_headers FROM events""",
        "decode_share_json": f"SELECT {wire}, false AS malformed FROM ({MESSAGES_SQL})",
        "share_to_json": f"SELECT {wire} FROM ({MESSAGES_SQL})",
        "message_defaults": f"""
          SELECT uuid, CASE WHEN coin_symbol = 'HYP' THEN 0 ELSE share_date_ms END AS share_date_ms,
            CASE WHEN coin_symbol = 'HYP' THEN '' ELSE miner_ip END AS miner_ip,
            CASE WHEN coin_symbol = 'HYP' THEN false ELSE is_solo END AS is_solo,
            CASE WHEN coin_symbol = 'HYP' THEN '' ELSE cost END AS cost
          FROM ({MESSAGES_SQL})""",
        "wallet_worker_split": """
          SELECT event_id, workerfull, split_part(workerfull, '.', 1) AS wallet,
            split_part(workerfull, '.', 2) AS worker
          FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'w' || user_id
                  WHEN 'click' THEN 'w' || user_id || '.a.b' WHEN 'signup' THEN ''
                  ELSE 'w' || user_id || '.rig' || user_id END AS workerfull FROM events)""",
        "share_projection": f"""
          SELECT uuid, server_id, 0::bigint AS coin_id, 0::bigint AS worker_id,
            0::bigint AS wallet_id, share_date_ms, difficulty, sharedif, nonce, is_solo,
            reward_method, cost FROM ({MESSAGES_SQL})""",
        "share_typing": f"""
          SELECT uuid, server_id, 0::bigint AS coin_id, 0::bigint AS worker_id,
            0::bigint AS wallet_id, share_date, {TYPED_SQL}, nonce, is_solo, reward_method
          FROM ({MESSAGES_SQL})""",
        "share_row_text": f"""
          SELECT uuid, server_id, 0::bigint AS coin_id, 0::bigint AS worker_id,
            0::bigint AS wallet_id, share_date_ms, {TYPED_SQL}, nonce, is_solo, reward_method,
            regexp_replace(cast(cast(cost AS decimal(30,20)) AS varchar), '\\.?0+$', '')
              AS cost_trimmed
          FROM ({MESSAGES_SQL})""",
        "time_buckets": f"""
          SELECT uuid, {_bucket_sql(60)} AS minute, {_bucket_sql(7)} AS seven
          FROM ({SHARES_SQL})""",
        "coin_id_lookup": f"""
          SELECT uuid, coin_symbol, coin_id, cast(average_round_diff AS varchar) AS average_round_diff,
            cast(coins_in_block AS varchar) AS coins_in_block,
            cast(current_effort AS varchar) AS current_effort
          FROM ({MESSAGES_SQL}) JOIN (
            SELECT coin_id, average_round_diff::decimal(25,10) AS average_round_diff,
              coins_in_block::decimal(25,10) AS coins_in_block, current_effort::decimal(10,2) AS current_effort
            FROM (VALUES (4, 0.000964, 2.105129971, 1615), (8, 0, 174.61411571, 0),
              (9, 1.401112, 10000000, 0), (10, 109052.63157895, 312.245522648, 0),
              (11, 0.0958054078, 1, 0)) AS c(coin_id, average_round_diff, coins_in_block, current_effort)
          ) USING (coin_id)""",
        "wallet_id_lookup": f"""
          WITH m AS ({MESSAGES_SQL}), {WALLET_IDS_SQL}
          SELECT m.uuid, m.name, m.coin_id, m.reward_method, coalesce(k.id, 0) AS wallet_id
          FROM m LEFT JOIN wallet_known k USING (name, coin_id, reward_method)""",
        "worker_id_lookup": f"""
          WITH m AS ({MESSAGES_SQL}), {WORKER_IDS_SQL}
          SELECT m.uuid, m.workerfull, m.coin_id, m.reward_method, coalesce(k.id, 0) AS worker_id
          FROM m LEFT JOIN worker_known k USING (workerfull, coin_id, reward_method)""",
        "wallet_get_or_create": f"""
          WITH m AS ({MESSAGES_SQL}), {WALLET_IDS_SQL}
          SELECT name, coin_id, reward_method, id, is_new,
            CASE WHEN is_new THEN is_solo END AS is_solo FROM wallet_all""",
        "worker_get_or_create": f"""
          WITH m AS ({MESSAGES_SQL}), {WORKER_IDS_SQL}
          SELECT workerfull, coin_id, reward_method, id, is_new,
            CASE WHEN is_new THEN wallet END AS wallet, CASE WHEN is_new THEN worker END AS worker,
            CASE WHEN is_new THEN server_id END AS server_id, CASE WHEN is_new THEN ip END AS ip,
            CASE WHEN is_new THEN is_solo END AS is_solo FROM worker_all""",
        "normalize_shares": f"""
          WITH m AS ({MESSAGES_SQL}), {WALLET_IDS_SQL}, {WORKER_IDS_SQL}
          SELECT m.uuid, m.server_id, m.coin_id, r.id AS worker_id, w.id AS wallet_id,
            m.share_date, {TYPED_SQL}, m.nonce, m.is_solo, m.reward_method
          FROM m JOIN wallet_all w USING (name, coin_id, reward_method)
            JOIN worker_all r USING (workerfull, coin_id, reward_method)""",
        "strict_messages": """
          SELECT event_id, event_id % 13 IN (1, 2, 3, 4, 5, 6, 7, 9, 10) AS malformed,
            if(malformed, NULL, cast(event_id AS varchar)) AS uuid, if(malformed, true, NULL) AS text_kept
          FROM events""",
        "rejected_shares": f"""
          SELECT CASE WHEN coin_symbol = 'DNX' THEN 'malformed message'
              WHEN coin_symbol = 'HYP' THEN 'unknown coin'
              WHEN c_hrate % 5 = 0 THEN 'workerfull too long'
              WHEN server_id = 'EU-2' THEN 'server_id too long'
              WHEN reward_method = 'SOLO' THEN 'bad cost' ELSE 'stored' END AS reject_reason,
            count(*) AS n FROM ({MESSAGES_SQL}) GROUP BY 1""",
        "share_by_uuid": f"""
          SELECT uuid, coin_id, wallet_id, worker_id, share_date, reward_method,
            cast(difficulty AS varchar) AS difficulty FROM ({SHARES_SQL}) WHERE uuid = '123'""",
        "range_difficulty_sum": _range_sql(
            "coin_id = 4 AND reward_method = 'PPLNS'", RANGE_START, END),
        "range_difficulty_sum_empty": _range_sql(
            "coin_id = 4 AND reward_method = 'PPS'", START, END),
        "interval_global": _interval_sql("coin_id = 4 AND reward_method = 'PPLNS'"),
        "interval_global_minutes": _interval_sql("coin_id = 4 AND reward_method = 'SOLO'", 60),
        "interval_global_years": _interval_sql(
            "coin_id = 4 AND reward_method = 'SOLO'", 86400, ITEMS_SQL,
            datetime(1995, 1, 1), datetime(2002, 1, 1)),
        "interval_wallet": _interval_sql(
            "coin_id = 4 AND reward_method = 'PPLNS' AND wallet_id = 8"),
        "interval_worker": _interval_sql(
            "coin_id = 4 AND reward_method = 'PPLNS' AND worker_id = 8"),
        "interval_wallet_and_worker": _interval_sql(
            "coin_id = 8 AND reward_method = 'PPLNS' AND wallet_id = 8 AND worker_id = 8"),
        "interval_series": _series_sql(3600, 100),
        "interval_series_seconds": _series_sql(1, 10_000),
        "coin_hashrate": _hashrate_sql("coin_id = 4", 4294967296.0),
        "wallet_hashrate": _hashrate_sql("wallet_id = 8", 65536.0),
        "worker_hashrate": _hashrate_sql("worker_id = 8", 65536.0),
        "batch_insert": f"""
          SELECT cast(year(share_date) * 100 + month(share_date) AS integer) AS share_month,
            7::bigint AS ingest_batch, count(*) AS cnt,
            cast(cast(sum(cast(difficulty AS decimal(25,10))) AS varchar) AS double) AS sumdif,
            max(share_date_ms) AS last_ms FROM ({MESSAGES_SQL}) GROUP BY 1""",
        "share_roundtrip": f"""
          SELECT uuid, server_id, coin_id, worker_id, wallet_id, share_date, nonce, is_solo,
            reward_method, {items_text} FROM ({ITEMS_SQL})""",
        "share_month_counts": f"""
          SELECT cast(year(share_date) * 100 + month(share_date) AS integer) AS share_month,
            count(*) AS cnt, 0::bigint AS misplaced FROM ({ITEMS_SQL}) GROUP BY 1""",
        "stored_range_scan": _range_sql(
            "coin_id = 8 AND reward_method = 'PPLNS'", datetime(1998, 2, 27),
            datetime(1999, 5, 1), ITEMS_SQL),
        "stored_share_by_uuid": f"""
          SELECT uuid, server_id, coin_id, worker_id, wallet_id, share_date, nonce, is_solo,
            reward_method, {items_text} FROM ({ITEMS_SQL})
          WHERE uuid = (SELECT min(uuid) FROM ({ITEMS_SQL}))""",
        "stored_interval_wallet": _interval_sql(
            "coin_id = 8 AND reward_method = 'PPLNS' AND wallet_id = 3", 86400, ITEMS_SQL,
            STORED_START, STORED_END),
        "stored_coin_hashrate": f"""
          SELECT coalesce({SUM_SQL}, 0.0::double) * 65536.0::double / {400 * 86400}::double AS hashrate
          FROM ({ITEMS_SQL}) WHERE coin_id = 8 AND share_date <= TIMESTAMP '{STORED_END}'
            AND share_date > TIMESTAMP '{STORED_END}' - INTERVAL 400 DAY""",
        "sums_range_difficulty": _range_sql("coin_id = 4 AND reward_method = 'PPLNS'", SUMS_START, SUMS_END),
        "sums_interval_wallet": _interval_sql(
            "coin_id = 4 AND reward_method = 'PPLNS' AND wallet_id = 8", 1800, SHARES_SQL, SUMS_START, SUMS_END),
        "sums_interval_global_years": _interval_sql(
            "coin_id = 4 AND reward_method = 'SOLO'", 86400, ITEMS_SQL, YEARS_START, YEARS_END),
        "replay_progress": """
          WITH p AS (SELECT (event_id % 5)::integer AS partition, event_id // 5 AS o FROM events),
          r AS (
            SELECT *, o // 150 AS b FROM p
            UNION ALL SELECT *, o // 150 + 1 AS b FROM p WHERE o % 150 >= 110 AND (o // 150 + 1) % 9 = 4),
          k AS (SELECT * FROM r WHERE (b + partition) % 7 <> 3),
          once AS (
            SELECT partition, o, lag(o) OVER (PARTITION BY partition ORDER BY o) AS before
            FROM (SELECT DISTINCT partition, o FROM k)),
          twice AS (
            SELECT partition, count(DISTINCT o // 150) AS overlapping, count(*) AS twice
            FROM (SELECT partition, o FROM k GROUP BY partition, o HAVING count(*) > 1) GROUP BY partition)
          SELECT 'shares' AS topic, partition, min(o) AS first_offset, max(o) AS last_offset,
            (SELECT count(*) FROM k WHERE k.partition = once.partition) AS n,
            max(o) - min(o) + 1 - count(*) AS missing, count(*) FILTER (o > before + 1) AS gaps,
            coalesce(any_value(overlapping), 0)::bigint AS overlapping, coalesce(any_value(twice), 0)::bigint AS twice,
            coalesce(min(before + 1) FILTER (o > before + 1), max(o) + 1) AS next_offset
          FROM once LEFT JOIN twice USING (partition) GROUP BY partition""",
        "compacted_scan": f"""
          SELECT cast(year(share_date) * 100 + month(share_date) AS integer) AS share_month,
            reward_method, count(*) AS cnt, {SUM_SQL} AS sumdif FROM ({ITEMS_SQL}) GROUP BY 1, 2""",
        "stream_ingest": f"""
          SELECT uuid, coin_id, coin_id AS wallet_coin, coin_id AS worker_coin, name AS wallet,
            workerfull, reward_method, share_date,
            cast(cast(difficulty AS decimal(25,10)) AS varchar) AS difficulty,
            cast(cast(cost AS decimal(30,20)) AS varchar) AS cost FROM ({MESSAGES_SQL})""",
        "backfill_ingest": f"""
          WITH m AS ({MESSAGES_SQL}),
          w AS (SELECT *, row_number() OVER (
                  ORDER BY md5(concat_ws('|', name, coin_id, reward_method)), name, coin_id,
                  reward_method) AS wallet_id
                FROM (SELECT DISTINCT name, coin_id, reward_method FROM m)),
          r AS (SELECT *, row_number() OVER (
                  ORDER BY md5(concat_ws('|', workerfull, coin_id, reward_method)), workerfull,
                  coin_id, reward_method) AS worker_id
                FROM (SELECT DISTINCT workerfull, coin_id, reward_method FROM m))
          SELECT wallet_id, worker_id, coin_id, count(*) AS cnt,
            cast(cast(sum(cast(difficulty AS decimal(25,10))) AS varchar) AS double) AS sumdif
          FROM m JOIN w USING (name, coin_id, reward_method)
            JOIN r USING (workerfull, coin_id, reward_method)
          GROUP BY 1, 2, 3""",
    }
