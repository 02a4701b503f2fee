"""Table and message schemas, as Spark DDL.

Every reader in this package is given one of these; nothing is inferred.
"""

# The keys of a share message and the columns and precisions of
# the stored tables.
SHARE_FOUND = """
    uuid string, blockType string, serverId string, coinSymbol string,
    workerfull string, shareDate bigint, cHrate bigint, aHrate bigint,
    difficulty string, sharedif string, nonce string, minerIp string,
    isSolo boolean, rewardMethod string, cost string
"""

SHARES = """
    uuid string, server_id string, coin_id bigint, worker_id bigint,
    wallet_id bigint, share_date timestamp, difficulty decimal(25,10),
    sharedif decimal(25,10), nonce string, is_solo boolean,
    reward_method string, cost decimal(30,20)
"""

# A share before it is typed: time in milliseconds, amounts as text.
SHARE_TEXT = """
    uuid string, server_id string, coin_id bigint, worker_id bigint,
    wallet_id bigint, share_date_ms bigint, difficulty string, sharedif string,
    nonce string, is_solo boolean, reward_method string, cost string
"""

COINS = """
    id bigint, symbol string, symbol2 string, name string, algo string,
    image string, min_withdraw decimal(10,6), transactions_explorer string,
    block_explorer string, is_active boolean, params string,
    average_round_diff decimal(25,10), average_solo_round_diff decimal(25,10),
    current_effort decimal(10,2), coins_in_block decimal(25,10),
    average_pps_round_diff decimal(25,10), average_effort decimal(5,2),
    average_last_effort decimal(5,2), seo_title string,
    last_reward_processed_id bigint
"""

WALLETS = """
    id bigint, coin_id bigint, name string, current_hashrate bigint,
    average_hashrate bigint, payment_threshold decimal(20,6),
    is_solo boolean, reward_method string
"""

WORKERS = """
    id bigint, coin_id bigint, workerfull string, wallet string, worker string,
    server_id string, ip string, current_hashrate bigint,
    average_hashrate bigint, last_share_date timestamp_ntz,
    is_connect boolean, current_diff decimal(25,10), created_at timestamp_ntz,
    updated_at timestamp_ntz, reported_hashrate bigint,
    reported_hashrate_date timestamp_ntz, threshold_change string,
    is_solo boolean, miner_client string, reward_method string
"""

# Number and exact difficulty of the shares of a minute.
MINUTE_SUMS = """
    minute timestamp, coin_id bigint, reward_method string, wallet_id bigint,
    worker_id bigint, cnt bigint, sumdif decimal(38,10)
"""

# Offsets of a batch in one partition of a topic.
PROGRESS = "topic string, partition int, first_offset bigint, last_offset bigint, n bigint"

# JSON key -> column name used once a message is decoded.
WIRE_COLUMNS = {
    "uuid": "uuid",
    "blockType": "block_type",
    "serverId": "server_id",
    "coinSymbol": "coin_symbol",
    "workerfull": "workerfull",
    "shareDate": "share_date_ms",
    "cHrate": "c_hrate",
    "aHrate": "a_hrate",
    "difficulty": "difficulty",
    "sharedif": "sharedif",
    "nonce": "nonce",
    "minerIp": "miner_ip",
    "isSolo": "is_solo",
    "rewardMethod": "reward_method",
    "cost": "cost",
}

# Characters that the stored columns hold.
TEXT_LIMITS = {"workerfull": 255, "server_id": 32, "miner_ip": 32, "reward_method": 16}

# The coins a pool starts with: id, symbol, name, algorithm, average_round_diff,
# current_effort, coins_in_block, average_effort, average_last_effort.
COIN_SEED = [
    (4, "ALPH", "Alephium", "Blake 3", "0.000964", "1615", "2.105129971", "0", "0"),
    (8, "KAS", "Kaspa", "HeavyHash", "0", "0", "174.61411571", "0", "0"),
    (9, "NEXA", "Nexa", "NexaPow", "1.401112", "0", "10000000", "0", "0"),
    (10, "DNX", "", "", "109052.63157895", "0", "312.245522648", "0.69", "0.18"),
    (11, "HYP", "Hypra", "EthashB3", "0.0958054078", "0", "1", "0.89", "1.23"),
]

# Natural keys. A solo flag is an attribute, never part of a key.
WALLET_KEY = ["name", "coin_id", "reward_method"]
WORKER_KEY = ["workerfull", "coin_id", "reward_method"]

SHARE_COLUMNS = [
    "uuid", "server_id", "coin_id", "worker_id", "wallet_id", "share_date",
    "difficulty", "sharedif", "nonce", "is_solo", "reward_method", "cost",
]
