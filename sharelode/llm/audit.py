"""How document filters overlap, counted by a stream that takes back what it said.

The files of a table are read as available-now micro-batches. A document fails filters A
to D by its own text, and E if a smaller id has the same text. Whether E fails is known
only at the end, so the state of each distinct text is the smallest id seen with it. As
long as an id is the smallest it counts as not failing E; when a smaller one arrives, its
earlier mask is retracted from the counters and counted again with E set.

States are kept in shards of about a thousand texts, so that the fixed cost of a state is
shared. A micro-batch writes its changes of the counters under its number, and a batch that
is run again replaces them. From the sums, a few hundred numbers for each part, everything
about the 120 orders of the filters follows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sharelode.llm.common import as_bytes, only, scratch_path, slices

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
# A code is a mask, whether the document is labelled good, and whether toxic.
GOOD, TOXIC = MASKS, 2 * MASKS
CODES = 4 * MASKS
# At most so many micro-batches, so that what each costs besides its files stays bounded.
BATCHES = 8
# Rows of the table per shard of states.
SHARD = 1024

_SYMBOLS = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(65, 91))
_ENTRIES = "shard long, key binary, doc_id long, part string, code int, n long"
_STATE_FIELDS = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()),
                           ("code", pa.int32()), ("n", pa.int64())])
_ENTRY_FIELDS = pa.schema([("shard", pa.int64()), *_STATE_FIELDS])
_JUDGED = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("code", pa.int32())])
_CHANGES = "part string, code int, n long"


def audit(spark: SparkSession, path: str, labels: DataFrame, *, batches: int = BATCHES,
          scratch: str | None = None) -> DataFrame:
    """One row per part, order of the filters and step, from the Parquet table at `path`.

    The table has `doc_id`, `text` and `source`; `labels` has `doc_id`, `quality` and
    `toxic`. Filters, by what fails: A under 50 words; B 100 * distinct words < 65 * words;
    C 100 * [A-Z] characters > 5 * code points; D any of `#$%&*|`; E the text of a smaller
    doc_id anywhere in the table. Columns: part, filter_order, step (1 to 5), and in
    documents of the part kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley, the filter's removals over all orders.

    A null source is the part '' and a null text is empty. A null doc_id has no smaller one
    and is smaller than none, so it never fails E nor makes another fail. Repeated rows count
    each; of equal ids none is smaller. A document is good or toxic if any row of `labels` says
    so with a 1; labels without a document do nothing. An empty table gives no rows. Texts of
    any length are judged whole; other columns are not read.

    The files are taken in at most `batches` micro-batches. Progress, states and changes are
    in `scratch`, a folder of the shared one by default; with a folder of an earlier call
    only files that are new since are read, and the result covers both. `labels` has to be
    the same then. States, some 50 bytes a text, are in the state store that the session
    names: Spark's default one keeps them in memory, the RocksDB one on local disks.
    """
    scratch = scratch or scratch_path(spark, "audit")
    changes = f"{scratch}/changes"
    _query(spark, path, labels, batches, scratch, changes).awaitTermination()
    stored = spark.read.schema(_CHANGES).option("recursiveFileLookup", "true").parquet(changes)
    return _orders(_summed(stored))


def _query(spark: SparkSession, path: str, labels: DataFrame, batches: int, scratch: str, changes: str):
    table = spark.read.parquet(path)
    files = table.inputFiles()
    per_batch = max(1, math.ceil(len(files) / batches))
    if len(files) == 1 and files[0].endswith(path.rsplit("/", 1)[-1]):
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes one file only as a pattern
    documents = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    entries = combined(labelled(judged(documents), labels), _shards(table, f"{scratch}/shards"))
    updates = entries.groupBy("shard").applyInPandasWithState(
        _updated, _CHANGES, "entries binary", "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        _summed(batch).write.mode("overwrite").parquet(f"{changes}/{batch_id}")

    # Without a file there is no batch, and the sums still need a table to read.
    spark.createDataFrame([], _CHANGES).write.mode("overwrite").parquet(f"{changes}/none")
    return (updates.writeStream.foreachBatch(write).outputMode("append")
            .option("checkpointLocation", f"{scratch}/progress").trigger(availableNow=True).start())


def _shards(table: DataFrame, path: str) -> int:
    """Number of shards, which stays what it was when the first files were read."""
    spark = table.sparkSession
    number = spark.range(1).select((F.lit(table.count()) / SHARD).cast("long").alias("shards") + 1)
    number.toDF("shards").write.mode("ignore").parquet(path)
    return spark.read.parquet(path).first()["shards"]


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy("part", "code").agg(F.sum("n").alias("n"))


# --- documents to entries -----------------------------------------------------


def judged(documents: DataFrame) -> DataFrame:
    """`key` (128-bit hash of the text), `doc_id`, `part` and the mask of A to D as `code`."""
    rows = only(documents, doc_id=F.col("doc_id").cast("long"), text="text",
                part=F.coalesce(F.col("source").cast("string"), F.lit("")))
    return rows.mapInArrow(_judge, "key binary, doc_id long, part string, code int")


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = as_bytes(batch.column("text"))
        characters = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
        codes = [mask(text, n) for text, n in zip(texts, characters)]
        yield pa.RecordBatch.from_arrays([
            pa.array(map(xxhash.xxh3_128_digest, texts), pa.binary()), batch.column("doc_id"),
            batch.column("part"), pa.array(codes, pa.int32())], schema=_JUDGED)


def mask(text: bytes, characters: int) -> int:
    """Bits of the filters A to D that fail."""
    words = text.split()  # of bytes, at space and \t to \r alone
    upper = len(text) - len(text.translate(None, _UPPER))
    return ((len(words) < 50)
            | (100 * len(set(words)) < 65 * len(words)) << 1
            | (100 * upper > 5 * characters) << 2
            | (_SYMBOLS.search(text) is not None) << 3)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Set the bits of good and toxic documents in `code`."""
    def says(name: str, bit: int) -> Column:
        return F.max(F.when(F.col(name) == 1, F.lit(bit)).otherwise(F.lit(0)))

    said = (only(labels, doc_id=F.col("doc_id").cast("long"), quality="quality", toxic="toxic")
            .filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
            .agg((says("quality", GOOD) + says("toxic", TOXIC)).alias("said")))
    return rows.join(said, "doc_id", "left").select(
        "key", "doc_id", "part", (F.col("code") + F.coalesce("said", F.lit(0))).alias("code"))


def combined(rows: DataFrame, shards: int) -> DataFrame:
    """What a group of rows says, before it is shuffled.

    For each text the rows at its smallest id, and counts of all rows by part and code: those
    of a larger id with E, all others as yet without. Counts have no key.
    A text that fills the table becomes one entry per group.
    """
    return rows.mapInArrow(lambda batches: _combine(batches, shards), _ENTRIES)


def _combine(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ids, parts, codes = (batch.column(name).to_pylist() for name in ("key", "doc_id", "part", "code"))
        least: dict[bytes, int] = {}
        for key, doc_id in zip(keys, ids):
            if doc_id is not None and (key not in least or doc_id < least[key]):
                least[key] = doc_id
        held: Counter = Counter()
        counts: Counter = Counter()
        for key, doc_id, part, code in zip(keys, ids, parts, codes):
            if doc_id is None:
                counts[part, code] += 1
            elif doc_id == least[key]:
                counts[part, code] += 1
                held[key, doc_id, part, code] += 1
            else:
                counts[part, code | COPY] += 1
        rows = [(_shard(entry[0], shards), *entry, n) for entry, n in held.items()]
        rows += [(_shard(xxhash.xxh3_128_digest(f"{code}/{part}"), shards), None, 0, part, code, n)
                 for (part, code), n in counts.items()]
        yield _batch(rows, _ENTRY_FIELDS)


def _shard(key: bytes, shards: int) -> int:
    return int.from_bytes(key[:8], "little") % shards


def _batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, schema)], schema=schema)


# --- state of texts -----------------------------------------------------------


class _Smallest:
    """Of each text of a shard the smallest id, and how many rows of each part and code have it."""

    def __init__(self, stored: bytes | None) -> None:
        self.ids: dict[bytes, int] = {}
        self.rows: dict[bytes, dict[tuple[str, int], int]] = {}
        self.changes: Counter = Counter()
        self.new = False
        if stored:
            with pa.ipc.open_stream(stored) as reader:
                for key, doc_id, part, code, n in zip(*[c.to_pylist() for c in reader.read_all().columns]):
                    self.ids[key] = doc_id
                    self.rows.setdefault(key, {})[part, code] = n

    def stored(self) -> bytes:
        rows = [(key, self.ids[key], part, code, n)
                for key, own in self.rows.items() for (part, code), n in own.items()]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _STATE_FIELDS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(_batch(rows, _STATE_FIELDS))
        return sink.getvalue().to_pybytes()

    def add(self, key: bytes, doc_id: int, part: str, code: int, n: int) -> None:
        """Rows that have been counted as not failing E."""
        least = self.ids.get(key)
        if least is not None and doc_id > least:
            self.retract(part, code, n)
            return
        self.new = True
        if least is None or doc_id < least:
            for (p, c), m in self.rows.get(key, {}).items():
                self.retract(p, c, m)
            self.ids[key], self.rows[key] = doc_id, {}
        own = self.rows[key]
        own[part, code] = own.get((part, code), 0) + n

    def retract(self, part: str, code: int, n: int) -> None:
        self.changes[part, code] -= n
        self.changes[part, code | COPY] += n


def _updated(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by the entries of a shard."""
    texts = _Smallest(state.get[0] if state.exists else None)
    for frame in frames:
        counts = frame["key"].isna()
        for part, code, n in frame.loc[counts, ["part", "code", "n"]].itertuples(index=False):
            texts.changes[part, int(code)] += int(n)
        entries = frame.loc[~counts, ["key", "doc_id", "part", "code", "n"]]
        for entry in zip(*[entries[name].tolist() for name in entries]):
            texts.add(*entry)
    if texts.new:
        state.update((texts.stored(),))
    rows = [(part, code, n) for (part, code), n in texts.changes.items() if n]
    if rows:
        yield pd.DataFrame(rows, columns=["part", "code", "n"])


# --- sums to orders -----------------------------------------------------------


def _orders(sums: DataFrame) -> DataFrame:
    """The rows of all orders, from the sums by part and code."""
    by_part = sums.groupBy("part").agg(
        F.collect_list("code").alias("codes"), F.collect_list("n").alias("counts"))  # at most CODES of each
    return by_part.mapInArrow(_steps, T._parse_datatype_string(
        "part string, filter_order string, step int, kept long, removed long, redundant long, "
        "unique_fails long, good_lost long, toxic_lost long, shapley long"))


def _ledger() -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """Orders, steps and filters; and which masks a measure counts there."""
    masks = np.arange(MASKS)
    steps, rows = [], defaultdict(list)
    for order in permutations(range(len(FILTERS))):
        earlier = 0
        for step, bit in enumerate(order, 1):
            fails, gone = (masks >> bit & 1) == 1, (masks & earlier) != 0
            steps.append(("".join(FILTERS[b] for b in order), step, bit))
            rows["removed"].append(fails & ~gone)
            rows["redundant"].append(fails & gone)
            rows["unique_fails"].append(masks == 1 << bit)
            earlier |= 1 << bit
            rows["kept"].append((masks & earlier) == 0)
    return steps, {name: np.array(found, np.int64) for name, found in rows.items()}


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps, counted = _ledger()
    names, numbers, bits = (list(x) for x in zip(*steps))
    filters = np.array(bits)
    for batch in batches:
        for row in batch.to_pylist():
            by_code = np.zeros(CODES, np.int64)
            np.add.at(by_code, row["codes"], row["counts"])
            groups = by_code.reshape(2, 2, MASKS)  # toxic, good, mask
            every = groups.sum(axis=(0, 1))
            removed = counted["removed"] @ every
            shapley = np.zeros(len(FILTERS), np.int64)
            np.add.at(shapley, filters, removed)
            columns = {
                "part": [row["part"]] * len(steps), "filter_order": names, "step": pa.array(numbers, pa.int32()),
                "kept": counted["kept"] @ every, "removed": removed, "redundant": counted["redundant"] @ every,
                "unique_fails": counted["unique_fails"] @ every,
                "good_lost": counted["removed"] @ groups[:, 1].sum(axis=0),
                "toxic_lost": counted["removed"] @ groups[1].sum(axis=0), "shapley": shapley[filters],
            }
            yield pa.RecordBatch.from_pydict(columns)
