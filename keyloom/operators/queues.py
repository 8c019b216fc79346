"""Message queues: visibility, counters, redrive, first-in-first-out groups, deduplication, throttling.

messages: queue, id, body, sent_ms, visible_ms, receive_count, group_id, dedup_id. State changes are
appended or rewritten as frames; order-dependent folds run by key in Arrow-batched groups.
"""

from __future__ import annotations

import base64
import struct as binary
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RECEIVED, BATCH_ENTRIES, BATCH_BYTES = 10, 10, 262_144
DEDUP_MS = 5 * 60 * 1000


def send(messages: DataFrame, new: DataFrame, now_ms: int, delay_s: int = 0) -> DataFrame:
    """messages with new rows (queue, id, body and whatever else); visible after the delay."""
    put = new.withColumn("sent_ms", F.lit(now_ms).cast("long")).withColumn("visible_ms", F.lit(now_ms + 1000 * delay_s).cast("long")).withColumn("receive_count", F.lit(0).cast("long"))
    return messages.unionByName(put, allowMissingColumns=True)


def check_send_batch(entries: DataFrame) -> DataFrame:
    """entries (id, body) with ok and code: more than BATCH_ENTRIES or BATCH_BYTES fail the whole batch, repeated ids too."""
    total = entries.agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"), F.count_distinct("id").alias("ids"))
    code = F.when(F.col("n") > BATCH_ENTRIES, "too_many").when(F.col("bytes") > BATCH_BYTES, "too_long").when(F.col("ids") < F.col("n"), "not_distinct")
    return entries.join(F.broadcast(total.select(code.alias("code")))).withColumn("ok", F.col("code").isNull())


def body_digest(body: Column) -> Column:
    return F.md5(body.cast("binary"))


def attributes_digest(names: Column) -> Column:
    """MD5 of message attributes (array of struct name, type, value): sorted by name, each part with its length in 4 bytes, a 1 before a string value."""
    part = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 8, "0")), c.cast("binary"))
    each = F.transform(F.array_sort(names), lambda a: F.concat(part(a["name"]), part(a["type"]), F.unhex(F.lit("01")), part(a["value"])))
    return F.md5(F.aggregate(each, F.unhex(F.lit("")), lambda x, y: F.concat(x, y)))


def receive(messages: DataFrame, now_ms: int, most: int = MOST_RECEIVED, timeout_s: int = 30) -> tuple[DataFrame, DataFrame]:
    """(messages after, received): of each queue the first `most` visible by visible_ms and id; they vanish for the timeout."""
    n = F.row_number().over(Window.partitionBy("queue").orderBy("visible_ms", "id"))
    got = messages.where(F.col("visible_ms") <= now_ms).withColumn("_n", n).where(F.col("_n") <= min(most, MOST_RECEIVED)).drop("_n")
    moved = got.withColumn("visible_ms", F.lit(now_ms + 1000 * timeout_s).cast("long")).withColumn("receive_count", F.col("receive_count") + 1)
    return messages.join(got.select("queue", "id"), ["queue", "id"], "left_anti").unionByName(moved), moved


def delete_received(messages: DataFrame, handles: DataFrame) -> DataFrame:
    """Messages but those whose handle (queue, id, receive_count as token) is current."""
    return messages.join(handles.select("queue", "id", "receive_count"), ["queue", "id", "receive_count"], "left_anti")


def change_visibility(messages: DataFrame, handles: DataFrame, now_ms: int) -> DataFrame:
    """handles: queue, id, receive_count, timeout_s."""
    joined = messages.join(handles.select("queue", "id", "receive_count", "timeout_s"), ["queue", "id", "receive_count"], "left")
    return joined.withColumn("visible_ms", F.when(F.col("timeout_s").isNull(), F.col("visible_ms")).otherwise(F.lit(now_ms) + 1000 * F.col("timeout_s"))).select(*messages.columns)


def encode_handle(generation: int, message_id: str, token: bytes, partition: int = 0) -> str:
    """A receipt handle: version, generation, partition, lengths, id and token in URL-safe base 64."""
    raw = message_id.encode()
    return base64.urlsafe_b64encode(binary.pack(">BQIHH", 2, generation, partition, len(raw), len(token)) + raw + token).decode()


def decode_handle(handle: str) -> dict[str, Any]:
    data = base64.urlsafe_b64decode(handle)
    version, generation, partition, n, m = binary.unpack(">BQIHH", data[:17])
    if version != 2 or len(data) != 17 + n + m:
        raise ValueError("no receipt handle")
    return {"generation": generation, "partition": partition, "id": data[17 : 17 + n].decode(), "token": data[17 + n :]}


def counters(messages: DataFrame, now_ms: int) -> DataFrame:
    """By queue: visible, not_visible (received before) and delayed (never received) messages."""
    seen = F.col("visible_ms") <= now_ms
    return messages.groupBy("queue").agg(
        F.count_if(seen).alias("visible"), F.count_if(~seen & (F.col("receive_count") > 0)).alias("not_visible"), F.count_if(~seen & (F.col("receive_count") == 0)).alias("delayed")
    )


def redrive(messages: DataFrame, most: int, target: str) -> DataFrame:
    """Messages whose next receipt would exceed `most` go to the target queue, their source noted."""
    over = F.col("receive_count") + 1 > most
    return messages.withColumn("dead_letter_source", F.when(over, F.col("queue"))).withColumn("queue", F.when(over, F.lit(target)).otherwise(F.col("queue"))).withColumn("receive_count", F.when(over, F.lit(0)).otherwise(F.col("receive_count")))


def retained(messages: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    return messages.where(F.lit(now_ms) - F.col("sent_ms") <= retention_ms)


def fifo_heads(messages: DataFrame, now_ms: int) -> DataFrame:
    """The next message of each group that has none in flight, by sent_ms and id."""
    flying = messages.where((F.col("visible_ms") > now_ms) & (F.col("receive_count") > 0)).select("queue", "group_id").distinct()
    first = messages.groupBy("queue", "group_id").agg(F.min_by(F.struct("id", "sent_ms", "visible_ms"), F.struct("sent_ms", "id")).alias("m"))
    return first.join(flying, ["queue", "group_id"], "left_anti").where(F.col("m.visible_ms") <= now_ms).select("queue", "group_id", "m.id", "m.sent_ms")


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as a long; built-in functions only."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = F.octet_length(text)
    each = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(each, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def fifo_partition(group: Column, partitions: int) -> Column:
    """Partition of a group, the number of partitions being a power of two."""
    return fnv1a32(group).bitwiseAND(F.lit(partitions - 1)).cast("int")


def deduplicate(messages: DataFrame, window_ms: int = DEDUP_MS) -> DataFrame:
    """queue, dedup_id, id, sent_ms, original: the message that each one counts as; greedy windows from the first accepted send.

    The sends of a queue and dedup_id are sorted by time and pass one task as a stream, with the open window alone in memory."""
    kinds = dict(messages.dtypes)
    names = ["queue", "dedup_id", "id", "sent_ms"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + f", original {kinds['id']}"
    ordered = messages.select(*names).repartition("queue", "dedup_id").sortWithinPartitions("queue", "dedup_id", "sent_ms", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, until = None, None, None
        for batch in batches:
            original = []
            for queue, dedup_id, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                # A hit doesn't renew the window; its end still counts as inside.
                if until is None or (queue, dedup_id) != now or t > until:
                    now, first, until = (queue, dedup_id), i, t + window_ms
                original.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(original, batch.column(2).type)], [*names, "original"])

    return ordered.mapInArrow(run, schema)


def content_dedup_id(body: Column) -> Column:
    return F.sha2(body, 256)


def throttle(requests: DataFrame, capacity: float, rate: float) -> DataFrame:
    """requests (queue, id, ts_ms, n tokens) with allowed and retry_after_s of a token bucket per queue; a request is met whole or not.

    A bucket is sequential: a queue's requests are sorted by time and pass one task as a stream, with the bucket's state alone in memory."""
    kinds = dict(requests.dtypes)
    names = ["queue", "id", "ts_ms", "n"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", allowed boolean, retry_after_s long"
    ordered = requests.select(*names).repartition("queue").sortWithinPartitions("queue", "ts_ms", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, last = None, capacity, None
        for batch in batches:
            ok, wait = [], []
            for queue, t, need in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if last is None or queue != now:
                    now, tokens, last = queue, capacity, t
                tokens = min(capacity, tokens + (t - last) / 1000 * rate)
                last = t
                met = need <= tokens
                tokens -= need if met else 0
                ok.append(bool(met))
                wait.append(0 if met else max(1, -int(-(need - tokens) // rate)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(wait, pa.int64())], [*names, "allowed", "retry_after_s"])

    return ordered.mapInArrow(run, schema)


def list_queues(queues: DataFrame, prefix: str = "", after: str | None = None, most: int = 1000) -> DataFrame:
    found = queues.where(F.startswith("name", F.lit(prefix)))
    return (found.where(F.col("name") > after) if after else found).orderBy("name").limit(most)


def tag(queues: DataFrame, name: str, tags: dict[str, str], remove: tuple[str, ...] = ()) -> DataFrame:
    """queues (name, tags MAP<STRING, STRING>) with a queue's tags set and removed."""
    put = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]) if tags else F.create_map().cast("map<string,string>")
    kept = F.map_filter("tags", lambda k, v: ~k.isin(*tags, *remove) if (tags or remove) else F.lit(True))
    return queues.withColumn("tags", F.when(F.col("name") == name, F.map_concat(kept, put)).otherwise(F.col("tags")))


def purge(messages: DataFrame, queue: str) -> DataFrame:
    return messages.where(F.col("queue") != queue)


def peek(messages: DataFrame, queue: str, after_id=None, most: int = 20, body_chars: int = 4096) -> DataFrame:
    """Messages by id from a cursor on, bodies cut; nothing changes."""
    found = messages.where(F.col("queue") == queue)
    found = found if after_id is None else found.where(F.col("id") > F.lit(after_id))
    return found.orderBy("id").limit(most).withColumn("truncated", F.length("body") > body_chars).withColumn("body", F.substring("body", 1, body_chars))


def select_attributes(attributes: Column, wanted: list[str]) -> Column:
    """Of a map the entries asked for: All or .*, a name, or prefix.*"""
    if "All" in wanted or ".*" in wanted:
        return attributes

    def met(k: Column, v: Column) -> Column:
        out = F.lit(False)
        for w in wanted:
            out = out | (F.startswith(k, F.lit(w[:-2])) if w.endswith(".*") else k == F.lit(w))
        return out

    return F.map_filter(attributes, met)


def parse_form(body: str) -> dict[str, Any]:
    """Form parameters; Name.1.Value style ones become lists in order of their number."""
    from urllib.parse import parse_qsl

    out: dict[str, Any] = {}
    lists: dict[str, dict[int, Any]] = {}
    for k, v in parse_qsl(body, keep_blank_values=True):
        parts = k.split(".")
        if len(parts) >= 2 and parts[1].isdigit():
            slot = lists.setdefault(parts[0], {})
            if len(parts) == 2:
                slot[int(parts[1])] = v
            else:
                slot.setdefault(int(parts[1]), {})[".".join(parts[2:])] = v
        else:
            out[k] = v
    return out | {k: [v[i] for i in sorted(v)] for k, v in lists.items()}


def sweep(messages: DataFrame, now_ms: int, retention_ms: int, most: int, dead: str) -> DataFrame:
    """A background pass: what is too old goes, then what was received too often moves."""
    return redrive(retained(messages, now_ms, retention_ms), most, dead)


def batches(rows: Iterator, n: int = BATCH_ENTRIES) -> Iterator[list]:
    block: list = []
    for r in rows:
        block.append(r)
        if len(block) == n:
            yield block
            block = []
    if block:
        yield block


def create_queue(queues: DataFrame, name: str, attributes: dict[str, str], now_ms: int) -> DataFrame:
    """queues (name, attributes MAP, tags MAP, created_ms) with a new one; an existing name stays as it is."""
    spark = queues.sparkSession
    new = spark.createDataFrame([(name, attributes, {}, now_ms)], "name string, attributes map<string,string>, tags map<string,string>, created_ms long")
    return queues.unionByName(new.join(queues.select("name"), "name", "left_anti"))


def delete_queue(queues: DataFrame, messages: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    return queues.where(F.col("name") != name), purge(messages, name)


def set_attributes(queues: DataFrame, name: str, new: dict[str, str]) -> DataFrame:
    put = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
    kept = F.map_filter("attributes", lambda k, v: ~k.isin(*new))
    return queues.withColumn("attributes", F.when(F.col("name") == name, F.map_concat(kept, put)).otherwise(F.col("attributes")))


def get_attributes(queues: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """attribute, value of a queue."""
    return queues.where(F.col("name") == name).select(F.explode(select_attributes(F.col("attributes"), wanted)).alias("attribute", "value"))


def may_purge(last_purge_ms: int | None, now_ms: int, apart_ms: int = 60_000) -> bool:
    """A queue is purged at most once a minute."""
    return last_purge_ms is None or now_ms - last_purge_ms >= apart_ms
