"""Shadow comparison of two stores, command classes, service metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class of each command of the structure server.
CLASSES = {
    "read": "DBSIZE EXISTS GET HEXISTS HGET HGETALL HLEN HMGET KEYS LINDEX LLEN LPOS LRANGE PFCOUNT PTTL SCAN SCARD SISMEMBER SMEMBERS TTL TYPE XLEN XRANGE XREAD XREVRANGE ZCARD ZCOUNT ZRANGE ZRANGEBYSCORE ZREVRANGE ZREVRANGEBYSCORE ZSCORE",
    "write": "DEL EXPIRE FLUSHALL FLUSHDB GETDEL HDEL HINCRBY HMSET HSET INCR LPOP LPUSH LREM LSET LTRIM PEXPIRE PFADD RENAME RPOP RPOPLPUSH RPUSH SADD SET SETEX SETNX SREM XADD XTRIM ZADD ZINCRBY ZPOPMIN ZREM ZREMRANGEBYRANK ZREMRANGEBYSCORE",
    "blocking": "BZPOPMIN",
    "pubsub": "PUBLISH PUBSUB SUBSCRIBE",
    "script": "EVAL EVALSHA",
    "transaction": "DISCARD EXEC MULTI",
    "admin": "CLIENT COMMAND HELLO INFO PING QUIT SELECT",
}


#: Class by which a proxy before two stores sends on each command.
ROUTING = {
    "read": """
        GET GETRANGE MGET STRLEN HGET HGETALL HEXISTS HLEN HMGET HKEYS HVALS HRANDFIELD HSCAN EXISTS KEYS RANDOMKEY
        LINDEX LLEN LPOS LRANGE PTTL TTL TYPE SCARD SISMEMBER SMISMEMBER SMEMBERS SRANDMEMBER SDIFF SINTER SINTERCARD
        SUNION SSCAN XLEN XRANGE XREVRANGE XINFO XPENDING ZCARD ZCOUNT ZLEXCOUNT ZMSCORE ZRANGE ZRANGEBYSCORE
        ZRANGEBYLEX ZREVRANGE ZREVRANGEBYSCORE ZREVRANGEBYLEX ZRANK ZREVRANK ZSCORE ZSCAN ZDIFF PFCOUNT TOUCH DUMP
        GEODIST GEOHASH GEOPOS GEOSEARCH GEORADIUS_RO GEORADIUSBYMEMBER_RO OBJECT SORT_RO SUBSTR""",
    "write": """
        SET SETEX PSETEX SETNX SETRANGE MSET MSETNX APPEND GETSET GETEX GETDEL DEL UNLINK COPY RENAME RENAMENX RESTORE
        INCR INCRBY INCRBYFLOAT DECR DECRBY HSET HMSET HDEL HINCRBY HINCRBYFLOAT HSETNX LPUSH LPUSHX LPOP RPUSH RPUSHX
        RPOP RPOPLPUSH LMOVE LREM LSET LTRIM LINSERT SADD SREM SPOP SMOVE SDIFFSTORE SINTERSTORE SUNIONSTORE EXPIRE
        PEXPIRE EXPIREAT PEXPIREAT PERSIST SORT XADD XTRIM XACK XDEL XGROUP XCLAIM XAUTOCLAIM ZADD ZINCRBY ZREM
        ZREMRANGEBYSCORE ZREMRANGEBYRANK ZREMRANGEBYLEX ZPOPMIN ZPOPMAX ZRANGESTORE ZUNIONSTORE ZINTERSTORE ZDIFFSTORE
        PFADD PFMERGE GEOADD GEORADIUS GEORADIUSBYMEMBER GEOSEARCHSTORE FLUSHALL FLUSHDB PUBLISH""",
    "blocking": "BLPOP BRPOP BRPOPLPUSH BLMOVE BLMPOP BZPOPMIN BZPOPMAX",
    "pubsub": "SUBSCRIBE UNSUBSCRIBE PSUBSCRIBE PUNSUBSCRIBE SSUBSCRIBE SUNSUBSCRIBE PUBSUB",
    "admin": """
        PING ECHO INFO CLIENT SELECT QUIT RESET DBSIZE SCAN AUTH HELLO WAIT CONFIG DEBUG CLUSTER COMMAND TIME SLOWLOG
        MEMORY LATENCY MODULE ACL SWAPDB WATCH UNWATCH""",
    "transaction": "MULTI EXEC DISCARD",
    "script": "EVAL EVALSHA EVAL_RO EVALSHA_RO SCRIPT FUNCTION FCALL FCALL_RO",
}


def routing_class(command: Column, arguments: Column | None = None) -> Column:
    """Class of a command at a proxy, in either case. XREAD and XREADGROUP block if an argument (an array of texts) says
    BLOCK and read otherwise; a command that isn't known is a write, which goes to both stores."""
    out = F.lit("write")
    for name, words in ROUTING.items():
        out = F.when(F.upper(command).isin(*words.split()), F.lit(name)).otherwise(out)
    waits = F.lit(False) if arguments is None else F.coalesce(F.exists(arguments, lambda a: F.upper(a) == "BLOCK"), F.lit(False))
    return F.when(F.upper(command).isin("XREAD", "XREADGROUP"), F.when(waits, "blocking").otherwise("read")).otherwise(out)


def command_class(command: Column) -> Column:
    out = F.lit("other")
    for name, words in CLASSES.items():
        out = F.when(F.upper(command).isin(*words.split()), F.lit(name)).otherwise(out)
    return out


def command_table(spark) -> DataFrame:
    return spark.createDataFrame([(c, k) for k, words in CLASSES.items() for c in words.split()], "command string, class string")


def divergence(primary: DataFrame, secondary: DataFrame, key: str, value: str) -> DataFrame:
    """key and kind of each difference: migration_gap (the second lacks it), extra_data (the first lacks it), data_mismatch."""
    a = primary.select(F.col(key), F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = secondary.select(F.col(key), F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    kind = F.when(F.col("_in_b").isNull(), "migration_gap").when(F.col("_in_a").isNull(), "extra_data").when(~F.col("_a").eqNullSafe(F.col("_b")), "data_mismatch")
    return a.join(b, key, "full_outer").select(key, kind.alias("kind")).where("kind IS NOT NULL")


def service_metrics(calls: DataFrame, by: str, milliseconds: str, failed: Column) -> DataFrame:
    """Requests, errors, mean and largest duration by operation."""
    return calls.groupBy(by).agg(F.count("*").alias("requests"), F.count_if(failed).alias("errors"), F.avg(milliseconds).alias("mean"), F.max(milliseconds).alias("largest"), F.percentile_approx(milliseconds, 0.95).alias("p95"))


def channel_counts(subscriptions: DataFrame) -> DataFrame:
    """Subscribers by channel."""
    return subscriptions.groupBy("channel").agg(F.count_distinct("client").alias("subscribers"))


def publish(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """client, channel, message: each message to each subscriber of its channel."""
    return messages.join(subscriptions.select("channel", "client").distinct(), "channel").select("client", "channel", "message")
