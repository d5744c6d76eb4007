"""Sets of whole numbers as bitmaps: one row of 4 KB for each 32,768 neighbouring numbers.

States of two loads merge by OR, so exact counts of different keys need neither the rows of earlier loads nor a shuffle by key:
what is shuffled are the buckets a task has seen. Dense keys in the order of the table touch few buckets for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKET_BITS = 32_768  # fixed by the bitmap functions
WORD_BITS = 64
# The largest filter that `might_hold` broadcasts: 8,192 buckets, 32 MB.
FILTER_BUCKETS, BITS_FOR_KEY = 8_192, 16
# Tables that the optimizer takes for smaller are joined without a filter: it would cost two more jobs and save no shuffle to speak of.
FILTERED_BYTES = 64_000_000


def bucket(key: Column | str) -> Column:
    return F.bitmap_bucket_number(F.col(key) if isinstance(key, str) else key)


def position(key: Column | str) -> Column:
    return F.bitmap_bit_position(F.col(key) if isinstance(key, str) else key)


def has_bit(bits: Column, at: Column) -> Column:
    """Is the bit set? False without a bitmap."""
    return _is_set(F.ascii(F.decode(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1")), at)


def _is_set(byte: Column, at: Column) -> Column:
    return F.coalesce(byte.cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0, F.lit(False))


def key_words(df: DataFrame, key: str, extra: list[Column] | None = None) -> DataFrame:
    """(bucket, word, rows, held, ...): keys as bits of whole numbers of 64 neighbouring keys each; rows without a key are a bucket NULL.

    Numbers are combined by plain hash aggregation, where a bitmap under construction would have the rows sorted.
    """
    at = position(key)
    return df.groupBy(bucket(key).alias("bucket"), F.floor(at / WORD_BITS).cast("int").alias("word")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % WORD_BITS).cast("int"))).alias("held"),
        *(extra or []),
    )


def key_state(df: DataFrame, key: str, extra: list[Column] | None = None) -> DataFrame:
    """(bucket, rows, bits, ...): how many rows each bucket has and which of its keys; rows without a key are a bucket NULL.

    `extra` aggregates, counts that add up, are computed in the same pass.
    """
    words = key_words(df, key, extra)
    counts = [F.sum(c).alias(c) for c in words.columns[4:]]
    entry = F.when(F.col("word").isNotNull(), F.struct("word", _digits(F.col("held")).alias("digits")))
    bits = _bitmap(F.sort_array(F.collect_list(entry)))  # a bucket has at most 512 words
    return words.groupBy("bucket").agg(F.sum("rows").alias("rows"), bits.alias("bits"), *counts)


def _digits(word: Column) -> Column:
    """The eight bytes of a word as hex digits, lowest byte first."""
    byte = lambda i: F.shiftrightunsigned(word, 8 * i).bitwiseAND(F.lit(255))
    return F.concat(*[F.lpad(F.hex(byte(i)), 2, "0") for i in range(8)])


def _bitmap(entries: Column) -> Column:
    """The bitmap of (word, digits) entries in ascending order; missing words are zeros."""
    filled = F.aggregate(entries, F.lit(""), lambda text, e: F.concat(F.rpad(text, e["word"] * 16, "0"), e["digits"]))
    return F.unhex(F.rpad(filled, BUCKET_BITS // 4, "0"))


def merge_states(states: DataFrame) -> DataFrame:
    """One state of several: rows add up, bitmaps are joined by OR."""
    return states.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.bitmap_or_agg("bits").alias("bits"))


def distinct_keys(state: DataFrame) -> Column:
    """Aggregate: the number of different keys of a merged state."""
    return F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits"))), F.lit(0))


def distinct_of_words(words: DataFrame) -> DataFrame:
    """(n): the number of different keys in the words of a table."""
    return words.agg(F.coalesce(F.sum(F.bit_count("held")), F.lit(0)).cast("bigint").alias("n"))


def repeated_keys(df: DataFrame, key: str, state: DataFrame) -> DataFrame:
    """(n: key groups with more than one row; NULL is a group), from the merged state.

    Rows are grouped by key only in buckets that have more rows than keys; where none has, the table is not read again.
    """
    surplus = state.filter(F.col("bucket").isNotNull() & (F.col("rows") > F.bitmap_count("bits"))).select("bucket")
    suspects = df.select(F.col(key).alias("_key"), bucket(key).alias("bucket")).join(surplus, "bucket", "left_semi")
    found = suspects.groupBy("_key").count().agg(F.count_if(F.col("count") > 1).alias("n"))
    nulls = state.agg(F.count_if(F.col("bucket").isNull() & (F.col("rows") > 1)).alias("_nulls")).scalar()
    return found.select((F.col("n") + nulls).alias("n"))


def with_membership(df: DataFrame, column: str, state: DataFrame, flag: str) -> DataFrame:
    """Add whether `column` is a key of the state; the join has one row for each bucket, not one for each key."""
    pairs = F.regexp_extract_all(F.hex("bits"), F.lit(".."), F.lit(0))
    listed = F.transform(pairs, lambda digits: F.conv(digits, 16, 10).cast("smallint"))  # once for each bucket, not for each row
    held = state.filter(F.col("bucket").isNotNull()).select(F.col("bucket").alias("_bucket"), listed.alias("_bytes"))
    joined = df.join(held, bucket(column) == F.col("_bucket"), "left")
    at = position(column)
    return joined.withColumn(flag, _is_set(F.get("_bytes", (at / 8).cast("int")), at)).drop("_bucket", "_bytes")


def might_hold(df: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """Add whether a row's key may be among `keys` (one column); never false for one that is.

    A filter of 16 bits for each key, at most 32 MB, is broadcast; with more keys than that it lets more rows through.
    """
    name = keys.columns[0]
    buckets = 1
    n = keys.count()
    while buckets * BUCKET_BITS < BITS_FOR_KEY * n and buckets < FILTER_BUCKETS:
        buckets *= 2
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(buckets * BUCKET_BITS))
    at, number, bits = unused(df, "_at", "_bucket", "_bits")
    whole = lambda c: F.floor(F.col(c) / BUCKET_BITS)
    filled = keys.select(place(F.col(name)).alias(at)).groupBy(whole(at).alias(number)).agg(
        F.bitmap_construct_agg(F.col(at) % BUCKET_BITS).alias(bits)
    )
    joined = df.withColumn(at, place(key)).join(F.broadcast(filled), whole(at) == F.col(number), "left")
    return joined.withColumn(flag, has_bit(F.col(bits), F.col(at) % BUCKET_BITS)).drop(at, number, bits)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where the table has such a column."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def small(df: DataFrame) -> bool:
    """Is the table too small for a filter, as far as the optimizer knows?"""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < FILTERED_BYTES


def without(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows whose key (never null) is not among `keys` (one column). Of a large table only rows that the filter can't clear are shuffled."""
    flag, own, other = unused(df, "_may", "_own", "_other")
    if small(df):
        return df.withColumn(own, key).join(keys.toDF(other), F.col(own) == F.col(other), "left_anti").select(*df.columns)
    flagged = might_hold(df, key, keys, flag)
    cleared = flagged.filter(~F.col(flag)).select(*df.columns)
    unclear = flagged.filter(flag).withColumn(own, key).join(keys.toDF(other), F.col(own) == F.col(other), "left_anti")
    return cleared.unionAll(unclear.select(*df.columns))


def only(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows whose key (never null) is among `keys` (one column). Of a large table only rows that the filter lets through are shuffled."""
    flag, own, other = unused(df, "_may", "_own", "_other")
    if small(df):
        return df.withColumn(own, key).join(keys.toDF(other), F.col(own) == F.col(other), "left_semi").select(*df.columns)
    passed = might_hold(df, key, keys, flag).filter(flag).withColumn(own, key)
    return passed.join(keys.toDF(other), F.col(own) == F.col(other), "left_semi").select(*df.columns)
