"""Helpers that several operators share: lineage cuts, let-bindings and distributed running sums."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009..U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
#: The six characters that separate words.
SPACES = " \t\n\x0b\x0c\r"


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    A folder of our own is only taken where the setting is absent and Spark runs in this process alone,
    as in tests and in the bench; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or _own()


@cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="spoolmill-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: a table written to the shared folder and read back.

    Unlike after ``checkpoint()``, its size is known to the optimizer as it is. After a checkpoint, the
    estimate of a join is the product of its sides' estimates, which in loops grows without bound.
    """
    path = f"{folder(df.sparkSession)}/spoolmill-{uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


#: Tables that were cut, by the scopes that are open.
_scopes: list[list[DataFrame]] = []


def drop(df: DataFrame) -> None:
    """Remove the table of a ``df`` that was :func:`cut`; nothing may read it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside are removed at the end, but for those given to what this yields, which
    become the enclosing scope's. Whatever is still read afterwards must be among them."""
    mine: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scopes.append(mine)
    try:
        yield keep
    finally:
        _scopes.pop()
        if _scopes:
            _scopes[-1].extend(kept)
        for df in mine:
            if not any(df is k for k in kept):
                drop(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


#: Elements that a scan folds at once; arrays are copied within such a block only.
_FOLD = 256


def scan(xs: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each element of ``xs``, ``add`` over all before it, from ``zero``: in blocks and then over the
    blocks, so that time grows little faster than the array."""

    def fold(items: Column) -> Column:
        start = F.struct(zero.alias("at"), F.filter(F.array(zero), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def whole(inner: Column) -> Column:
        offsets = fold(F.transform(inner, lambda x: x["at"]))["out"]
        return F.flatten(F.zip_with(inner, offsets, lambda x, o: F.transform(x["out"], lambda v: add(o, v))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _FOLD).cast("int")), lambda b: F.slice(xs, b * _FOLD + 1, F.lit(_FOLD)))
    return F.when(F.size(xs) == 0, F.filter(F.array(zero), lambda _: F.lit(False))).otherwise(let(F.transform(blocks, fold), whole))


#: Characters of a block of a cut text.
_CUT = 1024


def cut_up(text: Column) -> Column:
    """``text`` as an array of blocks, for :func:`between`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to before ``end`` of a text that was :func:`cut_up`, without
    counting from its beginning."""
    i, j = F.floor(start / _CUT).cast("int"), F.floor((end - 1) / _CUT).cast("int")
    first = F.substring(F.get(blocks, i), start - i * _CUT + 1, F.lit(_CUT))
    middle = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
    last = F.substring(F.get(blocks, j), F.lit(1), end - j * _CUT)
    one = F.substring(F.get(blocks, i), start - i * _CUT + 1, end - start)
    return F.when(end <= start, "").when(i == j, one).otherwise(F.concat(first, middle, last))


def settle(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns ``names`` evaluated once per row, last in order.

    They pass through a generator of one row, below which the optimizer doesn't copy their
    expressions when a later filter or projection mentions them.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def parts(df: DataFrame) -> int:
    """Partitions for a range shuffle: what the session uses for its other shuffles."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` range-partitioned by ``order``, with ``_pid`` rising along it; stable because it is written.

    Give a tie-breaker last: rows with equal keys stay in one partition.
    """
    return cut(df.repartitionByRange(parts(df), *order).withColumn("_pid", F.spark_partition_id()))


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``, the sum of ``value`` over all rows before this one in ``order``.

    Each range sums itself; only one row per range (as many as shuffle partitions) meets in one place.
    """
    rows = ranged(df, *order)
    totals = rows.groupBy("_pid").agg(F.sum(value).alias("_sum"))
    base = totals.select("_pid", F.coalesce(F.sum("_sum").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    here = F.sum(value).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(base), "_pid").withColumn(out, F.col("_base") + F.coalesce(here, F.lit(0))).drop("_pid", "_base")


#: Keys of more rows than this are hot, and of very many rows, those above the total over ``HOT_KEYS``.
HOT, HOT_KEYS = 10_000, 20_000


def is_hot(most: int | None, total: int | None) -> bool:
    """Whether a key of ``most`` of ``total`` rows should be joined apart."""
    return (most or 0) > max(HOT, (total or 0) // HOT_KEYS)


def join_spread(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``key`` and in ``weight`` how many rows of
    ``left`` have that key; ``right`` should be a written table.

    The rows of hot keys stay where they are and meet a broadcast of those keys: at most ``HOT_KEYS`` of
    them, since each has more than the total over ``HOT_KEYS`` rows.
    """
    total, most = right.agg(F.sum(weight), F.max(weight)).first()
    if not is_hot(most, total):
        return left.join(right, key)
    limit = max(HOT, total // HOT_KEYS)
    hot = right.where(F.col(weight) > limit)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(weight) <= limit), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


#: Bits of a sieve for each of its keys, and in all (32 MiB, what is broadcast at most).
SIEVE, SIEVE_BITS = 16, 1 << 28


def sift(df: DataFrame, by: Column, keys: DataFrame, key: Column, out: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``by`` may be among the values of ``key`` in ``keys``, or with ``out`` those where it
    is surely not: what a join with ``keys`` may leave out, told without a shuffle of ``df``. ``keys`` should be a
    written table; both expressions are hashes, as by ``xxhash64``.

    The keys set bits in a bitmap, dealt in buckets of 32,768 bits that are broadcast. Of the other rows one in
    ``SIEVE`` passes, and more of them where the keys outgrow ``SIEVE_BITS``: then the join that follows has more
    to do, with the same result.
    """
    bits = min(SIEVE * max(keys.count(), 2048), SIEVE_BITS)
    place = F.pmod(key, F.lit(bits))
    sieve = keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_place"))
    sieve = sieve.groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bitmap"))
    rows = df.withColumn("_at", F.pmod(by, F.lit(bits)))
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))) % 2 == 1
    on = (F.bitmap_bucket_number("_at") == F.col("_bucket")) & is_set
    return rows.join(F.broadcast(sieve), on, "left_anti" if out else "left_semi").drop("_at")


def carrying(df: DataFrame, used: list[str], added: list[str], work: Callable[[DataFrame], DataFrame], gone: tuple[str, ...] = ()) -> DataFrame:
    """``work`` on the columns ``used`` of ``df`` alone; the result has the columns of ``df``, which travel in one
    struct so that no name can clash, and those ``added``. A column of ``df`` that is named as an added one is
    replaced; ``gone`` are left out."""
    kept = [c for c in df.columns if c not in added and c not in gone]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    out = work(df.select(row.alias("_row"), *[F.col(f"`{c}`") for c in dict.fromkeys(used)]))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in kept], *added)
