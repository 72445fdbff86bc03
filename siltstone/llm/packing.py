"""Best-fit packing with certified bounds: partitions whose bins can't be proven necessary exchange documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import common

#: Tokens of a sequence; the id that ends each document; pieces that one partition packs; exchanges at most.
LIMIT, END_ID, ITEMS, ROUNDS = 1024, 2, 20_000, 6
#: Stands in the place of the exchange's number in the ids of sequences that one full piece fills.
WHOLE = 127

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most `limit` tokens: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, uint32).

    A document is its ids and end_id. Longer ones are cut from the end into pieces of `limit`; the first may be shorter.
    A null or empty text is end_id alone. Repeated rows and null doc_ids give their pieces like any other row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from siltstone.llm.encode import encoder

        own = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows, out = [], []
            for row, ids in enumerate(own.encode(batch.column(1), want_ids=True)[1]):
                raw = np.append(ids, end).astype("<u4").tobytes()
                n = len(raw) // 4
                begin = 0
                for k in range(-(-n // limit)):
                    size = (n - 1) % limit + 1 if k == 0 else limit
                    part = raw[4 * begin : 4 * (begin + size)]
                    rows.append(row)
                    out.append((k, begin, size, zlib.crc32(part), part if with_ids else None))
                    begin += size
            cols = list(zip(*out)) or [[]] * 5
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:4]]]
            names = PIECES.fieldNames()
            if with_ids:
                arrays.append(pa.array(cols[4], pa.binary()))
                names = [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    common.arrow_batches(docs.sparkSession)
    schema = T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType())]) if with_ids else PIECES
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(cut, schema)


def lower_bound(sizes: np.ndarray, limit: int) -> int:
    """Bins that any packing needs, by dual-feasible functions: total size, sizes over a half with their best fillers, and rounded multiples."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=limit + 1).astype(np.int64)
    size = np.arange(limit + 1)
    best = -(-int((count * size).sum()) // limit)
    for eps in range(0, limit // 2 + 1):
        value = np.where(size > limit - eps, limit, np.where(size >= eps, size, 0))
        best = max(best, -(-int((count * value).sum()) // limit))
    for k in range(1, 101):
        scaled = (k + 1) * size
        value = np.where(scaled % limit == 0, size * k, scaled // limit * limit)  # in units of 1 / (k * limit)
        best = max(best, -(-int((count * value).sum()) // (k * limit)))
    return best


def best_fit_decreasing(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin); items come in the order of `sizes`, largest first."""
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    some = 0  # bit r: a bin with r tokens left
    for i, size in enumerate(sizes.tolist()):
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            at, room = len(fill), limit
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += size
        if room > size:
            free[room - size].append(at)
            some |= 1 << room - size
    return bins, offsets, np.array(fill, np.int64)


def _packer(names: list[str], limit: int, turn: int, last: bool):
    """Packs one partition; open marks the pieces of bins that are handed on."""

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        order = [n for n in names if n != "length" and table.schema.field(n).type != pa.binary()]
        table = table.sort_by([("length", "descending"), *[(n, "ascending") for n in order]])
        sizes = table.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(sizes, limit)
        again = np.zeros(len(fill), bool)
        if not last:
            if len(fill) > lower_bound(sizes, limit):
                again = fill < limit
            elif fill.min() < limit:
                again[np.argmin(fill)] = True
        place = (turn << 56) + (int(key[0].as_py()) << 24)
        return pa.table({**{n: table.column(n) for n in names}, "sequence_id": pa.array(place + bins), "offset": pa.array(offsets), "open": pa.array(again[bins])})

    return packed


def pack(pieces: DataFrame, limit: int = LIMIT, items: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """pieces (with a bigint column length of 1 to limit) with sequence_id and offset, in as few sequences as it can.

    Each partition of about `items` pieces runs best-fit decreasing and computes a lower bound of its bin count by
    dual-feasible functions. A partition whose count equals the bound is certified; it hands on only its emptiest bin,
    whose free space is what rounding up costs it. One with a gap hands on every bin that isn't full. What is handed on is dealt anew
    (to fewer partitions, so that pieces of different partitions meet) and packed again, until one certified partition
    or `rounds` exchanges are left. A piece of `limit` is a sequence by itself and isn't dealt. The others are dealt by a
    hash of the row and of its place in the written table, so that equal rows spread over partitions, however many they
    are, and a lost task deals alike. An empty table gives an empty table; columns named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    kept = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset", "open", "_part", "_place")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("open", T.BooleanType())])
    pool = common.settle(pieces.select(names))
    place = F.monotonically_increasing_id()
    done = [pool.where(F.col("length") == limit).select(*names, (place + (WHOLE << 56)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    pool = pool.where(F.col("length") < limit)
    left = pool.count()
    if not left:
        return done[0]
    for turn in range(rounds + 1):
        parts = max(1, -(-left // items))
        last = turn == rounds or (turn > 0 and parts == 1)
        part = F.pmod(F.xxhash64(F.lit(turn), *names, "_place"), F.lit(parts)).alias("_part")
        out = common.settle(pool.withColumn("_place", place).select(part, *names).groupBy("_part").applyInArrow(_packer(names, limit, turn, last), schema))
        done.append(out.where("not open").select(*names, "sequence_id", "offset"))
        pool = out.where("open").select(names)
        if last or not (left := pool.count()):
            break
    return reduce(DataFrame.unionByName, done)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
