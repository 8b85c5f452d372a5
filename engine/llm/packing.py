"""Problem 8: texts, measured in tokens, packed into containers of fixed capacity.

1. Every text is measured whole by a public tokenizer, whose vocabulary file is a parameter; only (id, tokens) goes on.
2. The global histogram of lengths has at most CAPACITY classes whatever the corpus. A dynamic programme over it
   chooses BUCKETS upper bounds so that the room lost when items of a bucket share containers evenly is least.
3. Inside a bucket, containers are filled by token budget: the next item goes in while the capacity allows. Room that
   a bucket leaves over is offered to the shorter buckets, best fit first; the batches alone would leave 7 % unused.

A text longer than the capacity is cut into full containers and a rest, which is an item like others; nothing else is
split. Items are spread over shards by a hash of the id, as many as keep a shard near SHARD_TOKENS, so that no bucket
is one task's work; what each shard loses is its last container.

Defined results: null texts are left out; an empty text is an item of no tokens and has a container; equal lengths are
taken in order of id; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.session import shared_dir
from engine.sources.tables import table

CAPACITY, BUCKETS = 2048, 24
SHARD_TOKENS = 8_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def measured(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n): the number of tokens of each whole text."""

    def count(batches):
        import base64

        import public_tokenizers
        import pyarrow as pa
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n"])

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(count, "doc_id bigint, n bigint")


def bounds(histogram: dict[int, int], capacity: int = CAPACITY, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` length buckets; an item of a bucket with bound L costs capacity / floor(capacity / L)."""
    import numpy as np

    h = np.zeros(capacity + 1)
    for length, times in histogram.items():
        h[length] += times
    n, s = np.concatenate([[0], np.cumsum(h)]), np.concatenate([[0], np.cumsum(h * np.arange(capacity + 1))])
    best, back = np.full((buckets + 1, capacity + 1), np.inf), np.zeros((buckets + 1, capacity + 1), dtype=int)
    best[0, 0] = 0
    for k in range(1, buckets + 1):
        for e in range(1, capacity + 1):
            lost = (n[e + 1] - n[1 : e + 1]) * (capacity / (capacity // e)) - (s[e + 1] - s[1 : e + 1])
            total = best[k - 1, :e] + lost
            back[k, e] = int(np.argmin(total))
            best[k, e] = total[back[k, e]]
    k, e, out = int(np.argmin(best[:, capacity])), capacity, []
    while k:
        out.append(e)
        k, e = k - 1, int(back[k, e])
    return out[::-1]


def fill(ids: list, sizes: list[int], upper: list[int], capacity: int = CAPACITY) -> list[tuple]:
    """(id, piece, tokens, container) of every piece of one shard."""
    import bisect

    out, rest, used = [], [[] for _ in upper], 0
    for x, n in sorted(zip(ids, sizes, strict=True), key=lambda p: (-p[1], p[0] is not None, p[0] or 0)):
        whole, left = divmod(n, capacity)
        for piece in range(whole):
            out.append((x, piece, capacity, used))
            used += 1
        if left or not whole:
            rest[bisect.bisect_left(upper, left)].append((x, whole, left))
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some container has room r
    for bucket in reversed(rest):
        own = []
        bucket.sort(key=lambda p: -p[2])
        for x, piece, n in bucket:
            fits = free >> n
            if not fits:
                own.append((x, piece, n))
                continue
            r = n + (fits & -fits).bit_length() - 1
            c = rooms[r].pop()
            free ^= 0 if rooms[r] else 1 << r
            rooms[r - n].append(c)
            free |= 1 << (r - n)
            out.append((x, piece, n, c))
        room, batches = -1, []
        for x, piece, n in own:
            if room < n:
                if room >= 0:
                    batches.append((room, used - 1))
                room, used = capacity, used + 1
            room -= n
            out.append((x, piece, n, used - 1))
        if room >= 0:
            batches.append((room, used - 1))
        for r, c in batches:
            rooms[r].append(c)
            free |= 1 << r
    return out


def pack(sizes: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id) from (doc_id, n)."""
    counts = sizes.groupBy((F.col("n") % capacity).cast("int").alias("rest")).agg(F.count("*").alias("c"), F.sum("n").alias("t")).collect()  # at most `capacity` rows
    upper = bounds({r["rest"]: r["c"] for r in counts}, capacity, buckets) or [capacity]
    shards = max(1, -(-sum(r["t"] for r in counts) // shard_tokens))
    put = fill

    def shard(t):
        import pyarrow as pa

        number = t.column("shard")[0].as_py()
        rows = put(t.column("doc_id").to_pylist(), t.column("n").to_pylist(), upper, capacity)
        columns = list(zip(*rows, strict=True))
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "piece": pa.array(columns[1], pa.int64()), "n_tokens": pa.array(columns[2], pa.int64()), "container_id": pa.array([number << 32 | c for c in columns[3]], pa.int64())})

    spread = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return spread.groupBy("shard").applyInArrow(shard, "doc_id bigint, piece bigint, n_tokens bigint, container_id bigint")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark, "sizes")  # names the checkpoint folder
    return measured(table(spark, sf_dir, "documents")).checkpoint()


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or of each piece of a longer one."""
    return pack(_sizes(spark, sf_dir))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill of each container."""
    by = containers(spark, sf_dir).groupBy("container_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    return by.withColumn("fill", F.col("n_tokens") / CAPACITY)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, the least possible number of containers, and the share of room that is used."""
    f = fills(spark, sf_dir)
    return f.agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.ceil(F.sum("n_tokens") / CAPACITY).alias("least"), F.avg("fill").alias("fill"), F.max("n_tokens").alias("largest"))
