"""Problem 9: passages of held-out test items in a corpus.

1. `items_of` collects the test items (a held-out set, the small side by nature), drops the sentences that SHARED items
   or more have in common, and numbers their words: the vocabulary of everything that follows.
2. `encoded` turns every document, whole, into the numbers of its words (-1: none of the items'), once; that table is
   checkpointed in the shared folder and all later passes read it.
3. `latent` counts document frequencies over all passages and finds the leading right singular vectors of their TF-IDF
   matrix by randomised SVD: each pass multiplies the rows of all partitions with a (vocabulary x rank) block and adds
   the partial products; only blocks of that size reach the driver.
4. `candidates` compares all passages of each document (SPAN words, every STEP words, so that any RUN words lie whole in
   one) with all passages of the items by the cosine of their latent vectors; a pair of document and item with one
   similarity of NEAR goes on, as many as there are.
5. `leaked` judges a candidate over the whole document: RUN consecutive words of the item, or LONG consecutive words of
   it of which at most one in 1 / ALTERED is altered, by longest common subsequences of its sentences, which may stand
   anywhere in any order.

Documents never leave their task; the model is broadcast with the code and is bounded by the test items' vocabulary.

Defined results: null texts and null items are left out; an item without words matches nothing; repeated documents are
judged one by one; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engine.llm.blocks import sum_blocks
from engine.llm.normal import words
from engine.session import shared_dir
from engine.sources.tables import table

RUN, LONG, ALTERED = 14, 30, 1 / 8
#: A sentence that so many items hold is an instruction and does not count.
SHARED = 4
STEP = 5
SPAN = RUN + STEP - 1
#: Words between the starts of an item's passages of RUN words.
ITEM_STEP = 3
RANK, OVERSAMPLING, ITERATIONS = 128, 16, 1
NEAR = 0.7


def sentences(text: str) -> list[str]:
    import re

    return [s for s in re.split(r"(?<=[.?!])\s+", text) if s.strip()]


def items_of(items: DataFrame) -> tuple[list[tuple], dict[str, int]]:
    """[(item_id, part, sentences as lists of word numbers)] without the shared sentences, and the vocabulary."""
    rows = [(r["item_id"], [[words(s) for s in sentences(t or "")] for t in (r["question"], r["answer"])]) for r in items.select("item_id", "question", "answer").collect() if r["item_id"] is not None]
    among = Counter(s for _, parts in rows for s in {tuple(s) for p in parts for s in p})
    vocabulary: dict[str, int] = {}
    out = []
    for item, parts in rows:
        for k, part in enumerate(parts):
            own = [[vocabulary.setdefault(w, len(vocabulary)) for w in s] for s in part if s and among[tuple(s)] < SHARED]
            if own:
                out.append((item, k, own))
    return out, vocabulary


def encoded(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, codes)."""
    split = words

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            codes = [[vocabulary.get(w, -1) for w in split(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.list_(pa.int32()))], names=["doc_id", "codes"])

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(encode, "doc_id bigint, codes array<int>")


def _flat(batch):
    """All codes of a batch with the passage (SPAN words, side by side) each belongs to, without words outside the vocabulary."""
    import numpy as np

    column = batch.column("codes")
    length = np.diff(column.offsets.to_numpy())
    codes = column.flatten().to_numpy(zero_copy_only=False)
    spans = -(-length // SPAN)
    first = np.concatenate([[0], np.cumsum(spans)])
    within = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
    passage = np.repeat(first[:-1], length) + within // SPAN
    known = codes >= 0
    return codes[known], passage[known], int(first[-1])


def latent(codes: DataFrame, size: int, rank: int = RANK, iterations: int = ITERATIONS):
    """(weights): the (vocabulary x rank) matrix that takes a word to its share of a passage's latent vector, IDF included."""
    import numpy as np

    flat = _flat

    def frequencies(batch, total):
        import numpy as np

        c, p, n = flat(batch)
        total[: size, 0] += np.bincount(np.unique(c.astype(np.int64) + p * size) % size, minlength=size)
        total[size, 0] += n

    counts = sum_blocks(codes, frequencies, size + 1, 1)[:, 0]
    idf = np.log((1 + counts[size]) / (1 + counts[:size]))
    rank = min(rank + OVERSAMPLING, size)

    def multiply(block):
        def work(batch, total):
            import numpy as np

            c, p, n = flat(batch)
            if not len(c):
                return
            at = np.flatnonzero(np.diff(p, prepend=-1))
            rows = np.add.reduceat(block[c], at)  # passages in use x rank
            of = np.cumsum(np.diff(p, prepend=p[0]) != 0)
            order = np.argsort(c, kind="stable")
            start = np.flatnonzero(np.diff(c[order], prepend=-1))
            total[c[order][start]] += np.add.reduceat(rows[of[order]], start) * idf[c[order][start], None]

        return work

    q = np.linalg.qr(np.random.default_rng(9).standard_normal((size, rank)))[0]
    for _ in range(iterations + 1):
        y = sum_blocks(codes, multiply((idf[:, None] * q).astype(np.float32)), size, rank)
        q, r = np.linalg.qr(y)
    return (idf[:, None] * q[:, : min(RANK, rank)]).astype(np.float32)


def _covered(pattern: list[int], text: list[int]) -> int:
    """Bits of the pattern's words that a longest common subsequence with the text holds; bit-parallel, with trace-back."""
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    v, history = full, []
    for w in text:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
        history.append(v)
    out, i, j = 0, len(pattern), len(text)
    while i and j:
        now, before = history[j - 1], history[j - 2] if j > 1 else full
        low = (1 << i) - 1
        if (~now & low).bit_count() == (~before & low).bit_count():
            j -= 1  # the text's word j is not needed
        elif pattern[i - 1] == text[j - 1]:
            out |= 1 << (i - 1)
            i, j = i - 1, j - 1
        else:
            i -= 1
    return out


def leaked(parts: list[list[list[int]]], doc: list[int], near: list[list[int]]) -> bool:
    """Whether a document holds a passage of the item; near: for each part the starts of the document's passages that are near to it."""
    for part, starts in zip(parts, near, strict=True):
        item = [w for s in part for w in s]
        grams = {tuple(item[i : i + RUN]) for i in range(len(item) - RUN + 1)}
        heads = {g[0] for g in grams}
        if grams and any(doc[i] in heads and tuple(doc[i : i + RUN]) in grams for i in range(len(doc) - RUN + 1)):
            return True
        if len(item) < LONG or not starts:
            continue
        regions: list[list[int]] = []
        for s in sorted(starts):
            if regions and s - SPAN <= regions[-1][1]:
                regions[-1][1] = s + 2 * SPAN
            else:
                regions.append([max(0, s - SPAN), s + 2 * SPAN])
        held: list[bool] = []
        for s in part:
            best = 0
            for a, b in regions:
                got = _covered(s, doc[a:b])
                if got.bit_count() > best.bit_count():
                    best = got
            held += [bool(best >> i & 1) for i in range(len(s))]
        sums = [0]
        for h in held:
            sums.append(sums[-1] + h)
        for i in range(len(held) - LONG + 1):
            for j in range(i + LONG, min(len(held), i + 2 * LONG) + 1):  # a longer passage holds one of these
                if (j - i) - (sums[j] - sums[i]) <= ALTERED * (j - i):
                    return True
    return False


def matches(codes: DataFrame, parts: list[tuple], weights, verify: bool = True) -> DataFrame:
    """(item_id, doc_id, similarity): the candidates, judged if `verify`."""
    import numpy as np

    passages, owner = [], []
    for k, (_, _, own) in enumerate(parts):
        flat = [w for s in own for w in s]
        for i in range(0, max(1, len(flat) - RUN + ITEM_STEP), ITEM_STEP):
            piece = flat[max(0, min(i, len(flat) - RUN)) :][:RUN]
            passages.append(weights[piece].sum(0))
            owner.append(k)
    queries = np.array(passages, dtype=np.float32).reshape(len(passages), -1)
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    owner = np.array(owner, dtype=np.int64)
    starts_of = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else owner
    judge, near, span, step = leaked, NEAR, SPAN, STEP

    def search(batches):
        import numpy as np
        import pyarrow as pa

        table = np.concatenate([weights, np.zeros((1, weights.shape[1]), np.float32)])  # -1 is the last row
        by_item: dict = {}
        for k, (item, _, _) in enumerate(parts):
            by_item.setdefault(item, []).append(k)
        item_of = [p[0] for p in parts]
        for batch in batches:
            found = []
            for doc, codes in zip(batch.column("doc_id").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                c = np.asarray(codes, dtype=np.int64)
                best: dict = {}
                for base in range(0, len(c), 50_000):  # blocks bound the memory; each reaches into the next by a passage
                    part = c[base : base + 50_000 + span]
                    run = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[part], axis=0, dtype=np.float64)])
                    a = np.arange(0, max(1, min(len(part), 50_000)), step)
                    z = (run[np.minimum(a + span, len(part))] - run[a]).astype(np.float32)
                    size = np.linalg.norm(z, axis=1)
                    on = np.flatnonzero(size > 1e-6)
                    for i in range(0, len(on), 2048):
                        rows = on[i : i + 2048]
                        top = np.maximum.reduceat((z[rows] / size[rows, None]) @ queries.T, starts_of, axis=1)
                        for x, k in zip(*np.nonzero(top >= near), strict=True):
                            best.setdefault(int(k), []).append((float(top[x, k]), base + int(a[rows[x]])))
                for item in {item_of[k] for k in best}:
                    mine = by_item[item]
                    if not verify or judge([parts[k][2] for k in mine], codes, [[s for _, s in best.get(k, ())] for k in mine]):
                        found.append((item, doc, max(s for k in mine for s, _ in best.get(k, ()))))
            if found:
                x = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.float64())], names=["item_id", "doc_id", "similarity"])

    return codes.mapInArrow(search, "item_id bigint, doc_id bigint, similarity double") if len(owner) else codes.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, similarity double")


def report(spark: SparkSession, sf_dir: str, verify: bool = True) -> DataFrame:
    """(item_id, doc_id, similarity) of every document that holds a passage of an item."""
    shared_dir(spark, "leaks")  # names the checkpoint folder
    parts, vocabulary = items_of(table(spark, sf_dir, "eval_items"))
    codes = encoded(table(spark, sf_dir, "documents"), vocabulary).checkpoint()
    return matches(codes, parts, latent(codes, len(vocabulary)), verify)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).select("item_id", "doc_id")


def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected document with the number of items that leaked into it."""
    return report(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("similarity").alias("similarity"))
