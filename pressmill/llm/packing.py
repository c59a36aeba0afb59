"""Filling fixed-capacity containers with texts (problem 8).

Sizes are tokens of a public tokenizer (its vocabulary file is a parameter). A
text larger than the capacity is cut into full pieces and a rest; every other
stays whole. Pieces are spread over shards of about `SHARD` by a hash of their
id, so that no task grows with the data, and each shard is packed on its own,
which costs at most a part of one container a shard.

Within a shard the Martello-Toth reduction comes first: going down from the
largest piece, it fixes a container that provably dominates every other one that
could hold that piece: alone where nothing fits beside it, else with the largest
partner that fits, where that fills the room, where no two others fit beside it, or
where no set of others fills more of it than the partner does. (Whatever else stood
beside the piece fits where the partner stood.) The last case looks at pairs
first and, where three others would fit, at all sums of the pieces left. Pieces of
one size are alike, so whole counts are fixed at a time. What remains goes to the
fullest container it fits, largest first.

Defined results: NULL texts count as empty; texts without tokens take no room and
have no container (pack_id NULL); a capacity that is NULL or below 1 holds nothing
and is left out.
"""

from __future__ import annotations

import base64
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.session import spread, staged

#: Default place of the vocabulary, a rank file of byte-level BPE, and the pattern that goes with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD = 50_000
#: Kinds of containers that one pass over the sizes takes; more are taken in several.
CAPACITIES = 1_000
_encodings: dict[tuple, object] = {}


def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer, once a worker."""
    key = (vocabulary, pattern)
    if key not in _encodings:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens) of every document."""

    def run(batches):
        e = encoding(vocabulary, pattern)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return spread(documents.select(F.col(id_col).cast("long").alias("doc_id"), text_col), "doc_id").mapInArrow(run, "doc_id long, tokens long")


class _Left:
    """The pieces still to be placed, by size."""

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity, self.stacks = capacity, {}
        for i, s in enumerate(sizes):
            self.stacks.setdefault(s, []).append(i)
        self.count = np.zeros(capacity + 2, np.int64)
        for s, items in self.stacks.items():
            self.count[s] = len(items)
        self.every = np.arange(capacity + 2)
        self.look()

    def look(self) -> None:
        """largest: for each x the largest size there is up to x, 0 for none; sizes: those there are, ascending."""
        self.largest, self.sizes = np.maximum.accumulate(np.where(self.count > 0, self.every, 0)), np.flatnonzero(self.count)

    def partner(self, w: int) -> int | None:
        """The size whose piece beside one of size w dominates, 0 for nothing beside it, None if no single partner does."""
        room, count = self.capacity - w, self.count
        k = int(self.largest[room])
        if k == w and count[w] == 1:
            k = int(self.largest[w - 1])
        if not k or k == room:
            return k
        count[w] -= 1  # what stands beside it is of the others
        try:
            return None if self._fuller(k, room) else k
        finally:
            count[w] += 1

    def _fuller(self, k: int, room: int) -> bool:
        """Whether a set of two pieces or more sums to more than k, up to room."""
        count = self.count
        small = [int(s) for s in self.sizes[:4] for _ in range(min(3, int(count[s])))][:3]
        if len(small) < 2 or small[0] + small[1] > room:
            return False
        a = self.sizes[(self.sizes < room) & (count[self.sizes] > 0)]
        b = np.minimum(self.largest[room - a], room - a)  # the best second piece; a size counted once too often only leaves more to the best fit
        if len(a) and int(np.where(b > 0, a + b, 0).max()) > k:
            return True
        if len(small) < 3 or sum(small) > room:
            return False
        # three or more would fit: all sums there are, as bits
        reach, held, above = 1, (1 << room + 1) - 1, ((1 << room + 1) - 1) ^ ((1 << k + 1) - 1)
        for s in a[::-1].tolist():
            n, step = min(int(count[s]), room // s), 1
            while n:
                take = min(step, n)
                reach |= reach << s * take & held
                n, step = n - take, step * 2
            if reach & above:
                return True
        return False


def reduction(sizes: list[int], capacity: int) -> tuple[list[int], int, dict[int, list[int]]]:
    """(container of each piece that is fixed, -1 for others; containers; the others by size). Some best packing has these containers."""
    left, place, bins = _Left(sizes, capacity), [-1] * len(sizes), 0
    for w in sorted(left.stacks, reverse=True):
        while left.count[w]:
            k = left.partner(w)
            if k is None:
                break
            n = int(left.count[w]) if not k else int(left.count[w]) // 2 if k == w else int(min(left.count[w], left.count[k]))
            for _ in range(n):
                place[left.stacks[w].pop()] = bins
                if k:
                    place[left.stacks[k].pop()] = bins
                bins += 1
            for s in (w, k) if k else (w,):
                left.count[s] -= n
            left.look()
    return place, bins, left.stacks


def pack(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """(container of each piece, containers fixed by the reduction). Sizes are from 1 to capacity."""
    place, bins, stacks = reduction(sizes, capacity)
    fixed = bins
    # best fit, largest first; open containers by the room they have left
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for w in sorted((s for s in stacks if stacks[s]), reverse=True):
        for i in stacks[w]:
            m = mask >> w
            if m:
                room = w + (m & -m).bit_length() - 1
                b = left[room].pop()
                if not left[room]:
                    mask &= ~(1 << room)
            else:
                room, b, bins = capacity, bins, bins + 1
            place[i] = b
            left[room - w].append(b)
            mask |= 1 << (room - w)
    return place, fixed


def pieces(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, capacity, doc_id, piece_no, tokens): whole texts, or the full pieces and the rest of larger ones.

    The capacities, a few, ride along as a literal; a list of more than CAPACITIES is taken in parts.
    """
    c = capacities.where(F.col("capacity_tokens") >= 1).select("pack_name", F.col("capacity_tokens").cast("long")).distinct().collect()
    kind = "array<struct<pack_name:string,capacity:bigint>>"

    def part(rows: list) -> DataFrame:
        listed = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(k).cast("long").alias("capacity")) for n, k in rows]).cast(kind)
        j = sizes.select("doc_id", "tokens", F.explode(listed).alias("p")).select("doc_id", "tokens", "p.*")
        n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
        j = j.withColumn("piece_no", F.explode(F.sequence(F.lit(1), n)))
        return j.select("pack_name", "capacity", "doc_id", "piece_no", F.least(F.col("capacity"), F.col("tokens") - (F.col("piece_no") - 1) * F.col("capacity")).alias("tokens"))

    return reduce(DataFrame.unionByName, [part(c[a : a + CAPACITIES]) for a in range(0, max(1, len(c)), CAPACITIES)])


def packs(documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """(pack_name, pack_id, doc_id, piece_no, tokens): the container of each piece."""
    sizes = staged(token_counts(documents, vocabulary=vocabulary), "tokens")
    p = pieces(sizes, capacities)
    most = p.groupBy("pack_name").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shards = max(1, -(-most // shard))
    p = p.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int"))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        place, _ = pack(pdf["tokens"].tolist(), int(pdf["capacity"].iloc[0]))
        return pd.DataFrame({"pack_name": key[0], "pack_id": [(int(key[1]) << 32) + b for b in place], "doc_id": pdf["doc_id"], "piece_no": pdf["piece_no"], "tokens": pdf["tokens"]})

    out = p.where(F.col("tokens") > 0).groupBy("pack_name", "shard").applyInPandas(fill, "pack_name string, pack_id long, doc_id long, piece_no int, tokens long")
    empty = p.where(F.col("tokens") <= 0).select("pack_name", F.lit(None).cast("long").alias("pack_id"), "doc_id", "piece_no", "tokens")
    return out.unionByName(empty)


def report(documents: DataFrame, capacities: DataFrame, **params) -> DataFrame:
    """(pack_name, packs, least, unused): the containers used, the fewest that could hold the tokens, and the share of room left."""
    p = packs(documents, capacities, **params).where(F.col("pack_id").isNotNull())
    per = p.groupBy("pack_name", "pack_id").agg(F.sum("tokens").alias("t")).groupBy("pack_name").agg(F.count("*").alias("packs"), F.sum("t").alias("t"))
    j = per.join(capacities.select("pack_name", F.col("capacity_tokens").cast("long").alias("c")), "pack_name")
    return j.select("pack_name", "packs", F.ceil(F.col("t") / F.col("c")).cast("long").alias("least"), F.round(1 - F.col("t") / (F.col("packs") * F.col("c")), 6).alias("unused"))


def invariants(documents: DataFrame, capacities: DataFrame, **params) -> DataFrame:
    """(pack_name, documents, whole, missing, overfull, cut): what must hold of a packing, counted: every document is there, with all its pieces, no container holds more than its capacity, none is cut that would fit whole."""
    p = staged(packs(documents, capacities, **params), "packs")
    c = capacities.where(F.col("capacity_tokens") >= 1).select("pack_name", F.col("capacity_tokens").cast("long").alias("c")).distinct()
    full = p.where(F.col("pack_id").isNotNull()).groupBy("pack_name", "pack_id").agg(F.sum("tokens").alias("t")).join(c, "pack_name").groupBy("pack_name").agg(F.count_if(F.col("t") > F.col("c")).alias("overfull"))
    d = p.groupBy("pack_name", "doc_id").agg(F.count("*").alias("n"), F.max("piece_no").alias("last"), F.sum("tokens").alias("t")).join(c, "pack_name")
    each = d.groupBy("pack_name").agg(F.count("*").alias("documents"), F.sum("n").alias("pieces"), F.count_if(F.col("n") != F.col("last")).alias("missing"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("c"))).alias("cut"))
    return each.join(full, "pack_name", "left").select("pack_name", "documents", (F.col("pieces") >= F.col("documents")).alias("whole"), "missing", F.coalesce("overfull", F.lit(0)).alias("overfull"), "cut")
