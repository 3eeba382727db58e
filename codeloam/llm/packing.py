"""Filling containers of fixed capacity: sum-of-squares packing of documents measured in tokens."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.session import cut, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the byte-level vocabulary splits a text before merging
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ITEMS = 20_000  # expected items packed by one task
MAX_CAPACITIES = 1_000


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document with a text; strings of special tokens count as ordinary text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(encode(t)) for t in pdf["text"]]})

    return spread(documents.select("doc_id", "text").where("text is not null"), "doc_id").mapInPandas(run, "doc_id bigint, n_tokens bigint")


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item, in the order given.

    An item goes where the sum over all gaps of (open containers with that gap) squared grows least; a full or an
    untouched container has no gap to count. Ties go to the smallest gap, an open container before a new one.
    """
    count = np.zeros(capacity + 1, np.int64)
    at: dict[int, list[int]] = {}
    out, made = [], 0
    for s in sizes:
        if not 0 <= s <= capacity:
            raise ValueError("an item must fit into an empty container")
        gaps = np.flatnonzero(count[s:]) + s if s else np.flatnonzero(count)
        fresh = 2 * count[capacity - s] + 1 if 0 < s < capacity else 0
        best = None
        if len(gaps):
            if s == 0:
                best = int(gaps[0])
            else:
                grown = 2 * (count[gaps - s] - count[gaps]) + 2
                if gaps[0] == s:
                    grown[0] = 1 - 2 * count[s]
                k = int(grown.argmin())
                if s < capacity and grown[k] <= fresh:
                    best = int(gaps[k])
        if best is None:
            box, gap = made, capacity - s
            made += 1
        else:
            box = at[best].pop()
            count[best] -= 1
            gap = best - s
        out.append(box)
        if gap:
            count[gap] += 1
            at.setdefault(gap, []).append(box)
    return out


def pack(sizes: DataFrame, capacities: DataFrame, items_per_task: int = ITEMS) -> DataFrame:
    """(capacity_id, container_id, doc_id, piece_no, begin_token, n_tokens) for each capacity.

    Only a document longer than the capacity is split: into pieces of exactly the capacity, which fill a container
    each, and a rest that is packed like any item. Documents fall by hash into groups of about ``items_per_task``; each
    group is packed on its own, largest items first, so no task grows with the data and what is lost is at most a
    partly filled container per group and open gap.

    An empty text takes no room and still gets a container. Null sizes, null capacities and capacities under 1 are
    dropped; repeated rows are items of their own; equal sizes go in the order of doc_id; empty tables give an empty
    result; other columns are ignored.
    """
    sizes = sizes.select("doc_id", "n_tokens").where("n_tokens is not null")
    groups = max(1, -(-sizes.count() // items_per_task))
    caps = capacities.select(F.col("capacity_id").cast("int"), F.col("max_tokens").cast("bigint").alias("cap")).where("cap >= 1 and capacity_id is not null").distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(caps) > MAX_CAPACITIES:
        raise ValueError("too many capacities")
    each = F.explode(F.array(*[F.struct(F.lit(c[0]).alias("capacity_id"), F.lit(c[1]).cast("bigint").alias("cap")) for c in sorted(caps)]) if caps else F.expr("cast(array() as array<struct<capacity_id:int,cap:bigint>>)"))
    pieces = F.expr("greatest(1L, (n_tokens + cap - 1) div cap)")
    items = sizes.select("doc_id", "n_tokens", each.alias("c")).select("doc_id", "n_tokens", "c.*").withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    items = items.select("capacity_id", "cap", "doc_id", "piece_no", F.expr("piece_no * cap").alias("begin_token"), F.expr("least(cap, n_tokens - piece_no * cap)").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups)).alias("grp"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        box = np.array(sum_of_squares(pdf["n_tokens"].tolist(), int(pdf["cap"].iloc[0])), np.int64)
        return pdf.assign(container_id=(pdf["grp"].to_numpy(np.int64) << 32) | box)[["capacity_id", "container_id", "doc_id", "piece_no", "begin_token", "n_tokens"]]

    return items.groupBy("capacity_id", "grp").applyInPandas(run, "capacity_id int, container_id bigint, doc_id bigint, piece_no bigint, begin_token bigint, n_tokens bigint")


def pack_documents(documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`pack` of the documents' token counts; texts are read whole, once, and never shuffled for packing."""
    return pack(cut(token_counts(documents, vocabulary)), capacities)
