"""Encode whole texts with a public byte-level BPE by a tree of joins.

``encode`` is a homomorphism once its seams are repaired: the ids of ``a + b`` follow from the ids of ``a`` and of ``b``
by encoding a window around the seam again, whose text is that of the last tokens of the one and the first of the other.
The window grows until the tokens outside it are proved to stay. On either side it may end

* at a *safe cut*, between a character that isn't white space and a space or newline: the split pattern of the
  vocabulary has no alternative in which white space follows anything else, so no token crosses it; or
* within a run of letters, of digits or of other marks, which is one unit of the split pattern wherever the text goes on,
  if the new ids begin (end) with the token that stood there before: then all neighbours are pairs that the merges have
  made before, and a sequence of which every pair of neighbours encodes to itself is the encoding of its unit; or
* at the end of the text.

Long texts are cut into segments that Spark spreads over tasks, each encoded by halves; the segments of one text are then
joined as a tree too, from their ids alone. Null and empty texts have the empty list.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.arrowtext import int_lists, over_slices
from corpusloom.session import ship

#: The pattern by which the public vocabulary splits text before its merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Characters under which a piece is encoded at once, and characters of a segment that is encoded by one task.
LEAF, SEGMENT = 1024, 1 << 18


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The encoding of a rank file and the bytes of each of its tokens, loaded once in a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), tokens


def _kind(c: str) -> str:
    """Of what run a character is part: white space, letters, digits or other marks."""
    if c.isspace():
        return "s"
    first = unicodedata.category(c)[0]
    return first if first in "LN" else "o"


def _whole(tokens: list[bytes], ids: list[int], at: int) -> bool:
    """Whether a character begins with the token at ``at``."""
    return at <= 0 or at >= len(ids) or tokens[ids[at]][0] & 0xC0 != 0x80


def _stays(before: str, after: str, same: bool) -> bool:
    """Whether a window may end between ``before`` and ``after``; ``same`` says that the token on the window's side is the old one."""
    if not before or not after:
        return False
    if after[0] in " \n" and not before[-1].isspace():
        return True
    run = _kind(after[0])
    # an apostrophe close by may take letters of its own
    return same and run != "s" and len(before) >= 3 and _kind(before[-1]) == run and "'" not in before[-3:] + after[:1]


def join(a: list[int], b: list[int], enc, tokens: list[bytes], size: int = 6) -> list[int]:
    """The ids of a text from those of its two parts."""
    if not a or not b:
        return a or b
    low, high = max(0, len(a) - size), min(len(b), size)
    while True:
        while not _whole(tokens, a, low):
            low -= 1
        while not _whole(tokens, b, high):
            high += 1
        text = b"".join([tokens[i] for i in a[low:]] + [tokens[i] for i in b[:high]]).decode()
        made = enc.encode_ordinary(text)
        left = low == 0
        if not left:
            context = b"".join(tokens[i] for i in a[max(0, low - 6) : low]).decode(errors="ignore")
            left = _stays(context, text, made[0] == a[low])
        right = high == len(b)
        if not right:
            context = b"".join(tokens[i] for i in b[high : high + 4]).decode(errors="ignore")
            own = b"".join(tokens[i] for i in b[:high]).decode()  # the part of the window behind the seam: a run begun before it is no longer open after three characters
            right = _stays(own, context, made[-1] == b[high - 1])
        if left and right:
            return a[:low] + made + b[high:]
        low = low if left else max(0, low - size)
        high = high if right else min(len(b), high + size)
        size *= 2


def encode_tree(text: str, enc, tokens: list[bytes], leaf: int = LEAF) -> list[int]:
    """Encode halves recursively and join them; equal to encoding at once."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    half = len(text) // 2
    return join(encode_tree(text[:half], enc, tokens, leaf), encode_tree(text[half:], enc, tokens, leaf), enc, tokens)


def join_all(parts: list[list[int]], enc, tokens: list[bytes]) -> list[int]:
    """Join neighbours level by level, as a balanced tree."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1], enc, tokens) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def decode(ids: list[int], path: str) -> str:
    """The text of ids: the concatenation of their bytes."""
    return tokenizer(path)[0].decode(ids)


def _encoder(path: str, leaf: int, counts_only: bool):
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, tokens = tokenizer(path)
        at = batch.schema.get_field_index("__text")
        lists = [encode_tree(t, enc, tokens, leaf) if t else [] for t in batch.column(at).to_pylist()]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        if counts_only:
            made = pa.array(counts, pa.int64())
        else:
            flat = np.fromiter((x for ids in lists for x in ids), np.int32, int(counts.sum()))
            made = int_lists(flat, counts)
        keep = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made], [*(batch.schema.names[i] for i in keep), "ids" if not counts_only else "n_tokens"])

    return over_slices(encode, "__text")


def encode_texts(
    df: DataFrame, key: str, text: str = "text", *, vocabulary: str | None = None, leaf: int = LEAF, segment: int = SEGMENT, counts_only: bool = False
) -> DataFrame:
    """(key, ids) of each row, or (key, n_tokens) with ``counts_only``.

    One row for each row of ``df``: repeated rows and repeated keys stay repeated, however long their texts are. Null and
    empty texts have no ids; other columns of ``df`` are ignored, whatever their names.
    """
    ship(df.sparkSession)
    path = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    out = "n_tokens bigint" if counts_only else "ids array<int>"
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    short = rows.where(F.col("__text").isNull() | (F.length("__text") <= segment))
    done = short.mapInArrow(_encoder(path, leaf, counts_only), f"__key {kind}, {out}")
    # a text beyond one segment: its segments are encoded by different tasks, then joined at their seams
    cut = F.expr(f"transform(sequence(0, cast((length(__text) - 1) div {segment} as int)), i -> substring(__text, i * {segment} + 1, {segment}))")
    parts = (
        rows.where(F.length("__text") > segment)
        .select("__key", F.xxhash64("__text").alias("of"), F.length("__text").alias("long"), F.posexplode(cut).alias("part", "__text"))
        .groupBy("__key", "of", "long", "part")
        .agg(F.first("__text").alias("__text"), F.count("*").alias("copies"))  # equal rows are encoded once
        .repartition(F.col("__key"), F.col("of"), F.col("part"))
    )
    encoded = parts.mapInArrow(_encoder(path, leaf, False), f"__key {kind}, of bigint, long int, part int, copies bigint, ids array<int>")

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tokens = tokenizer(path)
        for batch in batches:
            lists = [join_all([p["ids"] for p in ps], enc, tokens) for ps in batch.column("parts").to_pylist()]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((x for ids in lists for x in ids), np.int32, int(counts.sum()))
            made = pa.array(counts, pa.int64()) if counts_only else int_lists(flat, counts)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("copies"), made], ["__key", "copies", out.split()[0]])

    joined = (
        encoded.groupBy("__key", "of", "long", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
        .mapInArrow(tree, f"__key {kind}, copies bigint, {out}")
        .select("__key", out.split()[0], F.explode(F.sequence(F.lit(1), "copies")))
        .drop("col")
    )
    return done.unionByName(joined).withColumnRenamed("__key", key)
