"""Encoding a corpus with a public byte-level BPE tokenizer (problem 8).

Method: monoid tree reduction. A text is halved until its parts are at most
`leaf` code points; leaves are encoded on their own and neighbours are joined:
a window around the seam is re-encoded, and it grows on either side until its
edge is a place where the tokens outside provably don't change.

Why an edge is safe: the tokenizer first cuts a text into units by a pattern of
which no alternative holds white space after another character, and merges
bytes inside a unit only. So a unit ends wherever a character other than white
space is followed by white space, whatever stands further to the left or right,
and tokens never reach across. Outside a window with two such edges (or with
the text's own ends) the tokens of the parts are those of the whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
LEAF = 2048
#: Fixed value: the unit pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZERS, name: str = NAME):
    """(encode, token_bytes, decode): loaded once in each Python worker."""
    import tiktoken

    with open(os.path.join(path, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return own.encode_ordinary, sizes, own.decode


def _left_edge(text: str) -> int:
    """The greatest offset of `text` that is a safe edge, looking from its end in growing windows."""
    n, width = len(text), 16
    while True:
        low = max(0, n - width)
        for i in range(n - 1, low, -1):
            if text[i].isspace() and not text[i - 1].isspace():
                return i
        if low == 0:
            return 0
        width *= 4


def _right_edge(text: str) -> int:
    """The least offset of `text` above 0 that is a safe edge, or its length."""
    n, width = len(text), 16
    while True:
        high = min(n, width)
        for i in range(1, high):
            if text[i].isspace() and not text[i - 1].isspace():
                return i
        if high == n:
            return n
        width *= 4


def join(left: tuple[str, list[int]], right: tuple[str, list[int]], encode, sizes: np.ndarray) -> tuple[str, list[int]]:
    """The monoid's operation on (text, ids); ("", []) is its unit."""
    (a, x), (b, y) = left, right
    if not a or not b:
        return (b, y) if not a else left
    i, j = _left_edge(a), _right_edge(b)
    middle = encode(a[i:] + b[:j])
    drop, k = len(a[i:].encode()), len(x)
    while drop > 0:
        k -= 1
        drop -= sizes[x[k]]
    skip, m = len(b[:j].encode()), 0
    while skip > 0:
        skip -= sizes[y[m]]
        m += 1
    if drop or skip:
        raise AssertionError("a token reaches across a safe edge")
    return a + b, x[:k] + middle + y[m:]


def encode_tree(text: str, encode, sizes: np.ndarray, leaf: int = LEAF) -> list[int]:
    """Ids of `text`, the same as those of encoding it in one go."""

    def node(lo: int, hi: int) -> tuple[str, list[int]]:
        if hi - lo <= leaf:
            part = text[lo:hi]
            return part, encode(part)
        mid = (lo + hi) // 2
        return join(node(lo, mid), node(mid, hi), encode, sizes)

    return node(0, len(text))[1]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZERS, name: str = NAME, leaf: int = LEAF) -> DataFrame:
    """(`key`, ids array<int>) for every row, without special tokens.

    Empty and null texts have the empty list. Strings that look like special
    tokens are ordinary text. Repeated rows each keep their row. There is no
    shuffle; other columns aren't read.
    """
    source = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = dict(source.dtypes)["__key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes, _ = encoder(path, name)
        for batch in batches:
            ids, ends = [], [0]
            for s in batch.column(1).to_pylist():
                if s:
                    ids.append(np.array(encode_tree(s, encode, sizes, leaf), dtype=np.int32))
                    ends.append(ends[-1] + len(ids[-1]))
                else:
                    ends.append(ends[-1])
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["__key", "ids"])

    return source.mapInArrow(run, f"__key {kind}, ids array<int>").withColumnRenamed("__key", key)
