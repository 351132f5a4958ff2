"""Token counts by byte-pair merging, without token identifiers.

A text is cut into pre-tokens by the tokenizer's pattern.  A pre-token starts as
its UTF-8 bytes in a linked list; a heap yields the adjacent pair of lowest rank
(leftmost first), which becomes one symbol, until no adjacent pair has a rank.
The count is the number of initial symbols minus the number of merges.  Counts
of pre-tokens are kept in a bounded table, since running text repeats them.

Strings of added tokens inside a text are one token each, as the library does by
default.  Defined cases: null and empty texts have 0 tokens; a pre-token of any
length is handled in n log n steps.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens in the table of known counts; it is emptied when full.
KNOWN = 400_000
#: The pre-token pattern of byte-level BPE: a fixed value of the tokenizer's format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Character -> byte: bytes that print stand for themselves, the others for the characters from 256 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def load_merges(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """(pair -> rank, strings of added tokens) of a byte-level BPE file in JSON.  Anything the counter does not model is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if spec.get("normalizer") or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        raise ValueError(f"{path}: only plain byte-level BPE is counted")
    added = spec.get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path}: added tokens that strip or need word bounds are not counted")
    letters = byte_alphabet()
    raw = lambda s: bytes(letters[c] for c in s)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(merges)}, sorted((t["content"] for t in added), key=len, reverse=True)


def count_merged(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols that are left of a pre-token."""
    n = len(piece)
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbol[i], symbol[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != left or j >= n or symbol[j] != right:
            continue  # one of the two has been merged meanwhile
        symbol[i], symbol[j] = left + right, None
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbol[i], symbol[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbol[i], symbol[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbol[h], symbol[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbol[h], symbol[i]))
    return n - merges


class Counter(dict):
    """pre-token -> tokens, filled as pre-tokens come."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int], added: list[str]):
        import regex

        self.ranks = ranks
        self.cut = regex.compile(PATTERN).findall
        self.split = regex.compile("|".join(map(regex.escape, added))).split if added else None
        self.special = added

    def __missing__(self, piece: str) -> int:
        n = count_merged(piece.encode(), self.ranks)
        if len(piece) <= 64:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split is None or not any(s in text for s in self.special):
            return sum(map(self.__getitem__, self.cut(text)))
        parts = self.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.cut(p))) for p in parts)


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """`docs` without its text, with n_bytes, n_tokens and over_limit; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(load_merges(tokenizer_path))  # as large as the vocabulary file
    keep = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit") and c != text_col]
    names = [*keep, "n_bytes", "n_tokens"]
    kinds = docs.select(*keep).schema
    schema = kinds.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*sent.value)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            tokens = [counter.count(t.as_py()) for t in text]
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), size, pa.array(tokens, pa.int64())], names)

    return docs.select(*keep, F.col(text_col).cast("string")).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public 50k byte-level vocabulary."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
