"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Benchmark items are cut into windows of n consecutive words (an item with fewer
words is one window).  Their hashes are broadcast; each training document is read
once, its windows are looked up, and every hit is verified word by word.  The hash
set is arrays: the items' words in one byte buffer, and for each different window
its hash, where it begins in the buffer, and the items that hold it, about 45 bytes a
word.  It is only broadcast behind a check of the items' bytes: items beyond
SLICE_BYTES are handled in slices, each of which is looked up in a pass of its own
over the (materialised) documents.

Defined cases: null texts have no words, nor have empty ones; long texts are taken
whole.  Items without words are not searched for; items without item_id are, but
add no id.  Items that share an id count once per document; equal items are one.
Documents keep all their rows, repeated ones too, and columns; result columns
replace columns of the same name.  Empty tables give no hits, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoframe.llm import textkit as tk
from cartoframe.runtime import Scratch

#: Bytes of benchmark text in one broadcast hash set.
SLICE_BYTES = 8 << 20
_TABLE_BITS = 22


class Windows:
    """Windows of a slice of the benchmark.

    data: the words of all items, one space between two; start, end: of each word.
    by_length: length -> (hashes in order, first word, where its owners begin, owners).
    """

    def __init__(self, items: list[tuple[int, str]], n: int):
        texts, numbers = [t for _, t in items], np.array([i for i, _ in items], np.int64)
        data, starts, ends, found = [], [], [], []
        words_before = bytes_before = 0
        for a, _, words in tk.runs(pa.array(texts, pa.string()), tk.ALNUM_WORDS):
            m = len(words.hash)
            if not m:
                continue
            own = b" ".join(words.word(i) for i in range(m))
            size = words.end - words.start
            begin = bytes_before + np.concatenate([[0], np.cumsum(size[:-1] + 1)])
            data.append(own)
            starts.append(begin)
            ends.append(begin + size)
            count = np.diff(words.bounds)
            for length in np.unique(np.minimum(count[count > 0], n)).tolist():
                whole = count >= n if length == n else count == length
                grams = words.grams(length)
                at = np.flatnonzero(words.doc[: len(grams)] == words.doc[length - 1 : length - 1 + len(grams)])
                at = at[whole[words.doc[at]]]
                found.append((length, grams[at], at + words_before, numbers[a + words.doc[at]]))
            words_before, bytes_before = words_before + m, bytes_before + len(own) + 1
        self.data = b" ".join(data)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({f[0] for f in found}):
            self.by_length[length] = self._merged(length, *(np.concatenate([f[c] for f in found if f[0] == length]) for c in (1, 2, 3)))

    def spelled(self, first: int, length: int) -> bytes:
        return self.data[self.start[first] : self.end[first + length - 1]]

    def _merged(self, length: int, hashes: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple:
        """Each different window once, with all its owners."""
        order = np.lexsort((owner, first, hashes))
        hashes, first, owner = hashes[order], first[order], owner[order]
        name = np.arange(len(hashes))
        again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        for i in again.tolist():  # nearly always the window before; of equal hashes and other words, all are compared
            k = name[i - 1]
            while k >= 0 and hashes[k] == hashes[i]:
                if self.spelled(first[k], length) == self.spelled(first[i], length):
                    name[i] = k
                    break
                k -= 1
        order = np.lexsort((owner, name))
        name, owner = name[order], owner[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])])
        name, owner = name[new], owner[new]
        head = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        return hashes[name[head]], first[name[head]], np.append(head, len(name)), owner.astype(np.int32)

    def filters(self) -> dict[int, np.ndarray]:
        """A bit per low part of the hash: most document windows are ruled out by one lookup."""
        out = {}
        for length, (hashes, *_) in self.by_length.items():
            flags = np.zeros(1 << _TABLE_BITS, bool)
            flags[(hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
            out[length] = flags
        return out

    def hits(self, words: tk.Words, filters: dict[int, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, length, items) of each verified window of a run."""
        m = len(words.hash)
        for length, (hashes, first, bounds, owners) in self.by_length.items():
            if m < length:
                continue
            grams = words.grams(length)
            found = np.flatnonzero(filters[length][(grams & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)])
            found = found[words.doc[found] == words.doc[found + length - 1]]
            low, high = np.searchsorted(hashes, grams[found]), np.searchsorted(hashes, grams[found], side="right")
            for i, a, b in zip(found.tolist(), low.tolist(), high.tolist(), strict=True):
                if a < b:
                    own = b" ".join(words.word(k) for k in range(i, i + length))
                    for u in range(a, b):
                        if self.spelled(first[u], length) == own:
                            yield i, length, owners[bounds[u] : bounds[u + 1]]


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with n_words, n_hit, item_ids (of items with occurring windows, as strings) and hits.

    `hits` are merged word spans [start, end): a word inside any occurrence of a window is in one.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-size // SLICE_BYTES) or 1
    base = [c for c in docs.columns if c.lower() not in {f.name for f in _RESULT}]
    now = docs.select(*base)
    text_at = base.index(text_col)
    scratch = Scratch(spark, "decontaminate") if slices > 1 else None
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(slices)) == k)
        rows = [(r.id, r.text) for r in part.collect()]  # one slice: SLICE_BYTES in the mean
        ids = sorted({i for i, _ in rows}, key=lambda i: (i is None, i))
        number = {x: i for i, x in enumerate(ids)}
        sent = spark.sparkContext.broadcast((ids, Windows([(number[i], t) for i, t in rows], n)))
        schema = T.StructType([*now.select(*base).schema.fields, *_RESULT.fields])

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=k == 0, kinds=schema) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            names, windows = sent.value
            filters = windows.filters()
            result = [(f.name, to_arrow_type(f.dataType)) for f in kinds.fields[-4:]]
            for batch in batches:
                for i, j, words in tk.runs(batch.column(text_at), tk.ALNUM_WORDS):
                    own = batch.slice(i, j - i)
                    spans: dict[int, list] = {}
                    owners: dict[int, set[str]] = {}
                    if not first:
                        for r, (had, ids_had) in enumerate(zip(own.column("hits").to_pylist(), own.column("item_ids").to_pylist(), strict=True)):
                            spans[r], owners[r] = [(x["start"], x["end"]) for x in had], set(ids_had)
                    for at, length, who in windows.hits(words, filters):
                        r = int(words.doc[at])
                        a = int(at - words.bounds[r])
                        spans.setdefault(r, []).append((a, a + length))
                        owners.setdefault(r, set()).update(names[w] for w in who.tolist() if names[w] is not None)
                    merged = [_merge(spans.get(r, [])) for r in range(j - i)]
                    columns = [np.diff(words.bounds).tolist(), [sum(b - a for a, b in m) for m in merged], [sorted(owners.get(r, ())) for r in range(j - i)], [[{"start": a, "end": b} for a, b in m] for m in merged]]
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in range(len(base))), *(pa.array(c, kind) for c, (_, kind) in zip(columns, result, strict=True))], [f.name for f in kinds.fields])

        now = now.mapInArrow(run, schema)
        if scratch is not None:
            now = scratch.table(now)
    return now


def cut_spans(text: str | None, hits: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them; the rest keeps its bytes."""
    if text is None or not hits:
        return text
    raw = text.encode()
    words = next(w for _, _, w in tk.runs(pa.array([text], pa.string()), tk.ALNUM_WORDS))
    out, at = [], 0
    for a, b in hits:
        out.append(raw[at : words.start[a]])
        at = int(words.end[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, remove: str = "documents", text_col: str = "text") -> DataFrame:
    """`docs` without contaminated documents (remove="documents"), or with the hit words cut out of their texts ("spans")."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove}")
    found = find_contamination(docs, items, n, text_col)
    if remove == "documents":
        return found.where("n_hit = 0").select(*docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [cut_spans(t, [(h["start"], h["end"]) for h in hits]) for t, hits in zip(batch.column(at).to_pylist(), batch.column("hits").to_pylist(), strict=True)]
            columns = [pa.array(texts, batch.schema.field(at).type) if c == at else batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return found.select(*docs.columns, "hits").mapInArrow(run, docs.schema)


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by `benchmark` windows of 10 words."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
