"""Removal of repeated sentence spans.

A text is cut into sentences (at . ! ? before anything but a word's character, and at line ends) and
each sentence into normalised words.  From every sentence on, the shortest run of
several consecutive sentences with at least `words` words is hashed, and with
`tails` also the shortest run that ends with each sentence.  Equal runs
are joined globally; the first occurrence is the one of least (doc_id, place),
and sentences covered by any other occurrence are removed.

Both directions together remove what all runs of any length would: in a longer
run, the sentences up to the end of the shortest run from its start are covered
by that run, and every later sentence ends a run that does not begin before it.
Without `tails`, short last sentences of a repeated passage stay.

Occurrences travel as packed arrays.  Of the occurrences of one run that a task
sees, only the first can be the global first, so only it goes to the join: a
passage in a third of all documents costs one entry a task there.

A run has to have some words to be a passage: short sentences that follow each other
("Yes. No.") repeat in texts that have nothing to do with each other.

Defined cases: null texts stay null.  A text of fewer sentences than `sentences`
or fewer words has no run and stays as it is, as does every text in which nothing
is removed, byte for byte; long texts are taken whole.  Rows that share doc_id and
text are one document: they do not repeat each other.  Rows without doc_id come
after all others, in order of their text's hash; a text's marks go to the rows of
that id and text alone.  Extra columns stay; result columns replace columns of the
same name.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoframe.llm import textkit as tk

NO_ID = (1 << 63) - 1
_OUTSIDE = tk.lut(lambda b: not (tk.ALNUM_WORDS[b] or 0x41 <= b <= 0x5A))
_STOP = tk.lut(lambda b: b in b".!?")


class Sentences:
    """Sentences of a run of texts: `doc`, `hash`, `count` (of words), `start` (byte in the run), `bounds` (of texts)."""

    def __init__(self, words: tk.Words):
        data, m = words.data, len(words.hash)
        self.words = words
        n = len(data)
        ends = np.zeros(n + 1, np.int64)
        if n:
            follows = np.ones(n, bool)
            follows[:-1] = _OUTSIDE[data[1:]]
            cut = (_STOP[data] & follows) | (data == 0x0A)
            np.cumsum(cut, out=ends[1:])
        part = ends[words.start]
        new = np.ones(m, bool)
        new[1:] = (part[1:] != part[:-1]) | (words.doc[1:] != words.doc[:-1])
        first = np.flatnonzero(new)
        self.count = np.diff(np.append(first, m))
        self.doc = words.doc[first]
        self.start = words.start[first]
        self.bounds = np.searchsorted(self.doc, np.arange(len(words.offsets)))
        last = first + self.count
        with np.errstate(over="ignore"):
            self.hash = tk.mix(tk.placed_sums(words.hash, first, last) + self.count.astype(np.uint64))

    def runs(self, sentences: int, words: int, tails: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, one past the last, hash) of every run; `tails`: also of the shortest that end with each sentence."""
        k = len(self.hash)
        total = np.concatenate([[0], np.cumsum(self.count)])
        first = np.arange(k)
        last = np.maximum(np.searchsorted(total, total[:-1] + words), first + sentences)
        ok = last <= self.bounds[self.doc + 1]
        if tails:
            past = np.arange(1, k + 1)
            begin = np.minimum(np.searchsorted(total, total[1:] - words, side="right") - 1, past - sentences)
            fits = begin >= self.bounds[self.doc]
            begin, past = begin[fits], past[fits]
            new = ~(ok[begin] & (last[begin] == past))  # a run that is the shortest both ways counts once
            first, last = np.concatenate([first[ok], begin[new]]), np.concatenate([last[ok], past[new]])
        else:
            first, last = first[ok], last[ok]
        with np.errstate(over="ignore"):
            return first, last, tk.mix(tk.placed_sums(self.hash, first, last) + (last - first).astype(np.uint64))


def _blob(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c, np.int64).tobytes() for c in columns)


def _repeats(docs: DataFrame, sentences: int, words: int, tails: bool) -> DataFrame:
    """id, text_hash, places (packed numbers, first sentence << 32 | one past the last): the non-first occurrences.  docs: id, text, text_hash."""
    places = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed (hash, id, text, place, first?) by target."""
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, doc, text, place = np.concatenate(held, axis=1)
            order = np.lexsort((place, text, doc, key))
            key, doc, text, place = (c[order] for c in (key, doc, text, place))
            same = np.zeros(len(key), bool)  # the same occurrence again, of a repeated row
            same[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (place[1:] == place[:-1])
            key, doc, text, place = (c[~same] for c in (key, doc, text, place))
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            # a non-first occurrence is settled: it only has to reach its document
            target = np.where(first, key.view(np.uint64) % np.uint64(places), tk.mix((doc ^ text).view(np.uint64)) % np.uint64(places)).astype(np.int64)
            order = np.lexsort((first, target))
            target, first = target[order], first[order]
            key, doc, text, place = (c[order] for c in (key, doc, text, place))
            rows = []
            for t in np.unique(target):
                a, b = np.searchsorted(target, t), np.searchsorted(target, t, side="right")
                c = a + int(np.searchsorted(first[a:b], True))
                rows.append((int(t), _blob(key[c:b], doc[c:b], text[c:b], place[c:b]), _blob(doc[a:c], text[a:c], place[a:c])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["target", "firsts", "settled"])

        for batch in batches:
            ids, texts = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(2).to_numpy()
            for i, j, w in tk.runs(batch.column(1), tk.ALNUM_WORDS):
                s = Sentences(w)
                first, last, key = s.runs(sentences, words, tails)
                if not len(first):
                    continue
                d = s.doc[first]
                held.append(np.stack([key.view(np.int64), ids[i:j][d], texts[i:j][d], (first - s.bounds[d]) << 32 | (last - s.bounds[d])]))
                size += len(first)
                if size >= 1_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for t, f, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                a, b = by.setdefault(t, ([], []))
                a.append(np.frombuffer(f.as_buffer(), np.int64).reshape(4, -1).copy())
                b.append(np.frombuffer(s.as_buffer(), np.int64).reshape(3, -1).copy())
        for t in list(by):
            a, b = by.pop(t)
            key, doc, text, place = np.concatenate(a, axis=1)
            order = np.lexsort((place, text, doc, key))
            key, doc, text, place = (c[order] for c in (key, doc, text, place))
            # anything but the head of its run, which two tasks may both have sent
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            head = np.repeat(start, np.diff(np.append(start, len(key))))
            again = (doc != doc[head]) | (text != text[head]) | (place != place[head])
            hit = np.concatenate([np.stack([doc, text, place])[:, again], *b], axis=1)
            if not hit.shape[1]:
                continue
            hit = np.unique(hit, axis=1)
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(hit[:2], axis=1) != 0).any(0)]))
            ends = np.append(cut[1:], hit.shape[1])
            for k in range(0, len(cut), 20_000):
                c, e = cut[k : k + 20_000], ends[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(hit[0, c]), pa.array(hit[1, c]), pa.array([hit[2, x:y].tobytes() for x, y in zip(c, e, strict=True)], pa.binary())], ["id", "text_hash", "places"])

    return docs.mapInArrow(scatter, "target int, firsts binary, settled binary").repartition(places, "target").mapInArrow(gather, "id long, text_hash long, places binary")


def remove_repeated_spans(docs: DataFrame, sentences: int = 2, words: int = 10, id_col: str = "doc_id", text_col: str = "text", tails: bool = False) -> DataFrame:
    """`docs` with repeated spans (`tails`: whole to their last sentence) cut from the text, and n_sentences, n_removed, removed (byte spans of the old text)."""
    base = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed", "removed", "__id", "__hash", "__at")]
    kinds = docs.select(*base).schema
    at = base.index(text_col)
    if not isinstance(kinds[text_col].dataType, T.StringType):
        raise TypeError(f"{text_col} is not a string column")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_hash.alias("h"))
    marks = _repeats(slim, sentences, words, tails).groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list("places").alias("__at"))
    own = docs.select(*base).withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("__hash", text_hash)
    joined = own.join(marks, ["__id", "__hash"], "left").select(*base, "__at")
    schema = T.StructType([*kinds.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        spans_type = to_arrow_type(schema["removed"].dataType)
        for batch in batches:
            for i, j, w in tk.runs(batch.column(at), tk.ALNUM_WORDS):
                s = Sentences(w)
                own = batch.slice(i, j - i)
                texts, counts, spans = own.column(at).to_pylist(), np.diff(s.bounds), []
                for r, marked in enumerate(own.column(len(base)).to_pylist()):
                    drop = np.zeros(int(counts[r]), bool)
                    for m in marked or ():
                        for p in np.frombuffer(m, np.int64).tolist():
                            drop[p >> 32 : p & 0xFFFFFFFF] = True
                    own_spans = []
                    if drop.any():
                        # a sentence reaches from its first word to the next sentence's, the text's first from its very start
                        begin = s.start[s.bounds[r] : s.bounds[r + 1]] - w.offsets[r]
                        edge = np.concatenate([[0], begin[1:], [w.offsets[r + 1] - w.offsets[r]]])
                        raw = texts[r].encode()
                        texts[r] = b"".join(raw[edge[x] : edge[x + 1]] for x in np.flatnonzero(~drop)).decode()
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
                        own_spans = [{"start": int(edge[a]), "end": int(edge[b])} for a, b in zip(turn[::2], turn[1::2], strict=True)]
                    spans.append((int(drop.sum()), own_spans))
                columns = [pa.array(texts, own.schema.field(at).type) if c == at else own.column(c) for c in range(len(base))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array([x for x, _ in spans], pa.int64()), pa.array([x for _, x in spans], spans_type)], schema.names)

    return joined.mapInArrow(run, schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without repeated runs of two or more sentences and 10 or more words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_spans(docs, tails=True).select("doc_id", "text", "n_sentences", "n_removed", "removed")
