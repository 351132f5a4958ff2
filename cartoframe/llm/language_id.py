"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of labelled texts,
whole texts of a bounded sample of rows.  A text is compressed with every
dictionary; the smallest result names the language.  The margin is how much
larger the second smallest is, relative to the smallest; a narrow margin rejects
the text (`rejected`).

A text is compressed in pieces of PIECE bytes, all of them, so that the
dictionary stays in the matcher's reach and does not lose its weight in long
texts.  Every text is compressed at each of LEVELS, and the sizes are added: their
match finders differ, so that short texts tie less and err in different places.

Defined cases: a text that is null or has no letters (Unicode category L) is
`und`, with score 0.  Ties go to the language that sorts first.  With one
language only, the score is 1.  Without labelled texts all is `und`.  Rows are
judged one by one, repeated ones too; an empty table gives an empty result.
Extra columns stay; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoframe.llm.sampling import Sample
from cartoframe.llm.toxicity import is_held_out

#: Labelled texts of a language that a dictionary is made from at most.
SAMPLE_ROWS = 300
PIECE, LEVELS = 4 << 10, (4, 5)

_LETTER = regex.compile(r"\p{L}").search
_BETWEEN = regex.compile(r"[^\p{L}\p{M}]+").sub


def _clean(text: str) -> str:
    """Lower case; runs of anything but letters and their marks are one space: markup and digits do not tell languages apart."""
    return _BETWEEN(" ", text.lower())


def make_dictionaries(texts: list[tuple[str, str]]) -> dict[str, bytes]:
    """Raw-content dictionaries from (language, text)."""
    parts: dict[str, list[bytes]] = {}
    for lang, text in texts:
        parts.setdefault(lang, []).append(_clean(text).encode())
    return {lang: b" ".join(own) for lang, own in sorted(parts.items()) if any(own)}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zstd

        self.langs = sorted(dictionaries)
        self.by = []
        for lang in self.langs:
            own = []
            for level in LEVELS:
                d = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                own.append(zstd.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
            self.by.append(own)

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, margin)"""
        if not text or not self.langs or not _LETTER(text):
            return "und", 0.0
        raw = _clean(text).encode()
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        sizes = [sum(len(compress(p)) for compress in own for p in pieces) for own in self.by]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        return self.langs[best], min(1.0, (min(others) - sizes[best]) / sizes[best]) if others else 1.0


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries from at most `rows` whole texts of each language, those of least hash of the id.  Rows without id are not learned from."""
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    sample = Sample(known.where("text is not null"), lambda _: rows)
    return make_dictionaries([(lang, text) for lang, _, text in sample.texts(sample.near)])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (the margin) and rejected (margin too narrow); columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    at, names = keep.index(text_col), [*keep, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(sent.value).classify
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names)

    return docs.select(*keep).mapInArrow(run, schema).withColumn("rejected", F.col("score") < margin)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = fit(docs.where(~is_held_out()))
    return identify(docs.select("doc_id", "text"), dictionaries).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
