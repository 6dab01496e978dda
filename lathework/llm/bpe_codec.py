"""BPE encoding and decoding by speculation and verification, for vocabularies with word ends.

Inside each task a greedy longest match proposes the tokens of every new word, one array pass tests
all adjacent pairs, and only words with a failing pair are merged exactly (see ``_bpe.WordBpe``).
Chunks and words seen before come from caches of bounded size. No shuffle.

Defined results: a null text is empty and has no ids; null ids, repeated rows and ties are carried
through row by row; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task encodes at once.
ROWS = 500


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_text, decoded): decimal ids joined by one space, and what they decode to.

    ``vocabulary`` is the path of a tokenizer file on the executors. Special tokens are not added;
    their strings in a text are taken as such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._bpe import word_bpe

        bpe = word_bpe(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, ids, decoded = zip(*bpe.encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_text", "decoded"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_text string, decoded string")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of an array column of ids: the token strings joined by one space; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._bpe import word_bpe

        text = word_bpe(vocabulary).text
        for batch in batches:
            out = [" ".join(text[i] for i in ids or () if i in text) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return df.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, decoded string")
