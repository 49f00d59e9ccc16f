"""Documents as pieces of token ids, ready to be packed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.llm.common import map_slices
from seasoncast.llm.word_bpe import load_word_bpe

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, vocab: str, tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit).

    A document is the ids of its text and then ``end_id``, cut into pieces of ``tokens``, the last
    of which may be shorter. Null and empty texts are the end id alone. A null ``doc_id`` stays
    null, repeated rows are repeated, other columns are not read.
    """
    step, end = 4 * tokens, end_id.to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load_word_bpe(vocab)
        doc, piece, start, length, ids = [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = bpe.encode(text) + end
            for i, at in enumerate(range(0, len(raw), step)):
                part = raw[at : at + step]
                doc.append(doc_id)
                piece.append(i)
                start.append(at // 4)
                length.append(len(part) // 4)
                ids.append(part)
        return pa.record_batch(
            [
                pa.array(doc, pa.int64()),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(ids, pa.binary()),
            ],
            names=["doc_id", "piece", "start", "length", "ids"],
        )

    return map_slices(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECES
    )
