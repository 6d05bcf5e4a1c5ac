"""Token counts with overlap resynchronisation for huge documents (op 10).

A document of up to two chunks is counted by the library as it is.  A longer
one is encoded as overlapping chunks with offsets.  Two neighbouring chunks are
spliced at a boundary that both of them have inside the overlap and that is
proven stable: a blank after a non-blank, which no piece of the vocabulary
contains (checked once), so that no merge crosses it and each side is encoded
as it would be in the whole text.  Where the overlap holds no such boundary it
is doubled; once it covers the next chunk, that chunk is taken into the left
one.  So the count is always that of the whole text, and memory follows the
chunk, not the document.

Defined results: null and empty texts have zero tokens and bytes; repeated rows
are counted each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, col, per_process, table, text_of

by_value(__name__)

MODEL = "piece_bpe_32k.model"
CHUNK = 16_384      # characters of a chunk
OVERLAP = 256       # characters that neighbouring chunks share at first
BLANKS = " ▁"       # the model writes a blank as the second


class SpanEncoder:
    """Counts and token offsets of a sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.stable = not any("▁" in p.lstrip("▁") for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.sp.encode(texts, num_threads=1, return_type="numpy")]

    def begins(self, text: str) -> list[int]:
        """Character offset at which each token begins."""
        return [b for b, _ in self.sp.encode(text, return_type="offset_mapping")["offsets"]]


def splice(text: str, left: list[int], left_at: int, right: list[int], right_at: int, end: int):
    """First stable boundary of both chunks in (right_at, end): the number of
    tokens before it in the left and in the right chunk; None if there is none."""
    for p in range(right_at + 1, end):       # at its start the right chunk has the blank that the model adds
        if text[p] in BLANKS and text[p - 1] not in BLANKS:
            a, b = bisect_left(left, p - left_at), bisect_left(right, p - right_at)
            if a < len(left) and b < len(right) and left[a] == p - left_at and right[b] == p - right_at:
                return a, b
    return None


def chunked_count(begins: Callable[[str], list[int]], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a whole text from overlapping chunks."""
    size, total = len(text), 0
    at, end, skip = 0, min(chunk + overlap, len(text)), 0   # the open chunk; its tokens already counted
    tokens, nxt = begins(text[at:end]), chunk
    while nxt < size:
        wide = overlap
        while True:
            right_end = min(nxt + chunk + wide, size)
            right = begins(text[nxt:right_end])
            found = splice(text, tokens, at, right, nxt, min(end, right_end))
            if found or end >= min(nxt + chunk, size):
                break
            wide *= 2                                       # alignment failed: widen
            end = min(nxt + wide, size)
            tokens = begins(text[at:end])
        if found:
            total += found[0] - skip
            at, end, tokens, skip = nxt, right_end, right, found[1]
        else:                                               # the overlap covers the chunk: take it in
            end = right_end
            tokens = begins(text[at:end])
        nxt += chunk
    return total + len(tokens) - skip


def _count(model: bytes, chunk: int, overlap: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = per_process(("tokens", hash(model)), lambda: SpanEncoder(model))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            short = [t if len(t) <= 2 * chunk or not enc.stable else "" for t in texts]
            n = [c if s or not t else chunked_count(enc.begins, t, chunk, overlap)
                 for t, s, c in zip(texts, short, enc.counts(short))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([c > limit for c in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: id, bytes, tokens, whether they exceed ``limit``."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:  # the driver's file; its bytes travel with the tasks
        model = f.read()
    df = docs.select(col(docs, id_col).alias("doc_id"), text_of(col(docs, text_col)).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(_count(model, chunk, overlap, limit),
                         f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_overlap_resynchronisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
