"""Exact merge-type (BPE) encoding by backtracking, and decoding (op 5).

A piece sequence is the merge result of a text exactly when each piece merges
to itself and each adjacent pair, merged again from its characters, stays that
pair.  Whether it does is seen by re-merging at the boundary only: the last
merges of both pieces are undone one by one, the later first, and at each step
the two parts that meet there must not have a better merge with each other.
(That needs pieces that score below their parts, which is checked; else the pair
is merged again as a whole.)  So a unit of text is encoded left to right with the longest piece that
an Aho-Corasick automaton finds at each position; a pair that re-merges to
something else makes the encoder try the next shorter piece, and a position
from which nothing fits is marked in a bitfield and never entered again.

Texts are cut into units at blanks and at characters that no piece contains:
no piece crosses such a cut (checked against the vocabulary), so the units
encode independently and repeated units are looked up.

Defined results: null and empty texts have no ids and decode to an empty text.
Every row is encoded by itself, repeated rows alike; an empty table gives an
empty result; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, col, fresh, per_process, table, text_of

by_value(__name__)

MODEL = "piece_bpe_32k.model"
# units in each of the two generations that a Python worker remembers, and half as many pairs: about
# 300 bytes each, so up to 180 MB where only digests leave, and 45 MB beside whole rows of ids
CACHED_UNITS, CACHED_BESIDE_ROWS = 300_000, 75_000
ANSWER_CHARS = 1_000_000  # characters whose ids leave a worker together
CACHED_CHARS = 48        # longer units are not remembered


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceCodec(dict):
    """Maps a unit of text to (its ids as text, its decoded text)."""

    def __init__(self, model: bytes, remembered: int | None = None):
        import ahocorasick
        import sentencepiece
        self.remembered = CACHED_UNITS if remembered is None else remembered
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.id_of = {p: i for i, p in enumerate(self.piece) if not (
            sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = [sp.get_score(i) for i in range(size)]
        self.width = [len(p) for p in self.piece]
        self.shown = [p.replace("▁", " ") for p in self.piece]
        chars = {c for p in self.id_of for c in p}
        if any("▁" in p.lstrip("▁") for p in self.id_of) or not chars <= self.id_of.keys() or len(self.byte_id) < 256:
            raise ValueError("needs pieces that hold blanks in front only, single characters and all bytes")
        self.known = chars
        self.automaton = ahocorasick.Automaton()
        self.parts = {}              # id -> the ids of its last merge
        for p, i in self.id_of.items():
            if self.merge(p) == [i]:  # pieces that no merge order reaches never occur
                self.automaton.add_word(p, (len(p) - 1, i))
                if len(p) > 1:
                    self.parts[i] = self.last
        self.automaton.make_automaton()
        single = {i for p, i in self.id_of.items() if len(p) == 1}
        # when an id is made: characters are there from the start, then the better score comes first
        self.rank = [float("inf") if i in single else score for i, score in enumerate(self.score)]
        # (runs of blanks have equal scores; they are merged as a whole)
        self.falling = all(self.rank[part] > self.rank[i] for i, both in self.parts.items() for part in both
                           if self.piece[i].strip("▁"))
        self.shorter = {}            # id -> longest piece that is a proper prefix of it
        for p, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1)
                                    if self.automaton.exists(p[:n])), None)
        self.pairs, self.old = {}, {}
        self.units = re.compile(r"\n| *[^ \n]+| +") if "\n" not in chars else re.compile(r" *[^ ]+| +")

    def merge(self, text: str) -> list[int]:
        """The ids by merging: best score first, then leftmost.  ``last`` keeps
        the parts of the last merge."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = []

        def offer(a, b):
            i = self.id_of.get(part[a] + part[b])
            if i is not None:
                heapq.heappush(heap, (-self.score[i], a, b, part[a], part[b]))
        for a in range(len(part) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if part[a] != x or part[b] != y or after[a] != b:
                continue
            part[a], part[b] = x + y, None
            self.last = self.id_of[x], self.id_of[y]
            after[a] = after[b]
            if after[a] < len(part):
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return [self.id_of[p] for p in part if p is not None]

    def fits(self, a: int, b: int) -> bool:
        """Whether two adjacent pieces survive being merged again."""
        if len(self.pairs) >= self.remembered:
            self.pairs.clear()
        ok = self.pairs[a, b] = self.stay(a, b) if self.falling else self.merge(self.piece[a] + self.piece[b]) == [a, b]
        return ok

    def stay(self, a: int, b: int) -> bool:
        """Undo the merges next to the boundary, the latest first; at each step
        a merge across it must not come before the one just undone (of two equal
        ones the left comes first)."""
        piece, rank, parts, score, id_of = self.piece, self.rank, self.parts, self.score, self.id_of
        least, ties = float("-inf"), True            # what a merge across has to beat, and whether a tie is enough
        while True:
            across = id_of.get(piece[a] + piece[b])
            if across is not None and (score[across] > least or ties and score[across] == least):
                return False
            if rank[a] < rank[b]:
                least, ties, a = rank[a], False, parts[a][1]
            elif b in parts:
                least, ties, b = rank[b], True, parts[b][0]
            else:                                    # two characters: nothing is left to undo
                return True

    def backtrack(self, text: str) -> list[int]:
        """Ids of a run of known characters."""
        # matches come by their end, so of one start the longest comes last
        longest = {end - before: i for end, (before, i) in self.automaton.iter(text)}
        failed, size, width, pairs = 0, len(text), self.width, self.pairs   # bit p of failed: nothing fits from p on
        ids, pos, token = [], 0, longest[0]
        while pos < size:
            while token is not None:
                end = pos + width[token]
                if not failed >> end & 1:
                    if not ids:
                        break
                    ok = pairs.get((ids[-1], token))
                    if ok or ok is None and self.fits(ids[-1], token):
                        break
                token = self.shorter[token]
            if token is None:                  # mark, step back, try shorter
                failed |= 1 << pos
                token = ids.pop()
                pos -= width[token]
            else:
                ids.append(token)
                pos = end
                token = longest.get(pos)
        return ids

    def encode_unit(self, unit: str) -> list[int]:
        text = unit.replace(" ", "▁")
        if text.startswith("▁▁"):              # runs of blanks: pieces of equal score, where order decides
            tail = self.encode_unit(" " + text.lstrip("▁")) if text.strip("▁") else []
            blanks = len(text) - len(text.lstrip("▁"))
            if tail and self.piece[tail[0]] != "▁":
                blanks -= 1
            else:
                tail = tail[1:]
            return self.merge("▁" * blanks) + tail
        if self.known.issuperset(text):
            return self.backtrack(text)
        ids = []
        for known, run in self.runs(text):
            ids += self.backtrack(run) if known else [self.byte_id[b] for b in run.encode("utf-8", "replace")]
        return ids

    def runs(self, text: str) -> Iterator[tuple[bool, str]]:
        start = 0
        for i in range(1, len(text) + 1):
            if i == len(text) or (text[i] in self.known) != (text[start] in self.known):
                yield text[start] in self.known, text[start:i]
                start = i

    def decode(self, ids: list[int]) -> str:
        """The text of ids, its leading blank kept."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        return b"".join([bytes([self.byte_of[i]]) if i in self.byte_of else self.shown[i].encode()
                         for i in ids]).decode("utf-8", "replace")

    def __missing__(self, unit: str) -> tuple[str, str]:
        value = self.old.pop(unit, None)
        if value is not None:
            self.remember(unit, value)
            return value
        ids = self.encode_unit(unit)
        text = self.decode(ids)
        value = ",".join(map(str, ids)), unit if text == unit else text   # mostly the same: kept once
        if len(unit) <= CACHED_CHARS:
            self.remember(unit, value)
        return value

    def remember(self, unit: str, value: tuple[str, str]) -> None:
        """Units are kept in two generations: when the new one is full it becomes
        the old one, so units that go on coming are not looked up anew."""
        if len(self) >= self.remembered:
            self.old = dict(self)
            self.clear()
        self[unit] = value

    def forget(self) -> None:
        """Give back what was remembered; the tables of the pieces stay."""
        self.clear()
        self.old.clear()
        self.pairs.clear()

    def both(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of a whole text."""
        if not text:
            return "", ""
        got = [self[u] for u in self.units.findall(" " + text.replace("▁", " "))]
        return ",".join([g[0] for g in got]), "".join([g[1] for g in got])[1:]


def _digests(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_process(("pieces", hash(model)), lambda: PieceCodec(model))
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                ids, decoded = codec.both(text)
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())],
                names=[*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _ids(model: bytes, at: int, columns: int):
    """Answers for column ``at``, beside the first ``columns`` columns."""
    def some(batch: pa.RecordBatch, got: list[tuple[str, str]]) -> pa.RecordBatch:
        values = np.fromstring(",".join(ids for ids, _ in got if ids), dtype=np.int32, sep=",")
        ends = np.cumsum([0, *(ids.count(",") + 1 if ids else 0 for ids, _ in got)], dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:columns], pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
             pa.array([text for _, text in got], pa.string())], names=[*batch.schema.names[:columns], "ids", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_process(("pieces", hash(model), "rows"), lambda: PieceCodec(model, CACHED_BESIDE_ROWS))
        for batch in batches:
            got, first, size = [], 0, 0
            for i, text in enumerate(batch.column(at)):  # one text at a time: a batch is held once, as it came
                text = text.as_py() or ""
                got.append(codec.both(text))
                size += len(text)
                if size > ANSWER_CHARS or i + 1 == batch.num_rows:   # answer in small batches: ids take more room than text
                    yield some(batch.slice(first, len(got)), got)
                    got, first, size = [], i + 1, 0
        codec.forget()                    # the worker lives on beside later steps
    return run


def _model(path: str | None) -> bytes:
    with open(path or model_path(), "rb") as f:  # the driver's file; its bytes travel with the tasks
        return f.read()


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with two more columns: ids (array of int) and decoded text,
    named ``ids`` and ``decoded`` (with underscores added if taken)."""
    ids, decoded = fresh(docs, "ids", "decoded")
    names = [f"c{i}" for i in range(len(docs.columns))]
    df, at = docs.toDF(*names), docs.columns.index(text_col)
    schema = ", ".join(f"{n} {kind}" for n, kind in df.dtypes)
    if df.dtypes[at][1] != "string":      # else the column itself travels, once
        df, at = df.withColumn("raw", text_of(F.col(names[at]))), len(names)
    out = df.mapInArrow(_ids(_model(path), at, len(names)), f"{schema}, ids array<int>, decoded string")
    return out.toDF(*docs.columns, ids, decoded)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: id, number of ids, SHA-256 of the ids joined by
    commas and of the decoded text."""
    df = docs.select(col(docs, id_col).alias("doc_id"), text_of(col(docs, text_col)).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(_digests(_model(path)),
                         f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_sentencepiece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
