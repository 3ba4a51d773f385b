"""SentencePiece encoding and decoding by an Aho-Corasick automaton over the pieces.

One pass of the automaton over a text visits, at each position, every piece that ends there (the state's output and
those along its output links); each relaxes the best score of the position after it. The best path under the model's
own scores is the encoding. A character no piece covers is spelled in byte pieces. White space is part of pieces only
at their start, so text falls into units (blanks, then what follows up to the next blank) whose best paths are
independent; the paths of short units are remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .bytetext import lists

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units remembered by a worker in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 250_000, 48
#: Texts encoded at once.
SLICE = 512
BLANK = "▁"
NEVER = float("-inf")


@dataclass
class Pieces:
    """What the codec needs of a model: ordinary pieces with scores, byte pieces, ids to bytes."""

    score: dict[str, tuple[int, float]]
    byte: list[int]
    spelled: list[bytes]
    unknown: float
    codec: Codec | None = field(default=None, compare=False)

    @staticmethod
    def read(path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        score, byte, spelled = {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelled.append(b"")
            else:
                text = piece.replace(BLANK, " ")
                if " " in text.lstrip(" "):
                    raise ValueError(f"piece {i} has a blank inside")
                score[text] = (i, sp.get_score(i))
                spelled.append(text.encode())
        return Pieces(score, byte, spelled, min((s for _, s in score.values()), default=0.0) - 10)

    def __getstate__(self):
        return (self.score, self.byte, self.spelled, self.unknown)

    def __setstate__(self, state):
        self.score, self.byte, self.spelled, self.unknown = state
        self.codec = None

    def ready(self) -> Codec:
        if self.codec is None:
            self.codec = Codec(self)
        return self.codec


class Codec(dict):
    """Encodes and decodes; as a mapping, remembers the packed ids of units."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.pieces, self.automaton = pieces, ahocorasick.Automaton()
        for text, (i, score) in pieces.score.items():
            self.automaton.add_word(text, (len(text), i, score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.alone = {t for t in pieces.score if len(t) == 1}
        inside = "" if any("\n" in t for t in pieces.score) else "\n"
        self.units = re.compile(rf" *[^ {inside}]+| +|\n").findall

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.path(unit)
            if len(unit) > LONGEST:
                return ids
        if len(self) >= REMEMBERED:  # what is used again moves on to the new generation
            self.older = dict(self)
            self.clear()
        self[unit] = ids
        return ids

    def path(self, text: str) -> bytes:
        """Ids (int32, packed) of the best path. Of equal paths to a position, that with the longest last piece."""
        n = len(text)
        best, start, piece = [0.0] + [NEVER] * n, [0] * (n + 1), [-1] * (n + 1)
        spelled = not self.alone.issuperset(text)
        unknown, done = self.pieces.unknown, 0
        for end, (length, i, score) in self.automaton.iter(text) if len(self.automaton) else ():
            if spelled and end > done:
                self.spell(text, done, end, best, start, piece, unknown)
                done = end
            end += 1
            value = best[end - length] + score
            if value > best[end]:
                best[end], start[end], piece[end] = value, end - length, i
        if spelled:
            self.spell(text, done, n, best, start, piece, unknown)
        out, at = [], n
        while at:
            i, first = piece[at], start[at]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.pieces.byte[b] for b in reversed(text[first].encode()))
            at = first
        out.reverse()
        return array("i", out).tobytes()

    def spell(self, text: str, done: int, end: int, best: list[float], start: list[int], piece: list[int], unknown: float) -> None:
        """Relaxes the positions after characters that are no piece themselves, from done to end."""
        for k in range(done, end):
            if text[k] not in self.alone and best[k] + unknown > best[k + 1]:
                best[k + 1], start[k + 1], piece[k + 1] = best[k] + unknown, k, -1

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.units(" " + text))) if text else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.spelled.__getitem__, ids))[1:]


def encode(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """`keep`, n_tokens long, token_ids array<int> (and round_trip boolean) for each row of docs with a `text`.

    Null and empty texts have no tokens. Any text comes back exactly from `decode`. Repeated rows give repeated
    results; an empty table gives none. The model file is read by the driver; its pieces are broadcast.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces.read(model))
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("token_ids", ArrayType(IntegerType()))
    if check:
        schema = schema.add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces.value.ready()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                packed = [codec.encode(t) for t in texts]
                n = np.array([len(p) // 4 for p in packed], np.int64)
                columns = [*batch.columns[:-1], pa.array(n), lists(np.frombuffer(b"".join(packed), np.int32), n, pa.int32())]
                if check:
                    columns.append(pa.array([codec.decode(np.frombuffer(p, np.int32).tolist()) == t.encode() for p, t in zip(packed, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select(*keep, F.col("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and text for each row with `token_ids`. Null ids: null; no ids: empty. Bytes that are no UTF-8 become U+FFFD.

    Control and unknown ids give nothing. Repeated rows give repeated results; an empty table gives none.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(Pieces.read(model))
    schema = encoded.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces.value.ready()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = batch.column(batch.num_columns - 1).to_pylist()
                texts = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.fieldNames())

    return encoded.select(*keep, F.col("token_ids")).mapInArrow(run, schema)
