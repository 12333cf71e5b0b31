"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

Spaces become marks, and a text falls into marked words: no piece spans from a
word's letters to the next mark, and none holds a line break, so words are
segmented one by one without any loss. The distinct words of a block of texts are
sorted, which lays them out as the depth-first order of their trie; the forward
scores and back pointers of a common prefix are kept on a stack and reused by
the next word. The best sum of piece scores wins, of equal sums the one with the
longest last piece. A unigram model's scores are taken as they are; a BPE model
holds ranks instead of log-probabilities, which Zipf's law turns into them:
-log(1 + rank). A character without piece costs 10 more than the worst piece and
is written as its UTF-8 bytes.

A block's words are encoded where its texts lie: nothing is shuffled. A mark
that the text itself holds counts as a character without piece, so decoding
gives back every text exactly.

Defined cases: null and empty texts have no pieces and decode to the empty text;
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stockcast.llm.common import carried

MARK = "▁"
#: stands for a mark in the text itself; a lone surrogate can't be in one
OWN_MARK = "\ud800"
UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
WORDS_PER_BLOCK = 100_000
REMEMBERED = 200_000
ROWS_AT_ONCE = 256


class Vocabulary(NamedTuple):
    pieces: dict[str, tuple[int, float]]
    bytes_at: tuple[int, ...]
    unknown: float
    longest: int


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file; a bounded table, read on the driver and sent with the tasks."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, at = {}, [0] * 256
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            at[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[piece] = (i, model.get_score(i))
    if all(s == int(s) for _, s in pieces.values()):
        pieces = {p: (i, -math.log1p(max(0.0, -s))) for p, (i, s) in pieces.items()}
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
        raise ValueError("pieces span words, so words can't be encoded one by one")
    return Vocabulary(pieces, tuple(at), min(s for _, s in pieces.values()) - 10.0, max(map(len, pieces)))


def encode_words(words: Iterable[str], v: Vocabulary) -> dict[str, bytes]:
    """Little-endian 32-bit piece numbers of each distinct word, over the trie that sorting lays out."""
    pieces, longest, unknown = v.pieces, v.longest, v.unknown
    out: dict[str, bytes] = {}
    best, back, last = [0.0], [(0, 0)], ""  # per depth: best sum; start and piece of the last step
    get = pieces.get
    for word in sorted(words):
        depth, limit = 0, min(len(word), len(last))
        while depth < limit and word[depth] == last[depth]:
            depth += 1
        del best[depth + 1:], back[depth + 1:]
        for end in range(depth + 1, len(word) + 1):
            top, step = None, None
            for start in range(max(0, end - longest), end):
                hit = get(word[start:end])
                if hit is not None:
                    total = best[start] + hit[1]
                    if top is None or total > top:
                        top, step = total, (start, hit[0])
                elif start == end - 1:
                    total = best[start] + unknown
                    if top is None or total > top:
                        top, step = total, (start, -1)
            best.append(top)
            back.append(step)
        ids, at = [], len(word)
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            else:
                raw = (MARK if word[start] == OWN_MARK else word[start]).encode()
                ids += [v.bytes_at[b] for b in reversed(raw)]
            at = start
        ids.reverse()
        out[word] = struct.pack(f"<{len(ids)}i", *ids)
        last = word
    return out


class Encoder:
    """Encodes blocks of texts; remembers a bounded number of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def units(self, text: str) -> list[str]:
        return UNITS.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)) if text else []

    def encode(self, text: str) -> bytes:
        parts, done = self.units(text), []
        for at in range(0, len(parts), WORDS_PER_BLOCK):
            block = self.learn(parts[at:at + WORDS_PER_BLOCK])
            done.append(b"".join(map(self.known.__getitem__, block)))
        return b"".join(done)

    def learn(self, parts: list[str]) -> list[str]:
        new = set(parts).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known, new = {}, set(parts)
            self.known.update(encode_words(new, self.vocabulary))
        return parts

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Texts of a block share their words' trie."""
        out, waiting, words = [], [], 0
        for text in texts:
            if len(text) > WORDS_PER_BLOCK:
                out += self._flush(waiting)
                out.append(self.encode(text))
                waiting, words = [], 0
                continue
            parts = self.units(text)
            waiting.append(parts)
            words += len(parts)
            if words > WORDS_PER_BLOCK:
                out += self._flush(waiting)
                waiting, words = [], 0
        return out + self._flush(waiting)

    def _flush(self, waiting: list[list[str]]) -> list[bytes]:
        self.learn([w for parts in waiting for w in parts])
        return [b"".join(map(self.known.__getitem__, parts)) for parts in waiting]


def decoder(v: Vocabulary) -> Callable[[np.ndarray], str]:
    """The inverse: pieces and bytes joined, marks as spaces, the first one dropped."""
    table = [b""] * (max(max(v.bytes_at), max(i for i, _ in v.pieces.values())) + 1)
    for piece, (i, _) in v.pieces.items():
        table[i] = piece.replace(MARK, " ").encode()
    for b, i in enumerate(v.bytes_at):
        table[i] = bytes([b])

    def decode(ids: np.ndarray) -> str:
        return b"".join(map(table.__getitem__, ids.tolist())).decode()[1:]

    return decode


def encode_batches(v: Vocabulary):
    """Appends the piece numbers as the last column; batches are cut small, as numbers take more room than text."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = encoder.encode_all([x or "" for x in part.column("text").to_pylist()])
                ends = np.cumsum([0, *map(len, found)]) // 4
                if ends[-1] >= 2**31:
                    raise ValueError("too many pieces for one Arrow batch")
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("row"), ids], ["row", "ids"])

    return of


def decode_arrow(v: Vocabulary):
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = decoder(v)
        for ids in batches:
            flat, at = ids.flatten().to_numpy(), 0
            out = []
            for n in ids.value_lengths().to_pylist():
                out.append(decode(flat[at:at + (n or 0)]))
                at += n or 0
            yield pa.array(out, pa.string())

    return of


def encoded(docs: DataFrame, model: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(row, ids): the columns of each row in a struct, with or without the text, and its piece numbers."""
    row = carried(docs if keep_text else docs.drop(text_col))
    slim = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return slim.mapInArrow(encode_batches(load(model)), schema)


def decoded(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` and the text that its piece numbers stand for, as ``decoded``."""
    return rows.withColumn("decoded", F.arrow_udf(decode_arrow(load(model)), "string")(F.col(ids_col)))


def digests(v: Vocabulary):
    """Of each text: number of pieces, SHA-256 of the numbers as little-endian 32-bit integers, whether decoding gives the text back."""
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decode = Encoder(v), decoder(v)
        for texts in batches:
            texts = [x or "" for x in texts.to_pylist()]
            found = encoder.encode_all(texts)
            yield pa.array([
                {"n_pieces": len(x) // 4, "ids_sha256": hashlib.sha256(x).hexdigest(), "round_trip": decode(np.frombuffer(x, "<i4")) == text}
                for x, text in zip(found, texts)
            ], pa.struct([("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())]))

    return of


def encoding_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids_sha256, round_trip) per row, without carrying the numbers out."""
    udf = F.arrow_udf(digests(load(model)), "n_pieces long, ids_sha256 string, round_trip boolean")
    return docs.select(F.col(id_col).alias("id"), udf(F.col(text_col)).alias("x")).select("id", "x.*")
