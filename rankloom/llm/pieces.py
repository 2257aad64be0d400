"""SentencePiece encoding by a batched Viterbi search, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from rankloom.llm.common import as_bytes, chunks

SPACE = "▁"
# Fixed values of the format: what a character without a piece costs more than the worst piece; kinds of pieces.
UNKNOWN_COST = 10.0
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
# Cells (words x places x piece lengths) of one step.
CELLS = 1 << 21
BASE = 0x9E3779B97F4A7C15
# A word is a run of spaces and what follows it up to the next space; no piece goes on behind such a place.
WORD = re.compile(" *[^ ]+| +")


class Pieces:
    """Tables of a model file: sorted keys of pieces, their scores and texts."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces \
                or not proto.normalizer_spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are, but for escaped spaces")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        pieces = [(p.piece.replace(SPACE, " "), p.score, p.type) for p in proto.pieces]
        plain = [(text, n) for n, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)]
        if any(" " in text.lstrip(" ") for text, _ in plain):
            raise ValueError("a piece has a space behind another character")
        self.longest = max(len(text) for text, _ in plain)
        chars = np.zeros((len(plain), self.longest), np.uint32)
        for row, (text, _) in enumerate(plain):
            chars[row, :len(text)] = _points(text)
        sizes = np.array([len(text) for text, _ in plain])
        prefix = _prefix_hashes(chars)
        keys = prefix[np.arange(len(plain)), sizes]
        order = np.argsort(keys, kind="stable")
        self.keys, self.chars, self.sizes = keys[order], chars[order], sizes[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces with one key")
        self.ids = np.array([n for _, n in plain], np.int32)[order]
        self.scores = np.array([pieces[n][1] for n in self.ids], float)
        self.unknown = next(n for n, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.unknown_score = self.scores.min() - UNKNOWN_COST
        self.byte_ids = np.full(256, self.unknown, np.int32)
        self.texts: list[bytes] = []
        for n, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = n
                self.texts.append(bytes([int(text[3:5], 16)]))
            else:
                self.texts.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.encode())
        # By the first bits of a key: whether there is such a piece at all.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def find(self, words: np.ndarray) -> np.ndarray:
        """Row of the piece (or -1) for every word of one length, end and piece length, longest first."""
        n, size = words.shape
        hashes = _prefix_hashes(words)
        most = min(self.longest, size)
        rows = np.full((n, size, most), -1, np.int32)
        for length in range(1, most + 1):
            power = np.uint64(pow(BASE, length, 1 << 64))
            key = hashes[:, length:] - hashes[:, :size + 1 - length] * power
            word, start = np.nonzero(self.maybe[key >> np.uint64(44)])
            key = key[word, start]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (self.sizes[at] == length)
            word, start, at = word[hit], start[hit], at[hit]
            # The key may lie; the characters do not.
            same = (words[word[:, None], start[:, None] + np.arange(length)] == self.chars[at, :length]).all(1)
            rows[word[same], start[same] + length - 1, most - length] = at[same]
        return rows

    def encode_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words of one length, one after the other, and how many each has.

        All words go from place to place together. At a tie the longest last
        piece wins. An unknown character becomes its bytes.
        """
        n, size = words.shape
        rows = self.find(words)
        most = rows.shape[2]
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        length = np.zeros((n, size + 1), np.int32)
        piece = np.full((n, size + 1), -1, np.int32)
        every = np.arange(n)
        for end in range(1, size + 1):
            first = max(most - end, 0)
            at = rows[:, end - 1, first:]
            before = best[:, end - most + first:end]
            candidates = np.where(at >= 0, before + self.scores[at], -np.inf)
            # A character that is no piece itself may stand alone as unknown.
            alone = at[:, -1] < 0
            candidates[alone, -1] = before[alone, -1] + self.unknown_score
            chosen = candidates.argmax(1)
            best[:, end] = candidates[every, chosen]
            piece[:, end] = at[every, chosen]
            length[:, end] = most - first - chosen
        # Back from the end; what a word has is written from the right.
        bytes_room = 4 if (piece < 0).any() else 1
        out = np.full((n, size * bytes_room), -1, np.int32)
        left = np.full(n, size * bytes_room)
        place = np.full(n, size)
        while (going := np.flatnonzero(place > 0)).size:
            at = piece[going, place[going]]
            known = at >= 0
            left[going[known]] -= 1
            out[going[known], left[going[known]]] = self.ids[at[known]]
            for w in going[~known].tolist():
                for byte in reversed(chr(words[w, place[w] - 1]).encode()):
                    left[w] -= 1
                    out[w, left[w]] = self.byte_ids[byte]
            place[going] -= length[going, place[going]]
        return out[out >= 0], size * bytes_room - left

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and how many each has; a null or empty text has none."""
        number: dict[str, int] = {}
        word_of, sizes = [], []
        for text in texts:
            found = WORD.findall((" " if self.prefix else "") + text.replace(SPACE, " ")) if text else []
            sizes.append(len(found))
            word_of += map(number.setdefault, found, count(len(word_of)))
        distinct = sorted(number, key=len)
        order = np.zeros(len(word_of), np.int64)
        order[np.fromiter(map(number.__getitem__, distinct), np.int64, len(distinct))] = np.arange(len(distinct))
        lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
        ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        start = 0
        while start < len(distinct):
            size = int(lengths[start])
            most = max(1, CELLS // (size * min(self.longest, size)))
            end = min(int(np.searchsorted(lengths, size, "right")), start + most)
            found, n = self.encode_words(_points("".join(distinct[start:end])).reshape(-1, size))
            ids.append(found)
            counts.append(n)
            start = end
        flat, counts = np.concatenate(ids), np.concatenate(counts)
        starts = np.cumsum(counts) - counts
        word = order[np.fromiter(word_of, np.int64, len(word_of))]
        per_word = counts[word]
        total = np.cumsum(per_word)
        take = np.repeat(starts[word] - (total - per_word), per_word) + np.arange(total[-1] if len(total) else 0)
        ends = np.r_[0, total][np.cumsum(sizes)] if len(sizes) else np.empty(0, np.int64)
        return flat[take], np.diff(np.r_[0, ends])

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids. Bytes that are no UTF-8 become U+FFFD; the space added in front goes."""
        text = b"".join(map(self.texts.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _prefix_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the first k characters, k = 0 to all, of every row."""
    out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    for k in range(words.shape[1]):
        mixed = (words[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        out[:, k + 1] = out[:, k] * np.uint64(BASE) + (mixed ^ mixed >> np.uint64(32))
    return out


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, pieces, n_pieces, restored)`` for every row of ``docs(doc_id, text)``.

    The model file is read on the driver and its tables are broadcast (about
    32,000 pieces). ``restored`` says whether decoding the pieces gives the
    text again; only a text that holds the space sign of the format itself is
    not. A null text has null pieces, an empty one none. Repeated rows stay;
    other columns are ignored.
    """
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in chunks(batches):
            raw = as_bytes(batch.column("text"))
            texts = [None if t is None else t.decode() for t in raw]
            ids, counts = pieces.encode(texts)
            ends = np.cumsum(counts)
            restored = []
            for text, end, n in zip(texts, ends.tolist(), counts.tolist()):
                restored.append(None if text is None else pieces.decode(ids[end - n:end].tolist()) == text)
            null = np.array([t is None for t in texts], bool)
            offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[null, False]) if null.any() else pa.array(np.r_[0, ends].astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids)),
                pa.array(counts, mask=null), pa.array(restored, pa.bool_())], ["doc_id", "pieces", "n_pieces", "restored"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, pieces array<int>, n_pieces bigint, restored boolean")
