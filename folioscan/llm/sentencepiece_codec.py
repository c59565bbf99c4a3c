"""SentencePiece encoding and decoding with forward states shared between words of a common prefix.

A normalised text is a row of marked words: the mark of white space, then what follows up to the next one. No piece of a supported model
crosses into a mark, so words are independent. The distinct new words of a batch are sorted, which lays them out as a trie in depth-first order;
walking from one to the next keeps the forward states of the prefix they share and computes only what differs.

The forward state of a unigram model is the best score and last piece of each prefix (Viterbi); of equal scores the one with the longest last piece, as in the library. Sums start
anew with each word, in double precision, where the library's run on over a text in single precision: segmentations that differ by less than its rounding can come out otherwise. A BPE model has no sums to compare:
scores rank its merges, and the best sum is not its encoding. There, the state is the last piece of the prefix's encoding. It is unique, and it is the piece that
ends the prefix and stands next to the last piece of what is before it as those two strings encode together; such neighbours are looked up in a cache.

Characters without a piece become byte pieces, or the unknown piece where a model has none, one for each run of them. Null text: null ids, null decoding. Empty text: no ids. Very long
texts are coded whole. Repeated rows are coded each. Columns besides id and text aren't read, so their names can't clash. Empty table: no rows. Decoding undoes encoding up to the model's own normalisation.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import configured

MARK = "▁"
#: Words kept with their ids in one Python worker; pairs of pieces kept with the verdict on them.
CACHE_WORDS, CACHE_PAIRS = 800_000, 500_000
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCodec:
    """Encoder and decoder of the model file at path (unigram or BPE)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        kind = spec.trainer_spec.model_type
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.bpe = kind == 2
        self.processor = SentencePieceProcessor(model_file=path)
        types = {i: p.type for i, p in enumerate(spec.pieces)}
        self.pieces = [p.piece for p in spec.pieces]
        if any(MARK in p.piece.lstrip(MARK) for i, p in enumerate(spec.pieces) if types[i] in (1, 4)) or 5 in types.values():
            raise ValueError("pieces that hold a mark after their first letter, and unused pieces, are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if types[i] in (1, 4)}
        self.scores = {p.piece: p.score for i, p in enumerate(spec.pieces) if types[i] in (1, 4)}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if types[i] == 6}
        self.unknown = next((i for i, t in types.items() if t == 2), 0)
        normal = [p.score for p in spec.pieces if p.type == 1]
        self.penalty = min(normal, default=0.0) - 10
        if not self.bpe:
            # The library scores a user's own piece by its bytes, above all others, whatever the file says.
            self.scores |= {p.piece: 0.1 * (len(p.piece.encode()) - 1) for p in spec.pieces if p.type == 4}
        self.out = [b"" if types[i] == 3 else bytes([int(p[3:5], 16)]) if types[i] == 6 else b" \xe2\x81\x87 " if types[i] == 2 else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.prefixed = spec.normalizer_spec.add_dummy_prefix
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        # Pieces that merging builds from their letters, and the lengths of those that end in given two letters.
        self.built = {p for p in self.ids if len(p) > 1 and self.bpe and self._merge(p) == [p]}
        self.steps = {p: self._edges(p) for p in self.built}
        lengths: dict[str, set[int]] = {}
        for p in self.built:
            lengths.setdefault(p[-2:], set()).add(len(p))
        self.ends = {end: sorted(found, reverse=True) for end, found in lengths.items()}

    def _merges(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """The merges of a short string, best score first, then leftmost: score and the parts after it."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            yield best[0], parts

    def _merge(self, text: str) -> list[str]:
        """The BPE encoding of a short string by merging."""
        found = list(text)
        for _, parts in self._merges(text):
            found = parts
        return found

    def _edges(self, piece: str) -> list[tuple[float, str, str]]:
        """The merges that build a piece: score, then its first and last part after it."""
        return [(score, parts[0], parts[-1]) for score, parts in self._merges(piece)]

    def _beside(self, a: str, b: str) -> bool:
        """Whether a + b encodes as these two pieces: replays the merges of both, which no merge across the border may precede."""
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        left, right = self.steps.get(a, ()), self.steps.get(b, ())
        i = j = 0
        end, begin = a[-1], b[0]
        while True:
            p = left[i][0] if i < len(left) else -math.inf
            q = right[j][0] if j < len(right) else -math.inf
            across = self.scores.get(end + begin)
            if across is not None and across > p and across >= q:
                fit = False
                break
            if i == len(left) and j == len(right):
                fit = True
                break
            if p >= q:
                end = left[i][2]
                i += 1
            else:
                begin = right[j][1]
                j += 1
        self.fits[a, b] = fit
        return fit

    def _forward(self, word: str, states: list[int], scores: list[float], start: int) -> None:
        """Appends the states of word's prefixes over start letters: length of the last piece, and for unigram models the best score."""
        if self.bpe:
            built, ends, fits = self.built, self.ends, self.fits
            for i in range(start + 1, len(word) + 1):
                chosen = 1
                if lengths := ends.get(word[i - 2 : i] if i > 1 else ""):
                    for n in lengths:
                        if n <= i and (piece := word[i - n : i]) in built:
                            j = i - n
                            if not j:
                                chosen = n
                                break
                            pair = (word[j - states[j] : j], piece)
                            fit = fits.get(pair)
                            if self._beside(*pair) if fit is None else fit:
                                chosen = n
                                break
                states.append(chosen)
            return
        for i in range(start + 1, len(word) + 1):
            best, chosen = -math.inf, 1
            for n in range(min(self.longest, i), 0, -1):
                score = self.scores.get(word[i - n : i], self.penalty if n == 1 else None)
                if score is not None and scores[i - n] + score > best:
                    best, chosen = scores[i - n] + score, n
            states.append(chosen)
            scores.append(best)

    def _ids(self, word: str, states: list[int]) -> bytes:
        out: list[int] = []
        ids, i = self.ids, len(word)
        while i:
            n = states[i]
            piece = word[i - n : i]
            found = ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(piece.encode()))
            else:
                out.append(self.unknown)
            i -= n
        out.reverse()
        return array("i", out).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encodes words that aren't known yet, in trie order."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        before, states, scores = "", [0], [0.0]
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :], scores[shared + 1 :]
            self._forward(word, states, scores, shared)
            self.known[word] = self._ids(word, states)
            before = word

    def words(self, text: str) -> list[str]:
        plain = self.processor.normalize(text)
        if MARK + MARK in plain or not plain.startswith(MARK) or plain.endswith(MARK):
            return _WORDS.findall(plain)
        return [MARK + w for w in plain.split(MARK)[1:]]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """ids of each text; None for None."""
        split = [None if t is None else self.words(t) if t else [] for t in texts]
        new = {w for words in split if words for w in words if w not in self.known}
        if len(self.known) + len(new) > CACHE_WORDS:
            new = {w for words in split if words for w in words}
        self.learn(new)
        known = self.known
        return [None if words is None else self._joined(np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<i4")) for words in split]

    def _joined(self, ids: np.ndarray) -> np.ndarray:
        """ids with each run of the unknown piece as one, across words where the mark itself is unknown."""
        if self.bytes or len(ids) < 2:
            return ids
        unknown = ids == self.unknown
        return ids[np.concatenate(([True], ~(unknown[1:] & unknown[:-1])))]

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefixed and text.startswith(" ") else text


_loaded: dict[str, PieceCodec] = {}


def loaded(path: str) -> PieceCodec:
    """One instance for each Python worker and path."""
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def _small(column: pa.Array, limit: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some limit bytes of text each; one row at least."""
    first, size = 0, 0
    for i, t in enumerate(column):
        size += len(t.as_buffer() or b"")
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(column):
        yield first, len(column)


def _encode(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in batches:
            for first, end in _small(batch.column(1)):
                texts = batch.column(1).slice(first, end - first).to_pylist()
                ids = codec.encode_all(texts)
                empty = np.zeros(0, dtype=np.int32)
                flat = pa.array(np.concatenate([empty, *(x for x in ids if x is not None)]), pa.int32())
                offsets = pa.array(np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, flat, mask=pa.array([x is None for x in ids]))
                columns = [batch.column(0).slice(first, end - first), lists, pa.array([None if x is None else len(x) for x in ids], pa.int64())]
                if check:
                    columns.append(pa.array([None if t is None else codec.decode(x) == t for t, x in zip(texts, ids, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "n_ids", "restored"][: len(columns)])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """(id_col, ids, n_ids) of each row, and restored if check: whether decoding the ids gives the text back exactly."""
    configured(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(model_path, check), "id long, ids array<int>, n_ids long" + ", restored boolean" * check).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of each row; null elements of the lists are left out."""
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.filter(F.col(ids_col), lambda x: x.isNotNull()).alias("ids"))
    return plain.mapInArrow(_decode(model_path), "id long, text string").withColumnRenamed("id", id_col)
