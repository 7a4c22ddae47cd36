"""SentencePiece encoding with the byte span of every piece, and decoding.

A text is normalised here as the model's normaliser does: at each position the
longest prefix that the compiled character map knows gives way to its
replacement, otherwise one character stays. Every byte of the result remembers
the bytes of the text it came from, so the pieces, whose surfaces concatenate to
the normalised text, project to byte spans of the original text.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from colloquy.llm.shared import Units, arrow_map, kept

SPACE = "▁"
_MARK = SPACE.encode()

OUTPUTS = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("begins", T.ArrayType(T.IntegerType(), False)),
        T.StructField("ends", T.ArrayType(T.IntegerType(), False)),
        T.StructField("decoded", T.StringType()),
    ]
)


class CharacterMap:
    """The compiled character map: a double-array trie of prefixes and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.targets = blob[4 + size :] if size else b""
        self.memo = Units(self._longest, 100_000, 32)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data[at:]`` and its replacement."""
        if not self.units:
            return None
        found, more = self.memo[data[at : at + 32]]
        if more and at + 32 < len(data):  # the trie goes on where the remembered bytes end
            found, _ = self._longest(data, at)
        return found or None

    def _longest(self, data: bytes, at: int = 0) -> tuple[tuple, bool]:
        """The prefix found, and whether the trie has more at the end of the data."""
        units, node, found = self.units, 0, ()
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node ^= step(units[0])
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                return found, False
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.targets[start : self.targets.index(b"\0", start)])
        return found, True


class Encoder:
    """One model: ids as the library gives them, spans, and decoded text."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = self.library.eos_id()
        self.kind = np.dtype("<u2" if len(proto.pieces) <= 65536 else "<i4")
        kinds = proto.pieces[0].DESCRIPTOR.enum_types_by_name["Type"].values_by_name
        byte, odd = kinds["BYTE"].number, {kinds["USER_DEFINED"].number, kinds["UNUSED"].number}
        self.unknown = self.library.unk_id()
        #: Symbols that a user defined, by their first byte, the longest first: the character map leaves them as they are.
        self.symbols: dict[int, list[bytes]] = {}
        own = (p.piece.encode() for p in proto.pieces if p.type == kinds["USER_DEFINED"].number)
        for symbol in sorted(filter(None, own), key=len, reverse=True):
            self.symbols.setdefault(symbol[0], []).append(symbol)
        self.length = np.array([1 if p.type == byte else len(p.piece.encode()) for p in proto.pieces])
        # No piece has a space mark behind another character, so no merge crosses from
        # one word to the next and words can be encoded one by one.
        self.by_word = (
            self.prefix
            and not self.squeeze
            and self.escape
            and not self.map.units
            and not self.suffix
            and proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
            and not any(SPACE in p.piece.lstrip(SPACE) or p.type in odd for p in proto.pieces)
        )
        self.words = Units(lambda word: np.array(self.library.encode(word), self.kind).tobytes())

    def ids(self, text: str) -> np.ndarray:
        """The library's ids of the whole text, without the end id."""
        if self.by_word and text and SPACE not in text:
            words = text.split(" ")
            if "" not in words:
                return np.frombuffer(b"".join(map(self.words.__getitem__, words)), self.kind).astype(np.int32)
        return np.array(self.library.encode(text), np.int32)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes and, for each, begin and end of its source in the text's bytes."""
        data = text.encode()
        if not self.map.units and not self.squeeze and not self.suffix:
            mark = _MARK if self.escape else b" "
            head = mark if self.prefix and data else b""
            source = np.frombuffer(data, np.uint8)
            # Bytes of one character share its span, as those of a replacement do.
            first = np.flatnonzero((source & 0xC0) != 0x80)
            bound = np.r_[first, source.size]
            char = np.cumsum((source & 0xC0) != 0x80) - 1
            repeat = np.where(source == 32, len(mark), 1)
            begin = np.r_[np.zeros(len(head), np.int64), np.repeat(first[char], repeat)]
            end = np.r_[np.zeros(len(head), np.int64), np.repeat(bound[char + 1], repeat)]
            return head + data.replace(b" ", mark), begin, end
        return self._normalise(data)

    def _normalise(self, data: bytes):
        pieces, at = [], 0
        while at < len(data):
            symbol = next((x for x in self.symbols.get(data[at], ()) if data.startswith(x, at)), None)
            found = None if symbol else self.map.longest(data, at)
            if symbol:
                size, target = len(symbol), symbol
            elif found:
                size, target = found
            else:
                size = 1 + sum(data[at] >= x for x in (0xC0, 0xE0, 0xF0))
                target = data[at : at + size]
            pieces.append((target, at, at + size))
            at += size
        if self.squeeze:
            while pieces and pieces[0][0] in (b" ", b""):
                pieces.pop(0)
        mark, out, begin, end, blank = _MARK if self.escape else b" ", bytearray(), [], [], self.squeeze

        def put(block: bytes, lo: int, hi: int) -> None:
            out.extend(block)
            begin.extend([lo] * len(block))
            end.extend([hi] * len(block))

        start = pieces[0][1] if pieces else 0
        if self.prefix and pieces and not self.suffix:
            put(mark, start, start)
        for target, lo, hi in pieces:
            if self.squeeze and blank:
                target = target.lstrip(b" ")
            if target:
                blank = target.endswith(b" ")
                if data[hi - len(target) : hi] == target and len(target) > 1:  # as in the text: each character has its own span
                    at = hi - len(target)
                    for char in target.decode():
                        size = len(char.encode())
                        put(mark if char == " " else char.encode(), at, at + size)
                        at += size
                else:
                    put(target.replace(b" ", mark), lo, hi)
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], begin[-len(mark) :], end[-len(mark) :]
        if self.prefix and pieces and self.suffix:
            put(mark, len(data), len(data))
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans in the text of the pieces of ``ids`` (without the end id)."""
        data, begin, end = self.normalise(text)
        size = self.length[ids]
        if (ids == self.unknown).any():
            size = np.array([1 if x.startswith("<0x") and len(x) == 6 and self.length[i] == 1 else len(x.encode()) for i, x in zip(ids, self.library.encode(text, out_type=str))])
        stop = np.cumsum(size)
        if (stop[-1] if stop.size else 0) != len(data):
            raise ValueError("pieces and normalised text differ in length")
        return begin[stop - size], end[stop - 1]


def encoder(model: bytes) -> Encoder:
    """The process's encoder for a model; Python workers keep it from task to task."""
    return kept(hashlib.sha256(model).hexdigest(), lambda: Encoder(model))


def _lists(flat: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([x.size for x in flat])].astype(np.int32)
    values = np.concatenate(flat) if flat else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (end id last), ``begins``, ``ends`` and ``decoded``.

    ``begins`` and ``ends`` are offsets in the UTF-8 bytes of the text; the end id
    stands at its end. A null text counts as empty: only the end id, decoded as
    the empty string. Whole texts of any length are encoded. Rows that are repeated give
    repeated results, an empty table none. A kept column that has the name of an output gives
    way to it; others may have any name.
    """
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        model = encoder(shared.value)

        def batch(texts):
            ids, begins, ends, decoded = [], [], [], []
            for text in texts:
                text = text or ""
                own = model.ids(text)
                begin, end = model.spans(text, own)
                size = len(text.encode())
                ids.append(np.append(own, np.int32(model.end)))
                begins.append(np.append(begin, size))
                ends.append(np.append(end, size))
                decoded.append(model.library.decode(ids[-1].tolist()))
            return _lists(ids), _lists(begins), _lists(ends), decoded

        return batch

    return arrow_map(docs, [text], OUTPUTS, make, keep)
