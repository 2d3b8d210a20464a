"""SentencePiece ids of whole texts, with the bytes of the text that each piece stands for.

A text is normalised first: at every position the longest prefix that the model's compiled
character map knows is replaced (a double-array trie, walked byte by byte), what the map
does not know is copied, white space is escaped. The source offset of every normalised
byte is kept. The normalised text is then cut where no piece of the vocabulary can reach
across; each distinct chunk is segmented once per task and its ids are reused. Running
sums of the pieces' lengths are places in the normalised text, which the kept offsets
turn into spans of the original bytes. No row needs another one, so nothing is shuffled.

The library segments the chunks and joins pieces to text again; normalising, aligning
and projecting are done here, so segmentation gets a model whose normaliser does nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from groundswell.llm.common import Recent, binary, documents, give_back, slices

STORED = 200_000  # chunks in each of the two generations whose ids a task holds
LONGEST = 48  # bytes of a chunk that is worth storing
BLOCK = 4 << 20  # bytes of one text whose chunks are held as objects at a time
MARK = "▁"  # stands for a blank
BAD = "�".encode()  # stands for a byte that is not UTF-8
CHARACTER = re.compile(
    rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}"
    rb"|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)

# Field numbers of the public model file format.
NORMALIZER, TRAINER = 3, 2
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
SUFFIX, BYTE_FALLBACK = 24, 35
PIECE, KIND, USER_DEFINED, UNUSED = 1, 3, 4, 5


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(field number, value, the field as it is written) of a protocol buffer message."""
    at = 0
    while at < len(data):
        begin = at
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, at = _number(data, at)
            if size is None:
                raise ValueError("not a sentencepiece model file")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value, data[begin:at]


def _message(field: int, content: bytes) -> bytes:
    size, head = len(content), bytearray([field << 3 | 2])
    while size > 127:
        head.append(size & 127 | 128)
        size >>= 7
    return bytes(head) + bytes([size]) + content


class CharacterMap:
    """The compiled map of a model: replacement of the longest known prefix at a place."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = array("I", compiled[4 : 4 + size])
        self.texts = compiled[4 + size :]
        self.root = self._children(self.units[0]) if self.units else 0
        self.starts = {b for b in range(256) if self._at(self.root ^ b) & 0x800000FF == b}

    def _at(self, place: int) -> int:
        return self.units[place] if place < len(self.units) else 0x80000000

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """(bytes read, replacement); nothing is read if no prefix is known."""
        units, place, best, value, read = self.units, self.root, 0, 0, 0
        for byte in raw[at : at + 256]:
            place ^= byte
            unit = self._at(place)
            if unit & 0x800000FF != byte:
                break
            read += 1
            place ^= self._children(unit)
            if unit >> 8 & 1:
                best, value = read, units[place] & 0x7FFFFFFF
        if not best:
            return 0, b""
        return best, self.texts[value : self.texts.index(b"\0", value)]


class Codec:
    """Encoder and decoder of one model file that falls back to bytes.

    Models with user-defined or unused pieces, without byte pieces, or that mark words at
    their end are refused.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        normalizer, trainer, rest, pieces = b"", b"", b"", []
        for field, value, written in fields(model):
            if field == NORMALIZER:
                normalizer = value
                continue
            rest += written
            if field == TRAINER:
                trainer = value
            elif field == 1:
                parts = {number: content for number, content, _ in fields(value)}
                pieces.append((parts[PIECE].decode(), parts.get(KIND, 1)))
        spec = {f: v for f, v, _ in fields(normalizer)}
        trained = {f: v for f, v, _ in fields(trainer)}
        kinds = {kind for _, kind in pieces}
        if (
            not trained.get(BYTE_FALLBACK)
            or trained.get(SUFFIX)
            or not spec.get(ESCAPE, 1)
            or kinds & {USER_DEFINED, UNUSED}
            or MARK not in {text for text, _ in pieces}
        ):
            raise ValueError("only models with byte pieces and marks before words are supported")
        self.prefix, self.squeeze = bool(spec.get(DUMMY_PREFIX, 1)), bool(spec.get(REMOVE_EXTRA, 1))
        self.map = CharacterMap(spec[CHARACTER_MAP]) if spec.get(CHARACTER_MAP) else None
        plain = _message(NORMALIZER, bytes([DUMMY_PREFIX << 3, 0, REMOVE_EXTRA << 3, 0, ESCAPE << 3, 0]))
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=rest + plain)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        ordinary = [text for text, kind in pieces if kind == 1]
        self.is_byte = np.array([kind == 6 for _, kind in pieces])
        self.length = np.array(
            [1 if kind == 6 else len(text.replace(MARK, " ").encode()) for text, kind in pieces]
        )
        self.cut = self._cuts(ordinary)
        self.bos, self.eos = (np.array([i], "<u4") for i in (self.whole.bos_id(), self.whole.eos_id()))
        self.recent = Recent(STORED)

    @staticmethod
    def _cuts(pieces: list[str]) -> re.Pattern:
        """Chunks that segmentation never crosses, blanks standing for marks."""
        if any(re.search(f"[^{MARK}]{MARK}", text) for text in pieces):
            return re.compile(rb"(?s).+")
        if any("\n" in text for text in pieces):
            return re.compile(rb" *[^ ]+| +")
        return re.compile(rb" *[^ \n]+|\n| +")

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, a blank for each mark, and the source of each byte and of the end."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze and MARK.encode() not in raw and _valid(raw):
            source = np.arange(-self.prefix, len(raw) + 1)
            source[0] = 0
            return b" " * self.prefix + raw, source
        texts, places, at, blank = [], [], 0, self.squeeze
        while at < len(raw):
            if self.map and raw[at] in self.map.starts:
                read, text = self.map.longest(raw, at)
            else:
                read, text = 0, b""
            if not read:
                found = CHARACTER.match(raw, at)
                read, text = (len(found[0]), found[0]) if found else (1, BAD)
            text = text.replace(MARK.encode(), b" ")
            if blank:
                text = text.lstrip(b" ")
            if text:
                texts.append(text)
                places.append((at, len(text)))
                blank = self.squeeze and text.endswith(b" ")
            at += read
        if not texts:
            return b"", np.zeros(1, np.int64)
        starts, sizes = np.array(places).T
        source = np.append(np.repeat(starts, sizes), len(raw))
        normal = b"".join(texts)
        if self.squeeze:
            size = len(normal.rstrip(b" "))
            normal, source = normal[:size], source[: size + 1]
        if self.prefix:
            return b" " + normal, np.concatenate([source[:1], source])
        return normal, source

    def _blocks(self, normal: bytes) -> Iterator[list[bytes]]:
        """The chunks, as many at a time as a block of the text holds."""
        at = 0
        while at < len(normal):
            end = at + BLOCK
            if end < len(normal) and (near := re.compile(rb"(?<=[^ ]) ").search(normal, end)):
                end = near.start()
            else:
                end = len(normal)
            yield self.cut.findall(normal, at, end)
            at = end

    def _segment(self, chunks: list[bytes]) -> list[bytes]:
        found = self.segmenter.encode([c.decode().replace(" ", MARK) for c in chunks], num_threads=1)
        return [array("I", ids).tobytes() for ids in found]

    def ids(self, normal: bytes) -> np.ndarray:
        parts = []
        for chunks in self._blocks(normal):
            distinct = set(chunks)
            long = [c for c in distinct if len(c) > LONGEST]
            passing = dict(zip(long, self._segment(long)))
            new = self.recent.missing(distinct.difference(long))
            stored = self.recent.now
            stored.update(zip(new, self._segment(new)))
            if passing:
                parts += [passing[c] if c in passing else stored[c] for c in chunks]
            else:
                parts += map(stored.__getitem__, chunks)
        return np.frombuffer(b"".join(parts), "<u4")

    def spans(self, normal: bytes, source: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of each piece in the original text.

        Of the byte pieces of a character, the last one has its span, the others none.
        """
        ends = np.cumsum(self.length[ids])
        starts = ends - self.length[ids]
        if len(ends) and self.is_byte[ids].any():
            head = (np.frombuffer(normal, np.uint8) & 0xC0) != 0x80
            first = np.maximum.accumulate(np.where(head, np.arange(len(normal)), 0))
            single = self.is_byte[ids]
            starts = np.where(single, first[starts], starts)
            inside = single & (ends < len(normal)) & ~np.append(head, True)[ends]
            ends = np.where(inside, starts, ends)
        return source[starts], source[ends]

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end, and the first and end byte of each in the text."""
        normal, source = self.normalise(raw)
        ids = self.ids(normal)
        starts, ends = self.spans(normal, source, ids)
        edge = np.array([0]), np.array([len(raw)])
        return (
            np.concatenate([self.bos, ids, self.eos]),
            np.concatenate([edge[0], starts, edge[1]]),
            np.concatenate([edge[0], ends, edge[1]]),
        )

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist())


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _lists(found: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)])
    values = pa.array(np.concatenate(found).astype(kind.to_pandas_dtype()))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _encode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = Codec(read_model(path))
    for batch in batches:
        raws = binary(batch, "text")
        for rows in slices(raws):
            ids, starts, ends = zip(*(codec.encode(raws[row] or b"") for row in rows))
            columns = [
                batch.column(0).slice(rows.start, len(rows)),
                _lists(ids, pa.int32()),
                _lists(starts, pa.int64()),
                _lists(ends, pa.int64()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "ids", "starts", "ends"])
    del codec
    give_back()


def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = Codec(read_model(path))
    for batch in batches:
        texts = [codec.decode(np.array(ids or [], "<u4")) for ids in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    del codec
    give_back()


def _digest(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = Codec(read_model(path))
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for batch in batches:
        found = []
        for raw in binary(batch, "text"):
            ids, starts, ends = codec.encode(raw or b"")
            spans = zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(starts.astype("<i8").tobytes()))
            decoded = codec.decode(ids).encode()
            found.append((len(ids), sha(ids.astype("<u4").tobytes()), sha(decoded), spans))
        columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.string(), pa.string(), pa.int64()))]
        if found:
            yield pa.record_batch(
                [batch.column(0), *columns],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"],
            )
    del codec
    give_back()


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts, ends) per row of ``docs`` (doc_id, text, ...).

    ``ids`` are those of the library's encode with begin and end ids; ``starts`` and
    ``ends`` bound the bytes of the UTF-8 text that each id stands for. Null and empty
    texts have the begin and end ids only; repeated rows and null ids stay as they are.
    """
    schema = "doc_id long, ids array<int>, starts array<long>, ends array<long>"
    return documents(docs).mapInArrow(partial(_encode, path), schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) per row of ``encoded`` (doc_id, ids, ...), by the library's decode.

    Null and empty lists give an empty text.
    """
    chosen = encoded.selectExpr("cast(doc_id AS long) AS doc_id", "cast(ids AS array<int>) AS ids")
    return chosen.mapInArrow(partial(_decode, path), "doc_id long, text string")


def codec_report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32) per row of ``docs``.

    Digests of what ``encode_texts`` and, from its ids, ``decode_ids`` give, without
    writing the lists: of the ids as little-endian unsigned 32-bit integers, of the
    decoded text in UTF-8, and of the starts followed by the ends as 64-bit integers.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    return documents(docs).mapInArrow(partial(_digest, path), schema)
