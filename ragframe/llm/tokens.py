"""Token ids in bit-packed binary files.

**Encoding.** The tokenizers library encodes each distinct piece of text once per task
and the ids are remembered (two generations of a bounded table). A piece is a word with
the space before it (byte-level BPE) or a word (BPE that drops white space): both
tokenizers split there first, so the pieces' ids in a row are the text's ids. Texts in
which a cut at a space could differ, or that hold an added token's string, are encoded whole.

**Files.** A file is a row of blocks and an index, each followed by a newline byte. A
block holds at most ``BLOCK_TOKENS`` ids, each in the fewest bits that the vocabulary
needs (least significant bit first), behind a header and a table of the pieces of
documents in it. The index at the file's end has every block's offset and first token,
so any token range is found by a binary search and unpacked with numpy. Files hold
documents in ascending doc_id order, and file numbers ascend with them.

Files are written by Spark's writers, whose commit survives lost tasks, and read by
Spark's readers; nothing opens a path from a task."""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragframe.llm.common import broadcast_up_to, shared_path, shared_table, text_batches

#: Remembered pieces in each of the two generations of a task's table.
REMEMBERED = 400_000
BLOCK_TOKENS = 1 << 16
#: Bytes of text that go to one file.
FILE_BYTES = 24 << 20

_HEAD = struct.Struct("<4sBIIQII")  # magic, bits, file, block, first token, pieces, tokens
_PIECE = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("flags", "u1")])  # flags: 1 last piece, 2 null id
#: White space before a space, in any engine's view of white space.
_ODD_PAIRS = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
#: Byte-level BPE writes each byte as a letter: itself where that prints, else one from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: b for b in _PRINTS} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTS)))}


class Pieces(dict):
    """Ids by piece, made when first asked for. Two generations of at most
    ``REMEMBERED`` pieces each bound it; a piece in use moves to the younger one."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece) or self.make(piece)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts, with a bounded memory of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tokenize = self.tok.model.tokenize
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        # texts with a token's own string in them are encoded whole
        self.added = [t["content"].lower() for t in made.get("added_tokens") or []]
        self.signs = {t[:1] for t in self.added}
        pre = made.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        if made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.lead = " "
        elif steps[0].get("type") == "Split" and r"\s" in str(steps[0].get("pattern")) and steps[0].get("behavior") == "Removed":
            self.lead = ""
        else:
            self.lead = None
        self.bits = max(1, (self.tok.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.pieces = Pieces(self._piece)
        if self.lead is not None:
            # letters for the splitting pattern; those whose lower case is a matter of course, where it is taken
            self.plain = str.isalpha if self.lead else _LATIN.fullmatch
            self.space = "\u0120" if self.lead else ""
            self.ends = {c: self._encode(c) for c in ",.;:!?"}
            self.line_end = self._encode("\n")

    def _encode(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of a word of letters only: one run for the pattern that splits text, so
        the model gets it at once, in its own letters for bytes."""
        if not self.lead:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenize(lead + word)]).tobytes()

    def _quick(self, piece: str) -> bytes | None:
        """Ids of a word, a word with one mark behind it, or such with a line's end and
        a word behind it; None for anything else."""
        if self.plain(piece):
            return self._word(piece, self.space)
        end = self.ends.get(piece[-1:])
        if end is not None and self.plain(piece[:-1]):
            return (self.pieces.get(piece[:-1]) or self._word(piece[:-1], self.space)) + end
        if "\n" in piece:
            first, _, word = piece.partition("\n")
            head = self._quick(first) if first and self.plain(word) else None
            if head is not None:
                return head + self.line_end + self._word(word, "")
        return None

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return array("I", [t.id for t in self.tokenize(self.space + (piece if self.lead else piece.lower()))]).tobytes()
        ids = self._quick(piece)
        return self._encode(self.lead + piece) if ids is None else ids

    def _whole(self, text: str) -> bool:
        """Whether a cut at each space could change the ids: beside other white space, or
        where the string of an added token stands in the text (in any case of letters)."""
        if self.lead is None or any(c in text or c.upper() in text for c in self.signs) and any(t in text.lower() for t in self.added):
            return True
        return bool(self.lead) and (text[:1] == " " or text[-1:] == " " or any(pair in text for pair in _ODD_PAIRS))

    def _lower(self, text: str) -> str:
        """The text, for a model without capitals in lower case where that is a matter of
        course: fewer pieces to remember."""
        if not self.lead:
            try:
                text.encode("latin-1")
                return text.lower()
            except UnicodeEncodeError:
                pass
        return text

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text; null is empty."""
        if not text:
            return np.empty(0, "<u4")
        if self._whole(text):
            return np.frombuffer(self._encode(text), "<u4")
        words = self._lower(text).split(" ")
        first = [self._encode(words.pop(0))] if self.lead else []
        return np.frombuffer(b"".join([*first, *map(self.pieces.__getitem__, words)]), "<u4")


    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. The texts' pieces are counted off in one table, so every
        distinct one is looked up once, and the ids are gathered by number."""
        out = [np.empty(0, "<u4")] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self._whole(t):
                out[i] = self.encode(t)
            else:
                plain.append(i)
        if not plain:
            return out
        cut = pc.split_pattern(pa.array([self._lower(texts[i]) for i in plain], pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        pieces = cut.flatten().dictionary_encode()
        codes = pieces.indices.to_numpy().astype(np.int64)
        ids = list(map(self.pieces.__getitem__, pieces.dictionary.to_pylist()))
        if self.lead:  # a text's first word has no space before it
            first = ends[:-1]
            ids += [self._encode(w) for w in cut.flatten().take(pa.array(first)).to_pylist()]
            codes[first] = len(pieces.dictionary) + np.arange(len(first))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        held = np.frombuffer(b"".join(ids), "<u4")
        n = size[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        found = held[np.arange(upto[-1]) + np.repeat(start[codes] - upto[:-1], n)]
        for i, a, b in zip(plain, upto[ends[:-1]].tolist(), upto[ends[1:]].tolist()):
            out[i] = found[a:b]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The task process's encoder of one vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, least significant bit first, rows of ids end to end."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = planes
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class FileWriter:
    """Turns documents into the byte strings of one file."""

    def __init__(self, file_no: int, bits: int):
        self.file_no, self.bits = file_no, bits
        self.at = self.first = 0
        self.index: list[tuple[int, int]] = []
        self.pieces: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n = 0

    def _block(self) -> bytes:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        out = _HEAD.pack(b"TIB1", self.bits, self.file_no, len(self.index), self.first, len(self.pieces), len(ids))
        out += np.array(self.pieces, _PIECE).tobytes() + pack(ids, self.bits)
        self.index.append((self.at, self.first))
        self.at += len(out) + 1
        self.first += len(ids)
        self.pieces, self.held, self.n = [], [], 0
        return out

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        null = 2 * (doc_id is None)
        while True:
            take = min(len(ids), BLOCK_TOKENS - self.n)
            last = take == len(ids)
            self.pieces.append((doc_id or 0, take, null | last))
            self.held.append(ids[:take])
            self.n += take
            ids = ids[take:]
            if self.n == BLOCK_TOKENS or len(self.pieces) >= BLOCK_TOKENS:
                yield self._block()
            if last:
                return

    def end(self) -> Iterator[bytes]:
        if self.pieces:
            yield self._block()
        if self.index:
            table = np.array(self.index, "<u8").tobytes()
            yield b"TIX1" + table + struct.pack("<QQ4s", self.at, len(self.index), b"END1")


class FileReader:
    """Random access to the bytes of one file (bytes, or a memory map)."""

    def __init__(self, data):
        self.data = memoryview(data)
        at, n, end = struct.unpack("<QQ4s", self.data[-21:-1])
        if bytes(end) != b"END1" or bytes(self.data[at:at + 4]) != b"TIX1":
            raise ValueError("not a token file")
        self.offsets, self.firsts = np.frombuffer(self.data[at + 4:at + 4 + 16 * n], "<u8").reshape(-1, 2).T.astype(np.int64)

    def block(self, i: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(file number, first token, pieces, ids) of the block."""
        at = int(self.offsets[i])
        _, bits, file_no, _, first, n_pieces, n = _HEAD.unpack(self.data[at:at + _HEAD.size])
        at += _HEAD.size
        pieces = np.frombuffer(self.data, _PIECE, n_pieces, at)
        at += n_pieces * _PIECE.itemsize
        return file_no, first, pieces, unpack(self.data[at:at + -(-n * bits // 8)], n, bits)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks that hold them only."""
        i, parts = max(0, int(np.searchsorted(self.firsts, start, "right")) - 1), []
        while i < len(self.firsts) and self.firsts[i] < stop:
            ids = self.block(i)[3]
            parts.append(ids[max(0, start - self.firsts[i]):max(0, stop - self.firsts[i])])
            i += 1
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first token in the file, tokens, crc32 of the ids) of each document."""
        start, n, crc = 0, 0, 0
        for i in range(len(self.offsets)):
            _, _, pieces, ids = self.block(i)
            raw, at = ids.tobytes(), 0
            for doc_id, size, flags in pieces.tolist():
                crc = zlib.crc32(raw[at:at + 4 * size], crc)
                at += 4 * size
                n += size
                if flags & 1:
                    yield (None if flags & 2 else doc_id), start, n, crc
                    start, n, crc = start + n, 0, 0


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every document of ``docs`` into token files under ``path``.

    Rows of one doc_id are ordered by a hash of their text; null ids come first. Null
    and empty texts give the end id only. An empty table writes no file with blocks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, size // FILE_BYTES + 1)

    def run(batches):
        enc = encoder(vocabulary)
        out = FileWriter(TaskContext.get().partitionId(), enc.bits)
        tail = np.array([] if end_id is None else [end_id], "<u4")

        def packed(items):
            items = list(items)
            return pa.RecordBatch.from_arrays([pa.array(items, pa.binary())], ["block"]) if items else None

        for batch in text_batches(batches, 1, 4 << 20):
            ids = enc.encode_many(batch.column(1).to_pylist())
            for doc_id, i in zip(batch.column(0).to_pylist(), ids):
                got = packed(out.add(doc_id, np.concatenate([i, tail])))
                if got is not None:
                    yield got
        got = packed(out.end())
        if got is not None:
            yield got

    ordered = rows.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, local_start, n_tokens, ids_crc32) of every document in the files."""
    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_buffer()
                if raw is None or raw.size < 21:
                    continue
                reader = FileReader(raw)
                file_no = reader.block(0)[0]
                rows = [(d, file_no, s, n, c) for d, s, n, c in reader.documents()]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "file", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "doc_id long, file int, local_start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, vocabulary: str, end_id: int | None = 2, path: str | None = None) -> DataFrame:
    """Writes the token files (to ``path``, or a new shared folder), reads them back and
    returns doc_id, start (ids of all documents before it), n_tokens and ids_crc32, one
    row per row of ``docs``; see :func:`write_token_files` for odd rows."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-files")
    write_token_files(docs, path, vocabulary, end_id)
    found = shared_table(read_token_files(spark, path), "token-rows")
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    bases = shared_table(totals.select("file", F.coalesce(before, F.lit(0)).alias("base")), "token-bases")
    return found.join(broadcast_up_to(bases, 1_000_000), "file").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
