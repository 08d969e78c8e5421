"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Every token of the rank file becomes a piece: its bytes mapped to printable characters (one for each of the 256 bytes),
with the negative rank as score, so that sentencepiece's best-scored merge is the lowest-ranked one. The normaliser is
the identity. A text is split into pre-tokens by a pattern, and each pre-token is encoded separately; a pre-token that is
itself a token is that token. Decoding maps ids to their bytes.

Work is a map over whole texts, without a shuffle; pre-tokens already encoded are remembered up to a fixed number.
The rank file is read once by the driver; its model is broadcast (refused beyond MAX_MODEL bytes).

Nulls: a null text is empty and has no ids; null ids decode to no bytes; an id outside the vocabulary is an error.
Repeated rows are coded alike. Input columns with the names of added ones are replaced.
"""

from __future__ import annotations

import base64
import re
import struct
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, table

MAX_MODEL = 64 << 20
#: Pre-tokens that a worker remembers, and characters (or ids) that it works on at once.
REMEMBERED, RUN = 100_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable and no space, else the next from U+0100 on."""
    own = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else "" for b in range(256)]
    rest = iter(range(256, 512))
    return [c or chr(next(rest)) for c in own]


CHARACTERS = byte_characters()
#: For str.translate of a text's bytes read as Latin-1.
TO_PIECE = dict(enumerate(CHARACTERS))


def to_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(TO_PIECE)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(field: int, body: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(body)) + body


def number(field: int, n: int) -> bytes:
    return varint(field << 3) + varint(n)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model: pieces in rank order and one unknown piece at the end."""
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = [message(1, message(1, to_piece(t).encode()) + varint(2 << 3 | 5) + struct.pack("<f", -r)) for r, t in enumerate(order)]
    pieces.append(message(1, message(1, b"<unk>") + varint(2 << 3 | 5) + struct.pack("<f", 0.0) + number(3, 2)))
    trainer = number(3, 2) + number(4, len(pieces)) + number(40, len(order)) + number(41, (1 << 64) - 1) + number(42, (1 << 64) - 1) + number(43, (1 << 64) - 1)
    normalizer = message(1, b"identity") + number(3, 0) + number(4, 0) + number(5, 0)
    return b"".join(pieces) + message(2, trainer) + message(3, normalizer)


#: The default pattern over Latin-1 bytes: its classes of letters, numbers and white space up to U+00FF, spelled out.
LETTERS, NUMBERS, WHITE = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"


def latin_splitter(pattern: str):
    """A splitter of Latin-1 bytes that cuts where the pattern does, for the default pattern; None for another one."""
    if pattern != public_tokenizers.PATTERN:
        return None
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE}{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return re.compile(spelled.encode("latin-1")).findall


class Coder:
    """Encoding and decoding with one model; lives in a Python worker."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        self.ranks, self.split, self.split_latin = ranks, regex.compile(pattern).findall, latin_splitter(pattern)
        tokens = sorted(ranks, key=ranks.get)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start, self.blob = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Ids of pre-tokens met so far; bytes are Latin-1 texts' pre-tokens.
        self.known: dict[str | bytes, list[int]] = {}

    def parts(self, text: str) -> list[str] | list[bytes]:
        if self.split_latin:
            try:
                return self.split_latin(text.encode("latin-1"))
            except UnicodeEncodeError:
                pass
        return self.split(text)

    def learn(self, new: set[str | bytes]) -> None:
        hard, pieces = [], []
        for p in new:
            token = p.encode() if isinstance(p, str) else p.decode("latin-1").encode()
            if (r := self.ranks.get(token)) is not None:
                self.known[p] = [r]
            else:
                hard.append(p)
                pieces.append(to_piece(token))
        if pieces:
            self.known.update(zip(hard, self.sp.encode(pieces, num_threads=1), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin, with the end."""
        ids, sizes, i = [], [], 0
        while i < len(texts):
            if len(self.known) > REMEMBERED:
                self.known.clear()
            run, chars = [], 0
            while i < len(texts) and chars < RUN:
                run.append(self.parts(texts[i]) if texts[i] else [])
                chars += len(texts[i] or "")
                i += 1
            self.learn(set().union(*run) - self.known.keys())
            get = self.known.__getitem__
            for parts in run:
                own = np.fromiter(chain.from_iterable(map(get, parts)), np.int32)
                ids.append(own)
                sizes.append(len(own))
        return np.concatenate(ids) if ids else np.empty(0, np.int32), np.cumsum([0, *sizes])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each row's bytes begin, with the end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an id is not in the vocabulary")
        out, size = [np.empty(0, np.uint8)], self.size[ids]
        ends = np.append(0, np.cumsum(size))
        for a in range(0, len(ids), RUN):
            n = size[a : a + RUN]
            shift = np.repeat(self.start[ids[a : a + RUN]] - (np.cumsum(n) - n), n)
            out.append(self.blob[shift + np.arange(len(shift))])
        return np.concatenate(out), ends[bounds]


class Shared:
    """What a coder is made of, and the coder itself once a worker needs it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.args = (ranks, model_bytes(ranks), pattern)
        if len(self.args[1]) > MAX_MODEL:
            raise ValueError(f"the model has {len(self.args[1])} bytes; at most {MAX_MODEL} are broadcast")

    def __getstate__(self):
        return self.args

    def __setstate__(self, args):
        self.args = args

    @property
    def coder(self) -> Coder:
        if "made" not in self.__dict__:
            self.made = Coder(*self.args)
        return self.made


def shared(spark: SparkSession, path: str, pattern: str):
    return spark.sparkContext.broadcast(Shared(read_ranks(path), pattern))


def id_lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))


def byte_rows(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def encode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df[keep] with the token ids of each whole text."""
    known = shared(df.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = known.value.coder
        flat, bounds = coder.encode(batch.column(text).to_pylist())
        return [id_lists(flat, bounds)]

    return append_arrow(df, [T.StructField(out, T.ArrayType(T.IntegerType()))], run, keep)


def decode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df[keep] with the bytes of each row's ids."""
    known = shared(df.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = known.value.coder
        column = batch.column(ids)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return [byte_rows(*coder.decode(column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *sizes])))]

    return append_arrow(df, [T.StructField(out, T.BinaryType())], run, keep)


def round_trip(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df[keep] with the token ids of each whole text and the bytes that these ids decode to: encode() and decode() in one worker, so
    ids are not sent to a second one."""
    known = shared(df.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = known.value.coder
        flat, bounds = coder.encode(batch.column(text).to_pylist())
        return [id_lists(flat, bounds), byte_rows(*coder.decode(flat, bounds))]

    return append_arrow(df, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.BinaryType())], run, keep)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=["doc_id"])
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLES: dict[str, str] = {}
