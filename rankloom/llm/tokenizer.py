"""Byte-level BPE by a public vocabulary, exact for texts of any length.

A text is divided by the vocabulary's pattern into pieces, each of which is encoded alone. A long text is
first cut where a piece must end whatever surrounds it (between a letter and a blank before a letter), and
the cuts are encoded in parallel by the threads of its task (the encoder runs outside Python's lock). A long
run that the pattern doesn't divide is encoded by tree concatenation: its parts are encoded in parallel, then
level by level two neighbours are joined: a window around their join is encoded again and grows until it
agrees with both sides. A sequence of tokens is the BPE encoding of its bytes if each pair of neighbours is
the encoding of the pair's bytes, so agreement at both ends of the window makes the joined sequence exact.
All this happens in the one scan of the table: nothing is shuffled and no text is read twice.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary of byte_bpe_50k lies, if the caller doesn't say.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern published with that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are cut and encoded in parallel; runs of more characters are encoded in parts and joined.
LONG_TEXT, LONG_PIECE = 32_768, 2_048
#: Threads that encode the parts of one long text.
THREADS = 4
#: Ids that a batch of results may hold.
IDS_AT_ONCE = 4_000_000

_SPLIT = regex.compile(PATTERN)
_SAFE_CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")


#: Vocabularies that came with a task, by their path on the driver.
_SHIPPED: dict[str, bytes] = {}


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    data = _SHIPPED[path] if path in _SHIPPED else Path(path).read_bytes()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


@functools.cache
def encoding(path: str = VOCABULARY):
    """The vocabulary at ``path`` (one for each worker process)."""
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@functools.cache
def run_encoding(path: str = VOCABULARY):
    """The same vocabulary for undivided runs: whatever it is given is one piece."""
    import tiktoken

    return tiktoken.Encoding("byte_bpe_run", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(path), special_tokens={})


@functools.cache
def _threads() -> ThreadPoolExecutor:
    return ThreadPoolExecutor(THREADS)


def _window(enc, left: list[int], right: list[int], width: int) -> tuple[int, int, str]:
    """Numbers of tokens of both sides, ``width`` or a few more, whose bytes are whole characters, and their text."""
    a, b = min(width, len(left)), min(width, len(right))
    while True:
        data = b"".join(enc.decode_tokens_bytes(left[len(left) - a :] + right[:b]))
        try:
            return a, b, data.decode()
        except UnicodeDecodeError:  # a token may begin or end within a character
            a, b = min(a + 1, len(left)), min(b + 1, len(right))


def join(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of two neighbouring parts of one run, from the encodings of the parts (both of whole characters); ``enc`` is for runs."""
    if not left or not right:
        return left + right
    width = 4
    while True:
        a, b, text = _window(enc, left, right, width)
        middle = enc.encode_ordinary(text)
        if (a == len(left) or middle[0] == left[len(left) - a]) and (b == len(right) or middle[-1] == right[b - 1]):
            return left[: len(left) - a] + middle + right[b:]
        width *= 2


def encode_run(enc, run: str, most: int = 0, each: Callable = map) -> list[int]:
    """Encoding of one undivided run: of its parts, by ``each`` (a map that may work in parallel), joined as a tree."""
    most = most or LONG_PIECE
    parts = list(each(enc.encode_ordinary, [run[k : k + most] for k in range(0, len(run), most)]))
    while len(parts) > 1:
        pairs = [parts[k : k + 2] for k in range(0, len(parts), 2)]
        parts = list(each(lambda p: join(enc, *p) if len(p) > 1 else p[0], pairs))
    return parts[0] if parts else []


def cuts(text: str, size: int = LONG_TEXT) -> list[str]:
    """Parts of about ``size`` characters that can be encoded apart; longer where no cut is safe."""
    parts, start = [], 0
    while len(text) - start > size:
        found = _SAFE_CUT.search(text, start + size)
        if found is None:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    return [*parts, text[start:]]


def _encode_part(part: str, path: str, each: Callable) -> np.ndarray:
    if len(part) <= 2 * LONG_PIECE:
        return np.array(encoding(path).encode_ordinary(part), np.int32)
    out: list[int] = []
    plain: list[str] = []
    for m in _SPLIT.finditer(part):
        piece = m[0]
        if len(piece) <= LONG_PIECE:
            plain.append(piece)
            continue
        # pieces that follow one another give the same pieces again, as the run after them isn't there to change the last one
        out += [i for p in plain for i in run_encoding(path).encode_ordinary(p)]
        plain = []
        out += encode_run(run_encoding(path), piece, each=each)
    out += [i for p in plain for i in run_encoding(path).encode_ordinary(p)]
    return np.array(out, np.int32)


def encode(text: str | None, path: str = VOCABULARY) -> np.ndarray:
    """Ids of a text without special tokens; none for an empty text and for null."""
    if not text:
        return np.zeros(0, np.int32)
    if len(text) <= 2 * LONG_PIECE:
        return np.array(encoding(path).encode_ordinary(text), np.int32)
    parts = cuts(text, LONG_PIECE)
    if len(text) <= LONG_TEXT:
        return np.concatenate([_encode_part(p, path, map) for p in parts])
    pool = _threads().map
    # parts in parallel; within a long run, its own parts
    short = iter(pool(lambda p: _encode_part(p, path, map), [p for p in parts if len(p) <= LONG_TEXT]))
    return np.concatenate([next(short) if len(p) <= LONG_TEXT else _encode_part(p, path, pool) for p in parts])


def _encoder(spark: SparkSession, path: str, counts: bool):
    vocabulary = spark.sparkContext.broadcast(Path(path).read_bytes())  # under a megabyte; executors need no copy of the file
    kind = pa.int32() if counts else pa.list_(pa.int32())

    def batch_of(ids: list[int], values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, kind)], ["id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _SHIPPED.setdefault(path, vocabulary.value)
        for batch in batches:
            ids, values, held = [], [], 0
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = encode(text, path)
                ids.append(i)
                values.append(len(own) if counts else own)
                held += len(own)
                if held > IDS_AT_ONCE:
                    yield batch_of(ids, values)
                    ids, values, held = [], [], 0
            yield batch_of(ids, values)

    return run


def token_ids(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY, counts: bool = False) -> DataFrame:
    """``id`` and ``ids`` (or with ``counts`` their number) of each row.

    Null and empty texts give [] (0). Rows with a repeated text are encoded each. The id column must be an
    integer, unique and not null. Other columns don't matter. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoder(df.sparkSession, path, counts), f"id bigint, ids {'int' if counts else 'array<int>'}")
