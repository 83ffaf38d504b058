"""Byte-level BPE: encoding by a tree reduction over text halves, decoding up the tree."""

from __future__ import annotations

import base64
import hashlib
from array import array

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from panelcast.llm.common import arrow_pass, texts

# The same pieces as the published pattern, with possessive repeats: fixed value.
FAST_PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)
LEAF_CHARS = 4096
FIRST_WINDOW = 32

_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One coder a worker process and rank file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _cuts(text: str, at: int) -> bool:
    """A piece surely begins at ``at`` whatever stands around: a space before a letter or digit.

    The space can only be the first character of a piece: runs of white space that are
    followed by something else leave their last character to the next piece.
    """
    return 0 < at < len(text) - 1 and text[at] == " " and text[at + 1].isalnum()


class ByteBpe:
    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.leaf_chars = leaf_chars
        self.bytes_of = {i: token for token, i in ranks.items()}
        coder = tiktoken.Encoding(
            "own", pat_str=FAST_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.flat = coder.encode_ordinary

    def encode(self, text: str) -> array:
        """Token ids of the whole text: halves recursively, joined at a stable seam."""
        if len(text) <= self.leaf_chars:
            return array("I", self.flat(text))
        middle = len(text) // 2
        return self._join(text, 0, middle, len(text))

    def _encode_range(self, text: str, lo: int, hi: int) -> array:
        if hi - lo <= self.leaf_chars:
            return array("I", self.flat(text[lo:hi]))
        return self._join(text, lo, (lo + hi) // 2, hi)

    def _join(self, text: str, lo: int, middle: int, hi: int) -> array:
        left = self._encode_range(text, lo, middle)
        right = self._encode_range(text, middle, hi)
        return self.seam(text[lo:middle], left, text[middle:hi], right)

    def seam(self, a: str, left: array, b: str, right: array) -> array:
        """Ids of ``a + b`` from the ids of both.

        The window around the seam grows until it starts and ends where a piece begins
        in any surroundings; tokens outside it cannot change. The window is encoded
        anew, and its own parts of both sides say how many tokens it replaces.
        """
        size, start, end = FIRST_WINDOW, 0, len(b)
        while True:
            lo = max(0, len(a) - size)
            start = next((i for i in range(len(a) - 2, lo, -1) if _cuts(a, i)), 0)
            if start or lo == 0:
                break
            size *= 2
        size = FIRST_WINDOW
        while True:
            hi = min(len(b), size)
            end = next((i for i in range(1, hi - 1) if _cuts(b, i)), len(b))
            if end < len(b) or hi == len(b):
                break
            size *= 2
        keep = len(left) - len(self.flat(a[start:]))
        skip = len(self.flat(b[:end]))
        return left[:keep] + array("I", self.flat(a[start:] + b[:end])) + right[skip:]

    def decode(self, ids: array) -> bytes:
        """Bytes of the ids: leaves are concatenated up the tree."""
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def little_endian(ids: array) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    if ids.itemsize != 4:
        raise RuntimeError("32-bit integers expected")
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode_texts(df: DataFrame, path: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null text has no ids. Narrow, one row in memory."""

    def work(batches):
        coder = load(path)
        for batch in batches:
            ids = [coder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return arrow_pass(texts(df, id_col, text_col), work, "doc_id long, ids array<int>")


def decode_ids(df: DataFrame, path: str, *, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(doc_id, content binary); null ids give empty content, an unknown id fails the job."""

    def work(batches):
        coder = load(path)
        for batch in batches:
            content = [coder.decode(array("I", x or [])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(content, pa.binary())], ["doc_id", "content"]
            )

    return arrow_pass(df.select(id_col, ids_col), work, "doc_id long, content binary")


def round_trip(df: DataFrame, path: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Encode every text, decode the ids again, and return digests of both.

    One row per input row, repeated rows included; null and empty texts have 0 tokens.
    Ids exist for one text at a time, so memory follows the longest text.
    """

    def work(batches):
        coder = load(path)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column("text"):
                ids = coder.encode(value.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(little_endian(ids)).hexdigest())
                of_bytes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(of_ids, pa.string()),
                    pa.array(of_bytes, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_pass(texts(df, id_col, text_col), work, schema)
