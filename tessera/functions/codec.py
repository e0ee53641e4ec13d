"""Byte-level codec as column expressions.

Token ids 0–255 are the UTF-8 bytes of the text; special tokens follow. The
whole codec is built-in Spark expressions, so it runs inside whole-stage code
generation and can be restated in SQL for checking.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Special token ids of the byte vocabulary (ids 0-255 are bytes).
BYTE_SPECIALS = {
    "<|python_start|>": 256,
    "<|python_end|>": 257,
    "<|output_start|>": 258,
    "<|output_end|>": 259,
    "<|assistant_end|>": 260,
    "<|bos|>": 261,
    "<|user_start|>": 262,
    "<|user_end|>": 263,
    "<|assistant_start|>": 264,
}

# The nine special token names, in vocabulary order, of the BPE tokenizer.
SPECIAL_TOKENS = [
    "<|bos|>",
    "<|user_start|>",
    "<|user_end|>",
    "<|assistant_start|>",
    "<|assistant_end|>",
    "<|python_start|>",
    "<|python_end|>",
    "<|output_start|>",
    "<|output_end|>",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utf8_ids(text) -> Column:
    """array<int> of the UTF-8 bytes of ``text`` (empty array for '').

    The bytes are re-read as ISO-8859-1, which maps every byte to the one
    character with that code point; splitting into characters and reading
    each code point gives the byte values, all in JVM expressions."""
    return _byte_ids(F.encode(_c(text), "UTF-8"))


def _byte_ids(data: Column) -> Column:
    latin = F.decode(data, "ISO-8859-1")
    ids = F.transform(F.split(latin, ""), lambda c: F.ascii(c))
    return F.when(F.length(latin) == 0, F.array().cast("array<int>")).otherwise(ids)


def bytes_to_text(ids) -> Column:
    """Decode byte ids (specials ≥ 256 dropped); malformed UTF-8 becomes U+FFFD."""
    kept = F.filter(_c(ids), lambda x: (x >= 0) & (x < 256))
    hx = F.array_join(F.transform(kept, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return F.make_valid_utf8(F.unhex(hx).cast("string"))


#: Rows whose ids are written at a time.
WRITTEN_ROWS = 64


@lru_cache(2)
def _written(top: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers below ``top``, each with a comma, as rows of bytes, and their sizes."""
    numbers = [b"%d," % i for i in range(top)]
    return np.array(numbers).view(np.uint8).reshape(top, -1), np.array([len(x) for x in numbers])


def _written_rows(ids: pa.ListArray) -> pa.Array:
    flat = ids.flatten()
    top = 0 if flat.null_count == len(flat) else int(pa.compute.max(flat).as_py()) + 1
    if flat.null_count or not 0 < top <= 1 << 20 or pa.compute.min(flat).as_py() < 0:
        return pa.array([None if r is None else ",".join(str(x) for x in r if x is not None) for r in ids.to_pylist()], pa.string())
    signs, sizes = _written(max(1 << 10, 1 << (top - 1).bit_length()))
    values = flat.to_numpy()
    rows = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(rows)
    size = sizes[values]
    size[ends[rows > 0] - 1] -= 1  # no comma after the last
    data = signs[values][np.arange(signs.shape[1]) < size[:, None]]
    bounds = np.append(0, np.cumsum(size))[np.append(0, ends)].astype(np.int32)
    texts = pa.StringArray.from_buffers(len(ids), pa.py_buffer(bounds), pa.py_buffer(data))
    return pa.compute.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string())) if ids.null_count else texts


@F.arrow_udf(StringType())
def _ids_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for ids in batches:
        for at in range(0, len(ids), WRITTEN_ROWS):
            yield _written_rows(ids[at : at + WRITTEN_ROWS])


def ids_text(ids) -> Column:
    """Ids with commas between, the same text as ``array_join(ids, ",")``, which
    makes a string of each; here many are written at a time."""
    return _ids_text(_c(ids))


class ByteCodec:
    """Byte tokenizer: encode is a Column expression, no join needed."""

    kind = "byte"

    def __init__(self, specials: dict[str, int] | None = None):
        self.specials = dict(specials or BYTE_SPECIALS)

    def special(self, name: str) -> int:
        if not name.startswith("<|"):
            name = f"<|{name}|>"
        return self.specials[name]

    @property
    def bos(self) -> int:
        return self.special("bos")

    def encode_col(self, text) -> Column:
        return utf8_ids(text)

    def length_col(self, text) -> Column:
        """How many ids a text has."""
        return F.octet_length(_c(text))

    def packed_col(self, text) -> Column:
        """The ids of a text as binary, a byte each; those of a concatenation are
        the concatenated binaries."""
        return F.encode(_c(text), "UTF-8")

    def unpacked_col(self, packed) -> Column:
        """array<int> of packed ids."""
        return _byte_ids(_c(packed))

    def encode(self, df: DataFrame, text: str, out: str = "ids") -> DataFrame:
        return df.withColumn(out, utf8_ids(text))

    def decode_col(self, ids) -> Column:
        return bytes_to_text(ids)

    def vocab(self, spark) -> DataFrame:
        """(token_id, token binary, is_special)."""
        rows = [(i, bytes([i]), False) for i in range(256)]
        rows += [(v, k.encode(), True) for k, v in sorted(self.specials.items(), key=lambda kv: kv[1])]
        return spark.createDataFrame(rows, "token_id int, token binary, is_special boolean")
