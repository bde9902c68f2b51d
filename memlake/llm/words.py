"""Words of a text as column expressions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts words, as a pattern.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = "\x20\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Maximal runs without space or \\t \\n \\v \\f \\r; null gives an empty array."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


#: The same in DuckDB, for a column or expression.
def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


#: Bytes of text worked on at once, about.
GROUP_BYTES = 2 << 20


def text_groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[pa.Array]:
    """Texts in a row, about `size` bytes a group, or one long text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    return (texts.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all `texts` in a row as places in a list of distinct words, that list, and the places where texts begin and end."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    codes, words, ends = coded.indices.to_numpy().astype(np.int64), coded.dictionary, split.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    none = pc.index(words, "").as_py()  # where a text begins or ends with white space
    if none >= 0:
        stays = codes != none
        ends = np.concatenate([[0], np.cumsum(stays)])[ends]
        codes = codes[stays]
    return codes, words, ends


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives its free memory back to the system, as it lives on through other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return whole
