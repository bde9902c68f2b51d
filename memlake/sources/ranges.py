"""Complete lines of byte ranges of files, on any store that Arrow's file systems know.

A range owns the lines that begin in it, wherever they end, so a long file can be cut anywhere and read by many tasks. What follows
the last newline of a file is no line yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

from pyarrow import fs

#: Bytes of a file that one task reads at most, but for the last line's rest; bytes read at once.
RANGE_BYTES, BLOCK = 64 << 20, 1 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        inner = path[5:] if scheme else path
        return fs.LocalFileSystem(), "/" + inner.lstrip("/") if scheme else inner
    return fs.FileSystem.from_uri(quote(unquote(path), safe=":/@?=&"))


def listing(root: str, suffix: str = ".jsonl") -> Iterator[tuple[str, int]]:
    """(path, length) of the files under `root` with the suffix; a missing root is an error."""
    store, inner = store_of(root)
    for f in store.get_file_info(fs.FileSelector(inner, recursive=True)):
        if f.type == fs.FileType.File and f.path.endswith(suffix):
            yield root.rstrip("/") + "/" + f.path[len(inner.rstrip("/")) :].lstrip("/"), f.size


def complete_end(path: str, begin: int, block: int = 1 << 16) -> int:
    """The byte after the last newline at or after `begin`; `begin` if there is none. Read from the end of the file."""
    store, inner = store_of(path)
    with store.open_input_file(inner) as f:
        at = f.size()
        while at > begin:
            lo = max(begin, at - block)
            f.seek(lo)
            found = f.read(at - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
    return begin


def lines_in(path: str, begin: int, end: int, base: int = 0, block: int = BLOCK) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, bytes without the newline) of the complete lines that begin in [begin, end); a line begins at `base`."""
    store, inner = store_of(path)
    with store.open_input_file(inner) as f:
        inside = begin <= base
        at = base if inside else begin - 1  # if the byte before is a newline, a line begins right here
        f.seek(at)
        held, first, scan = bytearray(), 0, 0
        while not inside or at + first < end:
            stop = held.find(b"\n", scan)
            if stop < 0:
                del held[:first]
                at, scan, first = at + first, len(held), 0
                more = f.read(block)
                if not more:
                    return
                held += more
                continue
            if inside:
                yield at + first, at + stop + 1, bytes(held[first:stop])
            inside, first, scan = True, stop + 1, stop + 1
