"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes, by sequential files.

The method of its name for repeated passages, complete and exact, for collections that one task can afford; the
README gives its measured cost, for which ``repeats`` finds the passages of a whole corpus in another way.

Each round lengthens the suffixes that are sorted by one symbol of every document, from the ends backwards.  The
rows of the order so far are read from front to back; each row goes to the end of the file of the symbol before
its suffix, which is the place of the longer suffix, as the transform's last-to-first mapping says.  A row is
(document, place, common prefix with the row before it).  The common prefix of two neighbours in a symbol's file
is one more than the least since that symbol's last row.  Files are only read forwards and appended to; memory
holds the texts' symbols, one block of rows and two numbers a symbol.

Defined results: null and empty texts have no rows but their end; ends of documents differ from each other and
from all symbols, so matches never cross documents; repeated texts are documents of their own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

ROW = np.dtype([("doc", "<i4"), ("at", "<i4"), ("lcp", "<i4")])
BLOCK = 1 << 16


def _rows(paths: list[str]) -> Iterator[np.ndarray]:
    for path in filter(os.path.exists, paths):
        with open(path, "rb") as f:
            while data := f.read(BLOCK * ROW.itemsize):
                yield np.frombuffer(data, dtype=ROW)


class Construction:
    """The files of one collection in ``folder``; ``written`` counts the bytes of all rounds."""

    def __init__(self, texts: list[bytes | None], folder: str):
        self.folder, self.round, self.written = folder, 0, 0
        self.sizes = np.array([len(t or b"") for t in texts], dtype=np.int64)
        self.first = np.r_[0, np.cumsum(self.sizes)]
        self.symbols = np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8)
        ends = np.zeros(len(texts), dtype=ROW)
        ends["doc"], ends["at"] = np.arange(len(texts)), self.sizes
        ends.tofile(self._path("end"))

    def _path(self, name: int | str) -> str:
        return f"{self.folder}/{name}" if name == "end" else f"{self.folder}/{self.round % 2}-{name:03d}"

    def paths(self) -> list[str]:
        return [self._path("end"), *(self._path(c) for c in range(256))]

    def insert(self) -> None:
        """One round: the next symbol of every document."""
        before = self.paths()
        self.round += 1
        seen, least = np.zeros(256, dtype=bool), np.full(256, np.iinfo(np.int32).max, dtype=np.int64)
        out = {}
        for rows in _rows(before):
            inside = rows["at"] > 0
            symbol = np.full(len(rows), -1)
            symbol[inside] = self.symbols[self.first[rows["doc"][inside]] + rows["at"][inside] - 1]
            lcp = rows["lcp"].astype(np.int64)
            low = np.minimum(least, lcp.min())
            for c in np.unique(symbol[inside]).tolist():
                own = np.flatnonzero(symbol == c)
                since = np.minimum.reduceat(np.r_[lcp, np.iinfo(np.int32).max], np.r_[0, own + 1])
                since[0] = min(since[0], least[c])
                made = rows[own]
                made["at"] -= 1
                made["lcp"] = since[:-1] + 1
                if not seen[c]:
                    made["lcp"][0], seen[c] = 0, True
                low[c] = since[-1]
                if c not in out:
                    out[c] = open(self._path(c), "wb")  # noqa: SIM115
                made.tofile(out[c])
                self.written += made.nbytes
            least = low
        for f in out.values():
            f.close()
        for path in before[1:]:
            if os.path.exists(path):
                os.remove(path)

    def run(self) -> Construction:
        for _ in range(int(self.sizes.max(initial=0))):
            self.insert()
        return self

    def repeated(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, place) of the strings of ``length`` symbols that start anywhere else as well."""
        last = np.zeros(0, dtype=ROW)
        for rows in _rows(self.paths()):
            rows = np.r_[last, rows]
            joint = rows["lcp"][1:] >= length
            # a block's last row is judged with the next block, and its own first row was the last one's last
            yield rows["doc"][:-1][joint], rows["at"][:-1][joint]
            yield rows["doc"][1:][joint], rows["at"][1:][joint]
            last = rows[-1:]

    def transform(self) -> bytes:
        """The transform, with a zero byte for the ends of documents."""
        return b"".join(
            bytes(int(self.symbols[self.first[d] + p - 1]) if p else 0 for d, p in zip(rows["doc"].tolist(), rows["at"].tolist(), strict=True)) for rows in _rows(self.paths())
        )


def repeated_starts(texts: list[bytes | None], length: int, folder: str) -> list[list[int]]:
    """For each text, the sorted starts of its repeated strings."""
    out: list[set[int]] = [set() for _ in texts]
    for docs, places in Construction(texts, folder).run().repeated(length):
        for d, p in zip(docs.tolist(), places.tolist(), strict=True):
            out[d].add(p)
    return [sorted(x) for x in out]
