"""Whole texts to token ids with a public tokenizer of the tokenizers library.

White space always parts tokens of the word tokenizers used here, so a text's ids are those of its words one
after the other.  A batch's words are split, numbered and put together again by Arrow; Python sees each
different word of a batch once at most.  A word that is plain letters and a run of marks is its letters in
lower case and then the marks, which is how the tokenizer parts it; the letters' ids are looked up or encoded
many words at once, and told apart by the tokens that end a word.  All other words are encoded as they are,
and texts with ASCII separators (28 to 31), which Arrow takes for white space and the tokenizer doesn't, are
encoded whole.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 1
#: Letter runs and other words whose ids are kept between batches, at most: those met first.
MAX_STEMS, MAX_WORDS = 350_000, 50_000
#: Letters (those whose lower case is one letter) and then marks.
PARTED = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<marks>[.,!?:;&*%$#|()-]*)$"
SEPARATORS = "[\x1c-\x1f]"


class Encoder:
    def __init__(self, path: str, end: int | None = END):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end is None else np.array([end], dtype="<u4").tobytes()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stems: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_stems(self, stems: list[str]) -> list[bytes]:
        """Words of plain lower-case letters: each is one unit of the tokenizer, and ends with a token that ends words."""
        out: list[bytes] = []
        for i in range(0, len(stems), 2000):
            some = stems[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            bounds = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(bounds) != len(some) + 1:  # another vocabulary than this way is made for
                out += self._encode(some)
                continue
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    @staticmethod
    def _looked_up(words: pa.Array, known: dict[str, bytes], limit: int, encode) -> pa.Array:
        """The ids of different words; those not known are encoded, and kept while there is room."""
        names = words.to_pylist()
        found = list(map(known.get, names))
        holes = [i for i, x in enumerate(found) if x is None]
        new = encode([names[i] for i in holes])
        for i, x in zip(holes, new, strict=True):
            found[i] = x
        room = max(0, limit - len(known))
        known.update((names[i], x) for i, x in zip(holes[:room], new))
        return pa.array(found, pa.large_binary())

    def _encode_words(self, words: pa.Array) -> pa.Array:
        """The ids of each of the words."""
        parts = pc.extract_regex(words, PARTED)
        is_parted = parts.is_valid()
        parts = parts.drop_null()
        stem = pc.utf8_lower(parts.field("stem")).dictionary_encode()
        marks = parts.field("marks").dictionary_encode()
        letters = self._looked_up(stem.dictionary, self.stems, MAX_STEMS, self._encode_stems).take(stem.indices)
        after = self._looked_up(marks.dictionary, self.words, MAX_WORDS, self._encode).take(marks.indices)
        parted = pc.binary_join_element_wise(letters, after, pa.scalar(b"", pa.large_binary()))
        other = self._looked_up(words.filter(pc.invert(is_parted)), self.words, MAX_WORDS, self._encode)
        place = np.empty(len(words), dtype=np.int64)
        mask = is_parted.to_numpy(zero_copy_only=False)
        place[mask] = np.arange(len(parted))
        place[~mask] = np.arange(len(parted), len(words))
        return pa.concat_arrays([parted, other]).take(pa.array(place))

    def ids(self, texts: pa.Array | Sequence[str | None]) -> list[bytes]:
        """Each text's ids, with the end id, as little-endian unsigned 32-bit integers; null counts as empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        gc.disable()  # nothing here makes cycles, and the lookup is large
        try:
            return self._ids(column.cast(pa.large_string()))
        finally:
            gc.enable()

    def _ids(self, column: pa.Array) -> list[bytes]:
        whole = pc.match_substring_regex(column, SEPARATORS)
        split = pc.utf8_split_whitespace(pc.if_else(whole, "", column))
        words = split.flatten().dictionary_encode()
        joined = self._encode_words(words.dictionary.cast(pa.large_string())).take(words.indices)
        _, offsets, data = joined.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[joined.offset :][: len(joined) + 1] if len(joined) else np.zeros(1, dtype=np.int64)
        bounds = split.offsets.to_numpy()
        ends = at[bounds - bounds[0]].tolist() if len(bounds) else []
        view = memoryview(data) if data is not None else memoryview(b"")
        out = [view[a:b].tobytes() + self.end for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._encode([column[i].as_py()])[0] + self.end
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end: int | None = END) -> Encoder:
    """One a worker process."""
    if (path, end) not in _encoders:
        _encoders[path, end] = Encoder(path, end)
    return _encoders[path, end]
