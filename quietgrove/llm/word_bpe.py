"""Ids of a vocabulary file whose pieces end at word ends and drop white space.

White space always separates pieces of such a vocabulary, so a text is encoded chunk by chunk
between ASCII white space, and chunks seen before are looked up. Chunks of plain Latin letters and
signs are split and merged here; any other chunk goes to the tokenizers library as it is.
"""

from __future__ import annotations

import functools
import json
import re
from typing import Optional, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quietgrove.llm.bpe import byte_signs
from quietgrove.llm.common import keeps

#: Chunks remembered per process; the table is emptied when it is full.
REMEMBERED = 400_000
#: Longer chunks go to the library, whose merging stays fast on them.
LONG_CHUNK = 256

# Fixed value: how this kind of vocabulary splits lower-case text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Below this sign lower-casing and composing work sign by sign, alike in every library.
_PLAIN = re.compile("[\x02-ɏ]*")
_ODD_GAP = re.compile("[\x1c-\x1f]")
_WORD_END = b"\x01"


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class WordBpe:
    """A vocabulary, with a table from chunks to their ids."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer
        self._forget()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_signs()
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            ends = token.endswith("</w>") and token != "</w>"
            body = token[:-4] if ends else token
            if token not in self.special:
                ranks[bytes(signs[c] for c in body) + _WORD_END * ends] = rank
        self._core = tiktoken.Encoding("own", pat_str="[^\x01]+\x01", mergeable_ranks=ranks,
                                       special_tokens={})
        self._ends = np.zeros(1 << 16, dtype=bool)
        self._ends[[rank for token, rank in ranks.items() if token.endswith(_WORD_END) and len(token) > 1]] = True
        self._pieces = regex.compile(PIECES)

    def _forget(self) -> None:
        """An empty table: the place of a chunk in ``_begin`` and ``_count``, which cut ``_flat``."""
        self.table: dict[str, int] = {}
        self._flat = np.empty(1 << 16, dtype=np.uint16)
        self._begin = np.empty(1 << 14, dtype=np.int64)
        self._count = np.empty(1 << 14, dtype=np.int64)
        self._used = 0

    def _remember(self, chunks: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Add chunks whose ids stand one after another."""
        first, after = len(self.table), len(self.table) + len(chunks)
        while after > len(self._begin):
            self._begin, self._count = (np.concatenate([a, np.empty_like(a)]) for a in (self._begin, self._count))
        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        self._flat[self._used:self._used + len(ids)] = ids
        self._begin[first:after] = self._used + np.cumsum(counts) - counts
        self._count[first:after] = counts
        self._used += len(ids)
        self.table.update(zip(chunks, range(first, after)))

    def _library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: pa.Array) -> None:
        """Remember the ids of new chunks; plain ones are merged in one call. Words of ASCII letters,
        most of all chunks, are one piece each and stay in Arrow up to there."""
        word = pc.and_(pc.ascii_is_alpha(chunks), pc.less_equal(pc.utf8_length(chunks), LONG_CHUNK))
        words = chunks.filter(word)
        lowered = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], pc.ascii_lower(words)),
                                 _WORD_END.decode())[0].as_py()
        plain, counts, pieces, other = _strings(words), [1] * len(words), [lowered] if len(words) else [], []
        for chunk in _strings(chunks.filter(pc.invert(word))):
            if len(chunk) <= LONG_CHUNK and _PLAIN.fullmatch(chunk):
                found = self._pieces.findall(chunk.lower())
                plain.append(chunk)
                counts.append(len(found))
                pieces += found
            else:
                other.append(chunk)
        if plain:
            joined = _WORD_END.decode().join([*pieces, ""])
            ids = np.array(self._core.encode_ordinary(joined), dtype=np.uint16)
            ends = np.concatenate(([0], np.nonzero(self._ends[ids])[0] + 1))
            self._remember(plain, ids, np.diff(ends[np.concatenate(([0], np.cumsum(counts)))]))
        for chunk in other:
            ids = np.array(self._library_ids(chunk), dtype=np.uint16)
            self._remember([chunk], ids, np.array([len(ids)]))

    def encode_array(self, texts: pa.Array, end_id: Optional[int] = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; none for null. ``end_id`` is
        added to every text.

        The texts are split and their chunks numbered in Arrow, so Python sees each different chunk
        once; the ids are then one gather.
        """
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _ODD_GAP.pattern)
        for special in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        odd = {int(i): texts[int(i)].as_py() for i in np.nonzero(whole.to_numpy(zero_copy_only=False))[0]}
        if odd:
            texts = pc.if_else(whole, "", texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        chunks = _strings(coded.dictionary)
        if len(self.table) >= REMEMBERED:
            self._forget()
        find = self.table.get
        place = np.array([find(c, -1) for c in chunks], dtype=np.int64)
        new = np.nonzero(place < 0)[0]
        if len(new):
            self._learn(coded.dictionary.take(pa.array(new)))
            place[new] = [self.table[chunks[i]] for i in new.tolist()]
        at = place[coded.indices.to_numpy()]
        count = self._count[at]
        bounds = np.concatenate(([0], np.cumsum(count)))
        ids = self._flat[np.repeat(self._begin[at] - bounds[:-1], count) + np.arange(bounds[-1])]
        offsets = split.offsets.to_numpy()
        bounds = bounds[offsets - offsets[0]]
        if not odd and end_id is None:
            return ids, np.diff(bounds)
        parts, end = np.split(ids, bounds[1:-1]), np.array([] if end_id is None else [end_id], dtype=np.uint16)
        for i, text in odd.items():
            parts[i] = np.array(self._library_ids(text), dtype=np.uint16)
        return np.concatenate([x for part in parts for x in (part, end)]), \
            np.array([len(part) + len(end) for part in parts], dtype=np.int64)

    def encode_all(self, texts: Sequence[Optional[str]]) -> list[np.ndarray]:
        """Ids of whole texts; none for null."""
        if not len(texts):
            return []
        ids, counts = self.encode_array(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1])

    def encode(self, text: Optional[str]) -> np.ndarray:
        return self.encode_all([text])[0]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


keeps("word_bpe", vocabulary.cache_clear)
