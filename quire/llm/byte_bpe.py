"""Byte-level BPE ids of whole texts, by words that repeat."""

from __future__ import annotations

import base64
import re
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in which a cut before a plain space could fall inside one of the pattern's pieces.
UNSAFE = re.compile(r"\s \s|\s $")
BLANK = re.compile(r"\s")
AT_ONCE = 1 << 20  # characters of distinct words encoded in one go


class ByteBpe:
    """Ids as the ``tokenizers`` file gives them, special strings inside texts included.

    The pattern never joins what stands before a single space to what follows, so a text is cut there, each distinct
    piece of a batch is encoded once with the same vocabulary as ranks, and the ids are gathered by index. Pieces without
    other white space are encoded as one text and told apart by the bytes of their ids. Texts with other runs of
    white space are encoded whole, texts that hold a special string by the tokenizer itself.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.load = lambda: Tokenizer.from_file(tokenizer_file)
        added = [t.content for t in self.load().get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)  # bytes of each id
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]

    @cached_property
    def tokenizer(self):
        """Only where a text has a special string; it takes far more memory than the ranks."""
        return self.load()

    def whole(self, text: str) -> np.ndarray:
        if self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.ranks.encode_ordinary(text), dtype=np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = [i for i, t in enumerate(texts.to_pylist()) if UNSAFE.search(t) or self.special.search(t)]
        pieces = pc.split_pattern(texts, " ")
        offsets = np.asarray(pieces.offsets) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        first = np.zeros(len(coded), dtype=bool)
        first[offsets[:-1]] = True  # no space stands before a text's first piece
        where = np.asarray(coded.indices).astype(np.int64) * 2 + ~first
        kinds, where = np.unique(where, return_inverse=True)
        names = coded.dictionary.to_pylist()
        pool, begin, lengths = self._pieces([" " * (k & 1) + names[k >> 1] for k in kinds.tolist()])
        out = []
        for i in range(len(texts)):
            own = where[offsets[i] : offsets[i + 1]]
            n = lengths[own]
            at = np.arange(n.sum()) + np.repeat(begin[own] - (np.cumsum(n) - n), n)
            out.append(pool[at])
        for i in odd:
            out[i] = self.whole(texts[i].as_py())
        return out

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, where those of each begin there and how many it has."""
        plain = np.array([len(x) > 1 and x[0] == " " and not BLANK.search(x, 1) for x in pieces], dtype=bool)
        begin, lengths = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        ids, taken, whole = [np.zeros(0, np.uint32)], 0, np.flatnonzero(plain)
        size = np.cumsum(np.fromiter((len(pieces[i]) for i in whole), np.int64, len(whole)))
        for some in np.split(whole, np.flatnonzero(np.diff(size // AT_ONCE)) + 1):
            held = [pieces[i] for i in some.tolist()]
            found = np.array(self.ranks.encode_ordinary("".join(held)), dtype=np.uint32)
            ends = np.cumsum(np.fromiter((len(x.encode()) for x in held), np.int64, len(held)))
            places = np.searchsorted(np.cumsum(self.sizes[found]), ends) + 1
            lengths[some] = np.diff(places, prepend=0)
            begin[some] = taken + places - lengths[some]
            ids.append(found)
            taken += len(found)
        for i in np.flatnonzero(~plain).tolist():
            found = np.array(self.ranks.encode_ordinary(pieces[i]), dtype=np.uint32)
            begin[i], lengths[i] = taken, len(found)
            ids.append(found)
            taken += len(found)
        return np.concatenate(ids), begin, lengths


@cache
def byte_bpe(tokenizer_file: str, ranks_file: str) -> ByteBpe:
    """One for each worker."""
    return ByteBpe(tokenizer_file, ranks_file)
