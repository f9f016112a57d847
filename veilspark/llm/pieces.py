"""Encoding of many texts with a byte-level tokenizer, each different piece of text once.

A byte-level BPE first cuts a text by its pattern and never merges across such a cut. Two kinds of place are cuts in
any text: between a letter and an ASCII character that is no letter, and between an ASCII character that is no space
and an ASCII space. A text is split there, pieces are named by a 64-bit hash, and only pieces that this worker hasn't
met go through the tokenizer; the ids of a text are those of its pieces, one after the other. The tokenizer is used as
its file has it: strings of its added tokens (such as <|endoftext|>) in a text become these tokens, as the library does
it by default, so each such string is a piece of its own. The result is that of encoding whole texts, which would take
about twice the time (969 CPU seconds a GB against 493, one core, 8 MB of texts with an empty store).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from veilspark.llm.shared import IS_SPACE, piece_hashes, slabs

#: Pieces that a worker keeps; a full store is emptied and filled anew, so that only speed depends on it.
KEPT_PIECES = 2_000_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_ENCODERS: dict[str, PieceEncoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on the machine that asks (a path in the task, not on the driver)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def added_places(raw: bytes, offs: np.ndarray, added: re.Pattern | None) -> list[tuple[int, int]]:
    """Where added tokens stand in the texts at offs: leftmost, longest, none across two texts."""
    out, at = [], 0
    while added is not None and (m := added.search(raw, at)):
        text = int(np.searchsorted(offs, m.start(), "right"))
        if m.end() <= offs[text]:
            out.append(m.span())
            at = m.end()
        else:
            at = m.start() + 1
    return out


def cut_points(buf: np.ndarray, offs: np.ndarray, whole: list[tuple[int, int]] = ()) -> np.ndarray:
    """Ascending first bytes of the pieces of the texts at offs; every non-empty text begins one. The ranges of whole are
    pieces of their own."""
    if not len(buf):
        return np.zeros(0, np.int64)
    ascii_ = buf < 0x80
    letter = _LETTER[buf]
    two = np.zeros(len(buf), bool)
    two[1:] = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    space = IS_SPACE[buf]
    known = (ascii_ & ~space) | two
    cut = np.zeros(len(buf), bool)
    cut[1:] = ((letter | two)[:-1] & (ascii_ & ~letter)[1:]) | (known[:-1] & space[1:])
    for a, b in whole:
        cut[a + 1 : b] = False
        cut[a] = True
        if b < len(cut):
            cut[b] = True
    cut[offs[:-1][offs[1:] > offs[:-1]]] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """ids and byte lengths of tokens for arrays of texts, by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that look at their neighbours have no pieces of their own")
        names = sorted((t.content.encode() for t in added.values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.token_bytes = np.zeros(max(*vocab.values(), *added) + 1, np.int32)
        for token, i in vocab.items():
            self.token_bytes[i] = len(token)  # one letter of the byte alphabet for each byte
        for i, t in added.items():
            self.token_bytes[i] = len(t.content.encode())
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint16 if len(self.token_bytes) <= 65536 else np.uint32)
        self.used = 0

    def _learn(self, keys: list[int], texts: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n, sizes = len(self.known), np.fromiter(map(len, encoded), np.int32, len(encoded))
        while n + len(keys) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter((i for e in encoded for i in e), np.int64, total)
        self.first[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.count[n : n + len(keys)] = sizes
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.used += total

    def encode(self, text) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For parts of an Arrow string array: first row, ids of all its texts in a row, where each text's begin (one
        more at the end), the bytes, and the texts' offsets in them."""
        for i, _, buf, offs in slabs(text):
            raw = buf.tobytes()
            starts = cut_points(buf, offs, added_places(raw, offs, self.added))
            ends = np.append(starts[1:], len(buf)) if len(starts) else starts
            names, at, back = np.unique(piece_hashes(buf, starts, ends), return_index=True, return_inverse=True)
            if len(self.known) + len(names) > max(KEPT_PIECES, len(names)):
                self.clear()
            keys = names.tolist()
            place = [self.known.get(k, -1) for k in keys]
            new = [j for j, p in enumerate(place) if p < 0]
            if new:
                a, b = starts[at[new]].tolist(), ends[at[new]].tolist()
                base = len(self.known)
                self._learn([keys[j] for j in new], [raw[x:y].decode("utf-8", "replace") for x, y in zip(a, b, strict=True)])
                for k, j in enumerate(new):
                    place[j] = base + k
            piece = np.array(place, np.int64)[back] if len(names) else np.zeros(0, np.int64)
            size = self.count[piece].astype(np.int64)
            ends_at = np.cumsum(size)
            total = int(ends_at[-1]) if len(ends_at) else 0
            take = np.arange(total) + np.repeat(self.first[piece] - (ends_at - size), size)
            per = np.concatenate(([0], ends_at))[np.searchsorted(starts, offs)]
            yield i, self.ids[take], per, buf, offs


def encoder(path: str | None = None) -> PieceEncoder:
    """This worker's encoder for a tokenizer file."""
    path = path or tokenizer_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
