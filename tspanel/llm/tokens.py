"""Token ids of whole texts with a public tokenizer, many texts at a time."""

from __future__ import annotations

import functools
import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa

from .text import _SPACE, ragged

#: Distinct pieces of text whose ids a worker keeps: about 150 bytes each, so 110 MB.
KEPT_PIECES = 750_000
#: Bytes of text that are encoded at a time; a slice takes about twenty times as much for a moment.
ENCODE_BYTES = 2 << 20
#: Pieces that go through the library as one text.
GROUP = 250

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[_SPACE] = 0x20
_FOLD[65:91] += 32
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

# How a tokenizer file has to split its texts so that pieces of a text can be encoded alone.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
END_OF_WORD = "</w>"
#: Words of one run of letters: a-z, and the letters from U+00C0 to U+00FF.
ONE_RUN = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"


def splits_into_words(file: str) -> bool:
    """Does the tokenizer ignore the case and keep its tokens within the words of ``WORD_PATTERN``?"""
    spec = json.loads(file)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    pattern = next((p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])), None)
    spaces = [s["pattern"].get("Regex") for s in steps if s["type"] == "Replace"]
    return (
        [s["type"] for s in steps] == NORMALIZERS and spaces == [r"\s+"] and pattern == WORD_PATTERN
        and spec["model"].get("end_of_word_suffix") == END_OF_WORD and not spec["model"].get("dropout")
    )


class Encoder:
    """Ids of texts by a tokenizer of the library.

    Where ``splits_into_words`` holds (``word_bpe_49k.json``), the texts of a slice are cut in pieces:
    words without the white space around them, which such tokenizers drop, cut again between an ASCII
    letter and punctuation. A text's ids are those of its pieces, one after the other. Each distinct
    piece goes through the library once per slice, and mostly once per worker. With another tokenizer,
    whole texts go through it. ``literal``: the names of special tokens in a text count as ordinary text.
    """

    def __init__(self, path: str, literal: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literal, self.mark = literal, "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.by_pieces = self.mark_id is not None and splits_into_words(self.tokenizer.to_str())
        self.one_run = re.compile(ONE_RUN).fullmatch
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.by_pieces:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(END_OF_WORD)]] = True
        self._forget()

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(uint32 ids of all rows, number of ids of each row)."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if not self.by_pieces:
            return self._whole(data, offsets)
        plain = b"<|" not in data.tobytes()  # else names of special tokens may be there, which have a case
        if plain:
            data = _FOLD[data]
        space = _SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = edge[:-1].copy()
        first[0] = True
        first[1:] |= space[:-1]
        if plain:
            first[1:] |= _PUNCTUATION[data[1:]] & _LETTER[data[:-1]]
        starts = np.flatnonzero(first & ~space)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        # a piece ends where white space, another piece or a row begins
        stops = np.flatnonzero(np.append(first | space, True) | edge)
        ends = stops[np.searchsorted(stops, starts, "right")]
        sizes = ends - starts
        bounds = np.append(0, np.cumsum(sizes)).astype(np.int64)
        packed = np.ascontiguousarray(data[~space])
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]
        ).dictionary_encode()
        number = self._numbers(column.dictionary.to_pylist())[np.asarray(column.indices)]
        lengths = self.lengths[number]
        ids = self.pool[ragged(self.begins[number], lengths)]
        total = np.append(0, np.cumsum(lengths))
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.tokenizer.encode_special_tokens = self.literal
        raw = data.tobytes()
        found = [self._ids(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def _ids(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, np.uint32)

    def _forget(self) -> None:
        self.pieces: dict[bytes, int] = {}
        self.pool, self.begins, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each piece among those kept; unknown ones are encoded first."""
        if len(self.pieces) + len(words) > KEPT_PIECES:
            self._forget()
        number = np.fromiter(map(self.pieces.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [words[i] for i in new]
            ids, lengths = self._encode(fresh)
            begins = len(self.pool) + np.cumsum(lengths) - lengths
            number[new] = len(self.lengths) + np.arange(len(new))
            self.pieces.update(zip(fresh, number[new].tolist()))
            self.pool = np.concatenate([self.pool, ids])
            self.begins = np.concatenate([self.begins, begins])
            self.lengths = np.concatenate([self.lengths, lengths])
        return number

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and the number of each, in groups; of a group only the ids are kept.

        Words of one run of letters go as one text, in which a word's last token tells its end. Others
        have a special token between them that no other text gives, and those that may hold the name
        of one go alone.
        """
        run = np.fromiter((self.one_run(p) is not None for p in pieces), bool, len(pieces))
        named = np.fromiter((b"<|" in p for p in pieces), bool, len(pieces))
        out, lengths = [], np.zeros(len(pieces), np.int64)
        order = [np.flatnonzero(run), np.flatnonzero(~run & ~named), np.flatnonzero(named)]
        self.tokenizer.encode_special_tokens = False
        for some, mark in ((order[0], " "), (order[1], self.mark)):
            for i in range(0, len(some), GROUP):
                group = some[i : i + GROUP]
                ids = self._ids(mark.join([pieces[j].decode() for j in group.tolist()]) + mark)
                last = np.flatnonzero(self.ends[ids] if mark == " " else ids == self.mark_id)
                lengths[group] = np.diff(last, prepend=-1) - (mark != " ")
                out.append(ids if mark == " " else ids[ids != self.mark_id])
        self.tokenizer.encode_special_tokens = self.literal
        for j in order[2].tolist():
            out.append(self._ids(pieces[j].decode()))
            lengths[j] = len(out[-1])
        # from the order of encoding to that of the pieces
        order = np.concatenate(order)
        ends = np.cumsum(lengths[order])
        begins = np.zeros(len(pieces), np.int64)
        begins[order] = ends - lengths[order]
        return np.concatenate([np.zeros(0, np.uint32), *out])[ragged(begins, lengths)], lengths


@functools.cache
def encoder(path: str, literal: bool) -> Encoder:
    """One per worker."""
    return Encoder(path, literal)
