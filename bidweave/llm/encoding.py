"""Token ids of whole texts with a public tokenizer, for Python steps over Arrow batches."""

from __future__ import annotations

import sys
import types
import zlib

import numpy as np

from bidweave.llm import words as W

CACHE_WORDS = 600_000  # words whose ids a Python worker keeps
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, with an end id.

    The tokenizer never joins text across white space: its pattern matches runs without white
    space, and no character composes with a white-space character before it. So a text's ids are those
    of its words. Ids of words are kept in a table of bounded size that a worker process shares between
    tasks; texts are split a segment at a time. New words made of letters are encoded many at once in
    one string: such a word is one run of the pattern and ends with the only id that marks a word's end.
    ASCII signs after letters are a run of their own, and A to Z encode like a to z.
    """

    def __init__(self, path: str, end_id: int | None = 2, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        kept = sys.modules.setdefault("_word_ids_of_this_worker", types.ModuleType("_word_ids_of_this_worker"))
        if getattr(kept, "path", None) != path:
            kept.tokenizer = Tokenizer.from_file(path)
            ends = np.zeros(kept.tokenizer.get_vocab_size(), bool)
            ends[[i for token, i in kept.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
            kept.path, kept.ids, kept.ends = path, {}, ends
        self.tokenizer, self.ids, self.ends, self.room = kept.tokenizer, kept.ids, kept.ends, cache_words
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def _one_by_one(self, found: list[bytes]) -> dict[bytes, bytes]:
        codes = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in found], add_special_tokens=False)
        return dict(zip(found, (np.array(c.ids, "<u4").tobytes() for c in codes)))

    def _letters(self, found: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words made of letters."""
        out = {}
        for low in range(0, len(found), 512):
            part = found[low:low + 512]
            codes = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[codes]) + 1
            if len(cuts) != len(part) or not len(cuts) or cuts[-1] != len(codes):
                out.update(self._one_by_one(part))  # a letter that falls apart when lower-cased
                continue
            raw, low_cut = codes.tobytes(), 0
            for word, cut in zip(part, (4 * cuts).tolist()):
                out[word] = raw[low_cut:cut]
                low_cut = cut
        return out

    def _encode(self, missing: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the table lacks."""
        plain, split = [], []
        cores, tails = {}, {}
        for word in missing:
            core = word.rstrip(_SIGNS)
            if core and core.decode("utf-8").isalpha():
                lower, tail = core.lower(), word[len(core):]
                cores[lower] = self.ids.get(lower)
                if tail:
                    tails[tail] = self.ids.get(tail)
                split.append((word, lower, tail))
            else:
                plain.append(word)
        cores.update(self._letters([w for w, v in cores.items() if v is None]))
        tails.update(self._one_by_one([w for w, v in tails.items() if v is None]))
        out = self._one_by_one(plain) if plain else {}
        out.update(cores)
        out.update(tails)
        for word, lower, tail in split:
            out[word] = cores[lower] + tails[tail] if tail else cores[lower]
        return out

    def rows(self, column):
        """Yield the id bytes of each row of a string column; null counts as empty."""
        data, offsets = W.utf8(column)
        for first, last in W.slices(offsets):
            texts, missing = [], set()
            for row in range(first, last):
                low, high, pieces = int(offsets[row]), int(offsets[row + 1]), []
                while low < high:
                    cut = W._cut(data[:high], low, W.SEGMENT)
                    found = data[low:cut].tobytes().split()
                    known = list(map(self.ids.get, found))
                    if None in known:
                        missing.update([w for w, v in zip(found, known) if v is None])
                        pieces.append((found, known))
                    else:
                        pieces.append((None, known))
                    low = cut
                texts.append(pieces)
            fresh = self._encode(missing) if missing else {}
            for pieces in texts:
                yield b"".join([b"".join(known if found is None else [fresh[w] if v is None else v for w, v in zip(found, known)])
                                for found, known in pieces]) + self.end
            for word, ids in fresh.items():
                if len(self.ids) >= self.room:
                    break
                self.ids[word] = ids


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
