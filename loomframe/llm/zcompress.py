"""Compressed sizes of texts under zstandard raw-content dictionaries."""

from __future__ import annotations

import random

import zstandard

#: Stands at the end of every dictionary and before every text: even a text of one word then makes a compressed block,
#: whose size shows what the dictionary saved, where zstandard would else store so few bytes as they are.
PAD = bytes(range(0x80, 0xC0))

_OTHERS = bytes(c for c in range(128) if not chr(c).isalpha())
_TO_SPACE = bytes.maketrans(_OTHERS, b" " * len(_OTHERS))


def letters_only(text: str) -> bytes:
    """Lower case in UTF-8, with one space for each run of ASCII characters that aren't letters."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split())


def build_content(texts: list[bytes], limit: int, seed: int = 7) -> bytes:
    """At most ``limit`` bytes of dictionary content: of every text a piece at a random place, all texts sharing the bytes
    alike; what short ones leave over goes to those after them, so the shortest come first."""
    rnd, out, left = random.Random(seed), [], limit
    for n, text in enumerate(sorted(texts, key=lambda t: (len(t), t))):
        share = left // (len(texts) - n) - 1
        if share <= 0:
            continue
        if len(text) > share:
            at = rnd.randrange(len(text) - share + 1)
            text = text[at : at + share]
        out.append(text)
        left -= len(text) + 1
    rnd.shuffle(out)
    return b"\n".join(out)


class Sizer:
    """The size of a text under each of several dictionaries. The whole text counts, block by block.

    A block is compressed by itself, so that long texts lean on the dictionary as short ones do and not on their own
    beginning; the work and the memory are in proportion to the text.
    """

    def __init__(self, contents: list[bytes], block: int, search_log: int = 2):
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=search_log, window_log=17, hash_log=16, chain_log=16,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        self.block, self.parts = block, []
        for content in contents:
            d = zstandard.ZstdCompressionDict(content + PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.parts.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, data: bytes) -> list[int]:
        if not data:
            return [0] * len(self.parts)
        step = self.block
        blocks = [PAD + data[i : i + step] for i in range(0, len(data), step)]
        return [sum([len(c.compress(b)) for b in blocks]) for c in self.parts]
