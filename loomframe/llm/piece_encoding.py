"""SentencePiece BPE encoding and decoding through a table of each prefix's last token.

Merging the best pair again and again gives a text one encoding, and cutting that encoding after any token gives the
encoding of what is left of the cut. So every prefix of a text that ends where some token ends has one last token; a
token can stand last exactly if it is compatible with the last token of the prefix before it, that is, if the two
tokens' joint text is encoded as these two. Tokens that end at a place come from an Aho-Corasick automaton; the table is
filled from left to right and the ids are read off backwards.

Texts are cut first where no token of the vocabulary can reach across: before a space that follows something else, and
between two characters that no token has side by side, such as one outside the vocabulary and any other. What lies
between is encoded once a task and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from copy import copy
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import per_document, table

SPACE_MARK = "▁"
_PARTS = re.compile(r" +[^ ]*")
#: Encoded words, encoded chunks and tested pairs that a task remembers, of each; beyond that it forgets those it met least lately.
REMEMBERED = 600_000


def merge_encode(text: str, rank: dict[str, float]) -> list[str]:
    """Plain merging of the best-ranked adjacent pair, leftmost first: defines what the table computes."""
    parts = list(text)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(text) and (r := rank.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, joint = heapq.heappop(heap)
        j = after[i] if parts[i] else len(text)
        if j >= len(text) or parts[i] + parts[j] != joint:
            continue
        parts[i], parts[j] = joint, ""
        after[i] = k = after[j]
        if k < len(text):
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in parts if p]


class Memory:
    """Values by key, REMEMBERED at most: when half of that many came or came back, all that didn't are forgotten."""

    def __init__(self) -> None:
        self.new: dict = {}
        self.old: dict = {}

    def find(self, key):
        """The value of a key that isn't among the new ones, if it is remembered."""
        return None if (value := self.old.get(key)) is None else self.put(key, value)

    def put(self, key, value):
        if len(self.new) >= REMEMBERED // 2:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


class PieceTable:
    """Encoder and decoder for one model file of the byte-fallback BPE kind."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)  # read for its vocabulary and scores alone
        n = sp.vocab_size()
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown = {i for i in range(n) if sp.is_unknown(i)}
        self.unknown_id = sp.unk_id()
        self.ids = {self.pieces[i]: i for i in range(n) if not special[i]}
        for piece in self.ids:
            if SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError("tokens with a space after other characters aren't supported")
        self.runs = {p: self.ids[p] for p in self.ids if len(p) > 1 and not p.strip(SPACE_MARK)}
        scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        words = {p: -s for p, s in scores.items() if len(p) > 1 and p not in self.runs}
        if self.runs and max(scores[p] for p in self.runs) >= -max(words.values(), default=0):
            raise ValueError("runs of spaces are expected to merge after everything else")
        self.rank, self.run_rank = words, {p: -scores[p] for p in self.runs}
        self.plain = {i: p.replace(SPACE_MARK, " ") for p, i in self.ids.items()}
        #: Only a token that its own text is encoded as can occur.
        self.tokens = {p: i for p, i in self.ids.items() if p not in self.runs and (len(p) == 1 or merge_encode(p, words) == [p])}
        self.id_texts, self.plain_texts = {p: str(i) for p, i in self.tokens.items()}, {p: self.plain[i] for p, i in self.tokens.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.tokens:
            self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        if any(len(c) == 1 and c not in self.ids for p in self.ids for c in p):
            raise ValueError("every character of a token is expected to be a token")
        behind: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                if a != SPACE_MARK:
                    behind.setdefault(a, set()).add(b)
        alike: dict[str, str] = {}  # characters by those that may follow
        for a, found in sorted(behind.items()):
            follow = "".join(sorted(found))
            alike[follow] = alike.get(follow, "") + a
        linked = "|".join(f"[{re.escape(a)}](?=[{re.escape(b)}])" for b, a in sorted(alike.items(), key=lambda x: -len(x[0])))
        #: Spaces with the characters behind them, as far as tokens have each two side by side.
        self.chunks = re.compile(f" *(?:{linked or '(?!)'})*[^ ]| +")
        self.compatible, self.encoded, self.cut = Memory(), Memory(), Memory()
        self.spaces = lru_cache(maxsize=4096)(self._spaces)

    def for_task(self) -> PieceTable:
        """The same table, which remembers for itself what it encodes; that goes when the task lets go of it."""
        own = copy(self)
        own.compatible, own.encoded, own.cut = Memory(), Memory(), Memory()
        return own

    def _pair(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are when they meet."""
        known = self.compatible.find((left, right))
        return self.compatible.put((left, right), merge_encode(left + right, self.rank) == [left, right]) if known is None else known

    def _table(self, text: str) -> list[str]:
        """The tokens of a text of known characters without runs of spaces."""
        last: list[str | None] = [None] * len(text)
        tested = self.compatible.new.get
        for end, (size, token) in self.automaton.iter(text):
            # all tokens that end here come one after another, the longest first
            if last[end] is None:
                if size > end:
                    last[end] = token
                elif (before := last[end - size]) is not None:
                    fits = tested((before, token))
                    if fits or fits is None and self._pair(before, token):
                        last[end] = token
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _spaces(self, n: int) -> tuple[int, ...]:
        """Ids of ``n`` spaces that no word's token has taken in; these merge among themselves, after all else."""
        return tuple(self.ids[p] for p in merge_encode(SPACE_MARK * n, self.run_rank))

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk: spaces and then known characters, either may be missing, or one unknown character."""
        body = chunk.lstrip(SPACE_MARK)
        n = len(chunk) - len(body)
        if not body:
            return list(self.spaces(n))
        if len(body) == 1 and body not in self.ids:
            data = body.encode("utf-8")
            fallback = [self.byte_ids[b] for b in data] if self.byte_ids else [self.unknown_id]
            return [*self.spaces(n), *fallback] if n else fallback
        tokens = self._table(SPACE_MARK + body if n else body)
        if n and tokens[0] != SPACE_MARK:
            n -= 1
        elif n:
            tokens = tokens[1:]
        ids = [self.tokens[t] for t in tokens]
        return [*self.spaces(n), *ids] if n else ids

    def word(self, word: str) -> tuple[str, str]:
        """A space and ``word`` behind it, which no token reaches out of: the ids, comma-joined, and the text they stand for."""
        if (found := self.encoded.find(word)) is not None:
            return found
        known, cut = self.cut.new.get, self.chunks.findall(" " + word)
        found = [known(c) or self._cut(c) for c in cut]
        if len(found) == 1:
            found = found[0]
        else:
            ids, plain = zip(*found)
            found = ",".join(ids), "".join(plain)
        # long ones and those of several chunks don't come back
        return self.encoded.put(word, found) if len(word) <= 64 and len(cut) <= 3 else found

    def _cut(self, chunk: str) -> tuple[str, str]:
        """The same of one chunk."""
        if (found := self.cut.find(chunk)) is not None:
            return found
        marked = chunk.replace(" ", SPACE_MARK)
        if marked[-1] in self.ids and marked[1:2] != SPACE_MARK:
            tokens = self._table(marked)
            ids, plain = ",".join([self.id_texts[t] for t in tokens]), "".join([self.plain_texts[t] for t in tokens])
        else:
            numbers = self._chunk(marked)
            ids, plain = ",".join(map(str, numbers)), self._plain(numbers)
        found = ids, chunk if plain == chunk else plain  # one string in memory
        return self.cut.put(chunk, found) if len(chunk) <= 64 else found

    def joined(self, text: str) -> tuple[str, str]:
        """The ids of a text, comma-joined, and the text that they are decoded to."""
        if not text:
            return "", ""
        text = text.replace(SPACE_MARK, " ")  # to the model, the mark in a text is a space
        parts = text.split(" ")  # the model puts one space before the text, so each part has one
        if "" in parts:  # spaces in a row belong to the word behind them
            parts = [p[1:] for p in _PARTS.findall(" " + text)]
        known, word = self.encoded.new.get, self.word
        ids, plain = zip(*[known(w) or word(w) for w in parts])
        # a word's ids stand for the same text wherever the word is, but for the first space of all
        return ",".join(ids), "".join(plain)[1:]

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.joined(text)[0].split(","))) if text else []

    def _plain(self, ids: list[int]) -> str:
        """The text of ids that aren't the first ones of a text."""
        try:
            return "".join([self.plain[i] for i in ids])
        except KeyError:
            return self.decode(ids, lead=False)

    def decode(self, ids: list[int], lead: bool = True) -> str:
        """The text of ``ids``: byte tokens joined to UTF-8, a wrong byte as U+FFFD; with ``lead``, without the first space."""
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            nonlocal lead
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
                lead = False

        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            flush()
            if i in self.silent:
                continue
            piece = " ⁇ " if i in self.unknown else self.pieces[i].replace(SPACE_MARK, " ")
            if lead:
                piece = piece[1:] if piece.startswith(" ") and i not in self.unknown else piece
                lead = False
            out.append(piece)
        flush()
        return "".join(out)


def _utf8(data: bytes) -> str:
    """UTF-8 to text; each byte that begins no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


_TABLES: dict[str, PieceTable] = {}


def load(model_file: str) -> PieceTable:
    """One table a process and model. ``encode`` takes it with a memory for each task, so that idle processes hold the table alone."""
    if model_file not in _TABLES:
        _TABLES[model_file] = PieceTable(model_file)
    return _TABLES[model_file]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: its id, ``ids`` (token ids), ``n_tokens`` and, ``with_text``, the ``decoded`` text.

    Null text counts as empty and gives no ids. Texts of any length are encoded whole, in time and memory proportional
    to their length. Repeated rows each give a row; other columns are never read. ``model_file`` has to lie where every
    executor finds it.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def start():
        pieces = load(model_file).for_task()

        def work(ids, texts):
            both = [pieces.joined(t or "") for t in texts]
            coded = [np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for x, _ in both]
            out = [ids, coded, [len(c) for c in coded]]
            return [*out, [plain for _, plain in both]] if with_text else out

        return work

    return per_document(docs, start, f"`{id_col}` {kind}, ids array<int>, n_tokens bigint" + ", decoded string" * with_text, id_col, text_col)


def decode(coded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``coded``: its id and the ``decoded`` text of its ids; null ids give an empty text."""
    from pyspark.sql import functions as F

    kind = coded.select(id_col).schema[0].dataType.simpleString()

    def start():
        pieces = load(model_file).for_task()

        def work(keys, texts):
            return keys, [pieces.decode([int(x) for x in t.split(",")]) if t else "" for t in texts]

        return work

    joined = coded.select(F.col(id_col), F.array_join(ids_col, ",").alias("text"))
    return per_document(joined, start, f"`{id_col}` {kind}, decoded string", id_col, "text")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` with the ids and the text given as SHA-256: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def start():
        pieces = load(model_file)  # remembers from task to task, which spares CPU time

        def one(text):
            ids, plain = pieces.joined(text or "")
            return ids.count(",") + bool(ids), _sha(ids), _sha(plain)

        def work(ids, texts):
            out = [one(t) for t in texts]
            return ids, [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]

        return work

    return per_document(docs, start, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
