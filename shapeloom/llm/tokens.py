"""Exact tokenizer results from a cache of words.

Both public JSON tokenizers split a text before any merge, so a text's ids are those of its pieces, one after another.
Pieces repeat, so each worker keeps what it has encoded, up to CACHE_ENTRIES pieces of at most CACHE_PIECE bytes.
Plain words that the cache lacks go through a merge table built from the tokenizer's own file; it is used only if it
agrees with the library on a probe of the vocabulary, and every other piece goes through the library itself.
"""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_ENTRIES = 400_000
CACHE_PIECE = 120
_TWO_SPACES = re.compile(r"\s\s")
#: Before a space that follows a visible character: such a place always parts two pieces.
_SPACE_RUN = re.compile(r"(?<=[!-~])(?= )")
#: Letters that are one code point in any normal form and in lower case, then marks other than the apostrophe.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Bytes of texts that lower case and str.split() treat as the tokenizer does: ASCII without \x1c-\x1f, and letters of U+00C0-U+00FF.
_EASY = bytes(b for b in range(256) if b not in range(0x1C, 0x20) and (b < 0xC0 or b == 0xC3))
_LOADED: dict = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_symbol() -> dict[str, int]:
    """The byte behind each printable symbol of a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Merges:
    """Byte-pair merges of one piece. A word end is a byte that UTF-8 never has, joined to the last byte first."""

    END = b"\xff"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tail = self.END if self.suffix else b""
        byte = _byte_of_symbol()

        def raw(token: str) -> bytes:
            if self.suffix and token.endswith(self.suffix):
                return bytes(byte[c] for c in token[: -len(self.suffix)]) + self.END
            return bytes(byte[c] for c in token)

        ranks = {bytes([b]): b for b in range(256)}
        if self.tail:
            ranks |= {bytes([b]) + self.END: 256 + b for b in range(255)}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(left + right), len(ranks) + 1)
        ids = {}
        for token, i in model["vocab"].items():
            if all(c in byte for c in token.removesuffix(self.suffix)):
                ids[raw(token)] = i
        self.id_of_rank = {rank: ids[token] for token, rank in ranks.items() if token in ids}
        self._ranks = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def ids(self, piece: bytes) -> list[int]:
        return [self.id_of_rank[r] for r in self._ranks(piece + self.tail)]


def _probe(tokenizer, path: str, spaced: bool) -> _Merges | None:
    """The merge table, if it gives the library's ids for words of the vocabulary and for joined ones."""
    try:
        table = _Merges(path)
        words = sorted(w for w in (t.removesuffix(table.suffix) for t in tokenizer.get_vocab()) if re.fullmatch("[a-z]{3,}", w))[::29]
        words += [a + b for a, b in zip(words, words[7:], strict=False)]
        words += [" " + w for w in words] if spaced else []
        wanted = tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return table if all(table.ids(w.encode()) == e.ids for w, e in zip(words, wanted, strict=True)) else None
    except (ImportError, KeyError, TypeError, ValueError, AttributeError):
        return None  # another kind of tokenizer: the library does it all


class _Cached:
    """Two generations of cached pieces: when the younger one is full it becomes the older one."""

    spaced = False

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = _probe(self.tokenizer, path, self.spaced)
        self.cache: dict = {}
        self.older: dict = {}

    def look_up(self, pieces: list) -> list:
        """The value of each piece, encoded now where the cache lacks it."""
        got = list(map(self.cache.get, pieces))
        if None not in got:
            return got
        cache, older = self.cache, self.older
        new = {p for p, v in zip(pieces, got, strict=True) if v is None}
        values, missing = {}, []
        for p in new:
            v = older.get(p)
            if v is None:
                missing.append(p)
            else:
                values[p] = v
        if missing:
            self.encode(missing, values)
        got = [values[p] if v is None else v for p, v in zip(pieces, got, strict=True)]
        if len(cache) + len(values) > CACHE_ENTRIES:
            self.older, self.cache = cache, {}
        self.cache.update((p, v) for p, v in values.items() if len(p) <= CACHE_PIECE)
        return got

    def encode(self, pieces: list, values: dict) -> None:
        rest, known, plain = [], self.cache, _PLAIN.fullmatch
        for p in pieces:
            m = plain(p) if self.merges else None
            if m is None:
                rest.append(p)
                continue
            word, marks = m.groups()
            v = known.get(word)
            if v is None:
                v = values.get(word)
                if v is None:
                    v = values[word] = self.merged(word)
            if marks:
                w = known.get(marks)
                if w is None:
                    w = values.get(marks)
                    if w is None:
                        w = values[marks] = self.merged(marks)
                v = values[p] = v + w
        if rest:
            coded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            values.update(zip(rest, [self.of_ids(e.ids) for e in coded], strict=True))


class WordIds(_Cached):
    """Ids of a lower-casing tokenizer that drops white space, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__(path)
        if self.merges:
            last = max(self.merges.id_of_rank)
            self.word_of_rank = [self.merges.id_of_rank.get(r, 0).to_bytes(4, "little") for r in range(last + 1)]
            self.ranks, self.tail = self.merges._ranks, self.merges.tail

    def of_ids(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def merged(self, piece: str) -> bytes:
        table = self.word_of_rank
        return b"".join([table[r] for r in self.ranks(piece.lower().encode() + self.tail)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        coded = text.encode()
        if coded.translate(None, _EASY) or b"<|" in coded:
            words = [w.decode() for w in coded.split()]
        else:
            words = text.lower().split()
        return b"".join(self.look_up(words))


class ByteCounts(_Cached):
    """Numbers of tokens of a byte-level tokenizer that keeps white space."""

    spaced = True

    def of_ids(self, ids: list[int]) -> int:
        return len(ids)

    def merged(self, piece: str) -> int:
        return len(self.merges._ranks(piece.encode() + self.merges.tail))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if _TWO_SPACES.search(text):
            return sum(self.look_up(_SPACE_RUN.split(text)))
        lines = text.split("\n")
        pieces = [p for line in lines if line for p in _with_space(line)]
        return sum(self.look_up(pieces)) + (len(lines) - 1) * self.look_up(["\n"])[0]


def _with_space(line: str) -> list[str]:
    first, *rest = line.split(" ")
    return ([first] if first else []) + [" " + w for w in rest]


def _loaded(kind: type, path: str):
    key = (kind.__name__, path)
    if key not in _LOADED:
        _LOADED[key] = kind(path)
    return _LOADED[key]


def word_ids(path: str) -> WordIds:
    return _loaded(WordIds, path)


def byte_counts(path: str) -> ByteCounts:
    return _loaded(ByteCounts, path)
