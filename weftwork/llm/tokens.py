"""Token ids of many texts by a given tokenizer file, with the ids of repeated words kept."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

_TAIL = b".,!?;:|&%$#*"
#: Letters that the tokenizer's normal forms leave as they are.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: In Latin-1 bytes, what a text of plain words does not hold.
_OTHER = re.compile(rb"[^a-z\xdf-\xf6\xf8-\xff \n.,]|[.,][^ \n]")


def default_tokenizer() -> str:
    """The public word-level BPE file that the image offers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _merge_ranks(vocab: dict[str, int]):
    """The vocabulary as merge ranks over bytes, with the end of a word as byte 0. Its ids follow the order of its
    merges, the single symbols first, so the pair that makes the lowest id is the one that merges first."""
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printable)}
    ranks = {}
    for token, i in vocab.items():
        bare = token.removesuffix("</w>")
        if bare and all(c in byte_of for c in bare) and not (bare == token and byte_of[bare[0]] == 0):
            ranks[bytes(byte_of[c] for c in bare) + b"\0" * (bare != token)] = i
    ranks[b"\0"] = max(vocab.values()) + 1
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """encode(text) gives what the tokenizer gives without special tokens, as little-endian uint32 bytes.

    The tokenizer lower-cases, drops white space and joins nothing across it, so a text is the
    concatenation of its pieces between blanks and line ends; a piece is a stem that ends in a letter and
    a tail of ASCII punctuation, which the tokenizer also parts. At most `limit` pieces are kept.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.pieces: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends_word[i] = token.endswith("</w>")
        self.merges = _merge_ranks(vocab)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Of words of plain letters: each is one word to the tokenizer, so many are merged in one call, and the ids part after each end of a word."""
        out: list[bytes] = []
        for a in range(0, len(words), 5000):
            some = words[a : a + 5000]
            ids = np.array(self.merges.encode_ordinary("\0".join(some) + "\0"), "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            raw, starts = ids.tobytes(), [0, *(4 * ends[:-1]).tolist()]
            out += [raw[x:y] for x, y in zip(starts, (4 * ends).tolist(), strict=True)]
        return out

    def _learn(self, missing: set[bytes]) -> None:
        parts, plain, raw = {}, set(), set()
        for piece in missing:
            stem = piece.rstrip(_TAIL)
            word = stem.decode()
            if not _PLAIN.fullmatch(word):
                raw.add(piece)
                continue
            if len(stem) < len(piece):
                parts[piece] = stem, piece[len(stem) :]
                if parts[piece][1] not in self.pieces:
                    raw.add(parts[piece][1])
            if stem not in self.pieces:
                plain.add(word)
        for these, ids in ((list(plain), self._words), (list(raw), lambda x: self._ids([p.decode() for p in x]))):
            for piece, got in zip(these, ids(these), strict=True):
                self.pieces[piece.encode() if isinstance(piece, str) else piece] = got
        for piece, (stem, tail) in parts.items():
            self.pieces[piece] = self.pieces[stem] + self.pieces[tail]

    def _plain_text(self, text: str) -> bytes | None:
        """The ids of a text of plain letters, blanks, line ends and lone full stops and commas after which a blank or an end follows;
        None for any other. Every blank and the place before every mark ends a word."""
        try:
            low = text.lower()
            raw = low.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if _OTHER.search(raw):
            return None
        return self.merges.encode_to_numpy(low.replace(".", "\0.").replace(",", "\0,").replace(" ", "\0").replace("\n", "\0") + "\0").astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [self._plain_text(t) for t in texts]
        rest, split = [i for i, x in enumerate(out) if x is None], []
        for i in rest:
            raw = texts[i].encode()
            if b"<|" not in raw:  # else a special token's name might come to be
                raw = raw.lower()
            split.append(raw.replace(b"\n", b" ").split(b" "))
        if len(self.pieces) > self.limit:
            self.pieces = {}
        missing = {p for s in split for p in s if p not in self.pieces}
        if missing:
            self._learn(missing)
        get = self.pieces.__getitem__
        for i, s in zip(rest, split, strict=True):
            out[i] = b"".join(map(get, s))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a process and file."""
    return Encoder(path)
