"""Token ids of whole texts, by the tokenizers library, with a bounded memo of words.

With a byte-level vocabulary whose pre-tokenizer lets one space lead the next word, a single blank or line feed between two other
characters always ends a pre-token. So a text whose white space is only such blanks and line feeds can be encoded word by word, and each
distinct word once. Any other text goes through the library whole. Both give the library's own ids for the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _plain(text: str) -> bool:
    """Whether the text's white space is single blanks and line feeds between other characters. (Other white space isn't printable.)"""
    flat = text.replace("\n", " ")
    return flat.isprintable() and "  " not in flat and flat[0] != " " != flat[-1]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """encode_all(texts) -> ids as bytes, little-endian unsigned 32-bit integers. At most `most` words are remembered at once, with the blank or
    the line feed that leads them; `chunk` characters of text are split at once."""

    def __init__(self, path: str, most: int = 1_200_000, chunk: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.most, self.chunk = most, chunk
        self.memo: dict[str, bytes] = {}
        size = self.tok.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.feed = self.whole("\n")
        #: Ids of the tokens that start with a blank, and those that are a line feed.
        names = [self.tok.id_to_token(k) or "" for k in range(size)]
        self.leads = {" ": np.array([x.startswith("\u0120") for x in names]), "\n": np.array([x == "\u010a" for x in names])}
        self.by_word = self._splits()

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _splits(self) -> bool:
        """Whether this vocabulary lets texts be encoded word by word, told from a probe."""
        probe = "Ab c'd, 12.5 x\nYe\u00e9 (z)\n'll \u4e2d a"
        parts = ["Ab", " c'd,", " 12.5", " x", "\n", "Ye\u00e9", " (z)", "\n", "'ll", " \u4e2d", " a"]
        return len(self.feed) == 4 and b"".join(map(self.whole, parts)) == self.whole(probe)

    def learn(self, words: set[str], lead: str) -> None:
        """Put words into the memo, many in one call: each starts with the only `lead` in it, and so at a token that starts with one."""
        new = list(words)
        own = [" " + w for w in new] if lead == " " else new
        for k in range(0, len(new), 4000):
            part = new[k : k + 4000]
            ids = np.array(self.tok.encode("".join(own[k : k + 4000]), add_special_tokens=False).ids)
            data, size = ids.astype(self.kind).tobytes(), int(self.kind[-1])
            ends = [*(size * np.flatnonzero(self.leads[lead][ids])).tolist(), size * len(ids)]
            if len(ends) != len(part) + 1:
                raise ValueError("the vocabulary does not start each word at a token of its own")
            self.memo.update(zip(part, map(data.__getitem__, map(slice, ends, ends[1:])), strict=True))

    def _some(self, texts: list[str | None]) -> Iterator[bytes]:
        if len(self.memo) > self.most:
            self.memo.clear()
        # words after a line feed keep it; other words but the first had a blank before them
        split = [t.replace("\n", " \n").split(" ") if t and self.by_word and _plain(t) else None for t in texts]
        firsts = [self.whole(x.pop(0)) if x else b"" for x in split]
        words: set[str] = set()
        words.update(*filter(None, split))
        words = words.difference(self.memo)  # goes through words, not through the memo
        if words:
            fed = {w for w in words if w[0] == "\n"}
            self.learn(fed, "\n")
            self.learn(words - fed, " ")
        get = self.memo.__getitem__
        for t, first, x in zip(texts, firsts, split, strict=True):
            if x is None:
                yield self.whole(t) if t else b""
            else:
                rest = b"".join(map(get, x))
                yield first + (np.frombuffer(rest, self.kind).astype("<u4").tobytes() if self.kind == "<u2" else rest)

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text (null: of the empty text), in order."""
        at = 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and n < self.chunk:
                n += len(texts[end] or "")
                end += 1
            yield from self._some(texts[at:end])
            at = end


_encoders: dict[str, Encoder] = {}


def forget() -> None:
    """Let go of the words that encoders remember: Python workers go on to tasks of other kinds."""
    for e in _encoders.values():
        e.memo.clear()


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
