"""Ids of whole texts, put together from the library's ids of their words, each word asked once per worker process.

A text is cut at single spaces. What a word may be worked out from alone depends on the tokenizer's normaliser and
pre-tokeniser, so there is one class per public tokenizer; both check these parts when they load and encode whole
texts by the library if they are others. Words that a rule does not cover go through the library as they are.
"""

from __future__ import annotations

import os
import string
from array import array

#: Words whose ids a worker process remembers (about 200 bytes each); beyond it the memory starts anew.
CACHED_WORDS = 800_000

#: Characters of a long text that are cut into words at a time.
SEGMENT = 1 << 20

_HELD: dict[tuple, "WordEncoder"] = {}


def encoder_of(kind: type, tokenizer: str) -> "WordEncoder":
    """The process's own encoder: Spark keeps Python workers for many tasks, so the words learnt by one serve the next."""
    key = (kind, tokenizer)
    if key not in _HELD:
        _HELD[key] = kind(tokenizer)
    return _HELD[key]


def segments(text: str):
    """The text in parts that single spaces, which are left out, part from each other."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = text.rfind(" ", at, at + SEGMENT)
        cut = cut if cut >= 0 else text.find(" ", at + SEGMENT)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


class WordEncoder(dict):
    """word -> its ids as bytes, None where a word's ids depend on its neighbours."""

    def __init__(self, tokenizer: str, cached: int = CACHED_WORDS):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        if not os.path.exists(tokenizer):
            import public_tokenizers
            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.id_bytes}"
        self.code = "H" if self.id_bytes == 2 else "I"
        self.cached = cached
        self.model = self.tokenizer.model
        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.stops: dict[str, bytes] = {}
        self.by_words = self.fits()

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def library(self, texts: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def mapped(self, text: str) -> str:
        """The letters that the model knows for the bytes of a text."""
        return self.byte_level.pre_tokenize_str(text)[0][0]

    def asked(self, mapped: str) -> bytes:
        return self.packed([t.id for t in self.model.tokenize(mapped)])

    def stop(self, marks: str) -> bytes:
        """Ids of a run of ASCII marks: one piece for both tokenizers' patterns."""
        ids = self.stops.get(marks)
        if ids is None:
            ids = self.stops[marks] = self.asked(marks)
        return ids

    def __missing__(self, word: str) -> bytes | None:
        ids = self.word(word)
        self[word] = ids
        return ids

    def fits(self) -> bool:
        raise NotImplementedError

    def word(self, word: str) -> bytes | None:
        raise NotImplementedError

    def by_word(self, text: str) -> bytes | None:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self.library(texts)
        if len(self) > self.cached:
            self.clear()
            self.stops.clear()
        out: list[bytes | None] = []
        for text in texts:
            try:
                out.append(None if any(x in text for x in self.added) else self.by_word(text))
            except TypeError:          # a None in the join: the text's words do not stand alone
                out.append(None)
        rest = [t for t, ids in zip(texts, out) if ids is None]
        whole = iter(self.library(rest) if rest else [])
        return [next(whole) if ids is None else ids for ids in out]


class ByteBpe(WordEncoder):
    """Byte-level BPE whose pattern gives a single space to the word behind it and never joins characters across one.

    So a text's ids are those of its first word, then those of " " + word. Letters, marks behind them and single
    line ends between such parts are pieces of their own; texts with other white space next to a space are encoded
    as they are.
    """

    def fits(self) -> bool:
        return self.tokenizer.normalizer is None and \
            "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)" == str(self.tokenizer.pre_tokenizer)

    def part(self, part: str, space: str) -> bytes | None:
        """Ids of space + letters + marks; None for any other part."""
        stem = part if part.isalpha() else part.rstrip(string.punctuation)
        if not stem.isalpha():
            return None
        if len(stem) == len(part):
            return self.asked(("Ġ" if space else "") + stem if stem.isascii() else self.mapped(space + stem))
        return (self[stem] if space else self.part(stem, "")) + self.stop(part[len(stem):])

    def word(self, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        parts = word.split("\n")
        found = [self.part(p, "" if i else " ") for i, p in enumerate(parts)]
        if None in found:
            return self.library([" " + word])[0]
        return self.stop("Ċ").join(found) if len(found) > 1 else found[0]

    def by_word(self, text: str) -> bytes | None:
        out = []
        for part in segments(text):
            words = part.split(" ")
            if not out:
                head = words.pop(0)
                if len(head) < len(text) and (not head or head[-1].isspace()):
                    return None
                out.append(self.library([head])[0])
            out.append(b"".join(map(self.__getitem__, words)))
        return b"".join(out)


class LowerWordBpe(WordEncoder):
    """BPE with word ends over lower-cased text without its white space: no piece crosses a space, so a text's ids are
    those of its words one after the other. NFC joins nothing with a space."""

    def fits(self) -> bool:
        return str(self.tokenizer.normalizer).startswith('Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), '
                                                         'content=" "), Lowercase()])') and \
            "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)" in str(self.tokenizer.pre_tokenizer)

    def part(self, part: str) -> bytes | None:
        stem = part if part.isalpha() else part.rstrip(string.punctuation)
        if not stem.isalpha():
            return self.stop(part) if not stem else None
        plain = stem.lower() if stem.isascii() else self.tokenizer.normalizer.normalize_str(stem)
        if not plain.isalpha():        # a letter that becomes several characters may join the marks behind it
            return None
        if len(stem) < len(part):
            return self[stem] + self.stop(part[len(stem):])
        return self.asked(plain if plain.isascii() else self.mapped(plain)) if plain == stem else self[plain]

    def word(self, word: str) -> bytes | None:
        found = [self.part(p) for p in word.split("\n") if p]
        return self.library([word])[0] if None in found else b"".join(found)

    def by_word(self, text: str) -> bytes | None:
        return b"".join(b"".join(map(self.__getitem__, part.split(" "))) for part in segments(text))
