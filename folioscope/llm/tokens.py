"""Token ids by the tokenizers library, at the speed of a dictionary.

Encoding whole texts spends most of its time on repeated words. A text is cut only where the tokenizer itself always
cuts (before a lone space, around a lone line feed), every distinct piece is encoded once by the library, and a text is
the concatenation of its pieces. Words and pieces share one cache: a piece encodes as the word that looks like it. The
cache is bounded: when it is full its older half goes, which costs time, never a result. Texts are cut at the strings of the vocabulary's added tokens first, as the library does; each gives its one id.
"""

import re
import struct

import numpy as np

#: The splitting patterns of the two vocabularies, as their files state them, with the letters and numbers
#: of PLAIN spelled for `re`.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"

#: Words, and as many pieces, of one generation of the cache; two generations are held per Python worker, at about 200
#: bytes an entry.
CACHE_ENTRIES = 200_000

#: Pieces of these characters (no numbers but the digits) are split here; every other piece goes to the library whole.
PLAIN = re.compile("[\n\t\r -~¡-±´-¸º»¿-ɏ]+")
LONG = 200
ODD_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters():
    """The printable stand-in of each byte: printable Latin-1 stays, the others follow from code point 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {**{b: chr(b) for b in keep}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Cache:
    """Two generations: entries not asked for while the younger one fills are forgotten."""

    def __init__(self, entries):
        self.entries, self.young, self.old = entries, {}, {}

    def make_room(self):
        if len(self.young) >= self.entries:
            self.young, self.old = {}, self.young


class Encoder:
    """ids(text) gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path, entries=CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spaced = self.library.normalizer is None
        self.pattern = re.compile(BYTE_PATTERN if self.spaced else WORD_PATTERN)
        self.letters = byte_letters()
        self.cache = Cache(2 * entries)
        self.packed = [struct.pack("<I", i) for i in range(self.library.get_vocab_size())]
        added = self.library.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that are not matched as plain strings are not supported")
        self.added = {t.content: struct.pack("<I", i) for i, t in added.items()}
        self.at_added = re.compile("({})".format("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))))

    def chunks(self, text):
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        odd = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\x01" in text or any(c in text for c in ODD_SPACES)
        if odd:
            return LONE_SPACE.split(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def piece(self, piece):
        got = self.cache.old.get(piece)
        if got is None:
            if piece.isascii() and piece.isprintable():
                shown = piece.replace(" ", self.letters[32])
            else:
                shown = "".join(map(self.letters.__getitem__, piece.encode()))
            packed = self.packed
            got = b"".join([packed[t.id] for t in self.model.tokenize(shown)])
        return got

    def parts(self, chunk):
        """As the pattern splits it; letters, and letters before punctuation, need no search."""
        core = chunk.rstrip(PUNCTUATION)
        if core[1:].isalpha() and (core[0] == " " or core[0].isalpha()):
            return (core, chunk[len(core) :]) if len(core) < len(chunk) else (core,)
        return self.pattern.findall(chunk)

    def word(self, chunk):
        if len(chunk) > LONG or not (chunk.isascii() and chunk.isprintable() or PLAIN.fullmatch(chunk)):
            return np.array(self.library.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.spaced and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self.piece(chunk)
        parts = self.parts(chunk if self.spaced else chunk.lower())
        known, out = self.cache.young, []
        for p in parts:
            got = known.get(p)
            if got is None:
                got = known[p] = self.piece(p)
            out.append(got)
        return out[0] if len(out) == 1 else b"".join(out)

    def ids(self, text):
        if not any(a in text for a in self.added):
            return self.plain_ids(text)
        return b"".join(self.added[part] if k % 2 else self.plain_ids(part) for k, part in enumerate(self.at_added.split(text)) if part)

    def plain_ids(self, text):
        """Of a text without added tokens."""
        chunks = self.chunks(text)
        self.cache.make_room()
        known, old = self.cache.young, self.cache.old
        out, long = list(map(known.get, chunks)), []
        for at in [k for k, ids in enumerate(out) if ids is None]:
            c = chunks[at]
            got = known.get(c)
            if got is None:
                got = old.get(c)
                known[c] = got = self.word(c) if got is None else got
                if len(c) > LONG:
                    long.append(c)
            out[at] = got
        for c in long:
            del known[c]
        return b"".join(out)


_ENCODERS = {}


def encoder(path, entries=CACHE_ENTRIES) -> Encoder:
    """One per Python worker, reused by its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, entries)
    return _ENCODERS[path]


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)
