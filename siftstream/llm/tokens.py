"""Token ids of whole texts at several times the speed of the tokenizers library, which makes every id.

Both vocabularies cut a text at white space before anything else looks at it, so the ids of a text are those of its
pieces in turn. The library encodes each distinct piece, and a bounded cache keeps the answers. Texts for which a cut
would not be certain (runs of white space, special tokens) go to the library whole.
"""

from __future__ import annotations

import codecs
import json
import os
import unicodedata

import numpy as np

from .files import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Memo:
    """Two generations of a cache: when the young one is full, it becomes the old one. Entries of ordinary words are counted,
    those of longer ones also by their characters."""

    LONG, MOST_LONG = 64, 8_000_000

    def __init__(self, most: int):
        self.most, self.young, self.old, self.long = most, {}, {}, 0

    def missing(self, keys: set) -> list:
        """Those keys that are in neither generation; the others are in the young one afterwards."""
        if self.long > self.MOST_LONG:
            self.old, self.young, self.long = {}, {}, 0
        elif len(self.young) > self.most:
            self.old, self.young = self.young, {}
        out, young, old = [], self.young, self.old
        for k in keys.difference(young):
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                young[k] = v
        self.long += sum(len(k) for k in out if len(k) > self.LONG)
        return out


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies give each byte: itself if it is printable Latin-1, else the next of
    those from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


BYTE_SIGNS = _byte_signs()
SIGNS_OF_BYTES = "".join(BYTE_SIGNS[b] for b in range(256))


def _bare(path: str):
    """A tokenizer of the library with the file's model and nothing before it."""
    from tokenizers import Tokenizer, models

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
    more = {"end_of_word_suffix": spec["end_of_word_suffix"]} if spec.get("end_of_word_suffix") else {}
    return Tokenizer(models.BPE(spec["vocab"], merges, cache_capacity=0, **more))


class PieceEncoder:
    """Encodes texts as Tokenizer.encode(text, add_special_tokens=False).ids, giving little-endian unsigned 32-bit ids.

    spaces_kept: whether a token may hold the space before a word (byte-level BPE); otherwise white space only separates.
    """

    #: Signs at the end of a word, which both vocabularies cut off behind a letter.
    SIGNS = ".,!?;:*%#$&|"
    #: Words that the byte-level model gets as one string, between signs that no token joins to anything.
    TOGETHER = 64

    def __init__(self, path: str, spaces_kept: bool, most: int = 400_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.spaces_kept, self.memo, self.tails = spaces_kept, Memo(most), {}
        self.words = _bare(path)
        # the sign of byte 0 stands in no word; where no other token holds it, no merge goes across it
        sign, vocab = BYTE_SIGNS[0], self.words.get_vocab()
        self.between = vocab[sign] if spaces_kept and [t for t in vocab if sign in t] == [sign] else None
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        assert not any(" " in s or "\n" in s for s in self.specials)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        """The first piece has nothing before it, one that begins with a line feed only that, any other a space."""
        if self.spaces_kept:
            return text.replace("\n", " \n").split(" ")
        return text.replace("\n", " ").split(" ")

    def sure(self, piece: str) -> bool:
        """Whether no white space stands at the ends of a piece, so that the library may look at it alone."""
        word = piece[1:] if piece[:1] == "\n" else piece
        return bool(word) and not word[0].isspace() and not word[-1].isspace()

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, each of which is one unit of the vocabulary's word splitting. The library's model
        alone encodes them, as nothing is left to split; what its normaliser does to such letters is done here."""
        if self.between is not None:
            return self.joined_ids(words)
        if self.spaces_kept:
            raw = [" " + w for w in words]
        else:
            raw = [unicodedata.normalize("NFC", w).lower() for w in words]
        got = self.words.encode([w.encode().decode("latin-1").translate(BYTE_SIGNS) for w in raw], is_pretokenized=True, add_special_tokens=False)
        ids = np.asarray(got.ids, "<u4").tobytes()
        ends = np.cumsum(np.bincount(np.asarray(got.word_ids), minlength=len(words))) * 4
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def joined_ids(self, words: list[str]) -> list[bytes]:
        """As word_ids, for byte-level vocabularies: the words of a string are merged apart, as each pair at its ends has the
        sign between."""
        lines = [codecs.charmap_decode((" " + "\0 ".join(words[k : k + self.TOGETHER]) + "\0").encode(), "strict", SIGNS_OF_BYTES)[0] for k in range(0, len(words), self.TOGETHER)]
        flat = np.concatenate([np.asarray(e.ids, "<u4") for e in self.words.encode_batch_fast(lines, add_special_tokens=False)])
        ends, ids = (np.flatnonzero(flat == self.between) * 4).tolist(), flat.tobytes()
        return [ids[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]

    def literal(self, found: set[str]) -> dict[str, bytes]:
        """A dict that holds the ids of short texts which occur again and again: signs at ends, first words."""
        if len(self.tails) > 100_000:
            self.tails = {}
        new = list(found.difference(self.tails))
        self.tails.update(zip(new, self.whole(new)))
        return self.tails

    def fill(self, miss: list[str]) -> None:
        """Puts pieces into the cache: the word before signs at the end, then those signs."""
        keep, cut, need, tails = self.spaces_kept, {}, set(), set()
        for m in miss:
            if keep and m.isalpha():
                need.add(m)
                continue
            word = m.rstrip(self.SIGNS)
            end = m[len(word) :]
            if not word or not word[-1].isalpha():
                word, end = m, ""
            key = word if keep or not word.isascii() else word.lower()
            if end or key != m:
                cut[m] = key, end
                tails.add(end)
            need.add(key)
        keys = self.memo.missing(need)
        found = dict.fromkeys(keys, b"")
        plain = [k for k in keys if k.isalpha() and (k.isascii() or max(k) < "\u0250" and "\u0130" not in k)]
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            found.update(zip(part, self.word_ids(part)))
        keys = [k for k in keys if not found[k]]
        for k in range(0, len(keys), 4096):
            part = keys[k : k + 4096]
            found.update(zip(part, self.whole([m if m[:1] == "\n" or not keep else " " + m for m in part])))
        young = self.memo.young
        young.update(found)
        end_ids = self.literal(tails)
        for m, (word, end) in cut.items():
            young[m] = young[word] + end_ids[end]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids. A few texts are taken at a time, so that what they look up stays in the processor's cache."""
        out = []
        for lo, hi in chunks(texts, 60_000):
            out += self._encode(texts[lo:hi])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [None if any(s in t for s in self.specials) else self.pieces(t) for t in texts]
        memo, keep = self.memo, self.spaces_kept
        need: set = set()
        for p in split:
            if p is not None:
                need.update(p[1:] if keep else p)
        miss = memo.missing(need)
        if keep:
            miss = [m for m in miss if m.isalpha() or self.sure(m)]
        if miss:
            self.fill(miss)
        get, out, left = memo.young.__getitem__, [], []
        heads = self.literal({p[0] for p in split if p is not None}) if keep else {}
        for n, p in enumerate(split):
            try:
                if p is None or keep and len(p) > 1 and p[0] and not self.sure(p[0]):
                    raise KeyError
                out.append(heads[p[0]] + b"".join(map(get, p[1:])) if keep else b"".join(map(get, p)))
            except KeyError:
                left.append(n)
                out.append(b"")
        for n, ids in zip(left, self.whole([texts[n] for n in left])):
            out[n] = ids
        return out


def encoder(path: str, spaces_kept: bool) -> PieceEncoder:
    """This process's encoder for a vocabulary file. Byte-level files see more different words, as case is kept."""
    return held(("pieces", path), lambda: PieceEncoder(path, spaces_kept, 800_000 if spaces_kept else 400_000))


def chunks(texts: list[str], chars: int = 1_000_000):
    """Ranges of a list whose texts have about so many characters together, one text at least."""
    at, size = 0, 0
    for n, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, n + 1
            at, size = n + 1, 0
    if at < len(texts):
        yield at, len(texts)
