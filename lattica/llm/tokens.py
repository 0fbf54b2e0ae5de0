"""Token ids by the tokenizers library, with a cache of what its model returned for the words of a text.

The byte-level pre-tokeniser always cuts before a blank that a word follows, and the model encodes what lies between cuts
alone, so a text's ids are the ids of its blank-led words in a row. Words repeat, so most come from the cache; the
others are cut by the tokenizer's pattern and their unknown parts go to the library's model. Texts with other blanks, or
with characters that Unicode versions class differently, go to the library whole.

Texts of ordinary length are cut and put together again in Arrow's arrays: Python sees the different words of a slice only.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import filterfalse, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import resident

#: Characters but those that all Unicode versions of the last years class alike. Like the next, for Python's re and for RE2.
UNSURE = "[^\x01-\u0557\u0600-\u06ff\u0900-\u097f\u1e00-\u206f\u20a0-\u20bf\u2190-\u2bff\u3000-\u9fff\uac00-\ud7a3]"
#: A blank after which no word starts (another of Python's blanks or the end does): there the text is not cut at blanks alone.
ODD_BLANK = " (?:[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|$)"


#: Words looked up together; texts of more bytes are encoded alone.
GROUP = 50_000
LONG = 1 << 20
#: New words that the library's model takes at once.
AT_ONCE = 4096
#: Bytes of words and of parts that a cache may hold, about, and what an entry takes besides its letters and ids.
WORD_BYTES, PART_BYTES, ENTRY = 128 << 20, 16 << 20, 140


class Recent:
    """Values by text in about `budget` bytes: a young and an old generation; a full young one becomes the old one, and what is asked
    for again moves up. Between two calls of turn() nothing that was put goes."""

    def __init__(self, budget: int):
        self.most, self.size = budget // 2, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if self.size > self.most:
            self.old = self.young if self.size < 2 * self.most else {}
            self.young, self.size = {}, 0

    def missing(self, keys) -> set[str]:
        """The keys that neither generation has; keys that only the old one has move up."""
        new, old = set(filterfalse(self.young.__contains__, keys)), self.old
        if new and old:
            up = [k for k in new if k in old]
            self.put(up, [old[k] for k in up])
            new.difference_update(up)
        return new

    def put(self, keys, values) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.size += ENTRY * len(keys) + 3 * sum(map(len, keys))


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + n) for n, b in enumerate(others)}}


def _strings(x: pa.Array) -> list[str]:
    """to_pylist(), which goes value by value, but sooner."""
    return x.to_numpy(zero_copy_only=False).tolist()


class WordCache:
    """Token ids of texts from those of their words, for tokenizers that cut texts by a byte-level pattern and encode parts alone.

    Words and parts used of late are kept, of bounded bytes.
    """

    #: What a text that is not cut at blanks holds.
    odd = ODD_BLANK

    def __init__(self, pattern: str, word_bytes: int = WORD_BYTES, part_bytes: int = PART_BYTES):
        self.find, self.uncut = regex.compile(pattern).findall, re.compile(self.odd).search
        self.words = Recent(word_bytes)  # by what follows the blank
        self.parts = Recent(part_bytes)

    def new_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of parts of the pattern, each alone."""
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        """The ids of a text that is not cut at blanks."""
        raise NotImplementedError

    def _learn(self, words: set[str]) -> None:
        """Cache the ids of blanks followed by these words.

        Letters alone are one part with their blank; what single other character follows them is the next part. Only
        other words need the pattern.
        """
        known, letters, ended, other = self.words.young, set(), [], []
        for word in words:
            if word.isalpha():
                letters.add(word)
            elif (start := word[:-1]).isalpha():
                ended.append((word, start, word[-1]))
            else:
                other.append(word)
        letters |= self.words.missing({start for _, start, _ in ended} - letters)
        new = list(letters)
        self.words.put(new, self.new_parts([" " + x for x in new]))
        if ended:
            parts = self._parts({end for _, _, end in ended})
            self.words.put([word for word, _, _ in ended], [known[start] + parts[end] for _, start, end in ended])
        if not other:
            return
        cut = self.find(" " + " ".join(other))  # parts that begin with a blank begin a word
        parts = self._parts(set(cut))
        found: list[bytes] = []
        for part in cut:
            if part[0] == " ":
                found.append(parts[part])
            else:
                found[-1] += parts[part]
        self.words.put(other, found)

    def _parts(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of these parts and others."""
        self.parts.turn()
        new = list(self.parts.missing(parts))
        self.parts.put(new, self.new_parts(new))
        return self.parts.young

    def _ready(self, words: list[str]) -> list[bytes]:
        """Ids of these words."""
        self.words.turn()
        new = self.words.missing(words)
        if new:
            self._learn(new)
        return list(map(self.words.young.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.uncut(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        out = [self.whole(first)] if first else []
        for at in range(0, len(rest), GROUP):  # the cache may start anew between slices
            out += self._ready(rest[at : at + GROUP])
        return b"".join(out)

    def encode_all(self, column: pa.Array) -> list[bytes]:
        """encode() of each text of a column; null counts as empty. Texts of ordinary length are looked up together."""
        texts = pc.fill_null(column, "")
        alone = pc.or_(pc.match_substring_regex(texts, self.odd), pc.greater(pc.binary_length(texts), LONG))
        out = {k: self.encode(texts[k].as_py()) for k in np.flatnonzero(alone.to_numpy(zero_copy_only=False)).tolist()}
        cut = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        words, starts = cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        led = np.ones(len(words), bool)
        led[starts[:-1]] = False  # a text's first word follows no blank
        coded = words.filter(pa.array(led)).dictionary_encode()
        ids = pa.array(self._ready(_strings(coded.dictionary)), pa.binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32)
        ends, data = ends[starts - np.arange(len(starts))].tolist(), memoryview(data or b"")
        first = _strings(words.take(pa.array(starts[:-1])))
        begun = {x: self.whole(x) if x else b"" for x in set(first)}
        return [out[k] if k in out else begun[x] + data[a:b] for k, (x, (a, b)) in enumerate(zip(first, pairwise(ends), strict=True))]


class CachedEncoder(WordCache):
    """The tokenizers library's ids."""

    odd = f"{UNSURE}|{ODD_BLANK}"

    def __init__(self, path: str, pattern: str):
        super().__init__(pattern)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        #: The same model for parts spelled in the vocabulary's letters, with blanks between them; the letters of each token.
        self.spelled = Tokenizer(self.library.model)
        self.spelled.pre_tokenizer = WhitespaceSplit()
        self.letters = byte_letters() | {0: " "}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(1 + max(vocabulary.values()), np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def new_parts(self, parts: list[str]) -> list[bytes]:
        """The model takes many at once; a part's tokens are those that end where it does, or before that."""
        out: list[bytes] = []
        for at in range(0, len(parts), AT_ONCE):
            raw = "\0".join(parts[at : at + AT_ONCE]).encode("utf-8", "surrogatepass")
            ids = np.array(self.spelled.encode_batch_fast([raw.decode("latin-1").translate(self.letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 0), len(raw))
            ends -= np.arange(len(ends))
            stops, data = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1, ids.tobytes()
            out += [data[a:b] for a, b in pairwise([0, *(4 * stops).tolist()])]
        return out


def encoder(path: str, pattern: str) -> CachedEncoder:
    return resident((CachedEncoder, path, pattern), lambda: CachedEncoder(path, pattern))
