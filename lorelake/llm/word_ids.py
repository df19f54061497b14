"""Ids of whole texts under a public word-level BPE file, with bounded caches.

The ids of a text are those that the tokenizers library gives without added special
tokens; the file's special strings are ordinary text. A file that drops white space and
merges inside words gives a word the same ids wherever it stands, and so each part of a
word (a run of letters, a digit, a run of signs). The words of a stretch of texts are split
and numbered by Arrow, and so are the parts of those that are letters and signs after
them; only distinct ones are looked up. The library's merge model encodes a new part once.
Words with characters that are not plain Latin go through the whole library, and so do texts
under any other kind of file.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# The normalizer steps, split pattern and word end of files whose words stand alone.
STEPS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
MAX_PARTS, LONGEST_KEPT = 600_000, 64
# Printed characters whose kind and lower case are the same in every Unicode version at hand.
LATIN = re.compile("[!-~\xa1-ſ]*").fullmatch


def latin(kind: str) -> str:
    """All such characters of a kind (first letter of the Unicode category)."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


PARTS = re.compile(f"{CONTRACTIONS}|[{latin('L')}]+|[{latin('N')}]|[^{latin('L')}{latin('N')}]+").findall

# Latin letters whose lower case is one letter, and signs after them that cannot begin a contraction.
USUAL = r"^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Words:
    """One tokenizer file with its caches; one for each worker process."""

    def __init__(self, spec: str, most: int = MAX_PARTS):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.code = "H" if self.size <= 1 << 16 else "I"
        shape = json.loads(spec)
        steps = [s["type"] for s in (shape.get("normalizer") or {}).get("normalizers", [])]
        splits = (shape.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = steps == STEPS and splits[0].get("pattern") == {"Regex": SPLIT} and shape["model"].get("end_of_word_suffix") == WORD_END
        self.letters = byte_letters()
        # Ids of newer and older parts: when the newer ones are full, they become the older ones.
        self.most, self.parts, self.older = most, {}, {}

    def packed(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, part: str) -> bytes:
        """Ids of a run of letters, a digit or a run of signs that is not among the newer parts."""
        found = self.older.get(part)
        if found is None:
            raw = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            found = self.packed([t.id for t in self.tokenizer.model.tokenize(raw)])
        if len(part) <= LONGEST_KEPT:
            if len(self.parts) >= self.most:
                self.parts, self.older = {}, self.parts
            self.parts[part] = found
        return found

    def known(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.parts.get, parts))
        return [self.part(p) if x is None else x for p, x in zip(parts, found, strict=True)] if None in found else found

    def word(self, word: str) -> bytes:
        """Ids of a run without ASCII white space."""
        return b"".join(self.known(PARTS(word.lower()))) if LATIN(word) else self.whole(word)

    def each(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        cut = pc.extract_regex(words, USUAL)
        usual = cut.is_valid()
        ids = []
        for part in (pc.utf8_lower(cut.field("letters").filter(usual)), cut.field("signs").filter(usual)):
            numbered = part.dictionary_encode()
            ids.append(pa.array(self.known(numbered.dictionary.to_pylist()), pa.large_binary()).take(numbered.indices))
        joined = pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary()))
        other = pa.array(list(map(self.word, words.filter(pc.invert(usual)).to_pylist())), pa.large_binary())
        order = np.argsort(~usual.to_numpy(zero_copy_only=False), kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return pa.concat_arrays([joined, other]).take(pa.array(back))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        """(ids of all texts in a row, where each text begins and the last one ends); null is empty."""
        texts = texts.fill_null("")
        if not self.by_word:
            each = [self.whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(each), self.kind), (np.cumsum([0, *map(len, each)]) // self.width).tolist()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = self.each(words.dictionary)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy()[words.indices.to_numpy()])])
        starts = np.frombuffer(split.buffers()[1], np.int32)[split.offset : split.offset + len(split) + 1]
        data = ids.take(words.indices).buffers()[2] or b""
        return np.frombuffer(data, self.kind, int(ends[-1]) // self.width), (ends[starts - starts[0]] // self.width).tolist()

    @property
    def width(self) -> int:
        return array(self.code).itemsize

    @property
    def kind(self) -> str:
        return f"<u{self.width}"


@functools.lru_cache(maxsize=2)
def load(spec: str) -> Words:
    return Words(spec)
