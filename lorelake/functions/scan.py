"""Which of many strings lie in a text: one pass over its bytes, whatever the number of strings.

The strings make one Aho-Corasick automaton, a table of next states. Numpy runs it
over many stretches of texts side by side, a byte of each at a time. Stretches of
one text overlap by the longest string less a byte, so nothing is lost between them.
Texts and strings are UTF-8, in which a string starts at a character where it is found.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

# Bytes of a text that a stretch advances, at least.
STRETCH = 256


class Scan:
    """``strings`` are (string, number from 0); a number is found where any of its strings is."""

    def __init__(self, strings: Iterable[tuple[bytes, int]], numbers: int):
        strings = list(strings)
        self.width = numbers // 64 + 1
        self.longest = max((len(s) for s, _ in strings), default=1)
        # Bytes that are in no string are one symbol, 0.
        used = sorted({b for s, _ in strings for b in s})
        self.symbol = bytes(used.index(b) + 1 if b in used else 0 for b in range(256)) if len(used) < 256 else bytes(range(256))
        self.symbols = 256 if len(used) == 256 else len(used) + 1
        children: list[dict[int, int]] = [{}]
        ends: list[tuple[int, int]] = []
        for string, number in strings:
            state = 0
            for symbol in string.translate(self.symbol):
                state = children[state].setdefault(symbol, len(children))
                if state == len(children):
                    children.append({})
            ends.append((state, number))
        # What a state has found: bits of the numbers, those of its longest proper suffix too.
        self.found = np.zeros((len(children), self.width), np.uint64)
        for state, number in ends:
            self.found[state, number >> 6] |= np.uint64(1 << (number & 63))
        self.next = np.zeros((len(children), self.symbols), np.int32)
        suffix, queue = [0] * len(children), [0]
        for state in queue:
            self.next[state] = self.next[suffix[state]]
            self.found[state] |= self.found[suffix[state]]
            for symbol, child in children[state].items():
                suffix[child] = int(self.next[suffix[state], symbol]) if state else 0
                self.next[state, symbol] = child
                queue.append(child)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(text, byte) bits of the numbers found in each text, lowest first."""
        data = np.frombuffer(b"".join(texts).translate(self.symbol) + b"\0", np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        advance = max(STRETCH, 4 * self.longest)
        parts = np.maximum(1, -(-lengths // advance))
        first = np.cumsum(parts) - parts
        offset = (np.arange(parts.sum()) - np.repeat(first, parts)) * advance
        length = np.minimum(advance + self.longest - 1, np.repeat(lengths, parts) - offset)
        order = np.argsort(-length, kind="stable")
        at = (np.repeat(np.cumsum(lengths) - lengths, parts) + offset)[order]
        # Stretches by falling length: those that go on at a byte are the first ones.
        active = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
        state = np.zeros(len(at), np.int32)
        found = np.zeros((len(at), self.width), np.uint64)
        steps = self.next.ravel()
        for k, n in enumerate(active):
            now = np.take(steps, state[:n] * np.int64(self.symbols) + np.take(data, at[:n] + k))
            state[:n] = now
            found[:n] |= np.take(self.found, now, axis=0)
        by_text = np.empty_like(found)
        by_text[order] = found
        return np.bitwise_or.reduceat(by_text, first, axis=0).astype("<u8").view(np.uint8)
