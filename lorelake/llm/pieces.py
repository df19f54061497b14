"""Piece vocabularies of SentencePiece files and exact forward passes over them.

A text is a path of pieces. Two readings of a vocabulary are offered:

* ``unigram``: the path with the highest sum of piece scores (max-plus).
* ``bpe``: the path that merging the best-scored pair again and again ends in. A
  sequence of pieces is that path exactly if each two neighbours, merged alone,
  stay as they are: the first merge across a border would also happen when only
  these two pieces are there. So a pair weighs 0 (allowed) or minus infinity, and
  each prefix of a text has exactly one allowed last piece.

Both are forward passes from left to right whose state at a position depends on the
text before it alone; words that share a prefix share the states of that prefix.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np

MARK = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, BYTE, USER_DEFINED = 1, 2, 6, 4  # piece types of the file format
UNIGRAM, BPE = 1, 2  # model types of the file format
UNKNOWN_PENALTY = 10.0  # an unknown character scores this much less than the worst piece
# Kept by one worker process: words in each of two generations (with a count, both counts, ids), judged pairs of pieces.
MAX_CACHED = {"count": 500_000, "both": 500_000, "ids": 300_000}
MAX_PAIRS = 300_000
# Characters of the texts that are split into words at a time.
SPLIT_CHARS = 1_000_000
# Longer words (texts without spaces, encoded data) are traced back once and not kept.
LONG_WORD = 64
RESET = -2  # state at a border that no piece can cross
FALLBACK = -1  # a character without a piece, written as bytes


class Pieces:
    """A vocabulary with its forward passes; one for each worker process and file."""

    def __init__(self, data: bytes, reading: str = "file"):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalization are read")
        if any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not read")
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        kind = {"file": proto.trainer_spec.model_type, "unigram": UNIGRAM, "bpe": BPE}[reading]
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are read")
        self.bpe = kind == BPE
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.text = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_ids = byte_ids if len(byte_ids) == 256 else None
        self.longest = max(map(len, self.ids))
        self.worst = min((self.score[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        known = set().union(*self.ids)
        # ASCII characters in no piece, and places before a space run, are borders that no piece crosses.
        cuts = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in known)
        spaced = all(MARK not in p.lstrip(MARK) for p in self.ids)
        cut = f"[{cuts}]" if cuts else "(?!)"
        rest = rf"{MARK}*[^{MARK}{cuts}]+|{MARK}+" if spaced else (f"[^{cuts}]+" if cuts else "(?s:.+)")
        self.units = re.compile(f"{cut}|{rest}").findall
        self.border = re.compile((f"(?<!{MARK})(?={MARK})|" if spaced else "") + (f"(?={cut})|(?<={cut})" if cuts else "(?!)"))
        # Lengths of the pieces that can end in a tail of up to three characters, long ones first.
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            lengths.setdefault(p[-3:], set()).add(len(p))
        for tail in lengths:
            for k in (1, 2):
                if len(tail) > k and tail[-k:] in self.ids:
                    lengths[tail].add(k)
        self.lengths = {tail: tuple(sorted(ls, reverse=True)) for tail, ls in lengths.items()}
        self.packed = [array("i", [i]).tobytes() for i in range(len(self.text))]
        self.allowed: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.most = dict(MAX_CACHED)
        self.caches: dict[str, tuple[dict[str, object], dict[str, object]]] = {}  # by what is kept of a word: newer and older words
        self.decoded = [b"" if p.type in (UNKNOWN, 3) else (bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode()) for p in proto.pieces]

    def marked(self, text: str) -> str:
        """The text as the vocabulary sees it."""
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    # -- the merge rule, for two pieces only ---------------------------------------

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-scored, leftmost pair until none is left."""
        parts = list(text)
        ids, score = self.ids, self.score
        heap = [(-score[ids[a + b]], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
        heapify(heap)
        nxt, prev = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        end = len(parts)
        while heap:
            _, i, joined = heappop(heap)
            j = nxt[i]
            if j >= end or not parts[i] or not parts[j] or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            nxt[i] = nxt[j]
            if nxt[i] < end:
                prev[nxt[i]] = i
                if (x := joined + parts[nxt[i]]) in ids:
                    heappush(heap, (-score[ids[x]], i, x))
            if prev[i] >= 0 and (x := parts[prev[i]] + joined) in ids:
                heappush(heap, (-score[ids[x]], prev[i], x))
        return [p for p in parts if p]

    def fits(self, left: int, right: int) -> bool:
        """Whether piece ``right`` may follow state ``left``."""
        if left < 0:  # border or fallback character: the piece only has to be the merge of itself
            ok = self.alone.get(right)
            if ok is None:
                ok = self.alone[right] = self.merged(self.text[right]) == [self.text[right]]
            return ok
        key = left << 32 | right
        ok = self.allowed.get(key)
        if ok is None:
            a, b = self.text[left], self.text[right]
            ok = self.allowed[key] = self.merged(a + b) == [a, b]
        return ok

    # -- forward passes --------------------------------------------------------------

    def extend_bpe(self, s: str, last: list, count: list, at: int) -> None:
        """Append the states of positions ``at + 1`` to the end of ``s``: last piece and number of pieces.

        ``last[i]`` is None where no allowed path from the start of the pass ends at ``i``.
        """
        get, fits, lengths, known = self.ids.get, self.fits, self.lengths.get, self.allowed.get
        add_state, add_count = last.append, count.append
        for i in range(at + 1, len(s) + 1):
            state, n = None, 0
            ls = lengths(s[i - 3 : i] if i > 2 else s[:i]) or lengths(s[i - 2 : i]) or lengths(s[i - 1])
            if ls is None:
                before = last[i - 1]
                if before is not None:
                    state, n = FALLBACK, count[i - 1] + (len(s[i - 1].encode()) if self.byte_ids else 1)
            else:
                for k in ls:
                    if k <= i and (t := get(s[i - k : i])) is not None and (left := last[i - k]) is not None:
                        ok = known(left << 32 | t) if left >= 0 else None
                        if ok or ok is None and fits(left, t):
                            state, n = t, count[i - k] + 1
                            break
            add_state(state)
            add_count(n)

    def extend_unigram(self, s: str, last: list, count: list, at: int, best: list) -> None:
        """Like extend_bpe with the best score of each position; the first best, shortest piece wins ties as in a left-to-right pass."""
        ids, lengths, score = self.ids, self.lengths.get, self.score
        for i in range(at + 1, len(s) + 1):
            state, n, top = None, 0, -math.inf
            one = False
            for k in lengths(s[i - 3 : i] if i > 2 else s[:i]) or lengths(s[i - 2 : i]) or lengths(s[i - 1]) or ():
                if k <= i and (b := best[i - k]) > -math.inf:
                    t = ids.get(s[i - k : i])
                    if t is not None:
                        one = one or k == 1
                        if (x := b + score[t]) > top:
                            state, n, top = t, count[i - k] + 1, x
            if not one and best[i - 1] > -math.inf and (x := best[i - 1] + self.worst) > top:
                state, n, top = FALLBACK, count[i - 1] + (len(s[i - 1].encode()) if self.byte_ids else 1), x
            last.append(state)
            count.append(n)
            best.append(top)

    def sweep(self, words: list[str], keep) -> None:
        """Walk the trie of sorted distinct words once; ``keep(word, last, count)`` at each terminal.

        The states of the current branch are a stack: a shared prefix is never computed again.
        """
        last, count, best, before = [RESET], [0], [0.0], ""
        extend = self.extend_bpe if self.bpe else functools.partial(self.extend_unigram, best=best)
        for word in words:
            shared = shared_prefix(before, word)
            del last[shared + 1 :], count[shared + 1 :], best[shared + 1 :]
            extend(word, last, count, at=shared)
            keep(word, last, count)
            before = word

    def path_ids(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of sorted distinct words.

        For merge files those of short words grow along the trie, like the states. Long words
        keep one state a position and are traced back at their terminal: their memory is linear.
        """
        traced = words if not self.bpe else [w for w in words if len(w) > LONG_WORD]
        found: dict[str, bytes] = self.terminals(traced, lambda w, last, _: array("i", self.back(w, last, len(w))).tobytes())
        if not self.bpe:
            return found
        words = [w for w in words if len(w) <= LONG_WORD]
        get, fits, lengths, known, packed = self.ids.get, self.fits, self.lengths.get, self.allowed.get, self.packed
        last, path, before = [RESET], [b""], ""
        for word in words:
            shared = shared_prefix(before, word)
            del last[shared + 1 :], path[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                state, ids = None, b""
                ls = lengths(word[i - 3 : i] if i > 2 else word[:i]) or lengths(word[i - 2 : i]) or lengths(word[i - 1])
                if ls is None:
                    if last[i - 1] is not None:
                        state, ids = FALLBACK, path[i - 1] + self.fallback(word[i - 1])
                else:
                    for k in ls:
                        if k <= i and (t := get(word[i - k : i])) is not None and (left := last[i - k]) is not None:
                            ok = known(left << 32 | t) if left >= 0 else None
                            if ok or ok is None and fits(left, t):
                                state, ids = t, path[i - k] + packed[t]
                                break
                last.append(state)
                path.append(ids)
            found[word] = path[-1]
            before = word
        return found

    def fallback(self, char: str) -> bytes:
        """Packed ids of a character without a piece."""
        return array("i", [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]).tobytes()

    def both_counts(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """(merge count, unigram count) of sorted distinct words, in one walk of their trie.

        Both passes look at the same pieces that end at a position, so these are looked up once.
        """
        ids, lengths, score, allowed, fits, worst = self.ids, self.lengths.get, self.score, self.allowed, self.fits, self.worst
        nothing = -math.inf
        last, count, uni, best = [RESET], [0], [0], [0.0]
        found: dict[str, tuple[int, int]] = {}
        before = ""
        for word in words:
            shared = shared_prefix(before, word)
            del last[shared + 1 :], count[shared + 1 :], uni[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                state, n, m, top, one = None, 0, 0, nothing, False
                for k in lengths(word[i - 3 : i] if i > 2 else word[:i]) or lengths(word[i - 2 : i]) or lengths(word[i - 1]) or ():
                    if k <= i:
                        t = ids.get(word[i - k : i])
                        if t is not None:
                            at = i - k
                            if (x := best[at] + score[t]) > top:
                                top, m = x, uni[at] + 1
                            if k == 1:
                                one = True
                            if state is None and (left := last[at]) is not None:
                                ok = allowed.get(left << 32 | t) if left >= 0 else None
                                if ok is None:
                                    ok = fits(left, t)
                                if ok:
                                    state, n = t, count[at] + 1
                if not one:
                    width = len(word[i - 1].encode()) if self.byte_ids else 1
                    if (x := best[i - 1] + worst) > top:
                        top, m = x, uni[i - 1] + width
                    if state is None and last[i - 1] is not None:
                        state, n = FALLBACK, count[i - 1] + width
                last.append(state)
                count.append(n)
                uni.append(m)
                best.append(top)
            found[word] = count[-1], uni[-1]
            before = word
        return found

    def back(self, s: str, last: list, end: int, start: int = 0) -> list[int]:
        """Ids of the path that ends at ``end``, from the states of a forward pass."""
        out: list[int] = []
        while end > start:
            t = last[end]
            if t == FALLBACK:
                out.extend([self.byte_ids[b] for b in reversed(s[end - 1].encode())] if self.byte_ids else [self.unknown])
                end -= 1
            else:
                out.append(t)
                end -= len(self.text[t])
        out.reverse()
        return out

    # -- words -------------------------------------------------------------------------

    def learn(self, words: set[str], kind: str, work) -> dict[str, object]:
        """The newer words of this kind, with all of ``words`` among them; ``work(sorted words)`` gives what is kept of new ones.

        When the newer generation is full it becomes the older one, and what that held is forgotten unless met again.
        """
        newer, older = self.caches.get(kind, ({}, {}))
        if len(self.allowed) > MAX_PAIRS:
            self.allowed.clear()
        missing = words.difference(newer)
        if newer and len(newer) + len(missing) > self.most[kind]:
            newer, older, missing = {}, newer, words
        known = missing.intersection(older)
        newer.update((w, older[w]) for w in known)
        newer.update(work(sorted(missing - known)))
        self.caches[kind] = newer, older
        return newer

    def fold(self, texts: list[str], kind: str, work, value) -> list:
        """``value(kept of each word)`` of each text as ``marked`` returns it; words of a bounded stretch of texts are held at a time."""
        out: list = []
        at = 0
        while at < len(texts):
            end, chars = at + 1, len(texts[at])
            while end < len(texts) and (chars := chars + len(texts[end])) <= SPLIT_CHARS:
                end += 1
            split = [self.units(s) for s in texts[at:end]]
            words = set().union(*split)
            known = self.learn(words, kind, work)
            out += [value(map(known.__getitem__, ws)) for ws in split]
            for w in words:
                if len(w) > LONG_WORD:
                    del known[w]
            at = end
        return out

    def terminals(self, words: list[str], value) -> dict[str, object]:
        """``value(word, last, count)`` at the trie's terminals."""
        found: dict[str, object] = {}
        self.sweep(words, lambda w, last, count: found.__setitem__(w, value(w, last, count)))
        return found

    def count_all(self, texts: list[str]) -> list[int]:
        """Number of pieces of each text."""
        return self.fold([self.marked(t) for t in texts], "count", lambda ws: self.terminals(ws, lambda w, last, count: count[-1]), sum)

    def encode_all(self, marked: list[str]) -> list[np.ndarray]:
        """Ids of each text, which is given as ``marked`` returns it."""
        return self.fold(marked, "ids", self.path_ids, lambda ids: np.frombuffer(b"".join(ids), "<i4"))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of a run of ids; the prefix space of the text's first run is still there."""
        return b"".join(map(self.decoded.__getitem__, ids.tolist()))

    # -- chunks of a long text ------------------------------------------------------------

    def states(self, s: str, at: int) -> list[tuple[int, int]]:
        """All (overhang, last piece) that a path can have at the first piece end at or after ``at``."""
        if at in (0, len(s)) or self.border.match(s, at):
            return [(0, RESET)]
        out = []
        for a in range(max(0, at - self.longest), at):
            for q in range(at, min(len(s), a + self.longest) + 1):
                t = self.ids.get(s[a:q])
                if t is not None:
                    out.append((q - at, t))
        if s[at - 1] not in self.ids:
            out.append((0, FALLBACK))
        return sorted(set(out))

    def run(self, s: str, start: int, state: int, end: int) -> tuple[list, list]:
        """States and scores of positions ``start`` to ``end`` of ``s`` for a pass that begins at ``start`` in ``state``."""
        part = s[start:end]
        last, count, best = [state], [0], [0.0]
        if self.bpe:
            self.extend_bpe(part, last, count, 0)
            best = [0.0 if x is not None else -math.inf for x in last]
        else:
            self.extend_unigram(part, last, count, 0, best)
        return last, best

    def exits(self, s: str, start: int, last: list, best: list, at: int, states: list[tuple[int, int]]) -> list[float]:
        """Score of reaching each state at ``at`` from a pass that began at ``start``."""
        out = []
        for over, t in states:
            end = at + over - start
            if t in (RESET, FALLBACK):
                ok = 0 <= end < len(best) and (t == RESET or end == 0 or last[end] == FALLBACK)
                out.append(best[end] if ok else -math.inf)
                continue
            begin = end - len(self.text[t])
            if begin < 0 or best[begin] == -math.inf or (self.bpe and not self.fits(last[begin], t)):
                out.append(best[end] if begin < 0 and end == 0 and last[0] == t else -math.inf)
            else:
                out.append(best[begin] + (0.0 if self.bpe else self.score[t]))
        return out

    def transfer(self, s: str, p0: int, p1: int) -> np.ndarray:
        """Max-plus matrix from the states at ``p0`` to the states at ``p1``; ``s`` has the context of both.

        A border inside the chunk makes the matrix an outer sum of its first and last stretch.
        """
        entry, leave = self.states(s, p0), self.states(s, p1)
        first = self.border.search(s, p0, len(s)) if p0 else None
        r0 = 0 if p0 == 0 else (first.start() if first and first.start() <= p1 else (len(s) if p1 == len(s) else None))
        if r0 is None:
            rows = [self.exits(s, p0 + o, *self.run(s, p0 + o, t, p1 + self.longest), p1, leave) for o, t in entry]
            return np.array(rows, float).reshape(len(entry), len(leave))
        into = []
        for o, t in entry:
            best = self.run(s, p0 + o, t, r0)[1] if p0 + o <= r0 else [-math.inf]
            into.append(best[-1])
        r1 = self.last_border(s, r0, p1)
        out = self.exits(s, r1, *self.run(s, r1, RESET, min(len(s), p1 + self.longest)), p1, leave)
        return np.add.outer(np.array(into, float), np.array(out, float))

    def last_border(self, s: str, r0: int, p1: int) -> int:
        r1 = r0
        for m in self.border.finditer(s, r0):
            if m.start() > p1:
                break
            r1 = m.start()
        return p1 if p1 == len(s) else r1

    def chunk_ids(self, s: str, p0: int, p1: int, entry: int, leave: int) -> np.ndarray:
        """Ids of the pieces that end after the entry state's end up to the exit state's end."""
        o, t = self.states(s, p0)[entry]
        over, final = self.states(s, p1)[leave]
        start, end = p0 + o, p1 + over
        if start >= end:
            return np.zeros(0, "<i4")
        first = self.border.search(s, start, len(s)) if start else None
        r0 = 0 if start == 0 else (first.start() if first and first.start() <= p1 else None)
        if r0 is None or r0 > end:
            return np.array(self.stretch(s, start, t, end, final), "<i4")
        r1 = max(r0, min(self.last_border(s, r0, p1), end))
        return np.concatenate([
            np.array(self.stretch(s, start, t, r0, RESET), "<i4"), *self.encode_all([s[r0:r1]]), np.array(self.stretch(s, r1, RESET, end, final), "<i4"),
        ])

    def stretch(self, s: str, start: int, state: int, end: int, final: int) -> list[int]:
        """Best ids from ``start`` to ``end`` whose last piece is ``final``, if that is a piece."""
        if start >= end:
            return []
        if final >= 0:
            begin = end - len(self.text[final])
            head = self.run(s, start, state, begin)[0] if begin >= start else [state]
            return [*self.back(s[start:], head, begin - start), final]
        last = self.run(s, start, state, end)[0]
        return self.back(s[start:], last, end - start)


def shared_prefix(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in which sums are maxima and products are sums; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.size and b.size else np.full((a.shape[0], b.shape[1]), -np.inf)


@functools.lru_cache(maxsize=4)
def load(data: bytes, reading: str = "file") -> Pieces:
    """One vocabulary for each worker process, file and reading, with its word cache."""
    return Pieces(data, reading)
