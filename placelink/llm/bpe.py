"""Batch tokenization with a public byte-level BPE.

Byte-level BPE works within pre-tokens, and most pre-tokens of a corpus repeat. A batch of texts
is cut into pre-tokens with numpy; each distinct pre-token that is not known yet is merged once
(by tiktoken's merger, over the vocabulary in the tokenizers file); ids are then gathered. Texts
with characters outside Latin letters or with rare white space go through the tokenizers library
whole. Tests hold the ids against the library's.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .vectext import CODE, U, mix, powers, ragged

CAPACITY = 1_000_000
LIMIT = 0x250
L, N, S, O = 0, 1, 2, 3  # noqa: E741
_kind = np.full(LIMIT, O, np.int8)
for _c in range(LIMIT):
    _cat = unicodedata.category(chr(_c))
    _kind[_c] = L if _cat[0] == "L" else N if _cat[0] == "N" else S if chr(_c) in " \t\n\r\x0b\x0c" else O
#: Characters left to the library: other white space and controls.
ODD = np.zeros(LIMIT + 1, bool)
ODD[[*range(0x1C, 0x20), 0x85, 0xA0, LIMIT]] = True
_codes = mix(np.arange(1, LIMIT + 1, dtype=np.uint64) * CODE[1]) | U(1)


def cut(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts joined as code points; ``off`` are the texts' offsets."""
    n = len(cp)
    kind = _kind[cp]
    first = np.zeros(n + 1, bool)
    first[off] = True
    change = first[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    bound = change.copy()
    # white space before a word: its last character stands alone, or with the word if a blank
    e = np.flatnonzero(change & ~first[:-1])
    e = e[kind[e - 1] == S]
    bound[e - 1] = True
    bound[e[cp[e - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll after anything but a blank
    q = np.flatnonzero((cp == 39) & bound)
    q = q[q + 1 < n]
    q = q[change[q + 1] & ~first[q + 1] & (kind[q + 1] == L)]
    if len(q):
        a = cp[q + 1]
        b = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        k = np.where(one, 1, np.where(two, 2, 0))
        q, k = q[k > 0], k[k > 0]
        bound[q + 1] = False
        nxt = q + 1 + k
        bound[nxt[nxt < n]] = True
    return np.flatnonzero(bound)


class Encoder:
    """Ids of texts by the tokenizer file at ``path``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves, others from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
        for t in self.tok.get_added_tokens_decoder().values():
            ranks.pop(t.content.encode(), None)
        import tiktoken

        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new_keys, self.new_slots = self.keys, self.slots
        self.at, self.len, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, keys, slots, want):
        if not len(keys):
            return np.full(len(want), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, slots[at], -1)

    def _slots(self, want: np.ndarray, piece) -> np.ndarray:
        """Slots of distinct sorted hashes; ``piece(i)`` is the i-th string."""
        got = self._find(self.keys, self.slots, want)
        miss = got < 0
        got[miss] = self._find(self.new_keys, self.new_slots, want[miss])
        miss = np.flatnonzero(got < 0)
        if len(miss):
            if len(self.at) + len(miss) > CAPACITY and len(self.at):
                self.clear()
                return self._slots(want, piece)
            ids = [self.merge(piece(i)) for i in miss]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            base = len(self.at)
            self.at = np.concatenate([self.at, len(self.ids) + np.concatenate([[0], np.cumsum(lens)[:-1]])])
            self.len = np.concatenate([self.len, lens])
            self.ids = np.concatenate([self.ids, np.fromiter((x for y in ids for x in y), np.int32, int(lens.sum()))])
            got[miss] = base + np.arange(len(miss))
            k, s = np.concatenate([self.new_keys, want[miss]]), np.concatenate([self.new_slots, got[miss]])
            order = np.argsort(k)
            self.new_keys, self.new_slots = k[order], s[order]
            if len(k) > 50_000:
                k, s = np.concatenate([self.keys, self.new_keys]), np.concatenate([self.slots, self.new_slots])
                order = np.argsort(k)
                self.keys, self.slots = k[order], s[order]
                self.new_keys, self.new_slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the n + 1 offsets of the texts."""
        plain, cps = [], []
        for t in texts:
            cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            ok = not ODD[np.minimum(cp, LIMIT)].any()
            plain.append(ok)
            if ok:
                cps.append(cp)
        out_len = np.zeros(len(texts), np.int64)
        fast = np.zeros(0, np.int32)
        if cps:
            cp = np.concatenate(cps)
            off = np.concatenate([[0], np.cumsum([len(c) for c in cps])])
            if len(cp):
                start = cut(cp, off[:-1][off[:-1] < len(cp)])
                end = np.append(start[1:], len(cp))
                pre = np.zeros(len(cp) + 1, np.uint64)
                np.cumsum(_codes[cp] * powers(len(cp))[: len(cp)], out=pre[1:])
                h = mix((pre[end] - pre[start]) * powers(len(cp) + 1, True)[start])
                want, where, back = np.unique(h, return_index=True, return_inverse=True)
                joined = "".join(t for t, ok in zip(texts, plain) if ok)
                slot = self._slots(want, lambda i: joined[start[where[i]] : end[where[i]]])[back]
                lens = self.len[slot]
                fast = self.ids[ragged(self.at[slot], lens)]
                total = np.concatenate([[0], np.cumsum(lens)])
                out_len[plain] = np.diff(total[np.searchsorted(start, off)])
        slow_texts = [t for t, ok in zip(texts, plain) if not ok]
        if not slow_texts:
            return fast, np.concatenate([[0], np.cumsum(out_len)])
        slow = self.whole(slow_texts)
        parts, f = [], 0
        for i, ok in enumerate(plain):
            if ok:
                parts.append(fast[f : f + out_len[i]])
                f += out_len[i]
            else:
                parts.append(np.array(slow.pop(0), np.int32))
                out_len[i] = len(parts[-1])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(out_len)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
