"""Byte-level BPE over whole documents with the ``tokenizers`` library.

The library cuts a text at the strings of its added tokens, splits the rest into pre-tokens and merges
bytes within each of them only, so the ids of a text are the ids of these parts in a row. ``Encoder``
finds the pre-tokens of many documents at once with numpy and has the library encode every distinct
one; repeated ones of up to 64 characters come from a table of bounded size in the worker, longer ones
are encoded where they stand. The result equals ``Tokenizer.encode(whole text).ids``; the tests hold
it against that of a tokenizer of their own. The character classes come from the library's own regular expressions, so they
follow its Unicode version. Tokenizers of another kind are given whole texts directly.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from spanloom.llm.hashing import CHUNK, LONG, code_points, groups, span_hashes

O_, L_, N_, S_ = 0, 1, 2, 3
#: Distinct pre-tokens kept in a worker; beyond it the table starts anew.
TABLE = 3 << 18
_SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tok = Tokenizer.from_file(path)
        pre = json.loads(self.tok.pre_tokenizer.__getstate__()) if self.tok.pre_tokenizer else {}
        added = self.tok.get_added_tokens_decoder()
        plain = not any(t.lstrip or t.rstrip or t.single_word or "\n" in t.content for t in added.values())
        self.fast = plain and self.tok.normalizer is None and isinstance(self.tok.model, BPE) and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.added = {t.content: i for i, t in added.items()}
        # Of several that begin at one place the longest counts.
        self.at_added = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if added else None
        self.byte_level = pre.get("type") == "ByteLevel"
        if self.byte_level:
            self.id_bytes = np.zeros(max(self.tok.get_vocab_size(), *self.added.values(), 0) + 1, np.int64)
            for i in range(len(self.id_bytes)):
                word = self.tok.id_to_token(i) or ""
                self.id_bytes[i] = len(word.encode()) if word in self.added else len(word)  # in a byte-level vocabulary one character stands for one byte
        if self.fast:
            self.kind = self._kinds()
            self.newline = self.tok.encode("\n", add_special_tokens=False).ids
            self.fast = len(self.newline) == 1
            self._clear()

    @staticmethod
    def _kinds() -> np.ndarray:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        kind = np.zeros(0x110000, np.uint8)
        step = 1 << 13  # small parts: the library keeps an alignment of every byte
        for base in [*range(0, 0xD800, step), *range(0xE000, 0x110000, step)]:
            top = min(base + step, 0xD800) if base < 0xD800 else min(base + step, 0x110000)
            every = "".join(map(chr, range(base, top)))
            for what, k in ((r"\p{L}+", L_), (r"\p{N}+", N_), (r"\s+", S_)):
                hit = np.ones(top - base, bool)
                for _, (a, b) in Split(Regex(what), "removed").pre_tokenize_str(every):
                    hit[a:b] = False
                kind[base:top][hit] = k
        return kind

    def _clear(self) -> None:
        self.bits = TABLE.bit_length()
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.keys = np.zeros(TABLE + 1, np.uint64)
        self.at = np.zeros(TABLE + 2, np.int64)
        self.n, self.flat, self.n_flat = 0, np.zeros(1 << 16, np.uint32), 0

    # -- pre-tokens ------------------------------------------------------------------------------

    def _starts(self, cps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start. first: whether a document starts at a code point."""
        kind = self.kind[cps]
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(start)
        end = np.append(run[1:], len(cps))
        space = (kind[run] == S_) & (end < len(cps))
        space[space] = ~first[end[space]]
        last = end[space] - 1  # white space before something: its last character stands alone or joins what follows
        start[last] = True
        start[last[cps[last] == 32] + 1] = False
        # 's 't 'm 'd 're 've 'll at the start of a pre-token
        quote = np.flatnonzero((cps == 39) & start)
        quote = quote[quote + 1 < len(cps)]
        quote = quote[~first[quote + 1] & (kind[quote + 1] == L_)]
        if len(quote):
            one = cps[quote + 1]
            there = np.minimum(quote + 2, len(cps) - 1)
            two = np.where((quote + 2 < len(cps)) & ~first[there], cps[there], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            hit = quote[short | long]
            start[hit + 1] = False
            after = hit + np.where(short[short | long], 2, 3)
            start[after[after < len(cps)]] = True
        return np.flatnonzero(start)

    # -- table of pre-tokens ---------------------------------------------------------------------

    def _find(self, h: np.ndarray) -> np.ndarray:
        out, left, mask = np.zeros(len(h), np.int32), np.arange(len(h)), (1 << self.bits) - 1
        s = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            c = self.slot[s]
            same = self.keys[c] == h
            same &= c > 0
            out[left[same]] = c[same]
            on = ~same & (c > 0)
            left, s, h = left[on], (s[on] + 1) & mask, h[on]
        return out

    def _add(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        k = np.arange(self.n + 1, self.n + 1 + len(h), dtype=np.int32)
        self.keys[k] = h
        flat = np.concatenate(ids)
        if self.n_flat + len(flat) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(len(self.flat) + len(flat), np.uint32))
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.at[self.n + 1] = self.n_flat
        self.at[self.n + 2 : self.n + 2 + len(h)] = self.n_flat + np.cumsum([len(x) for x in ids])
        self.n, self.n_flat = self.n + len(h), self.n_flat + len(flat)
        s, mask = (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(k):
            free = self.slot[s] == 0
            self.slot[s[free]] = k[free]
            on = self.slot[s] != k
            s, k = (s[on] + 1) & mask, k[on]

    def _encode_words(self, words: list[str], blank: np.ndarray) -> list[np.ndarray]:
        out: list = [None] * len(words)
        for i in np.flatnonzero(blank):
            out[i] = np.array(self.tok.encode(words[i], add_special_tokens=False).ids, np.uint32)
        rest = np.flatnonzero(~blank)
        for a in range(0, len(rest), 4096):
            part = rest[a : a + 4096]
            ids = np.array(self.tok.encode("\n" + "\n".join([words[i] for i in part]) + "\n", add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == self.newline[0])
            for i, x, y in zip(part.tolist(), (cut[:-1] + 1).tolist(), cut[1:].tolist(), strict=True):
                out[i] = ids[x:y]
        return out

    def _rows(self, joined: str, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        row = self._find(h)
        miss = np.flatnonzero(row == 0)
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            if self.n + len(new) > TABLE:
                self._clear()
                miss = np.arange(len(h))
                new, at = np.unique(h, return_index=True)
            at = miss[at]
            blank = self.kind[cps[ends[at] - 1]] == S_
            self._add(new, self._encode_words([joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], blank))
            row[miss] = self._find(h[miss])
        return row

    # -- documents -------------------------------------------------------------------------------

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        size = np.array([len(t) for t in texts], np.int64)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cps = code_points(joined)
        begin = np.cumsum(size) - size
        first = np.zeros(len(cps), bool)
        first[begin[begin < len(cps)]] = True
        starts = self._starts(cps, first)
        ends = np.append(starts[1:], len(cps))
        long = ends - starts > LONG
        some, row = np.flatnonzero(~long), np.zeros(len(starts), np.int64)
        row[some] = self._rows(joined, cps, starts[some], ends[some], span_hashes(cps, starts[some], ends[some]))
        alone = [np.array(self.tok.encode(joined[a:b], add_special_tokens=False).ids, np.uint32) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        count = self.at[row + 1] - self.at[row]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.at[row] - total[:-1], count) + np.arange(total[-1])]
        if alone:
            ids = np.insert(ids, np.repeat(total[:-1][long], [len(x) for x in alone]), np.concatenate(alone))
            count[long] = [len(x) for x in alone]
            total = np.concatenate([[0], np.cumsum(count)])
        edge = np.searchsorted(starts, np.append(begin, len(cps)))
        return ids, np.diff(total[edge])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if not self.fast:
            each = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate(each or [np.zeros(0, np.uint32)]), np.array([len(x) for x in each], np.int64)
        if self.at_added and any(map(self.at_added.search, texts)):
            return self._around_added([self.at_added.split(t) for t in texts])
        return self._encode(texts)

    def _around_added(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are given as parts: text, added token, text, ..., text."""
        plain, n = self._encode([part for parts in split for part in parts[::2]])
        own, counts, at = np.split(plain, np.cumsum(n)), [], 0
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)]
        for parts in split:
            begin = len(ids)
            for k, part in enumerate(parts):
                ids.append(np.array([self.added[part]], np.uint32) if k % 2 else own[at + k // 2])
            at += len(parts) // 2 + 1
            counts.append(sum(map(len, ids[begin:])))
        return np.concatenate(ids), np.array(counts, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > CHUNK:
            ids, counts = zip(*(self._encode([t]) if len(t) <= CHUNK else self._plain(t) for t in self._cut(texts[0])), strict=True)
            return np.concatenate(ids), np.array([sum(int(c[0]) for c in counts)], np.int64)
        parts = [self._encode(texts[a:b]) if b - a == 1 and len(texts[a]) > CHUNK else self._chunk(texts[a:b]) for a, b in groups(texts)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in parts]), np.concatenate([c for _, c in parts])

    def _plain(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        return ids, np.array([len(ids)], np.int64)

    @staticmethod
    def _cut(text: str) -> Iterator[str]:
        """Parts of a long text, cut between a word and the space before the next."""
        at = 0
        while len(text) - at > CHUNK:
            hit = _SAFE_CUT.search(text, at + CHUNK // 2)
            if not hit:
                break
            yield text[at : hit.start()]
            at = hit.start()
        yield text[at:]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    return Encoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
