"""Token ids of whole texts, equal to the tokenizers library's, by remembered units.

A text is cut where the vocabulary's own pre-tokenizer always cuts: around
white space and, in words of plain letters, digits and punctuation, between
letters and the rest. Each distinct unit of a worker is encoded once by the
library; texts become array lookups. Words with apostrophes or characters
outside Latin-1 letters stay whole, and texts with rare white space or with the
string of an added token (``<|endoftext|>``), which the library matches first,
go to the library as they are. The remembered units are bounded (``REMEMBER``).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from rowmill.llm.text import mix, span_hashes

REMEMBER = 500_000           # units a worker keeps, about 40 MB at the peak of an update
WHITE, LETTER, OTHER, HARD = 0, 1, 2, 3
CLASS = np.full(256, HARD, np.uint8)
CLASS[0x21:0x7F] = OTHER
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER
CLASS[0x27] = HARD
CLASS[[0x20, *range(0x09, 0x0E)]] = WHITE
RARE_WHITE = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]"
                        rb"|\xe2\x81\x9f|\xe3\x80\x80")
PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return out


class Encoder:
    """``encode(buf, offs)``: ids of all texts, and how many each has."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.model = self.library.model
        parts = json.loads(spec)
        pre, added = parts["pre_tokenizer"], parts.get("added_tokens") or []
        self.added = [t["content"].encode() for t in added if t["content"]]
        # those matched in normalised text cannot be found in the bytes: every text goes to the library
        self.whole = bool(parts.get("normalizer")) and any(t["normalized"] for t in added)
        self.spaced = pre["type"] == "ByteLevel"          # a space belongs to the word after it
        self.lower = not self.spaced
        self.letters = byte_letters()
        self.size = self.library.get_vocab_size()
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)                   # ids of unit k: ids[at[where[k]]:at[where[k] + 1]]
        self.where = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _unit_ids(self, units: list[str]) -> list[list[int]]:
        out: list = [None] * len(units)
        rest = []
        for k, u in enumerate(units):
            if PLAIN.fullmatch(u):
                raw = (u.lower() if self.lower else u).encode()
                out[k] = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in raw]))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.library.encode_batch([units[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _learn(self, h: np.ndarray, units: list[str]) -> None:
        if len(self.known) + len(h) > REMEMBER and len(self.known):
            raise OverflowError
        got = self._unit_ids(units)
        sizes = np.array([len(g) for g in got], np.int64)
        base = len(self.at) - 1
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.array([i for g in got for i in g], np.uint32)])
        known = np.concatenate([self.known, h])
        order = np.argsort(known, kind="stable")
        self.where = np.concatenate([self.where, base + np.arange(len(h))])[order]
        self.known = known[order]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return self.known[k] == h, self.where[k]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offs) - 1
        raw = buf.tobytes()
        odd = np.full(n, self.whole)
        for mark in self.added:
            at = raw.find(mark)
            while at >= 0:
                d = int(np.searchsorted(offs, at, "right")) - 1
                odd[d] = True
                at = raw.find(mark, int(offs[d + 1]))
        if self.spaced:
            for m in RARE_WHITE.finditer(raw):
                odd[np.searchsorted(offs, m.start(), "right") - 1] = True
        starts, ends, doc = units(buf, offs, self.spaced)
        if odd.any():
            keep = ~odd[doc]
            starts, ends, doc = starts[keep], ends[keep], doc[keep]
        u, first, inverse = np.unique(mix(span_hashes(buf, starts, ends)), return_index=True, return_inverse=True)
        have, _ = self._find(u)
        new = np.flatnonzero(~have)
        if len(new):
            s, e = starts[first], ends[first]
            try:
                self._learn(u[new], [raw[s[k]:e[k]].decode() for k in new.tolist()])
            except OverflowError:
                self._forget()
                self._learn(u, [raw[s[k]:e[k]].decode() for k in range(len(u))])
        _, w = self._find(u)
        begin, size = self.at[w][inverse], (self.at[w + 1] - self.at[w])[inverse]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        counts = np.bincount(doc, size, minlength=n).astype(np.int64)
        if odd.any():
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for d in np.flatnonzero(odd).tolist():
                pieces[d] = np.array(self.library.encode(raw[offs[d]:offs[d + 1]].decode(), add_special_tokens=False).ids,
                                     np.uint32)
                counts[d] = len(pieces[d])
            ids = np.concatenate(pieces)
        return ids, counts


def units(buf: np.ndarray, offs: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of units and the text of each, in order."""
    n = len(buf)
    kind = CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    edge[n] = True
    word = kind != WHITE
    turn = edge.copy()
    turn[1:n] |= word[1:] != word[:-1]
    bounds = np.flatnonzero(turn[:n + 1]) if n else np.zeros(0, np.int64)
    s, e = (bounds[:-1], bounds[1:]) if n else (bounds, bounds)
    is_word = word[s] if n else np.zeros(0, bool)
    hard = np.concatenate([[0], np.cumsum(kind == HARD)])
    soft = is_word & (hard[e] == hard[s])
    inner = np.zeros(n + 1, bool)
    if n:
        inner[1:n] = kind[1:] != kind[:-1]
        covered = np.repeat(soft, e - s)
        inner[:n] &= covered
    inner[bounds] = True
    cuts = inner
    if spaced and n:
        ws, we = s[~is_word], e[~is_word]
        before_word = (we < n) & ~edge[np.minimum(we, n)]
        last = we[before_word] - 1
        cuts[last] = True                                # the last white character stands apart
        glued = last[buf[last] == 0x20]
        cuts[glued + 1] = False                          # and a space goes with the word
    b = np.flatnonzero(cuts)
    starts, ends = b[:-1], b[1:]
    if not spaced and n:
        keep = word[starts]
        starts, ends = starts[keep], ends[keep]
    doc = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, doc


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def vocabulary(path: str) -> str:
    """Text of a vocabulary file, read by the driver and broadcast to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()
