"""Word-end BPE encoding with a bounded chunk cache.

The vocabulary file describes a normaliser (NFC, white space to one blank, lower case), a split
into letter runs, digits and symbol runs, and BPE whose last symbol of a word carries ``</w>``.
White space always separates words, so the ids of a text are the ids of its white-space chunks in
order, and chunks repeat: they are cached as packed little-endian uint32.

Chunks of plain Latin characters are encoded in bulk by tiktoken's merge loop over the same ranks
(byte 0x01 stands for ``</w>``: a byte followed by it has ids 256-511, below every merge).  Every
other chunk (special-token strings, control characters, non-Latin scripts) goes to the tokenizers
library itself, and a probe at start-up compares both paths.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct

import regex

PIECE = regex.compile(r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)")
#: Characters for which NFC is the identity and lower-casing is per character in both libraries.
PLAIN = regex.compile(r"[!-~\xa1-\u024f]+")
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
CACHE_CHUNKS = 300_000
LONG_CHUNK = 64


def file_digest(path: str) -> str:
    """SHA-256 of a tokenizer file: the tokenizer's version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _unicode_to_byte() -> dict[str, int]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(spare)}


class WordBpe:
    """Packed ids and counts of whole texts, equal to ``tokenizers`` without added tokens."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.cache_chunks = cache_chunks
        self.cache: dict[bytes, bytes] = {}
        self.fast = self._bulk_encoder(path)

    def _bulk_encoder(self, path: str):
        """A tiktoken encoding over the same ranks, or None where the file isn't of this kind."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>":
            return None
        back = _unicode_to_byte()
        ranks = {}
        for token, i in model["vocab"].items():
            if token in SPECIALS:
                continue
            end = token.endswith("</w>") and len(token) > 4
            body = token[:-4] if end else token
            ranks[bytes(back[c] for c in body) + (b"\x01" if end else b"")] = i
        try:
            encoding = tiktoken.Encoding("word_end", pat_str="[^\\x01\\n]+\\x01|\\n", mergeable_ranks=ranks, special_tokens={})
        except Exception:
            return None
        self.newline = ranks.get(b"\n")
        self.fast = encoding
        probe = "The quick brown-fox's naïve übergröße, señor 42x $%& won't straße éèà ozeñ don't!!".split()
        got = self._bulk(probe)
        want = [self._one(c) for c in probe]
        return encoding if got == want else None

    def _one(self, chunk: str) -> bytes:
        ids = self.lib.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _bulk(self, chunks: list[str]) -> list[bytes]:
        """Chunks without a newline, encoded in one call; newline tokens tell them apart."""
        import numpy as np

        marked = PIECE.sub("\\1\x01", "\n".join(chunks).lower())
        # a newline is white space, so it is never part of a piece and stays as it is
        ids = np.asarray(self.fast.encode_ordinary(marked), dtype="<u4")
        cuts = np.flatnonzero(ids == self.newline)
        if len(cuts) != len(chunks) - 1:
            return [self._one(c) for c in chunks]
        raw = ids.tobytes()
        edges = [-1, *cuts.tolist(), len(ids)]
        return [raw[4 * (a + 1) : 4 * b] for a, b in zip(edges, edges[1:])]

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        new, plain = {}, []
        for m in missing:
            try:
                s = m.decode()
            except UnicodeDecodeError:
                s = m.decode("utf-8", "replace")
            if self.fast is not None and PLAIN.fullmatch(s) and "<|" not in s:
                plain.append((m, s))
            else:
                new[m] = self._one(s)
        if plain:
            new.update(zip([m for m, _ in plain], self._bulk([s for _, s in plain])))
        return new

    def lookup(self, texts: list[str | None]):
        """For each text its chunks, and a table that has all of them."""
        split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
        if len(self.cache) > self.cache_chunks:
            self.cache = {}
        seen = set().union(*split) if split else set()
        missing = [c for c in seen if c not in self.cache]
        table = self.cache
        if missing:
            new = self._learn(missing)
            long = {k: v for k, v in new.items() if len(k) > LONG_CHUNK}
            self.cache.update((k, v) for k, v in new.items() if len(k) <= LONG_CHUNK)
            if long:
                table = {**{c: self.cache[c] for c in seen if c in self.cache}, **long}
        return split, table

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        split, table = self.lookup(texts)
        return [b"".join(map(table.__getitem__, s)) for s in split]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text."""
        split, table = self.lookup(texts)
        return [sum(map(len, map(table.__getitem__, s))) // 4 for s in split]
