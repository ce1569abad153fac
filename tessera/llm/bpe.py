"""Token ids of a `tokenizers` file, computed once per distinct chunk of text.

A chunk is a stretch of text that no pre-token crosses at either end, so the
ids of a text are those of its chunks one after the other. Chunks are found and
hashed with numpy over a whole slice of texts; distinct ones not seen before
are encoded, all others come from the worker's cache by their 64-bit hash.

* ``led``: byte-level tokenizers with their own pattern and no normalizer. A
  space belongs to what follows it; a cut is made before a space only if the
  next byte starts no white space, where the pattern always starts anew.
* ``words``: letter, digit and punctuation runs behind NFC, white space and
  lower-case normalizers; nothing crosses ASCII white space.
* ``whole``: any other file; each text is one chunk.

New chunks are encoded by tiktoken with the file's own merges as ranks if the
file passes a check at load and the chunk has only characters below U+0590 (one
meaning in all Unicode versions at hand) and no special string. tiktoken merges
two neighbours whenever their concatenation is a token, the library only if
that very pair is a merge. The check: all merges give distinct tokens, and each
token's own symbols, merged by the library's rule, end as that token alone. Then
the two agree: until a neighbour from outside takes part, the symbols of a
token's stretch merge as the token alone does, which passes through one state
of two symbols only, the pair of its merge. A file that fails goes through the
library. In ``words`` mode the end
of a word is a NUL byte, whose merges come first. Everything else goes through
the tokenizers library itself. Special strings inside a text are handled as
the library does by default.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from tessera.llm import scan

CACHE_CHUNKS = 2_000_000
SLICE_BYTES = 4 << 20
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = b"\0"
_RARE = re.compile("[^\x01-֏]")
_SPACES = re.compile(r"\s")

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[32, *range(9, 14)]] = True
#: Bytes that may start white space in any library's eyes.
_MAY_BE_SPACE = _ASCII_SPACE.copy()
_MAY_BE_SPACE[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def byte_symbols() -> dict[str, int]:
    """Symbol of each byte in byte-level vocabularies: printable ones stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def chunk_mode(spec: dict) -> str:
    """'led', 'words' or 'whole' for the contents of a tokenizer file."""
    for t in spec.get("added_tokens") or []:
        if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or _SPACES.search(t["content"]):
            return "whole"
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "led"
    parts = pre.get("pretokenizers") or []
    if norm and norm.get("type") == "Sequence" and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"] and len(parts) == 2:
        replace, (split, level) = norm["normalizers"][1], parts
        if (replace["pattern"] == {"Regex": "\\s+"} and replace["content"] == " " and split.get("type") == "Split" and split.get("invert")
                and split.get("behavior") == "Removed" and split["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
                and " " not in split["pattern"]["Regex"] and level.get("type") == "ByteLevel"
                and not level.get("use_regex") and not level.get("add_prefix_space")):
            return "words"
    return "whole"


def all_reached(merges: list[tuple[str, str]], suffix: str = "") -> bool:
    """Whether the symbols of every merged token, merged by pairs in the order of
    ``merges`` (leftmost first), end as that token alone."""
    rank = {m: k for k, m in enumerate(merges)}
    none = len(merges)
    for a, b in merges:
        token = a + b
        end = bool(suffix) and token.endswith(suffix)
        parts = list(token[: -len(suffix)] if end else token)
        if end:
            parts[-1] += suffix
        while len(parts) > 1:
            ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                return False
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.mode = chunk_mode(spec)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._ranked(spec) if self.mode != "whole" else None
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)

    def _ranked(self, spec: dict) -> object | None:
        """A tiktoken encoding with the file's merges as ranks and the map to its ids."""
        import tiktoken

        model, symbols = spec["model"], byte_symbols()
        suffix = model.get("end_of_word_suffix") or ""
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in odd) or bool(suffix) != (self.mode == "words"):
            return None

        def raw(token: str) -> bytes:
            end = bool(suffix) and token.endswith(suffix)
            return bytes(symbols[c] for c in (token[: -len(suffix)] if end else token)) + (END if end else b"")

        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        start = sorted(symbols, key=symbols.get)
        tokens = start + ([c + suffix for c in start] if suffix else []) + merged
        if len(set(tokens)) != len(tokens) or any(t not in model["vocab"] for t in tokens):
            return None
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if not all_reached(pairs, suffix):
            return None
        self.id_of = np.array([model["vocab"][t] for t in tokens], self.kind)
        self.bytes_of = np.array([len(raw(t)) for t in tokens], np.int64)
        self.gap = 256 + 32
        if self.mode == "words":
            import regex

            self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "| ")
        return tiktoken.Encoding("chunks", pat_str="[^\0]+\0" if self.mode == "words" else PATTERN,
                                 mergeable_ranks={raw(t): k for k, t in enumerate(tokens)}, special_tokens={})

    def _is_plain(self, chunk: str) -> bool:
        if self.fast is None or _RARE.search(chunk) or any(x in chunk for x in self.special):
            return False
        return self.mode == "led" or ("Σ" not in chunk and not _SPACES.search(chunk))

    def _encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each chunk."""
        plain = [self._is_plain(c) for c in chunks]
        fast = [c for c, p in zip(chunks, plain) if p]
        slow = [c for c, p in zip(chunks, plain) if not p]
        got: list[np.ndarray] = []
        n_fast = np.zeros(0, np.int64)
        if fast and self.mode == "led":
            # each chunk but the first of a text starts with its space; cuts between them hold
            joined = [c if c[:1] == " " else "" for c in fast]
            heads = [k for k, c in enumerate(joined) if not c]
            n_fast, flat = self._led(joined)
            got = np.split(flat, np.cumsum(n_fast)[:-1])
            for k in heads:
                got[k] = self.id_of[self.fast.encode_ordinary(fast[k])]
            n_fast = np.array([len(g) for g in got], np.int64)
        elif fast:
            text = unicodedata.normalize("NFC", " ".join(fast)).lower()
            ranks = np.array(self.fast.encode_ordinary("\0".join(self.pieces.findall(text)) + "\0"), np.int64)
            gaps = np.flatnonzero(ranks == self.gap)
            bounds = np.concatenate([[-1], gaps, [len(ranks)]])
            n_fast = np.diff(bounds) - 1
            got = np.split(self.id_of[np.delete(ranks, gaps)], np.cumsum(n_fast)[:-1])
        rest = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(slow, add_special_tokens=False)] if slow else []
        if not slow:
            return (np.concatenate(got) if len(got) else np.zeros(0, self.kind)), n_fast
        a, b = iter(got), iter(rest)
        out = [next(a) if p else next(b) for p in plain]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _led(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One pass over space-led chunks; the byte lengths of the tokens tell the chunks apart."""
        safe = [c if c and not c[-1].isspace() else "" for c in chunks]
        ranks = np.array(self.fast.encode_ordinary("".join(safe)), np.int64)
        ends = np.cumsum(self.bytes_of[ranks])
        stops = np.cumsum([len(c.encode()) for c in safe])
        upto = np.searchsorted(ends, stops, "right")
        n = np.diff(upto, prepend=0)
        flat = self.id_of[ranks]
        odd = [k for k, (c, s) in enumerate(zip(chunks, safe)) if c and not s]
        if not odd:
            return n, flat
        parts = np.split(flat, upto[:-1])
        for k in odd:
            parts[k] = self.id_of[self.fast.encode_ordinary(chunks[k])]
        return np.array([len(p) for p in parts], np.int64), np.concatenate(parts)

    def cuts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the chunks, and the first chunk of each text."""
        n = len(buf)
        if self.mode == "words":
            return scan.words(buf, offsets, ~_ASCII_SPACE)
        lengths = np.diff(offsets)
        first = np.zeros(n + 1, bool)
        first[offsets[:-1][lengths > 0]] = True
        if self.mode == "led" and n:
            cut = np.zeros(n, bool)
            cut[:-1] = (buf[:-1] == 32) & ~_MAY_BE_SPACE[buf[1:]]
            cut[offsets[1:][lengths > 0] - 1] = False  # the last byte of a text leads nothing
            first[:-1] |= cut
        s = np.flatnonzero(first[:-1])
        return s, np.append(s[1:], n)[: len(s)], np.searchsorted(s, offsets)

    def distinct(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted distinct chunk hashes, a start and end of each, the hash index
        of every chunk, and the first chunk of each text."""
        s, e, at = self.cuts(buf, offsets)
        h = scan.span_hash(scan.prefix_hash(buf), s, e)
        keys, where, which = np.unique(h, return_index=True, return_inverse=True)
        return keys, s[where], e[where], which, at

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a slice of texts and where each text's ids start."""
        keys, s, e, which, at = self.distinct(buf, offsets)
        k = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = k < len(self.keys)
        known[inside] = self.keys[k[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            data = buf.tobytes()
            flat, n = self._encode_new([data[a:b].decode("utf-8", "replace") for a, b in zip(s[new].tolist(), e[new].tolist())])
            place = np.searchsorted(self.keys, keys[new])
            start = len(self.flat) + np.cumsum(n) - n
            self.keys = np.insert(self.keys, place, keys[new])
            self.at, self.n = np.insert(self.at, place, start), np.insert(self.n, place, n)
            self.flat = np.concatenate([self.flat, flat])
        row = np.searchsorted(self.keys, keys)[which]
        n = self.n[row]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.at[row] - (ends - n), n) + np.arange(total)]
        starts = np.concatenate([[0], ends])[at]
        if len(self.keys) > CACHE_CHUNKS:
            self._forget()
        return ids, starts


_encoders: dict[str, ChunkEncoder] = {}


def encoder(name_or_path: str) -> ChunkEncoder:
    """One encoder per worker process and file, so its cache outlives a task."""
    if name_or_path not in _encoders:
        _encoders[name_or_path] = ChunkEncoder(vocabulary_path(name_or_path))
    return _encoders[name_or_path]


def vocabulary_path(name_or_path: str) -> str:
    """A file of the public tokenizers package by name, or a path as it is."""
    if os.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
