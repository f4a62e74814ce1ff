"""Exact ids of a byte-level BPE vocabulary, fast: one loaded pair of encoders for each worker process.

The file's own library is the definition. A second, faster library with the same merges is used for texts
of characters on which both libraries' patterns agree (SAFE, which the tests compare one by one); a text
with any other character goes to the defining library. Long texts are encoded as a tree of leaves cut
anywhere (Codec.encode_tree), and so are pre-tokens of more than LEAF * 2 bytes, which no pattern splits
(tree_encode).
"""

from __future__ import annotations

import functools
import json
import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges of characters on which the two libraries' classes agree.
SAFE = "\x00-\x1b\x20-\x7e\xa1-ɀΑ-ΡΣ-ώЀ-ҁ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣"
_UNSAFE = regex.compile(f"[^{SAFE}]")
LEAF = 2048
#: LEAF characters of one class from a place on; every run of twice as many has such a place at a multiple of LEAF.
_RUN = regex.compile(rf"\p{{L}}{{{LEAF}}}|\p{{N}}{{{LEAF}}}|[^\s\p{{L}}\p{{N}}]{{{LEAF}}}|\s{{{LEAF}}}")
SPLIT = regex.compile(PATTERN)
#: Characters of a leaf of a long text, and of a window's first half.
LEAF_TEXT = 1 << 12
GROW = 64
THREADS = 4
_EDGE = regex.compile(r"[A-Za-z0-9](?=[ \n\t])")
_LAST_EDGE = regex.compile(r"(?s)(.*[A-Za-z0-9])(?=[ \n\t])")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {chr(b): b for b in own}, 256
    for b in range(256):
        if b not in own:
            out[chr(spare)] = b
            spare += 1
    return out


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE in JSON)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _bytes_of_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(symbols[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes_of.items()}, special_tokens=self.special)
        self.all_bytes = self.bytes_of | {i: s.encode() for s, i in self.special.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.allowed = set(self.special)
        self.leaves = 1  # of the text encoded last
        self._pool: ThreadPoolExecutor | None = None

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token, by its length directly or as a tree."""
        one = self.fast._encode_single_piece
        return one(raw) if len(raw) <= 2 * LEAF else tree_encode(raw, one, self.all_bytes, leaves=lambda parts: [x.tolist() for x in self._each([p.decode() for p in parts], True)])

    def parts(self, text: str):
        """Pre-tokens of a safe text in order; a special string comes as its id."""
        for part in self._special.split(text) if self._special else (text,):
            if part in self.special:
                yield self.special[part]
            else:
                yield from SPLIT.findall(part)

    @staticmethod
    def safe(text: str) -> bool:
        return text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f\x7f") or not _UNSAFE.search(text)

    def _flat(self, text: str, safe: bool) -> np.ndarray:
        """Ids of a text as a library gives them in one go."""
        if safe:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=()).view(np.int32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _each(self, texts: list[str], safe: bool) -> list[np.ndarray]:
        """Ids of each text, side by side: the fast library lets other threads run while it works."""
        if len(texts) < 2 or not safe:
            return [self._flat(t, safe) for t in texts]
        if self._pool is None:
            self._pool = ThreadPoolExecutor(THREADS)
        return list(self._pool.map(lambda t: self._flat(t, True), texts))

    def encode_array(self, text: str) -> np.ndarray:
        """Ids of a text; one of more than 2 * LEAF_TEXT characters is a tree of leaves (see encode_tree)."""
        self.leaves, safe = 1, self.safe(text)
        if safe and any(_RUN.match(text, p) for p in range(0, len(text) - LEAF + 1, LEAF)):
            out: list[int] = []
            for part in self.parts(text):
                out += [part] if isinstance(part, int) else self.piece(part.encode())
            return np.array(out, np.int32)
        return self._flat(text, safe) if len(text) <= 2 * LEAF_TEXT else self.encode_tree(text, safe)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def encode_tree(self, text: str, safe: bool, leaf: int | None = None) -> np.ndarray:
        """Ids of a long text by tree concatenation: halves down to leaves wherever they fall, encoded side by
        side; then neighbours are joined, level by level, by windows around the cut (_join)."""
        self.leaves = 1 << max(0, (-(-len(text) // (leaf or LEAF_TEXT)) - 1).bit_length())
        at = [len(text) * i // self.leaves for i in range(self.leaves + 1)]
        level = list(zip(at[:-1], at[1:], self._each([text[i:j] for i, j in zip(at[:-1], at[1:])], safe)))
        while len(level) > 1:
            level = [self._join(text, level[i], level[i + 1], safe) for i in range(0, len(level), 2)]
        return level[0][2]

    def _join(self, text: str, left: tuple, right: tuple, safe: bool) -> tuple:
        """(start, end, ids) of two neighbours as one.

        A window from an edge in the left part to an edge in the right part is encoded anew. An edge is a place
        between a letter or digit and a space, where every scan of the pattern stops, whatever is around; so the
        ids of both parts outside the window stay. The sides agree when what the window replaces, encoded alone,
        is what the parts have there; else the window doubles, at most to both parts whole.
        """
        (start, cut, x), (_, end, y) = left, right
        k = GROW
        while True:
            p, q = start, end
            if cut - k > start:
                m = _EDGE.search(text, cut - k, cut)
                p = m.end() if m else None
            if cut + k < end:
                m = _LAST_EDGE.match(text, cut, cut + k)
                q = m.end(1) if m else None
            if p is not None and q is not None:
                a, b = self._flat(text[p:cut], safe), self._flat(text[cut:q], safe)
                if np.array_equal(x[len(x) - len(a) :], a) and np.array_equal(y[: len(b)], b):
                    return start, end, np.concatenate([x[: len(x) - len(a)], self._flat(text[p:q], safe), y[len(b) :]])
            k *= 2

    def decode(self, ids) -> str:
        try:
            return self.fast.decode_bytes(ids).decode("utf-8", errors="replace")
        except (KeyError, OverflowError, TypeError):
            return b"".join([self.all_bytes.get(i, b"") for i in ids]).decode("utf-8", errors="replace")


def join(left: list[int], right: list[int], encode, bytes_of: dict[int, bytes]) -> list[int]:
    """The ids of the bytes of left and right together, each being the ids of its own bytes.

    A list of ids is the encoding of its bytes when each neighbouring pair is the encoding of the pair's
    bytes. A window around the join is encoded anew; where its first id is left's and its last is right's,
    every pair holds, and the lists meet there. Else the window doubles, at most to both lists whole.
    """
    if not left or not right:
        return left + right
    k = 4
    while True:
        a, b = left[-k:], right[:k]
        w = encode(b"".join([bytes_of[i] for i in a]) + b"".join([bytes_of[i] for i in b]))
        if (k >= len(left) or w[0] == a[0]) and (k >= len(right) or w[-1] == b[-1]):
            return left[: -len(a)] + w + right[len(b) :]
        k *= 2


def tree_encode(raw: bytes, encode, bytes_of: dict[int, bytes], leaf: int = LEAF, leaves=None) -> list[int]:
    """Ids of an unsplit run of bytes: halves down to leaves of whole characters, then joined upwards in pairs.

    leaves: encodes a list of leaves side by side; else `encode` takes one after another.
    """
    n = 1 << max(0, (-(-len(raw) // leaf) - 1).bit_length())
    at = [len(raw) * i // n for i in range(n + 1)]
    for i, p in enumerate(at):
        while 0 < p < len(raw) and raw[p] & 0xC0 == 0x80:
            p -= 1
        at[i] = p
    parts = [raw[i:j] for i, j in zip(at[:-1], at[1:]) if i < j]
    level = leaves(parts) if leaves else [encode(p) for p in parts]
    while len(level) > 1:
        level = [join(level[i], level[i + 1], encode, bytes_of) for i in range(0, len(level) - 1, 2)] + level[len(level) // 2 * 2 :]
    return level[0] if level else []


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)
