"""Token counts by finite-state transducers (operator 6).

Two deterministic machines count the tokens of a byte-level BPE vocabulary without running its merges:

* The *cutter* is a Mealy machine of eight states over classes of characters. It marks where the pieces begin that the
  vocabulary's pattern cuts a text into. Texts of a batch are laid end to end and split into blocks of equal length; each
  block's map from entry state to exit state is computed for all blocks at once, the maps are composed by a parallel
  prefix scan, and the blocks are then run from their true entry states.
* The *counter* is a transducer over the bytes of a piece. A transition carries the signed number of tokens by which the
  encoding of the longer prefix differs from that of the shorter, so the sum along a piece's path is its token count.
  A state holds, for each vocabulary prefix that ends here, the last token before it and how many tokens ago that was;
  that is all which later bytes can depend on. States and transitions are compiled when first needed and then shared.

Null texts count as empty. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmill.runtime import prepare

# Symbols and states of the cutter.
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACE_LAST, WHITE_LAST, WHITE, SEPARATOR = range(9)
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINS_NEXT, ONE_MORE, TWO_MORE, IN_WHITE = range(8)
STATES, BLOCK = 8, 64
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Pieces whose counts a worker remembers, and transitions that it keeps, before it starts afresh.
MEMO, TRANSITIONS = 900_000, 600_000


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]."""
    follow = np.zeros((9, STATES), np.uint8)
    begins = np.ones((9, STATES), bool)
    for symbol, within in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        follow[symbol] = within
        begins[symbol, [within, JOINS_NEXT]] = False
    for state, then in ((TWO_MORE, ONE_MORE), (ONE_MORE, DONE)):
        follow[LETTER, state], begins[LETTER, state] = then, False
    for symbol, then in ((QUOTE2, ONE_MORE), (QUOTE3, TWO_MORE)):
        follow[symbol] = then
        follow[symbol, [IN_OTHERS, JOINS_NEXT]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, JOINS_NEXT]] = False
    follow[SPACE_LAST], follow[WHITE_LAST], follow[WHITE] = JOINS_NEXT, DONE, IN_WHITE
    begins[WHITE, IN_WHITE] = False
    follow[SEPARATOR], begins[SEPARATOR] = DONE, False
    return follow, begins


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE for every code point."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        out[list(WHITE_SPACE)] = WHITE
        _classes = out
    return _classes


def symbols(code: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """The cutter's input: each character's class with what the pattern's lookahead would see."""
    kind = classes()[code]
    after = np.full(len(code) + 3, SEPARATOR, np.uint8)
    after[: len(kind)] = kind
    after[separators] = SEPARATOR
    white = kind == WHITE
    last = white & (after[1 : len(kind) + 1] != WHITE) & (after[1 : len(kind) + 1] != SEPARATOR)
    out = kind.copy()
    out[last] = np.where(code[last] == 0x20, SPACE_LAST, WHITE_LAST)
    quotes = np.flatnonzero(code == 0x27)
    if len(quotes):
        padded = np.concatenate([code, np.zeros(2, code.dtype)])
        padded[separators] = 0
        one, two = padded[quotes + 1], padded[quotes + 2]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE2
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[quotes[pair]] = QUOTE3
    out[separators] = SEPARATOR
    return out


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps under composition: row i becomes maps[i] after ... after maps[0]."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def piece_starts(symbol: np.ndarray) -> np.ndarray:
    """Indices at which a piece begins."""
    follow, begins = _cutter()
    n = len(symbol)
    blocks = -(-n // BLOCK)
    lanes = np.full(blocks * BLOCK, SEPARATOR, np.uint8)
    lanes[:n] = symbol
    lanes = np.ascontiguousarray(lanes.reshape(blocks, BLOCK).T).astype(np.intp)
    flat = follow.ravel()
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (blocks, STATES)).copy()
    for row in lanes:
        maps = flat[row[:, None] * STATES + maps]
    state = np.zeros(blocks, np.intp)
    if blocks > 1:
        state[1:] = scan(maps[:-1])[:, DONE]
    mark, starts = np.empty((BLOCK, blocks), bool), begins.ravel()
    for i, row in enumerate(lanes):
        at = row * STATES + state
        mark[i], state = starts[at], flat[at]
    return np.flatnonzero(mark.T.ravel()[:n])


class Counter:
    """The transducer of one byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        # Tokens are numbered by rank: bytes first, then merges in their order.
        rank = {c: b for c, b in byte_of.items()}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for pair in merges:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            new = rank.setdefault(left + right, len(self.parts))
            if new == len(self.parts):
                self.parts.append((rank[left], rank[right]))
            self.joined.setdefault((rank[left], rank[right]), new)
        assert all(t in rank or t in self.specials for t in vocab)
        # The trie of all tokens: kids[node] maps a byte to a node, token[node] is the rank or -1.
        self.kids: list[dict[int, int]] = [{}]
        self.token = [-1]
        for text, number in rank.items():
            node = 0
            for c in text:
                b = byte_of[c]
                if b not in self.kids[node]:
                    self.kids[node][b] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                node = self.kids[node][b]
            self.token[node] = number
        self.restart()

    def restart(self) -> None:
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, int] = {"": 0}
        self.states: dict[tuple, int] = {((0, -1, 0),): 0}
        self.tails: list[tuple] = [((0, -1, 0),)]
        #: state << 8 | byte -> next state << 9 | change of the count + 256
        self.next: dict[int, int] = {}

    def stable(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two tokens."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._stable(left, right)
        return known

    def _stable(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges, again and again; a merge across the seam that comes before the one undone breaks the pair.
        bound = len(self.parts) + 1
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            if left > right or right < 256:
                if left < 256:
                    return True
                bound, left = left, self.parts[left][1]
            else:
                bound, right = right + 1, self.parts[right][0]

    def compile(self, state: int, byte: int) -> int:
        """The transition of a state under a byte."""
        kept, delta, chosen = [], 0, -1
        for node, before, ago in self.tails[state]:
            child = self.kids[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if chosen < 0 and token >= 0 and (before < 0 or self.stable(before, token)):
                chosen, delta = token, ago + 1
            if self.kids[child]:
                kept.append((child, before, ago))
        tail = (*((node, before, ago - delta) for node, before, ago in kept), (0, chosen, 0))
        new = self.states.get(tail)
        if new is None:
            new = self.states[tail] = len(self.tails)
            self.tails.append(tail)
        self.next[state << 8 | byte] = out = new << 9 | delta + 256
        return out

    def count_piece(self, piece: str) -> int:
        state, total, follow = 0, 0, self.next
        for byte in piece.encode():
            step = follow.get(state << 8 | byte)
            if step is None:
                step = self.compile(state, byte)
            state = step >> 9
            total += (step & 511) - 256
        return total

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; the vocabulary's special strings are one token each, as in the library by default."""
        if not texts:
            return np.zeros(0, np.int64)
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = [text]
            for special in self.specials:
                if special in text:
                    cut = [x for piece in cut for x in piece.split(special)]
            extra[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        if len(self.next) > TRANSITIONS:
            self.restart()
        elif len(self.memo) > MEMO:
            self.memo = {"": 0}
        joined = "\n".join(parts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = piece_starts(symbols(code, ends))
        if not len(starts):
            return extra
        # A piece ends where the next begins, but before the separator.
        part = np.searchsorted(ends, starts)
        stops = np.minimum(np.append(starts[1:], len(code)), ends[part])
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        memo = self.memo
        try:
            numbers = np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            for piece in set(pieces):
                if piece not in memo:
                    memo[piece] = self.count_piece(piece)
            numbers = np.fromiter(map(memo.__getitem__, pieces), np.int64, len(pieces))
        return extra + np.bincount(np.asarray(owner)[part], weights=numbers, minlength=len(texts)).astype(np.int64)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def groups(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive rows whose sizes sum to most, or single rows."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    yield slice(begin, len(sizes))


def count_tokens(df: DataFrame, path: str, text: str = "text", into: str = "n_tokens", most_chars: int = 1_000_000) -> DataFrame:
    """df with the columns n_bytes and ``into`` (both long) added after its own, which must not have these names.

    path: a byte-level BPE file of the ``tokenizers`` library that every executor can read. Null texts count 0. No shuffle.
    """
    from pyspark.sql.types import LongType, StructType

    prepare(df.sparkSession)
    names = df.columns
    if clash := {into, "n_bytes"} & set(names):
        raise ValueError(f"columns in use: {sorted(clash)}")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            tokens = np.concatenate([machine.count(texts[s]) for s in groups(sizes, most_chars)]) if texts else np.zeros(0, np.int64)
            n_bytes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_bytes), pa.array(tokens)], [*names, "n_bytes", into])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add("n_bytes", LongType()).add(into, LongType()))
