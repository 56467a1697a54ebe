"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A text becomes an array of code points, each mapped to a symbol class.  A small automaton over these
classes marks where pieces begin; its transition functions compose associatively, so the scan runs
over many lanes at once and no regular expression is used.  The slices feed a bounded cache of
merged pieces, and byte offsets of every id are kept so that any id range can be decoded alone.

Null text is treated as empty and gives no ids.  Repeated rows are encoded each on its own, texts of any length
whole; columns other than id and text are not read or returned.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Merged pieces kept by one worker, at most; a full cache keeps those that were met again.
CACHE_PIECES = 1 << 17
#: Lane length of the scan.
LANE = 128
#: Code points scanned at once.
SCAN = 1 << 20

# Symbol classes of code points.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE = range(6)
# Symbols after one look ahead: the last ones are white space before a non-space, and contractions.
S_LETTER, S_NUMBER, S_OTHER, S_RUN, S_BLANK_LAST, S_SPACE_LAST, S_SHORT, S_LONG = range(8)
# A rank above all ranks.
NONE = 1 << 40
# Filler behind the ids of a piece; no pair with it makes a token.
PAD = 1 << 20
# States: what the piece in progress is.  CLOSED: the next code point begins a piece in any case.
Q_CLOSED, Q_LETTER, Q_NUMBER, Q_OTHER, Q_RUN, Q_JOINING, Q_TWO_LEFT, Q_ONE_LEFT = range(8)

# White space by Unicode (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, from the Unicode general categories."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    table[32] = BLANK
    table[39] = QUOTE
    return table


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]."""
    nxt = np.zeros((8, 8), dtype=np.uint8)
    begins = np.ones((8, 8), dtype=bool)
    for sym, run in ((S_LETTER, Q_LETTER), (S_NUMBER, Q_NUMBER), (S_OTHER, Q_OTHER)):
        nxt[sym, :] = run
        begins[sym, [run, Q_JOINING]] = False
    nxt[S_RUN, :] = Q_RUN
    begins[S_RUN, Q_RUN] = False
    nxt[S_BLANK_LAST, :] = Q_JOINING
    nxt[S_SPACE_LAST, :] = Q_CLOSED
    for sym, left in ((S_SHORT, Q_ONE_LEFT), (S_LONG, Q_TWO_LEFT)):
        nxt[sym, :] = left
        nxt[sym, [Q_JOINING, Q_OTHER]] = Q_OTHER  # no contraction inside a run of other symbols
        begins[sym, [Q_JOINING, Q_OTHER]] = False
    nxt[:, Q_TWO_LEFT], begins[:, Q_TWO_LEFT] = Q_ONE_LEFT, False
    nxt[:, Q_ONE_LEFT], begins[:, Q_ONE_LEFT] = Q_CLOSED, False
    return nxt, begins


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbols with one look ahead (two for contractions) for the code points of one text."""
    cls = _classes()[points]
    sym = np.array([S_LETTER, S_NUMBER, S_OTHER, S_RUN, S_RUN, S_OTHER], dtype=np.uint8)[cls]
    white = (cls == BLANK) | (cls == SPACE)
    last = np.zeros(len(cls), dtype=bool)
    last[:-1] = white[:-1] & ~white[1:]
    sym[last & (cls == BLANK)] = S_BLANK_LAST
    sym[last & (cls == SPACE)] = S_SPACE_LAST
    quotes = np.flatnonzero(cls[:-1] == QUOTE)
    if len(quotes):
        one = points[quotes + 1]
        two = np.where(quotes + 2 < len(points), points[np.minimum(quotes + 2, len(points) - 1)], 0)
        sym[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
        pairs = ((ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l")))
        sym[quotes[np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])]] = S_LONG
    return sym


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray]:
    """The transition functions that occur, closed under composition with a symbol.

    Returns then[8 * f + symbol] = 8 * (f followed by symbol), and image[f, state].
    """
    nxt, _ = _automaton()
    first = tuple(range(8))
    known, queue, rows = {first: 0}, [first], []
    for f in queue:  # grows while it is read
        row = []
        for sym in range(8):
            g = tuple(int(nxt[sym, q]) for q in f)
            if g not in known:
                known[g] = len(known)
                queue.append(g)
            row.append(8 * known[g])
        rows.append(row)
    return np.array(rows, dtype=np.int64).ravel(), np.array(queue, dtype=np.int64)


def _scan(sym: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Where pieces begin in one stretch of symbols that is entered in ``state``.

    Lanes are composed side by side into one transition function each; these give the state in which
    every lane is entered, and a second pass marks the beginnings.
    """
    nxt, begins = _automaton()
    then, image = _monoid()
    n = len(sym)
    lanes = max(1, n // LANE)
    grid = np.ascontiguousarray(sym[: lanes * LANE].reshape(-1, lanes, min(LANE, n) if n < LANE else LANE)[0].T).astype(np.int64)
    f = np.zeros(grid.shape[1], dtype=np.int64)
    for col in grid:
        f = then.take(f + col)
    entry = np.empty(len(f), dtype=np.int64)
    q = state
    table = image.tolist()
    for i, g in enumerate((f >> 3).tolist()):
        entry[i] = q
        q = table[g][q]
    step, starts = nxt.T.astype(np.int64).ravel() << 3, np.ascontiguousarray(begins.T).ravel()
    out = np.empty(grid.shape, dtype=bool)
    entry <<= 3
    for i, col in enumerate(grid):
        at = entry + col
        out[i] = starts.take(at)
        entry = step.take(at)
    marks = np.empty(n, dtype=bool)
    done = grid.size
    marks[:done] = out.T.reshape(-1)
    for i in range(done, n):  # less than one lane
        marks[i] = begins[sym[i], q]
        q = int(nxt[sym[i], q])
    return marks, q


def piece_starts(text: str) -> np.ndarray:
    """Code-point offsets at which the pieces of ``text`` begin."""
    return _group_starts([text])[0]


def _group_starts(group: list[str]) -> list[np.ndarray]:
    # A white separator ends each text as the end of a text does, and closes the piece before it.
    sizes = np.array([len(x) for x in group])
    ends = np.cumsum(sizes + 1)
    sym = _symbols(np.frombuffer(("\n".join(group) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    sym[ends - 1] = S_SPACE_LAST
    marks = np.empty(len(sym), dtype=bool)
    state = Q_CLOSED
    for a in range(0, len(sym), SCAN):
        marks[a : a + SCAN], state = _scan(sym[a : a + SCAN], state)
    at = np.flatnonzero(marks)
    first, cut = np.searchsorted(at, ends - 1 - sizes), np.searchsorted(at, ends - 1)
    return [at[a:b] - (e - 1 - n) for a, b, e, n in zip(first, cut, ends, sizes)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pack(ids: list[int]) -> bytes:
    return np.array(ids, dtype=np.int32).tobytes()


class PieceCache(dict):
    """Piece -> its ids as packed int32, merged on first sight; a full cache keeps the pieces of several groups of texts."""

    def __init__(self, ranks: dict[bytes, int], limit: int = CACHE_PIECES):
        super().__init__()
        self.ranks, self.limit = ranks, limit
        self.again: set[str] = set()
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys_ = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys_.tolist()] + [NONE], dtype=np.int64)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair of ids makes; NONE where it makes none."""
        key = left << 32 | right
        at = np.searchsorted(self.keys_, key)
        at[at == len(self.keys_)] = 0
        return np.where(self.keys_[at] == key, self.merged[at], NONE)

    def __missing__(self, piece: str) -> bytes:
        return pack(merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks))

    def learn(self, pieces: set[str]) -> None:
        """Merge the pieces that are not cached, all short ones side by side."""
        new = [p for p in pieces if p not in self]
        self.again.update(pieces.difference(new))
        if len(self) + len(new) > self.limit:
            kept = {p: self[p] for p in self.again} if len(self.again) + len(new) <= self.limit else {}
            self.clear()
            self.update(kept)
            self.again.clear()
            new = [p for p in pieces if p not in self]
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self[p] = pack([whole])
            elif len(raw) > 48:
                self[p] = pack(merge_piece(raw, self.ranks))
            else:
                by_size.setdefault(-(-len(raw) // 6) * 6, []).append((p, raw))
        for size, group in by_size.items():
            for a in range(0, len(group), 8192):
                part = group[a : a + 8192]
                raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for _, x in part), dtype=np.uint8).reshape(-1, size)
                ids = self.single[raw]
                ids[np.arange(size) >= np.array([len(x) for _, x in part])[:, None]] = PAD
                self.update(zip((p for p, _ in part), self.merge_rows(ids)))

    def merge_rows(self, ids: np.ndarray) -> list[bytes]:
        """Ids of many padded pieces: in each step every row merges its leftmost pair of lowest rank."""
        out = [b""] * len(ids)
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(ids))
        while ids.shape[1] > 1:
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(at)), at]
            done = low == NONE
            if done.any():
                ended = ids[done]
                raw = ended.astype(np.int32).tobytes()
                width = 4 * ended.shape[1]
                for k, (r, n) in enumerate(zip(rows[done].tolist(), (4 * (ended != PAD).sum(axis=1)).tolist())):
                    out[r] = raw[k * width : k * width + n]
                go = ~done
                ids, rank, rows, at, low = ids[go], rank[go], rows[go], at[go], low[go]
                if not len(ids):
                    return out
            each = np.arange(len(ids))
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            ids[each, at] = low
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1)
            for pos in (at - 1, at):
                ok = (pos >= 0) & (pos < rank.shape[1])
                rank[each[ok], pos[ok]] = self.rank_of(ids[each[ok], pos[ok]], ids[each[ok], pos[ok] + 1])
        for r, x in zip(rows.tolist(), ids.tolist()):
            out[r] = pack(x)
        return out


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: join the adjacent pair of lowest rank, leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
    while pair:
        low = min(pair)
        if low == 1 << 30:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and links, so that a very long piece takes n log n steps."""
    import heapq

    n = len(piece)
    end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged meanwhile
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(piece[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[PieceCache, list[bytes]]:
    ranks = read_ranks(path)
    back = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        back[rank] = token
    return PieceCache(ranks), back


def encode_batch(texts: list[str], cache: PieceCache) -> list[np.ndarray]:
    """Ids of each text; texts are cut into pieces ``SCAN`` code points at a time, which bounds memory."""
    out, group, size = [], [], 0
    for i, text in enumerate(texts, 1):
        group.append(text)
        size += len(text)
        if size >= SCAN or i == len(texts):
            out += _encode_group(group, cache)
            group, size = [], 0
    return out


def _encode_group(texts: list[str], cache: PieceCache) -> list[np.ndarray]:
    pieces = []
    for text, starts in zip(texts, _group_starts(texts)):
        at = starts.tolist()
        pieces.append(list(map(text.__getitem__, map(slice, at, [*at[1:], len(text)]))))
    cache.learn(set(chain.from_iterable(pieces)))
    return [np.frombuffer(b"".join(map(cache.__getitem__, x)), dtype=np.int32) for x in pieces]


def encode(path: str) -> Callable[[Column], Column]:
    """Column of texts -> column of ids, by the rank file at ``path`` on every executor."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def to_ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = _loaded(path)[0]
        for part in parts:
            texts = [x if isinstance(x, str) else "" for x in part]
            yield pd.Series(encode_batch(texts, cache), dtype=object)

    return to_ids


def decode(path: str) -> Callable[[Column], Column]:
    """Column of ids -> column of the bytes they stand for; null ids give no bytes."""

    @F.pandas_udf(T.BinaryType())
    def to_bytes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        back = _loaded(path)[1]
        for part in parts:
            yield pd.Series([b"" if ids is None else b"".join(map(back.__getitem__, ids.tolist())) for ids in part], dtype=object)

    return to_bytes


def digest(path: str) -> Callable[[Column], Column]:
    """Column of texts -> struct of the id count and the SHA-256 of the ids and of what they decode to.

    Encodes and decodes as the two functions above do, but the ids stay in the Python worker.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def to_digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache, back = _loaded(path)
        for part in parts:
            rows = []
            for a in range(0, len(part), 256):
                texts = [x if isinstance(x, str) else "" for x in part.iloc[a : a + 256]]
                for packed in encode_batch(texts, cache):
                    ids = packed.tolist()
                    written = hashlib.sha256(" ".join(map(str, ids)).encode())
                    rows.append((len(ids), written.hexdigest(), hashlib.sha256(b"".join(map(back.__getitem__, ids))).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return to_digest


def offsets(path: str) -> Callable[[Column], Column]:
    """Column of ids -> byte offset at which each id's bytes begin in the decoded text."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def to_offsets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = np.array([len(x) for x in _loaded(path)[1]], dtype=np.int64)
        for part in parts:
            yield pd.Series([np.concatenate(([0], np.cumsum(size[np.asarray(ids, dtype=np.int64)])[:-1])).astype(np.int32) if ids is not None and len(ids) else np.zeros(0, np.int32) for ids in part], dtype=object)

    return to_offsets


def encode_documents(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, ids, offsets, intact) of every row.

    ``offsets`` are the byte offsets at which the ids begin; ``intact`` tells that every id decodes to the
    text's bytes from its offset to the next one's, and that these cover the text.
    """

    def encode_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, back = _loaded(path)
        size = np.array([len(x) for x in back], dtype=np.int64)
        for part in parts:
            for a in range(0, len(part), 256):
                some = part.iloc[a : a + 256]
                texts = [x if isinstance(x, str) else "" for x in some[text]]
                ids = encode_batch(texts, cache)
                ends = [np.cumsum(size[i]) for i in ids]
                offsets = [(e - size[i]).astype(np.int32) for e, i in zip(ends, ids)]
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                # bytes of all ids behind one another are the text's just if each id stands at its offset
                intact = [b"".join(map(back.__getitem__, i.tolist())) == t and (e[-1] if len(e) else 0) == len(t) for i, e, t in zip(ids, ends, raw)]
                yield pd.DataFrame({doc: some[doc].astype(object), "n_tokens": [len(i) for i in ids], "ids": ids, "offsets": offsets, "intact": intact})

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(doc, text).mapInPandas(encode_rows, f"`{doc}` {kind}, n_tokens long, ids array<int>, offsets array<int>, intact boolean")
