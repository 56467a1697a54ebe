"""Removal of byte strings of LENGTH that also start in a document with a smaller id.

Equal texts are one class from the start: every later copy is covered as a whole.  Of the distinct texts,
every string of LENGTH bytes has an anchor: the leftmost of its GRAM-byte grams with the smallest hash.
Equal strings have equal anchors at equal places, so only strings around the same anchor need
comparing.  A stretch around an anchor (all strings it is the anchor of) is a segment.

1. Texts are dealt into chunks of CHUNK rows.  Each chunk tells each bucket of hashes which anchors it
   has and the digest of each one's segment, as packed numbers; the bucket answers each chunk which of
   its anchors stand elsewhere too, and which of these have different segments.  Answers go back to
   their chunk, so nothing of the size of the corpus is broadcast or sent to the driver.
2. Where all segments of an anchor are equal, their smallest id is that of all their strings.
3. The distinct segments of other anchors that share anything are joined into one text for each anchor,
   whose suffix array is built by linear grouping (``grouping_sa``); neighbours in suffix order with
   LENGTH equal bytes are one string, and the smallest id of its segments is the string's.  An anchor with more than MOST distinct segments is
   split by the place of the anchor in the string, each part with a wider anchor: first into parts of PART
   places, then into single places, where all strings of a part are equal.  No task ever holds a hot anchor.
4. Each text takes the ids back through its segments; strings of smaller ids mark their bytes.

Null text is empty.  Rows with a null id neither remove nor lose anything.  Rows that share an id
don't remove each other's bytes.  Repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.llm import textkernel
from scopespark.llm.grouping_sa import suffix_array
from scopespark.session import discard, spool

LENGTH, GRAM = 50, 28
_WIDE = LENGTH - GRAM + 1
#: log2 of the rows of a chunk; bytes of packed anchors that a bucket holds.
CHUNK, BUCKET = 9, 12 << 20
#: Bytes whose anchors are found at once, and strings compared at once.
PIECE, ROWS = 1 << 16, 20_000
#: Segments of one anchor that are sorted together.
MOST = 512
#: Places of the anchor that a part of a hot anchor has, and then a part of such a part.
PART = (4, 1)
_LOW = np.uint64((1 << 40) - 1)


#: A random number for each byte.
_SYMBOL = textkernel.mix64(np.arange(1, 257, dtype=np.uint64))


def _slide(x: np.ndarray, wide: int, low: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``wide`` neighbours, by doubling."""
    f = np.minimum if low else np.maximum
    n, span = len(x), 1
    while span * 2 <= wide:
        x = f(x[: len(x) - span], x[span:])
        span *= 2
    rest = wide - span
    return f(x[: n - wide + 1], x[rest : rest + n - wide + 1]) if rest else x


def anchors(rows: list[bytes]) -> tuple[np.ndarray, ...]:
    """(row, hash, position, first, last, seg): anchors of texts and the strings each is the anchor of.

    String s (the LENGTH bytes from s on) has its anchor at the leftmost minimum over grams s to
    s + LENGTH - GRAM; ``first`` and ``last`` bound the strings of an anchor, ``seg`` is a digest of its
    segment's bytes and of the anchor's place in it.  Short texts are handled in one buffer.
    """
    out: list[tuple] = []
    for lo, hi in textkernel.blocks(rows, PIECE):
        if hi - lo == 1:
            row, step = rows[lo], PIECE
            for a in range(0, max(len(row) - LENGTH + 1, 0), step):
                own = _anchors(row[a : a + step + LENGTH - 1], np.array([0]), np.array([min(step + LENGTH - 1, len(row) - a)]))
                if own:
                    out.append((own[0] + lo, own[1], own[2] + a, own[3] + a, own[4] + a, own[5]))
        else:
            ends = np.cumsum([len(x) for x in rows[lo:hi]])
            own = _anchors(b"".join(rows[lo:hi]), np.concatenate(([0], ends[:-1])), ends)
            if own:
                out.append((own[0] + lo, *own[1:]))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchors(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """The same for one buffer of texts; positions count from each text's start."""
    n = len(text)
    if n < LENGTH:
        return None
    buf = np.frombuffer(text, dtype=np.uint8)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL[buf] * textkernel._power("up", n), out=total[1:])
    back = textkernel._power("down", n + 1)
    h = textkernel.mix64((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])
    # the position in the low bits makes the leftmost of equal minima the smallest
    place = np.uint64((1 << 21) - 1)
    at = (_slide((h & ~place) | np.arange(len(h), dtype=np.uint64), _WIDE, True) & place).astype(np.int64)
    string = np.arange(len(at))
    row = np.repeat(np.arange(len(starts)), ends - starts)[: len(at)]
    inside = np.flatnonzero(string + LENGTH <= ends[row])  # no string reaches into the next text
    if not len(inside):
        return None
    at, row = at[inside], row[inside]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    pos, row, first, last = at[new], row[new], inside[new], inside[np.append(new[1:], len(at)) - 1]
    shape = ((pos - first) << 8 | (last - first)).astype(np.uint64)
    seg = textkernel.mix64((total[last + LENGTH] - total[first]) * back[first] ^ textkernel.mix64(shape))
    return row, h[pos], pos - starts[row], first - starts[row], last - starts[row], seg


def _pack(low: np.ndarray) -> bytes:
    """40-bit numbers, five bytes each."""
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    five = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), dtype=np.uint8)
    out[:, :5] = five
    return out.view("<u8").ravel()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bits 40 and up, which choosing minima leaves even; ``buckets`` is a power of two."""
    return (hashes >> np.uint64(40) & np.uint64(buckets - 1)).astype(np.int64)


def repeated_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, one, more): hashes (40 bits) of a chunk's anchors that stand in several texts, with
    equal segments (``one``) and with different ones (``more``).

    Hashes that only seem equal cost time, never a result.
    """

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for chunk, own in part.groupby(part["row"].to_numpy(dtype=np.int64) >> CHUNK):
                _, h, _, _, _, seg = anchors(textkernel.to_bytes(own["text"]))
                if not len(h):
                    continue
                order = np.lexsort((seg, h))
                h, seg = h[order], seg[order]
                at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (seg[1:] != seg[:-1]))))
                edge = h[at][1:] != h[at][:-1]
                first, last = np.append(True, edge), np.append(edge, True)
                several = (np.diff(np.append(at, len(h))) > 1) | ~(first & last)
                two = first | last  # two segments of an anchor tell that they differ
                at, several = at[two], several[two]
                b = _bucket(h[at], buckets)
                order = np.argsort(b, kind="stable")
                at, b, several = at[order], b[order], several[order]
                key, seg = h[at] & _LOW, seg[at] & _LOW
                cuts = np.flatnonzero(np.diff(b, prepend=-1))
                ends = np.append(cuts[1:], len(b))
                yield pd.DataFrame({
                    "bucket": b[cuts], "chunk": int(chunk),
                    "keys": [_pack(key[x:y]) for x, y in zip(cuts, ends)],
                    "segs": [_pack(seg[x:y]) for x, y in zip(cuts, ends)],
                    "several": [np.packbits(several[x:y]).tobytes() for x, y in zip(cuts, ends)],
                })

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        keys, segs = [_unpack(x) for x in part["keys"]], [_unpack(x) for x in part["segs"]]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(k)) for x, k in zip(part["several"], keys)])
        source = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key, seg = np.concatenate(keys), np.concatenate(segs)
        order = np.lexsort((seg, key))
        key, seg, several, source = key[order], seg[order], several[order], source[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(new)
        group, size = np.cumsum(new) - 1, np.diff(np.append(at, len(key)))
        repeated = (size > 1) | (np.maximum.reduceat(several, at) > 0)
        mixed = seg[at] != seg[np.append(at[1:], len(seg)) - 1]
        kind = np.where(repeated, 1 + mixed, 0)[group]
        order = np.lexsort((key, kind, source))
        key, kind, source = key[order], kind[order], source[order]
        sides = [np.searchsorted(source * 3 + kind, np.arange(len(keys)) * 3 + k) for k in (1, 2, 3)]
        out = [(c, _pack(key[a:b]), _pack(np.unique(key[b:e]))) for c, a, b, e in zip(part["chunk"], *sides) if e > a]
        return pd.DataFrame(out, columns=["chunk", "one", "more"]).assign(bucket=int(part["bucket"].iloc[0]))[["chunk", "bucket", "one", "more"]]

    sent = texts.select("row", "text").mapInPandas(send, "bucket int, chunk long, keys binary, segs binary, several binary")
    return sent.groupBy("bucket").applyInPandas(meet, "chunk long, bucket int, one binary, more binary")


def segments(texts: DataFrame, told: DataFrame, buckets: int, kind: str) -> DataFrame:
    """Rows of two kinds.  Places: (t, s, row, doc, first, n).  Segments, once a chunk: (h, s, low, n) and for
    anchors with different segments also their bytes and lead.

    ``h`` is the anchor, ``t`` its 16 leading bits and ``s`` the digest of its segment; ``lead`` is the anchor's offset, ``n`` the
    number of strings, ``low`` the smallest id of the chunk that has the segment.
    """

    def cut(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["h", "t", "s", "row", "doc", "first", "n", "low", "bytes", "lead"]
        if not len(own) or not len(answers):
            return pd.DataFrame([], columns=names)
        lists = [[np.sort(_unpack(x)) for x in answers[k]] for k in ("one", "more")]
        of = np.full(buckets, -1)
        of[answers["bucket"].to_numpy()] = np.arange(len(answers))
        rows = textkernel.to_bytes(own["text"])
        text, h, pos, first, last, seg = anchors(rows)
        b, key = of[_bucket(h, buckets)], h & _LOW
        state = np.zeros(len(h), dtype=np.int8)
        order = np.argsort(b, kind="stable")
        edge = np.searchsorted(b[order], np.arange(len(answers) + 1))
        for k in range(len(answers)):
            here = order[edge[k] : edge[k + 1]]
            for value, have in ((1, lists[0][k]), (2, lists[1][k])):
                if len(have) and len(here):
                    at = np.minimum(np.searchsorted(have, key[here]), len(have) - 1)
                    state[here[have[at] == key[here]]] = value
        use = np.flatnonzero(state)
        if not len(use):
            return pd.DataFrame([], columns=names)
        ids = own["doc"].to_numpy()
        # null where a row is of the other kind, without turning whole numbers into floats
        listed = (lambda x: pd.array(x, dtype="Int64")) if ids.dtype.kind == "i" else (lambda x: pd.Series(x, dtype=object).array)
        doc = ids[text[use]]
        n = last[use] - first[use] + 1
        places = pd.DataFrame({"t": pd.array((h[use].view(np.int64) >> 48), dtype="Int64"), "s": seg[use].view(np.int64), "row": pd.array(own["row"].to_numpy()[text[use]], dtype="Int64"), "doc": listed(doc), "first": pd.array(first[use], dtype="Int64"), "n": n})
        order = np.lexsort((doc, seg[use], h[use]))
        hh, ss = h[use][order], seg[use][order]
        once = use[order[np.flatnonzero(np.concatenate(([True], (hh[1:] != hh[:-1]) | (ss[1:] != ss[:-1]))))]]
        raw = [rows[t][a : e + LENGTH] if x == 2 else None for t, a, e, x in zip(text[once].tolist(), first[once].tolist(), last[once].tolist(), state[once].tolist())]
        segs = pd.DataFrame({"h": pd.array(h[once].view(np.int64), dtype="Int64"), "s": seg[once].view(np.int64), "low": listed(ids[text[once]]), "bytes": raw, "lead": pd.array(pos[once] - first[once], dtype="Int64"), "n": last[once] - first[once] + 1})
        return pd.concat([places, segs]).reindex(columns=names)

    spec = f"h long, t short, s long, row long, doc {kind}, first int, n int, low {kind}, bytes binary, lead int"
    by = texts.select("row", "doc", "text", F.shiftright("row", CHUNK).alias("chunk")).groupBy("chunk")
    return by.cogroup(told.groupBy("chunk")).applyInPandas(lambda x, y: cut(x, y), spec)


def sort_groups(groups: list[list[tuple[bytes, int, int, int]]]) -> list[np.ndarray]:
    """Smallest id of every string of each anchor's segments (bytes, low, lead, n), one array a segment.

    Segments none of whose strings has the digest of another one of the same anchor share nothing and keep
    their own id.  The others stand behind one another, each closed by a separator, the last by the end
    symbol, and are sorted; neighbours in suffix order that begin with the same LENGTH bytes are one string.
    """
    segs = [x for g in groups for x in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    sizes, counts = np.array([len(x[0]) + 1 for x in segs]), np.array([x[3] for x in segs])
    lows, leads = np.array([x[1] for x in segs]), np.array([x[2] for x in segs])
    flat = np.frombuffer(b"".join(x[0] + b"\0" for x in segs) + bytes(LENGTH), dtype=np.uint8)
    begin, before = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(segs)), counts)
    nth = np.arange(len(of)) - before[of]
    string = begin[of] + nth
    total = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL[flat] * textkernel._power("up", len(flat)), out=total[1:])
    same = (total[string + LENGTH] - total[string]) * textkernel._power("down", len(flat))[string]
    same ^= textkernel.mix64((group[of] << 8 | (leads[of] - nth)).astype(np.uint64))
    _, back, times = np.unique(same, return_inverse=True, return_counts=True)
    shares = np.bincount(of, weights=times[back] > 1, minlength=len(segs)) > 0
    orders, ends = [], np.flatnonzero(shares)
    for part in np.split(ends, np.flatnonzero(np.diff(group[ends])) + 1) if len(ends) else ():
        symbols: list[int] = []
        for k in part.tolist():
            symbols += segs[k][0]
            symbols.append(-1)
        symbols[-1] = -2
        where = np.concatenate([np.arange(begin[k], begin[k] + sizes[k]) for k in part.tolist()])
        orders.append(where[suffix_array(symbols)])
    best = lows[of]
    if orders:
        place = np.full(len(flat), -1)
        place[string] = np.arange(len(string))
        order = np.concatenate(orders)
        order = order[place[order] >= 0]
        own_group = group[of[place[order]]]
        new = np.empty(len(order), dtype=bool)
        for a in range(0, len(order), ROWS):
            lo = max(a - 1, 0)
            text = flat[order[lo : a + ROWS, None] + np.arange(LENGTH)]
            differ = (text[1:] != text[:-1]).any(axis=1) | (own_group[lo + 1 : a + ROWS] != own_group[lo : a + ROWS - 1][: len(text) - 1])
            new[a : a + ROWS] = differ if a else np.concatenate(([True], differ))
        at = place[order]
        best[at] = np.minimum.reduceat(lows[of[at]], np.flatnonzero(new))[np.cumsum(new) - 1]
    return np.split(best, before[1:])


def _sorted_groups(few: DataFrame) -> DataFrame:
    """(h, s, at, lows): the smallest id of each string of the segments, by suffix arrays."""

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: list[list[int]] = []
        groups: list[list[tuple]] = []
        anchor: list[int] = []
        held = 0

        def answer() -> pd.DataFrame:
            done = pd.DataFrame({"h": np.repeat(anchor, [len(g) for g in names]), "s": [x for g in names for x in g], "at": 0, "lows": sort_groups(groups)})
            names.clear(), groups.clear(), anchor.clear()
            return done

        for part in parts:
            for h, s, low, raw, lead, n in zip(part["h"], part["s"], part["low"], part["bytes"], part["lead"], part["n"]):
                if not anchor or h != anchor[-1]:
                    if held > 20_000:
                        yield answer()
                        held = 0
                    anchor.append(h), groups.append([]), names.append([])
                names[-1].append(s)
                groups[-1].append((raw, low, lead, n))
                held += 1
        if groups:
            yield answer()

    near = few.repartition("h").sortWithinPartitions("h", "s").select("h", "s", "low", "bytes", "lead", "n")
    return near.mapInPandas(solve, "h long, s long, at int, lows array<long>")


def _parts(hot: DataFrame, places: int, kind: str) -> DataFrame:
    """Segments cut into parts of so many places of the anchor, each under the bytes that all its strings share."""

    def digest(raw: bytes, salt: int) -> int:
        return int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=salt.to_bytes(4, "little")).digest(), "little", signed=True)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for h, s, low, raw, lead, n in zip(part["h"], part["s"], part["low"], part["bytes"], part["lead"], part["n"]):
                for r in range((lead - n + 1) // places, lead // places + 1):
                    near, far = r * places, min(r * places + places - 1, _WIDE - 1)
                    a, e = max(lead - far, 0), min(lead - near, n - 1)
                    own = raw[a : e + LENGTH]
                    core = raw[lead - near : lead + LENGTH - far]
                    out.append((h, s, a, digest(core, r << 8 | places), digest(own, (lead - a) << 8 | (e - a)), low, own, lead - a, e - a + 1))
            yield pd.DataFrame(out, columns=["h", "s", "at", "h2", "s2", "low", "bytes", "lead", "n"])

    return hot.mapInPandas(cut, f"h long, s long, at int, h2 long, s2 long, low {kind}, bytes binary, lead int, n int")


def lowest_ids(found: DataFrame, parts: tuple[int, ...] = PART) -> DataFrame:
    """(h, s, at, lows): the smallest ids of the strings of each segment, from string ``at`` on.

    ``found`` holds each segment (h, s, low, bytes, lead, n) once.
    """
    counts = found.groupBy("h").agg(F.count("*").alias("k"))
    if not parts:  # single places: all strings of a part are equal
        return found.select("h", "s", F.lit(0).alias("at"), F.array("low").alias("lows"))
    kind = found.schema["low"].dataType.simpleString()
    hot = spool(counts.where(F.col("k") > MOST).select("h"), "hot")
    if hot.isEmpty():
        return _sorted_groups(found)
    sorted_ = _sorted_groups(found.join(hot, "h", "left_anti"))
    cut = spool(_parts(found.join(hot, "h", "left_semi").select("h", "s", "low", "bytes", "lead", "n"), parts[0], kind), "parts")
    distinct = cut.groupBy(F.col("h2").alias("h"), F.col("s2").alias("s")).agg(F.min("low").alias("low"), F.min("bytes").alias("bytes"), F.min("lead").alias("lead"), F.min("n").alias("n"))
    below = lowest_ids(spool(distinct, "distinct"), parts[1:]).select(F.col("h").alias("h2"), F.col("s").alias("s2"), F.col("at").alias("at2"), "lows")
    split = cut.select("h", "s", "at", "h2", "s2").join(below, ["h2", "s2"]).select("h", "s", (F.col("at") + F.col("at2")).alias("at"), "lows")
    return sorted_.unionByName(split)


def duplicate_spans(texts: DataFrame) -> DataFrame:
    """(row, first, mask): for each of the distinct ``texts`` (row, doc, text, n_bytes) that loses bytes, the first
    string of each place and a mask of the strings that an earlier document has."""
    kind = texts.schema["doc"].dataType.simpleString()
    size = texts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = 1 << int(max(16, size // BUCKET)).bit_length()
    told = spool(repeated_anchors(texts, buckets), "answers")
    both = spool(segments(texts, told, buckets, kind), "anchors", "zstd")
    discard(told)
    segs = both.where("row is null").groupBy("h", "s").agg(F.min("low").alias("low"), F.min("bytes").alias("bytes"), F.min("lead").alias("lead"), F.min("n").alias("n"))
    segs = spool(segs, "segments", "zstd")
    whole = segs.where("bytes is null").select("h", "s", F.lit(-1).alias("at"), F.array("low").alias("lows"))
    lows = spool(whole.unionByName(lowest_ids(segs.where("bytes is not null"))), "lows")
    discard(segs)
    places = both.where("row is not null").select("t", "s", "row", "doc", "first", "n")
    known = lows.select(F.shiftright("h", 48).cast("short").alias("t"), "s", "at", "lows", F.array_min("lows").alias("least"))
    hit = places.join(known, ["s", "t"]).where("least < doc")
    # a segment has fewer than 32 strings: one bit for each that an earlier document has
    mask = F.expr("IF(at < 0, shiftleft(1, n) - 1, shiftleft(aggregate(transform(lows, (v, i) -> IF(v < doc, shiftleft(1, i), 0)), 0, (a, b) -> a | b), at))")
    spans = hit.select("row", "first", mask.alias("mask")).groupBy("row").agg(F.collect_list(F.struct("first", "mask")).alias("found")).select("row", "found.first", "found.mask")
    out = spool(spans, "spans")
    discard(both)
    discard(lows)
    return out


def remove(docs: DataFrame, doc: str = "doc_id", text: str = "text", view: Callable[[Column], Column] = lambda kept: kept) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept) per row of ``docs``.

    ``kept`` is ``view`` of the bytes that stay, by default these themselves.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("k", F.unhex(F.md5(F.col("text").cast("binary"))))
    distinct = rows.where("doc is not null").groupBy("k", "text").agg(F.min("doc").alias("doc"))
    texts = spool(distinct.select(F.monotonically_increasing_id().alias("row"), "k", "doc", "text", F.octet_length("text").alias("n_bytes")), "texts", "zstd")
    joined = texts.join(duplicate_spans(texts), "row", "left").select("k", "doc", "text", "first", "mask")

    def take_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["k", "low", "n_removed", "n_spans", "kept"]
        for part in parts:
            out = []
            for k, d, row, first, mask in zip(part["k"], part["doc"].tolist(), textkernel.to_bytes(part["text"]), part["first"], part["mask"]):
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
                if first is None:
                    out.append((k, d, 0, 0, row))
                    continue
                cover = np.zeros(len(row) + 1, dtype=np.int32)
                first, mask = np.asarray(first, dtype=np.int64), np.asarray(mask, dtype=np.int64)
                at = (first[:, None] + np.arange(_WIDE))[(mask[:, None] >> np.arange(_WIDE)) & 1 == 1]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + LENGTH, -1)
                gone = np.cumsum(cover[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((k, d, int(gone.sum()), runs, np.frombuffer(row, dtype=np.uint8)[~gone].tobytes()))
            yield pd.DataFrame(out, columns=names)

    kind = docs.schema[doc].dataType.simpleString()
    left = joined.mapInPandas(take_out, f"k binary, low {kind}, n_removed long, n_spans long, kept binary")
    first = spool(left.select("k", "low", "n_removed", "n_spans", view(F.col("kept")).alias("kept")), "kept")
    discard(texts)
    size = F.octet_length("text").cast("long")
    own = rows.where("doc is not null").select("k", "doc", size.alias("n_bytes")).join(first, "k")
    copy = (F.col("doc") > F.col("low")) & (F.col("n_bytes") >= LENGTH)  # an earlier document has every string
    pick = lambda whole, name: F.when(copy, whole).otherwise(F.col(name)).alias(name)
    told = own.select("doc", "n_bytes", pick(F.col("n_bytes"), "n_removed"), pick(F.lit(1).cast("long"), "n_spans"), pick(view(F.lit(b"")), "kept"))
    none = F.lit(0).cast("long")
    unnamed = rows.where("doc is null").select("doc", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), view(F.col("text").cast("binary")).alias("kept"))
    return told.unionByName(unnamed)
