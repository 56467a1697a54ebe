"""Exact token counts without token ids.

Pieces of a BPE model depend on one pre-token at a time.  The corpus is reduced to its distinct
pre-tokens with their frequencies, each is counted once by the model's own library, and per-document
pre-token frequencies are joined to that table and summed.  The join has two parts: a head of bounded
size, one pre-token (the most frequent) for each of ``slots`` hash slots, is handed to every task;
all other occurrences go through a shuffle join.  Null text counts as empty text.  Repeated rows are
counted each on its own, texts of any length whole; null ids stay null; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopespark.session import spool

#: Hash slots of the head: at most so many pre-tokens are broadcast, whatever the corpus size.
SLOTS = 1 << 18
#: Distinct pre-tokens that a task holds before it passes on their counts.
FLUSH = 200_000


@lru_cache(maxsize=2)
def _model(path: str):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = False
    model.no_truncation()
    model.no_padding()
    return model


@lru_cache(maxsize=2)
def _splitter(path: str):
    """The model's normaliser and pre-token pattern as plain functions, read from the model file."""
    import json
    import unicodedata

    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    if steps != ["NFC", "Replace", "Lowercase"] or (split["behavior"], split["invert"]) != ("Removed", True) or level["type"] != "ByteLevel":
        raise ValueError(f"{path}: not a model with NFC, white space, lower case and a removing split")
    special = [x["content"] for x in spec["added_tokens"]]
    find = regex.compile(split["pattern"]["Regex"]).findall
    marks = re.compile("|".join(map(re.escape, special))) if special else None

    def lower(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # letter by letter: the final form of sigma does not depend on its place
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def pre_tokens(text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stand in the text (one token each)."""
        if marks is None or not marks.search(text):
            return find(lower(text)), 0
        parts = marks.split(text)
        return [t for part in parts for t in find(lower(part))], len(parts) - 1

    return pre_tokens


def _strings(column: pd.Series) -> Iterator[str]:
    return (x if isinstance(x, str) else "" for x in column)


def pre_token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(piece_key, freq): the corpus's distinct pre-tokens; tasks add up before the shuffle."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pre_tokens = _splitter(path)
        seen: Counter = Counter()
        for part in parts:
            for x in _strings(part[text]):
                seen.update(pre_tokens(x)[0])
                if len(seen) > FLUSH:
                    yield pd.DataFrame({"pre_token": pd.Series(list(seen.keys()), dtype=object), "freq": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"pre_token": pd.Series(list(seen.keys()), dtype=object), "freq": list(seen.values())})

    each = docs.select(text).mapInPandas(count, "pre_token string, freq long")
    return each.groupBy("pre_token").agg(F.sum("freq").alias("freq"))


def count_pieces(distinct: DataFrame, path: str) -> DataFrame:
    """``distinct`` with ``n_pieces``: the model counts each distinct pre-token once."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(path)
        for part in parts:
            sizes = [len(x) for x in model.encode_batch_fast(part["pre_token"].tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"pre_token": part["pre_token"].to_numpy(dtype=object), "freq": part["freq"], "n_pieces": np.array(sizes, dtype=np.int64)}).astype({"pre_token": object})

    return distinct.mapInPandas(count, "pre_token string, freq long, n_pieces long")


def head_of(vocabulary: DataFrame, slots: int = SLOTS) -> dict[str, int]:
    """Pieces of the most frequent pre-token of each hash slot: at most ``slots`` entries."""
    slot = F.pmod(F.xxhash64("pre_token"), F.lit(slots))
    best = vocabulary.groupBy(slot.alias("slot")).agg(F.max(F.struct("freq", "pre_token", "n_pieces")).alias("b")).select("b.pre_token", "b.n_pieces")
    table = best.toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))


def token_counts(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(row, doc, n_bytes, n_tokens) per row of ``docs``, as the model's library counts the whole text."""
    vocabulary = spool(count_pieces(pre_token_counts(docs, path, text), path), "pieces")
    head = docs.sparkSession.sparkContext.broadcast(head_of(vocabulary, slots))

    def frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pre_tokens = _splitter(path)
        pieces = head.value
        get = pieces.get
        for part in parts:
            rows, ids, sizes, totals, rest = part["row"].tolist(), part[doc], [], [], []
            for k, x in enumerate(_strings(part[text])):
                tokens, special = pre_tokens(x)
                sizes.append(len(x.encode("utf-8", "surrogatepass")))
                totals.append(sum(map(get, tokens, repeat(0))) + special)
                others = Counter(t for t in tokens if t not in pieces)
                rest += [(rows[k], t, n) for t, n in others.items()]
            yield pd.DataFrame({"row": rows, "doc": ids, "n_bytes": sizes, "head": totals, "pre_token": pd.Series([None] * len(rows), dtype=object), "n": 0}).astype({"doc": "object"})
            if rest:
                r, t, n = zip(*rest)
                yield pd.DataFrame({"row": r, "doc": None, "n_bytes": None, "head": None, "pre_token": pd.Series(t, dtype=object), "n": n})

    kind = docs.schema[doc].dataType.simpleString()
    each = docs.select(F.monotonically_increasing_id().alias("row"), doc, text).mapInPandas(frequencies, f"row long, doc {kind}, n_bytes long, head long, pre_token string, n long")
    each = spool(each, "frequencies")
    tail = each.where("pre_token is not null").join(vocabulary.select("pre_token", "n_pieces"), "pre_token")
    tail = tail.groupBy("row").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("tail"))
    heads = each.where("pre_token is null").select("row", "doc", "n_bytes", "head")
    return heads.join(tail, "row", "left").select("row", "doc", "n_bytes", (F.col("head") + F.coalesce("tail", F.lit(0))).alias("n_tokens"))
