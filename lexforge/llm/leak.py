"""Problem 8: evaluation texts leaking into training text.

A text is aligned with an item by Smith-Waterman over words; the score finds edited copies,
the longest diagonal run exact ones. Which pairs are aligned follows from bounds that no
leaked pair can miss, so nothing is lost to seeds: a shared run of ``window`` words is
looked up, and the score of an alignment is at most

* MATCH times the words that text and item have in common, each as often as both hold it;
* the greatest sum over a stretch of the text that counts MATCH for a word of the item and
  the smaller loss of MISMATCH and GAP for any other.

Words at which the second sum is 0 end every alignment, so only one of each stretch of them
is kept. The items are the stated query set: they go to the tasks in blocks of at most
BLOCK_WORDS words, each of which passes over all texts; texts are shuffled
only where their table has fewer splits than there are cores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, schema, spread, type_of

BLOCK_WORDS = 2_000_000
#: Items are bounded in groups of about so many words, table cells at a time, and aligned so many pairs at a time.
GROUP_WORDS, CELLS, PAIRS = 50_000, 4_000_000, 256
MATCH, MISMATCH, GAP = 2, -1, 1
_WORD = re.compile("[a-z]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of the letters a-z after lower-casing."""
    return _WORD.findall(text.lower()) if text else []


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(Smith-Waterman score with linear gaps, longest common run) of two word-id sequences."""
    return align_all([(doc, item)])[0]


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """:func:`align` of many (doc, item), PAIRS of like length at a time."""
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]))
    for lo in range(0, len(order), PAIRS):
        at = order[lo : lo + PAIRS]
        n, m = (max(len(pairs[i][side]) for i in at) for side in (0, 1))
        # filled up with words that equal nothing
        doc, item = np.full((n, len(at)), -1, "i4"), np.full((len(at), m), -2, "i4")
        for row, i in enumerate(at):
            doc[: len(pairs[i][0]), row], item[row, : len(pairs[i][1])] = pairs[i]
        item[item == -1] = -2
        h, run = np.zeros((len(at), m + 1), "i4"), np.zeros((len(at), m + 1), "i4")
        best, longest = np.zeros_like(h), np.zeros_like(h)
        slope = np.arange(m + 1, dtype="i4") * GAP
        for w in doc:
            eq = item == w[:, None]
            new = np.zeros_like(h)
            new[:, 1:] = np.maximum(h[:, :-1] + np.where(eq, MATCH, MISMATCH), h[:, 1:] - GAP)
            np.maximum(new, 0, out=new)
            h = np.maximum.accumulate(new + slope, axis=1) - slope
            run[:, 1:] = np.where(eq, run[:, :-1] + 1, 0)
            np.maximum(best, h, out=best)
            np.maximum(longest, run, out=longest)
        for i, s, r in zip(at, best.max(1), longest.max(1)):
            out[i] = int(s), int(r)
    return out


def _blocks(items: DataFrame) -> int:
    words = items.agg(F.sum(F.length("text") / 5)).first()[0] or 0
    return int(words // BLOCK_WORDS) + 1


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed_words: int = 6, window: int = 12, min_share: float = 0.5) -> DataFrame:
    """(id, item, score, share, longest_run): texts and the items they hold.

    ``share`` is the score over that of the whole item. A pair comes out if its longest common run has at least ``window`` words
    or its share is at least ``min_share``; all such pairs do. An item shorter than ``seed_words`` comes out where the whole of it stands as a run
    (half of three words would be anywhere); an item without words never does. Null and empty texts hold nothing. A repeated text row or a repeated item gives its pairs once.
    """
    key, item_key = type_of(docs, id_col), type_of(items, item_col)
    docs = pick(docs, id=id_col, text=text_col)
    items = pick(items, item=item_col, text=item_text_col).where("item is not null and text is not null").distinct()
    n_blocks = _blocks(items)
    out = None
    for block in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block)
        found = _one_block(docs, [(r["item"], words_of(r["text"])) for r in part.collect()], schema(("id", key), ("item", item_key), ("score", "integer"), ("share", "double"), ("longest_run", "integer")), seed_words, window, min_share)
        out = found if out is None else out.unionByName(found)
    return out.distinct().withColumnsRenamed({"id": id_col, "item": item_col})


class _Group:
    """Some items with the bounds of their alignments with a text."""

    def __init__(self, items: list[np.ndarray], vocabulary: int, window: int, min_share: float, short: int) -> None:
        self.items = items
        # lengths of the runs looked up: of short items the whole
        self.lengths = sorted({len(w) if len(w) < short else window for w in items})
        held = np.unique(np.concatenate(items))
        self.code = np.full(vocabulary + 1, len(held), "i4")
        self.code[held] = np.arange(len(held))
        # the last row stands for all other words
        self.counts = np.zeros((len(held) + 1, len(items)), "i4")
        self.runs: dict[bytes, set[int]] = {}
        for k, w in enumerate(items):
            np.add.at(self.counts[:, k], self.code[w], 1)
            run = len(w) if len(w) < short else window
            for i in range(len(w) - run + 1):
                self.runs.setdefault(w[i : i + run].tobytes(), set()).add(k)
        # a short item's score is never enough
        self.need = np.array([max(1, math.ceil(min_share * MATCH * len(w) - 1e-9)) if len(w) >= short else MATCH * len(w) + 1 for w in items])

    def pairs(self, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, words of ``doc`` to align with it) of all items that may leak."""
        code, other = self.code[doc], len(self.counts) - 1
        n = np.bincount(code, minlength=other + 1)[:other]
        u = np.flatnonzero(n)
        may = MATCH * np.minimum(n[u, None], self.counts[u]).sum(0) >= self.need
        # a shared run lies between two words of no item
        exact: set[int] = set()
        ends = np.flatnonzero(np.concatenate(([True], code == other, [True])))
        for lo, hi in zip(ends[:-1], ends[1:] - 1):
            for run in self.lengths:
                for i in range(lo, hi - run + 1):
                    exact |= self.runs.get(doc[i : i + run].tobytes(), set())
        may[list(exact)] = True
        cols = np.flatnonzero(may)
        step = max(1, CELLS // max(1, len(doc)))
        for part in (cols[lo : lo + step] for lo in range(0, len(cols), step)):
            c = np.cumsum(np.where(self.counts[code][:, part] > 0, MATCH, max(MISMATCH, -GAP)), axis=0)
            sums = c - np.minimum(np.minimum.accumulate(c, axis=0), 0)
            for k, s in zip(part, sums.T):
                if k in exact or s.max() >= self.need[k]:
                    keep = s > 0
                    keep[1:] |= keep[:-1]
                    yield int(k), doc[keep]


def _one_block(docs: DataFrame, items: list[tuple], fields, n: int, window: int, min_share: float) -> DataFrame:
    items = [(k, w) for k, w in items if w]
    number = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
    shared = docs.sparkSession.sparkContext.broadcast((items, number))  # at most BLOCK_WORDS words

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, number = shared.value
        ids = [np.fromiter((number[w] for w in words), "i4", len(words)) for _, words in items]
        cuts = np.cumsum([0] + [len(w) for w in ids])[:-1] // GROUP_WORDS
        for pdf in batches:
            texts = [(key, np.array([number.get(w, len(number)) for w in words_of(text)], "i4")) for key, text in zip(pdf["id"], pdf["text"])]
            for g in np.unique(cuts):
                at = np.flatnonzero(cuts == g)
                group = _Group([ids[k] for k in at], len(number), window, min_share, n)
                open_: list[tuple] = []
                for last, (key, doc) in enumerate(texts, 1 - len(texts)):
                    open_ += [(key, at[k], part) for k, part in group.pairs(doc)] if len(doc) else []
                    if len(open_) >= 8 * PAIRS or (last == 0 and open_):
                        rows = []
                        for (who, k, _), (score, longest) in zip(open_, align_all([(part, ids[k]) for _, k, part in open_])):
                            share = score / (MATCH * len(ids[k]))
                            if longest >= window or (share >= min_share if len(ids[k]) >= n else longest == len(ids[k])):
                                rows.append((who, items[k][0], score, share, longest))
                        open_ = []
                        yield pd.DataFrame(rows, columns=["id", "item", "score", "share", "longest_run"])

    return spread(docs).where(F.col("text").isNotNull()).mapInPandas(search, fields)
