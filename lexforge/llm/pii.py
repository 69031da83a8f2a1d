"""Problem 10: personal information inside free text.

A character-level bidirectional LSTM with CRF transitions (:mod:`.pii_model`)
reads every text in overlapping windows. Each window is decoded by Viterbi; where
windows overlap, a span counts as the window sees it in which its middle lies farthest from the edges, and of spans
that still cross the longer one stays. :mod:`.pii_rules` may then trim span edges; it rejects no span for its form.

Defined results: a null or empty text has no spans and comes back unchanged; texts
of any length are read whole, in windows; equal texts give equal spans; equal
values in one text come out once in ``find_pii``; an empty table gives no rows.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii_model as M
from .common import pick, schema, spread, type_of
from .pii_rules import snap

SPAN, STEP, BATCH = 256, 160, 384
_MODEL: dict | None = None


def model() -> dict[str, np.ndarray]:
    """The trained parameters, read once per process."""
    global _MODEL
    if _MODEL is None:
        _MODEL = M.load(pkgutil.get_data(__package__, "pii_model.npz"))
    return _MODEL


def tag(texts: list[str | None], params: dict | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text, sorted; code points count as positions."""
    params = params or model()
    ids, starts = [], []
    for k, t in enumerate(texts):
        if not t:
            continue
        codes = M.encode(t)
        for lo in range(0, max(1, len(codes) - (SPAN - STEP)), STEP):
            starts.append((k, lo, len(codes)))
            ids.append(codes[lo : lo + SPAN])
    raw: dict[int, list[tuple[int, int, int, str]]] = {}
    order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
    for at in range(0, len(order), BATCH):
        part = order[at : at + BATCH]
        block = np.zeros((len(part), len(ids[part[-1]])), np.int16)
        for row, i in enumerate(part):
            block[row, : len(ids[i])] = ids[i]
        best = M.viterbi(params, M.emissions(params, block))
        for row in np.flatnonzero(best.any(1)):
            k, lo, n = starts[part[row]]
            size = len(ids[part[row]])
            # a place belongs to the window in which it lies farthest from the edges: the middle of two overlaps divides them
            own_lo = lo + (SPAN - STEP) // 2 if lo else 0
            own_hi = lo + STEP + (SPAN - STEP) // 2 if lo + size < n else n + 1
            for a, b, kind in M.spans(best[row, :size]):
                if own_lo <= lo + (a + b) // 2 < own_hi:
                    raw.setdefault(k, []).append((a - b, lo + a, lo + b, kind))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, found in raw.items():
        kept: list[tuple[int, int, str]] = []
        for _, a, b, kind in sorted(found):
            edge = snap(kind, texts[k], a, b)
            if edge and not any(edge[0] < e and s < edge[1] for s, e, _k in kept):
                kept.append((*edge, kind))
        out[k] = sorted(kept)
    return out


def tag_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each record with its spans (kind, value, begin, end) and its text with placeholders such as ``[EMAIL]``."""
    span = T.ArrayType(T.StructType().add("kind", "string").add("value", "string").add("begin", "integer").add("end", "integer"))
    key = type_of(df, id_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                texts = [t if isinstance(t, str) else None for t in part["_text"]]
                found = tag(texts)
                redacted = []
                for t, marks in zip(texts, found):
                    at, pieces = 0, []
                    for a, b, kind in marks:
                        pieces += [t[at:a], f"[{kind.upper()}]"]
                        at = b
                    redacted.append(t if t is None else "".join([*pieces, t[at:]]))
                yield pd.DataFrame({
                    "_id": part["_id"].values,
                    "spans": [[{"kind": k, "value": t[a:b], "begin": a, "end": b} for a, b, k in m] for t, m in zip(texts, found)],
                    "redacted": redacted,
                })

    return spread(pick(df, _id=id_col, _text=text_col), 2).mapInPandas(run, schema(("_id", key), ("spans", span), ("redacted", T.StringType()))).withColumnRenamed("_id", id_col)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, value): each distinct value of each record."""
    return (
        tag_pii(df, id_col, text_col)
        .select(id_col, F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))).alias("s"))
        .select(id_col, "s.kind", "s.value")
        .distinct()
    )
