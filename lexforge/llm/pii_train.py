"""Training of the tagger.

``python -m lexforge.llm.pii_train DOCUMENTS.parquet [SECONDS [MODEL.npz]]`` trains the network and writes ``pii_model.npz`` beside this file.
Half of the windows come from the generator of :mod:`.pii_synth`, whose names, towns and sentences have nothing to do with any table;
half from a bounded sample of texts (at most :data:`MAX_TEXTS`), in which the labelling functions below mark spans and most
marked values are replaced by generated ones. What the network learned is measured on the generator's held-out part:
``python -m lexforge.llm.pii_train --held-out``.
"""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

import numpy as np

from . import pii_model as M
from .pii_rules import ADDRESS, EMAIL, ID_NUMBER, PHONE, REMOTE
from .pii_synth import Maker, score

MAX_TEXTS = 20_000
WINDOW = 160

#: Given names and beginnings and ends of family names with which spans are labelled.
GIVEN = "Samuel Lucia Pavel Olga Noor Rosa Zoë Kenji Aisha Yusuf Maria Elena Priya Åsa Tomas Ingrid Björn Felix Irene René Nadia Marco Leila Viktor Tamara Milan Greta Jonas Stefan Amara Pedro Oscar Hugo Wanda".split()
FAMILY = "Velt Ost Sand Wick Quill Pell Brand Zab Lind Ulver Hollow Marr Thorn Tesk Dorn Krav Grim Fern".split()

_FAM = rf"(?:{'|'.join(FAMILY)})[a-zøåöäüé]{{2,8}}"
_UFAM = rf"(?:{'|'.join(x.upper() for x in FAMILY)})[A-ZØÅÖÄÜÉ]{{2,8}}"
_GIV = "|".join(map(re.escape, GIVEN))
_NAME = re.compile(
    rf"(?<![\w.@-])(?:(?:{_GIV}|[A-Z]\.) (?:[A-Z]\. )?{_FAM}(?:-{_FAM})?|{_FAM}(?:-{_FAM})?, (?:{_GIV})|(?:{_GIV.upper()}) (?:[A-Z]\. )?{_UFAM}(?:-{_UFAM})?|(?:{_GIV}) [A-Z]\.)(?![\w@-])"
)


def label(text: str) -> list[tuple[int, int, str]]:
    """Spans of personal information, by pattern and context, without overlaps."""
    found: list[tuple[int, int, str]] = []

    def take(kind: str, m: re.Match) -> None:
        a, b = m.span()
        if not any(a < e and s < b for s, e, _ in found):
            found.append((a, b, kind))

    for m in ADDRESS.finditer(text):
        take("address", m)
    for m in EMAIL.finditer(text):
        if not REMOTE.match(m[0]):
            take("email", m)
    for m in ID_NUMBER.finditer(text):
        if not text[: m.start()].endswith(("Version ", "version ")):
            take("id_number", m)
    for m in PHONE.finditer(text):
        if "ISBN" not in text[max(0, m.start() - 30) : m.start()]:
            take("phone", m)
    for m in _NAME.finditer(text):
        take("name", m)
    return sorted(found)


def vary(text: str, marks: list[tuple[int, int, str]], maker: Maker) -> tuple[str, list[tuple[int, int, str]]]:
    """The same text with generated values in most of its spans."""
    made = {"name": maker.name, "email": maker.email, "phone": maker.phone, "id_number": maker.id_number, "address": maker.address}
    out, marks_out, at, n = [], [], 0, 0
    for a, b, kind in marks:
        out.append(text[at:a])
        n += a - at
        value, k = text[a:b], maker.r.random()
        if k < 0.5:
            value = made[kind]()
        elif k < 0.65:
            value = re.sub(r"(?<=\d)\d(?=\d)", lambda m: str(maker.r.randint(0, 9)), value)
        out.append(value)
        marks_out.append((n, n + len(value), kind))
        n += len(value)
        at = b
    out.append(text[at:])
    return "".join(out), marks_out


def window(text: str, marks: list[tuple[int, int, str]], lo: int) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and gold labels of a window; a cut span begins with I."""
    ids = np.zeros(WINDOW, np.int16)
    gold = np.zeros(WINDOW, np.int64)
    part = M.encode(text[lo : lo + WINDOW])
    ids[: len(part)] = part
    for a, b, kind in marks:
        s, e = max(a, lo) - lo, min(b, lo + WINDOW) - lo
        if s < e:
            gold[s:e] = M.LABELS.index(f"I-{kind}")
            if a >= lo:
                gold[s] = M.LABELS.index(f"B-{kind}")
    return ids, gold


def _sample(marked: list, with_spans: list, size: int, maker: Maker) -> tuple[np.ndarray, np.ndarray]:
    """A batch of windows: half generated, half of texts, two thirds of these around a span."""
    rows, r = [], maker.r
    for _ in range(size):
        if not marked or r.random() < 0.5:
            t, k = maker.text()
            lo = r.randint(0, max(0, len(t) - WINDOW // 2))
        elif with_spans and r.random() < 0.65:
            t, k = vary(*r.choice(with_spans), maker)
            a, b, _k = r.choice(k)
            lo = max(0, min(r.randint(b - WINDOW + 8, a - 8) if b - a < WINDOW - 16 else a - 8, len(t) - 40))
        else:
            t, k = r.choice(marked)
            lo = r.randint(0, max(0, len(t) - WINDOW // 2))
        rows.append(window(t, k, lo))
    return np.stack([x[0] for x in rows]), np.stack([x[1] for x in rows])


def _worker(texts: list[str], size: int, seed: int, pipe) -> None:
    """Answers parameters with the gradients of a fresh batch."""
    marked = [(t, label(t)) for t in texts if t]
    with_spans, maker = [x for x in marked if x[1]], Maker(seed)
    while (p := pipe.recv()) is not None:
        pipe.send(M.loss_and_grads(p, *_sample(marked, with_spans, size, maker)))


def train(texts: list[str], seconds: float = 240, hidden: int = 48, batch: int = 24, workers: int = 8, seed: int = 7, say=print, every: int = 100, start: dict | None = None) -> dict[str, np.ndarray]:
    """Fit the network on at most MAX_TEXTS texts with Adam; stops after ``seconds``.

    ``start`` goes on from given parameters at a lower rate. Each worker process computes the gradients of its own batch; with no workers all runs here.
    """
    import multiprocessing as mp

    texts = [t for t in texts if t][:MAX_TEXTS]
    pipes, procs = [], []
    for w in range(workers):
        here, there = mp.Pipe()
        procs.append(mp.get_context("fork").Process(target=_worker, args=(texts, batch, seed * 100 + w, there), daemon=True))
        procs[-1].start()
        pipes.append(here)
    if not workers:
        marked = [(t, label(t)) for t in texts if t]
        with_spans, maker = [x for x in marked if x[1]], Maker(seed)
    p = {k: v.copy() for k, v in start.items()} if start else M.init(hidden, seed=seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    began, step, lost = time.time(), 0, []
    while (used := (time.time() - began) / seconds) < 1:
        step += 1
        for x in pipes:
            x.send(p)
        got = [x.recv() for x in pipes] or [M.loss_and_grads(p, *_sample(marked, with_spans, batch, maker))]
        g = {k: sum(x[1][k] for x in got) / len(got) for k in p}
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = (1.5e-3 if start else 4e-3) * min(1.0, step / 30) * (1 - used) ** 0.7
        for k, v in g.items():
            v = v * min(1.0, 5 / max(norm, 1e-6))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype("f4")
        lost.append(float(np.mean([x[0] for x in got])))
        if step % every == 0:
            say(f"step {step} loss {np.mean(lost[-every:]):.3f} ({used:.0%})")
    for x in pipes:
        x.send(None)
    return p


def held_out(texts: int = 2000, seed: int = 99) -> dict[str, tuple[float, float, int]]:
    """(recall, precision, number) by kind on generated texts of the held-out part."""
    from .pii import tag

    maker = Maker(seed, held_out=True)
    made = [maker.text() for _ in range(texts)]
    return score(tag([t for t, _ in made]), [m for _, m in made])


if __name__ == "__main__":
    if sys.argv[1] == "--held-out":
        for kind, (recall, precision, n) in held_out().items():
            print(f"{kind}: recall {recall:.3f}, precision {precision:.3f} of {n}")
    else:
        import pyarrow.parquet as pq

        rows = pq.read_table(sys.argv[1], columns=["text"]).column("text").to_pylist()
        before = M.load(Path(sys.argv[3]).read_bytes()) if len(sys.argv) > 3 else None
        fitted = train(rows, float(sys.argv[2]) if len(sys.argv) > 2 else 240, seed=11 if before else 7, start=before)
        M.save(fitted, str(Path(__file__).with_name("pii_model.npz")))
