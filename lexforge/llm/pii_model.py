"""Character-level bidirectional LSTM with CRF transitions, in numpy.

One forward pass serves training and inference; :func:`loss_and_grads` holds the
backward pass (BPTT through both directions, forward-backward for the CRF).
"""

from __future__ import annotations

import io
import unicodedata

import numpy as np

from .pii_rules import KINDS

PAD, VOCAB = 0, 102
LABELS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")
N_LABELS = len(LABELS)
BAD = np.float32(-1e4)


def _char_table() -> np.ndarray:
    """Code point -> character class: ASCII as it is, accented letters as their base, the rest by category."""
    table = np.full(65536, 101, np.int16)
    for cp in range(32, 127):
        table[cp] = cp - 31
    table[10], table[9], table[13], table[160] = 96, 97, 97, 97
    for cp in range(128, 65536):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        cat = unicodedata.category(ch)
        if "a" <= base <= "z" or "A" <= base <= "Z":
            table[cp] = ord(base) - 31
        elif cat == "Lu":
            table[cp] = 98
        elif cat[0] == "L":
            table[cp] = 99
        elif cat == "Nd":
            table[cp] = 100
        elif cat == "Zs":
            table[cp] = 97
    return table


_TABLE = None


def encode(text: str) -> np.ndarray:
    """Class of each code point of ``text``."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _char_table()
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.where(cps < 65536, cps, 65535)]


def illegal() -> np.ndarray:
    """Transitions that no labelling has: I of a kind follows only B or I of that kind."""
    bad = np.zeros((N_LABELS, N_LABELS), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                bad[i, j] = a[1:] != b[1:] or a[0] == "O"
    return bad


ILLEGAL = illegal()


def init(hidden: int = 48, emb: int = 24, seed: int = 7) -> dict[str, np.ndarray]:
    """Fresh parameters."""
    r = np.random.default_rng(seed)
    g = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype("f4")
    p = {"emb": r.standard_normal((VOCAB, emb)).astype("f4") * 0.3, "wx": g(2, emb, 4 * hidden), "u": g(2, hidden, 4 * hidden) * 0.7}
    p["b"] = np.zeros((2, 4 * hidden), "f4")
    p["b"][:, hidden : 2 * hidden] = 1.0
    p["wo"] = g(2, hidden, N_LABELS)
    p["bo"] = np.zeros(N_LABELS, "f4")
    p["a"], p["start"] = np.zeros((N_LABELS, N_LABELS), "f4"), np.zeros(N_LABELS, "f4")
    return p


def save(p: dict[str, np.ndarray], path: str) -> None:
    """Write the parameters in half precision."""
    np.savez_compressed(path, **{k: v.astype("f2") for k, v in p.items()})


def load(raw: bytes) -> dict[str, np.ndarray]:
    """Parameters from the bytes of a saved model."""
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k].astype("f4") for k in z.files}


def _scaled(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Input table (2, V, 4H) and recurrent weights with the gates' halves folded in: sigmoid(x) = tanh(x/2)/2 + 1/2."""
    h = p["u"].shape[1]
    k = np.ones(4 * h, "f4")
    k[: 3 * h] = 0.5
    return (np.matmul(p["emb"][None], p["wx"]) + p["b"][:, None]) * k, p["u"] * k


def emissions(p: dict, ids: np.ndarray, keep: bool = False):
    """Label scores (T, B, L) of a batch (B, T); with ``keep`` also what the backward pass needs."""
    n, t_max = ids.shape
    hid = p["u"].shape[1]
    table, u = _scaled(p)
    h = np.zeros((2, n, hid), "f4")
    c = np.zeros((2, n, hid), "f4")
    hs = np.empty((t_max, 2, n, hid), "f4")
    kept = [] if keep else None
    z = np.empty((2, n, 4 * hid), "f4")
    for t in range(t_max):
        np.matmul(h, u, out=z)
        z[0] += table[0][ids[:, t]]
        z[1] += table[1][ids[:, t_max - 1 - t]]
        np.tanh(z, out=z)
        s = z[:, :, : 3 * hid]
        s *= 0.5
        s += 0.5
        i, f, o, g = z[:, :, :hid], z[:, :, hid : 2 * hid], z[:, :, 2 * hid : 3 * hid], z[:, :, 3 * hid :]
        new = f * c
        new += i * g
        tc = np.tanh(new)
        h = o * tc
        hs[t] = h
        if keep:
            kept.append((z.copy(), c, tc))
        c = new
    e = hs[:, 0] @ p["wo"][0] + hs[::-1, 1] @ p["wo"][1] + p["bo"]
    return (e, hs, kept) if keep else e


def viterbi(p: dict, e: np.ndarray) -> np.ndarray:
    """Best labelling (B, T) under emissions and transitions."""
    t_max, n, k = e.shape
    a = np.where(ILLEGAL, BAD, p["a"])
    back = np.empty((t_max, n, k), np.int8)
    v = e[0] + p["start"]
    at = np.ascontiguousarray(a.T)[None]  # (1, to, from)
    for t in range(1, t_max):
        s = v[:, None, :] + at
        b = s.argmax(2)
        back[t] = b
        v = np.take_along_axis(s, b[:, :, None], 2)[:, :, 0] + e[t]
    out = np.empty((n, t_max), np.int8)
    out[:, -1] = v.argmax(1)
    rows = np.arange(n)
    for t in range(t_max - 1, 0, -1):
        out[:, t - 1] = back[t, rows, out[:, t]]
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def loss_and_grads(p: dict, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the gold labellings (B, T) and its gradients."""
    n, t_max = ids.shape
    hid = p["u"].shape[1]
    e, hs, kept = emissions(p, ids, keep=True)
    a = np.where(ILLEGAL, BAD, p["a"])
    alpha = np.empty_like(e)
    beta = np.zeros_like(e)
    alpha[0] = e[0] + p["start"]
    for t in range(1, t_max):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + a[None], 1) + e[t]
    for t in range(t_max - 2, -1, -1):
        beta[t] = _lse(a[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    rows = np.arange(n)
    score = p["start"][gold[:, 0]] + sum(e[t, rows, gold[:, t]] for t in range(t_max)) + sum(a[gold[:, t - 1], gold[:, t]] for t in range(1, t_max))
    de = np.exp(alpha + beta - z[None, :, None])
    ga = np.zeros_like(a)
    for t in range(1, t_max):
        ga += np.exp(alpha[t - 1][:, :, None] + a[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(ga, (gold[:, t - 1], gold[:, t]), 1)
    gs = de[0].sum(0)
    np.subtract.at(gs, gold[:, 0], 1)
    de[np.arange(t_max)[:, None], rows[None], gold.T] -= 1
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["a"], g["start"] = np.where(ILLEGAL, 0, ga).astype("f4"), gs
    g["bo"] = de.sum((0, 1))
    hb = hs[::-1, 1]
    g["wo"][0] = hs[:, 0].reshape(-1, hid).T @ de.reshape(-1, N_LABELS)
    g["wo"][1] = hb.reshape(-1, hid).T @ de.reshape(-1, N_LABELS)
    dh_out = np.stack([de @ p["wo"][0].T, (de @ p["wo"][1].T)[::-1]], 1)  # (T, 2, B, H)
    dtable = np.zeros((2, VOCAB, 4 * hid), "f4")
    dh = np.zeros((2, n, hid), "f4")
    dc = np.zeros((2, n, hid), "f4")
    ut = p["u"].transpose(0, 2, 1).copy()
    dz = np.empty((2, n, 4 * hid), "f4")
    dzs = np.empty((t_max, 2, n, 4 * hid), "f4")
    for t in range(t_max - 1, -1, -1):
        q, c_prev, tc = kept[t]
        i, f, o, gg = q[:, :, :hid], q[:, :, hid : 2 * hid], q[:, :, 2 * hid : 3 * hid], q[:, :, 3 * hid :]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[:, :, :hid] = dc * gg * i * (1 - i)
        dz[:, :, hid : 2 * hid] = dc * c_prev * f * (1 - f)
        dz[:, :, 2 * hid : 3 * hid] = dh * tc * o * (1 - o)
        dz[:, :, 3 * hid :] = dc * i * (1 - gg * gg)
        dzs[t] = dz
        if t:
            g["u"] += np.matmul(hs[t - 1].transpose(0, 2, 1), dz)
        dh = np.matmul(dz, ut)
        dc = dc * f
    for d in (0, 1):
        order = ids.T if d == 0 else ids.T[::-1]
        flat, z2 = order.reshape(-1), dzs[:, d].reshape(-1, 4 * hid)
        one = np.zeros((VOCAB, len(flat)), "f4")
        one[flat, np.arange(len(flat))] = 1
        dtable[d] = one @ z2
    g["b"] = dtable.sum(1)
    g["wx"] = np.matmul(p["emb"].T[None], dtable)
    g["emb"] = np.matmul(dtable, p["wx"].transpose(0, 2, 1)).sum(0)
    return float((z - score).mean()), {k: (v / n).astype("f4") for k, v in g.items()}


def spans(labels: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs of a labelling: (start, end, kind); an I without its B begins a run too."""
    out, start, kind = [], -1, ""
    for pos in np.append(np.flatnonzero(labels), len(labels)):
        name = LABELS[labels[pos]] if pos < len(labels) else "O"
        if start >= 0 and (name[2:] != kind or name[0] == "B" or pos != last + 1):
            out.append((start, last + 1, kind))
            start = -1
        if start < 0 and name != "O":
            start, kind = int(pos), name[2:]
        last = int(pos)
    return out
