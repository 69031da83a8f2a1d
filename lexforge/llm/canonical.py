"""Problem 1: mapping free-entered values to a canonical list.

Token-level repair: every distinct value is read in several notations (as tokens, as
one word, with endings taken off); each distinct token is compared with the vocabulary of
the reference list by edit distance. The vocabulary passes to the tasks in blocks of
at most VOCABULARY words; a product of letter-pair indicators leaves the pairs that no word within the distance can
fail, and these are measured. Shortened forms are measured by the same distance with gap costs: a cut-off end is
one gap, dropped vowels are cheap ones. Corrected tokens are combined with soft TF-IDF to rank
complete entries; the best one is taken if its score reaches the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, join_hot, keep, pick

#: Letters of other scripts that look like Latin ones, and digits typed for letters.
LOOKALIKES = str.maketrans("асеіјорѕтухһкмнвԁԛԝαοε", "aceijopstyxhkmhbdqwaoe")
DIGITS = str.maketrans("013457@$", "oieastas")
CLOSE, ACCEPT = 0.6, 0.62
STEM_SCORE = 0.98
#: Gap costs of shortened forms, in edits: of a cut-off end its first letter and each further one, and of a dropped vowel.
CUT_OPEN, CUT_MORE, VOWEL = 1.3, 0.15, 0.35
#: Words of a vocabulary block, buckets of the letter-pair indicators, and table cells of a filter step.
VOCABULARY, PAIRS, CELLS = 20_000, 256, 2_000_000


def plain(text: str) -> str:
    """Lower-case base letters: compatibility forms, accents, look-alike letters and invisible marks are resolved."""
    t = unicodedata.normalize("NFKC", text)
    t = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) not in ("Mn", "Cf"))
    t = t.lower()
    return t.translate(LOOKALIKES) if re.search("[a-z]", t) or not t.isascii() else t


def stems(token: str) -> list[str]:
    """A token with an English ending taken off."""
    out = []
    if token.endswith("ies") and len(token) > 5:
        out.append(token[:-3] + "y")
    if token.endswith("es") and len(token) > 5:
        out.append(token[:-2])
    if token.endswith("s") and not token.endswith("ss") and len(token) > 4:
        out.append(token[:-1])
    for end in ("ing", "ed"):
        if token.endswith(end) and len(token) > 6:
            out += [token[: -len(end)], token[: -len(end)] + "e"]
    return out


def notations(value: str) -> list[tuple[float, list[str]]]:
    """Readings of a value: (weight, tokens)."""
    t = plain(value)
    parts = [re.sub(r"\d+$", "", p) or p for p in re.findall(r"[^\W_]+(?:[$@][^\W_]+)*", t)]
    parts = [p.translate(DIGITS) if re.search("[a-z]", p) and sum(c.isdigit() for c in p) <= max(1, len(p) // 4) else p for p in parts]
    parts = [p for p in parts if re.search(r"[^\W\d]", p)]
    if not parts:
        return []
    out = [(1.0, parts)]
    if len(parts) > 1:
        out.append((1.0, ["".join(parts)]))
        if len(parts[0]) == 1:
            out.append((1.0, parts[1:]))
    for weight, tokens in list(out):
        if len(tokens) == 1:
            out += [(weight * STEM_SCORE, [s]) for s in stems(tokens[0])]
    return out


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distance with transposition of neighbours (optimal string alignment) of each pair."""
    n = len(a)
    la, lb = np.fromiter(map(len, a), "i4", n), np.fromiter(map(len, b), "i4", n)
    wa, wb = int(la.max(initial=0)), int(lb.max(initial=0))
    code = lambda x, w: np.array(x, f"<U{max(w, 1)}").view("<u4").reshape(n, max(w, 1))
    ca, cb = code(a, wa), code(b, wb)
    prev2, prev = None, np.broadcast_to(np.arange(wb + 1, dtype="i4"), (n, wb + 1)).copy()
    out = np.where(la == 0, lb, 0)
    for i in range(1, wa + 1):
        cur = np.empty_like(prev)
        cur[:, 0] = i
        for j in range(1, wb + 1):
            same = ca[:, i - 1] == cb[:, j - 1]
            d = np.minimum(np.minimum(prev[:, j], cur[:, j - 1]) + 1, prev[:, j - 1] + ~same)
            if i > 1 and j > 1:
                swap = (ca[:, i - 1] == cb[:, j - 2]) & (ca[:, i - 2] == cb[:, j - 1])
                d = np.where(swap, np.minimum(d, prev2[:, j - 2] + 1), d)
            cur[:, j] = d
        done = la == i
        out[done] = cur[np.flatnonzero(done), lb[done]]
        prev2, prev = prev, cur
    return out


def reach(length: int) -> int:
    """Edits that a word of this length may differ by."""
    return 1 if length <= 4 else 2 if length <= 6 else 3 if length <= 9 else 4


def shortened(word: str) -> dict[str, float]:
    """Shortened forms of three letters or more with their similarity: 1 - gap costs / length."""
    n, out = len(word), {}
    for k in range(3, n):
        out[word[:k]] = 1 - (CUT_OPEN + CUT_MORE * (n - k - 1)) / n
    for head in (word[:1], ""):
        form = head + re.sub("[aeiou]", "", word[len(head) :])
        if 3 <= len(form) < n:
            out[form] = max(out.get(form, 0.0), 1 - VOWEL * (n - len(form)) / n)
    return out


def _pairs(words: list[str]) -> np.ndarray:
    """One row per word: which buckets its letter pairs, with its ends, fall into. Shared buckets only raise what two words have in common."""
    out = np.zeros((len(words), PAIRS), "f4")
    for i, w in enumerate(words):
        p = f"^{w}$"
        out[i, [(ord(x) * 31 + ord(y) * 17) % PAIRS for x, y in zip(p, p[1:])]] = 1
    return out


def _letters(words: list[str], most: int) -> np.ndarray:
    """One row per word: a bucket for each letter and each time it occurs, up to ``most``; products of rows count the letters in common."""
    out = np.zeros((len(words), 32 * most), "f4")
    for i, w in enumerate(words):
        n = Counter(ord(x) % 32 for x in w)
        out[i, [k * most + j for k, c in n.items() for j in range(min(c, most))]] = 1
    return out


class Vocabulary:
    """A block of words with what the filters need."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.size = np.fromiter(map(len, words), "i4", len(words))
        self.far = np.fromiter((reach(n) for n in self.size), "i4", len(words))
        self.most = max((c for w in words for c in Counter(ord(x) % 32 for x in w).values()), default=1)
        self.pairs, self.letters = _pairs(words), _letters(words, self.most)
        self.forms: dict[str, list[tuple[str, float]]] = {}
        for w in words:
            for form, sim in shortened(w).items():
                self.forms.setdefault(form, []).append((w, sim))

    def close(self, tokens: list[str]) -> Iterator[tuple[str, str, float]]:
        """(token, word, similarity) of all pairs within reach whose similarity is at least CLOSE, and of the shortened forms.

        Of d edits the s swaps leave the letters as they are and touch three pairs, the others touch two; so letters missing in the other word
        number at most d - s, and all but 2 d + s pairs are in common. No pair within reach fails these bounds.
        """
        yield from ((t, w, s) for t in tokens for w, s in self.forms.get(t, ()))
        longest, step = int(self.size.max(initial=0)) + 4, max(1, CELLS // max(1, len(self.words)))
        tokens = [t for t in tokens if len(t) <= longest]
        for lo in range(0, len(tokens) if self.words else 0, step):
            part = tokens[lo : lo + step]
            lt = np.fromiter(map(len, part), "i4", len(part))[:, None]
            p = _pairs(part)
            missing = np.maximum(lt, self.size) - _letters(part, self.most) @ self.letters.T
            need = np.maximum(p.sum(1)[:, None], self.pairs.sum(1)) - 3 * self.far + missing
            r, c = np.nonzero((np.abs(lt - self.size) <= self.far) & (missing <= self.far) & (p @ self.pairs.T >= need))
            if len(r):
                a, b = [part[i] for i in r], [self.words[j] for j in c]
                d = edit_distances(a, b)
                sim = 1 - d / np.maximum(lt[r, 0], self.size[c])
                yield from ((x, y, float(z)) for x, y, z, ok in zip(a, b, sim, d <= self.far[c]) if ok and z >= CLOSE)


def correct_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim) of the vocabulary words close to each token.

    ``tokens``: distinct token; ``vocabulary``: distinct word. ``sim`` is 1 - edits / longer length, at least CLOSE, or that of a shortened form.
    Tokens stay where they are; pairs are neither joined nor shuffled, so no frequent letter pair gathers anything.
    """
    sc = tokens.sparkSession.sparkContext
    blocks, out = vocabulary.count() // VOCABULARY + 1, None
    for b in range(blocks):
        words = sorted(r["word"] for r in vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b).select("word").collect())  # about VOCABULARY words
        shared = sc.broadcast(Vocabulary(words))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame(list(shared.value.close(pdf["token"].tolist())), columns=["token", "word", "sim"])

        found = tokens.select("token").mapInPandas(run, "token string, word string, sim double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("token", "word").agg(F.max("sim").alias("sim"))


def map_values(values: DataFrame, reference: DataFrame, value_col: str = "element", key_col: str = "term_id", word_col: str = "word", freq_col: str = "freq") -> DataFrame:
    """(value, key, score) for each distinct value that is neither null nor blank; key is null if no entry reaches ACCEPT.

    Of equal scores the more frequent entry wins, then the smaller key. Entries may have several tokens.
    An empty list leaves every value unmatched; values longer than any entry by more than four letters meet none unless in pieces.
    """
    distinct = pick(values, value=value_col).where(~blank(F.col("value"))).distinct()
    entries = pick(reference, key=key_col, entry=word_col, freq=freq_col).where(~blank(F.col("entry")))
    parts = F.split(F.lower(F.trim("entry")), r"[\s_-]+")
    # an entry of several tokens is also read as one word
    spelled = F.when(F.size(parts) > 1, F.array(parts, F.array(F.array_join(parts, "")))).otherwise(F.array(parts))
    entry_tokens = entries.select("key", "freq", F.posexplode(spelled).alias("form", "words")).select("key", "freq", "form", F.explode("words").alias("word")).distinct()
    n_entries = entries.agg(F.count("*").alias("n_entries"))
    idf = entry_tokens.groupBy("word").agg(F.countDistinct("key").alias("df")).join(F.broadcast(n_entries)).select("word", (1 + F.log(F.col("n_entries") / F.col("df"))).alias("idf"))
    weighted = entry_tokens.join(idf, "word")
    norms = weighted.groupBy("key", "form").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    weighted = weighted.join(norms, ["key", "form"]).select("key", "form", "freq", "word", "idf", (F.col("idf") / F.col("norm")).alias("v"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(v, k, w, t) for v in pdf["value"] for k, (w, tokens) in enumerate(notations(v)) for t in tokens]
            yield pd.DataFrame(rows, columns=["value", "reading", "weight", "token"])

    readings = distinct.mapInPandas(read, "value string, reading int, weight double, token string")
    readings = keep(readings)
    close = keep(correct_tokens(readings.select("token").distinct(), entry_tokens.select("word").distinct()))
    top_idf = F.lit(1.0) + F.log(F.col("n_entries"))
    # a typed token weighs as the rarest word it may stand for; one that stands for none weighs as an unknown word
    token_idf = close.join(idf, "word").groupBy("token").agg(F.max("idf").alias("idf"))
    typed = readings.join(token_idf, "token", "left").join(F.broadcast(n_entries)).withColumn("idf", F.coalesce("idf", top_idf))
    length = typed.groupBy("value", "reading").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    typed = typed.join(length, ["value", "reading"]).select("value", "reading", "weight", "token", (F.col("idf") / F.col("norm")).alias("v_typed"))
    pair = typed.join(close, "token").join(weighted, "word").groupBy("value", "reading", "key", "form", "token").agg(F.max(F.col("weight") * F.col("v_typed") * F.col("v") * F.col("sim")).alias("s"), F.max("freq").alias("freq"))
    score = pair.groupBy("value", "reading", "key", "form").agg(F.sum("s").alias("score"), F.max("freq").alias("freq"))
    best = score.where(F.col("score") >= ACCEPT).groupBy("value").agg(F.max(F.struct(F.round("score", 9).alias("score"), "freq", (-F.col("key")).alias("minus"))).alias("b"))
    return distinct.join(best, "value", "left").select("value", (-F.col("b.minus")).alias("key"), F.col("b.score").alias("score"))


def map_rows(rows: DataFrame, reference: DataFrame, id_col: str = "typed_id", value_col: str = "element", version_col: str = "loaded_at", key_col: str = "term_id", word_col: str = "word", freq_col: str = "freq") -> DataFrame:
    """(id, value, key, score): one row per id whose value is neither null nor blank, key 0 if unmatched.

    Of several deliveries of an id the latest counts, ties by the greater value. Rows join the distinct values' results, hot values by broadcast.
    """
    r = pick(rows, id=id_col, value=value_col, version=version_col).where(F.col("id").isNotNull() & ~blank(F.col("value")))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = r.repartition(n, "id").groupBy("id").agg(F.max(F.struct("version", "value")).alias("r")).select("id", "r.value")
    sizes = r.groupBy("value").agg(F.count("*").alias("rows"))
    total = sizes.agg(F.sum("rows").alias("total_rows"))
    mapped = keep(map_values(sizes, reference, "value", key_col, word_col, freq_col).join(sizes, "value"))
    return join_hot(r, mapped, "value", "rows", total).select("id", "value", F.coalesce("key", F.lit(0)).alias("key"), "score")


def unmatched(mapped: DataFrame) -> DataFrame:
    """(value, rows): the values that mean no entry, with their frequency."""
    return mapped.where("key = 0").groupBy("value").agg(F.count("*").alias("rows"))
