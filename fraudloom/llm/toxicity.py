"""Toxicity: a learned lexicon in a trie, met with misspellings by a Levenshtein automaton.

Lexicon: words and word beginnings (stems, 3 to 9 letters) that are far more frequent in
texts labelled toxic than in others, learned with their weights (log ratio of the rates) from
labelled training rows.  A word of a text matches a term exactly, through a stem, or within one edit
of a term of five letters or more: the automaton of the word for one edit is run along the
trie; behind the edit the rest has to match, so a branch ends with its first other letter.
The outcome for a word is remembered within a task, so every distinct word is met once.

Context: a hit whose neighbourhood of WINDOW words holds quotation marks or a reporting word
counts QUOTED of its weight, so that text which quotes abuse stays apart from abuse.  A
logistic model of the weight of hits, their share of the words, and the weight of
misspelled hits gives the score.

Lexicon and model are fitted on at most SAMPLE_ROWS labelled training rows, chosen by a hash
of the id; everything else reads all rows.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import checked, crc_remainder, cut
from .tokens import slices, spans, word_hashes

SAMPLE_ROWS = 20_000
MIN_DOCS, MIN_RATIO, MIN_Z = 5, 8.0, 8.0
STEMS = range(3, 10)
WINDOW, QUOTED = 6, 0.25
MEMO = 4_000_000
HITS = ["__exact", "__share", "__near"]
LETTER = re.compile(r"[^\W\d_]")
QUOTES = (b'"', "“".encode(), "”".encode(), "«".encode(), "»".encode())
REPORTING = {b"said", b"says", b"wrote", b"quote", b"quoted", b"quoting", b"called"}


def bare(word: bytes) -> str:
    """A word without marks and digits at its ends; bytes are lower-cased already (A-Z)."""
    w = word.decode("utf-8", "replace")
    first, last = LETTER.search(w), LETTER.search(w[::-1])  # one pass each, however long the word
    return w[first.start() : len(w) - last.start()] if first else ""


class Lexicon:
    """Trie over terms; whole words match exactly or within an edit, stems match any word that begins with them."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.trie: dict = {}
        self.heads: dict[int, dict[int, set[str]]] = {}  # length of a word one edit away -> length of the half -> halves
        self.tails: dict[int, dict[int, set[str]]] = {}
        for w in words:
            if len(w) < 5:
                continue
            node = self.trie
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w
            h = len(w) // 2
            for n in (len(w) - 1, len(w), len(w) + 1):
                self.heads.setdefault(n, {}).setdefault(h, set()).add(w[:h])
                self.tails.setdefault(n, {}).setdefault(len(w) - h, set()).add(w[h:])

    def may_be_near(self, w: str) -> bool:
        """One edit changes the length by one at most and leaves the first or the last half of a term whole, at its end of the word."""
        for n, halves in self.heads.get(len(w), {}).items():
            if w[:n] in halves:
                return True
        for n, halves in self.tails.get(len(w), {}).items():
            if w[-n:] in halves:
                return True
        return False

    def near(self, w: str) -> str | None:
        """The term within one edit of `w` with the largest weight.

        The automaton of `w` for one edit, run along the trie: one state has read i letters
        without an edit, and from every node it passes the edit is made and the rest must match.
        """
        best = None

        def end(node: dict | None, i: int) -> None:
            nonlocal best
            for ch in w[i:]:
                if (node := node.get(ch)) is None:
                    return
            term = node.get("")
            if term is not None and (best is None or self.words[term] > self.words[best]):
                best = term

        node, n = self.trie, len(w)
        for i in range(n + 1):
            ahead, rest = w[i : i + 1], w[i + 1 : i + 2]
            for ch, child in node.items():
                if ch == "":
                    continue
                if i < n and ch != ahead and rest in child:  # another letter; `rest` is "" at the end of the word
                    end(child, i + 1)
                if ahead in child:  # a letter of the term left out
                    end(child, i)
            if i == n:
                end(node, n)
                break
            end(node, i + 1)  # a letter too many
            if (node := node.get(ahead)) is None:
                break
        return best

    def meet(self, w: str) -> tuple[float, float]:
        """(weight as an exact or stem match, weight as a misspelling)."""
        if not w:
            return 0.0, 0.0
        got = self.words.get(w, 0.0)
        for n in self.lengths:
            if len(w) >= n:
                got = max(got, self.stems.get(w[:n], 0.0))
        if got:
            return got, 0.0
        if len(w) >= 4 and self.may_be_near(w) and (t := self.near(w)):
            return 0.0, self.words[t]
        return 0.0, 0.0


def _features(batches):
    """(text, toxic) -> occurrences and documents per class of words ('w') and stems ('s'); kind 'd' counts all words."""
    uses, docs = (Counter(), Counter()), Counter()
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = Counter(bare(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split())
            words.pop("", None)
            c = uses[1 if y else 0]
            c[("d", "")] += words.total()
            own: Counter = Counter()
            for w, n in words.items():
                n = min(n, 3)  # one text says little, however often it says it
                own[("w", w)] += n
                for k in STEMS:
                    if len(w) > k:
                        own[("s", w[:k])] += n
            c.update(own)
            if y:
                docs.update(own.keys())
    keys = list(uses[0].keys() | uses[1].keys())
    names = ["kind", "term", "bad", "fine", "docs"]
    for a in range(0, len(keys), 50_000):
        part = keys[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([t for _, t in part]), *[pa.array([c[k] for k in part], pa.int64()) for c in (uses[1], uses[0], docs)]], names=names)


def learn_lexicon(labelled: DataFrame) -> Lexicon:
    """`labelled` (text, toxic), bounded by the caller."""
    counts = labelled.select("text", "toxic").mapInArrow(_features, "kind string, term string, bad bigint, fine bigint, docs bigint").groupBy("kind", "term").agg(*[F.sum(c).alias(c) for c in ("bad", "fine", "docs")])
    counts = cut(counts)
    sums = counts.filter("kind = 'd'").agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("fine"), F.lit(0))).first()
    bad, fine = sums[0] + 1.0, sums[1] + 1.0
    w = F.log(((F.col("bad") + 0.5) / bad) / ((F.col("fine") + 0.5) / fine))
    rows = counts.filter((F.col("kind") != "d") & (F.col("docs") >= MIN_DOCS)).withColumn("w", w).filter((F.col("w") >= float(np.log(MIN_RATIO))) & (F.col("w") * F.sqrt("docs") >= MIN_Z)).collect()  # of a bounded sample
    found = {(r.kind, r.term): (r.w, r.docs) for r in rows}
    whole = {t: n for (kind, t), (_, n) in found.items() if kind == "w"}
    stems: dict[str, float] = {}
    # the shortest beginning that many words share; one that a single word makes up is that word
    for (kind, t), (w, n) in sorted(found.items(), key=lambda x: (len(x[0][1]), x[0])):
        if kind == "s" and not any(t[:i] in stems for i in STEMS if i < len(t)) and not any(x.startswith(t) and m >= 0.5 * n for x, m in whole.items()):
            stems[t] = w
    words = {t: w for (kind, t), (w, _) in found.items() if kind == "w" and not any(t[:i] in stems for i in STEMS if i <= len(t))}
    return Lexicon(words, stems)


def _hits(lexicon, names: list[str]):
    """Adds the last three columns: log weight of hits, log share of hits in the words, log weight of misspelled hits."""

    def run(batches):
        lex: Lexicon = lexicon.value
        known = np.zeros(0, np.uint64)  # words without a match
        hot: dict[int, tuple[float, float]] = {}
        for b in batches:
            for lo, hi, raw, off in slices(b.column(names.index("text")), 1 << 21):
                starts, ends, first = spans(raw, off)
                h = word_hashes(raw, starts, ends)
                u, at = np.unique(h, return_index=True)
                if len(known):
                    pos = np.minimum(np.searchsorted(known, u), len(known) - 1)
                    fresh = known[pos] != u
                    u, at = u[fresh], at[fresh]
                dull = []
                for x, i in zip(u.tolist(), at.tolist()):
                    if x not in hot:
                        got = lex.meet(bare(raw[starts[i] : ends[i]].tobytes().lower()))
                        if got[0] or got[1]:
                            hot[x] = got
                        else:
                            dull.append(x)
                more = np.array(dull, np.uint64)  # in order, as `u` is: a stable sort merges two runs
                known = np.sort(np.concatenate((known, more)), kind="stable") if len(known) < MEMO else more
                n = hi - lo
                exact, near = np.zeros(n), np.zeros(n)
                if hot:
                    keys = np.array(sorted(hot), np.uint64)
                    pos = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    where = np.flatnonzero(keys[pos] == h)
                    doc = np.searchsorted(first, where, "right") - 1
                    for i, d in zip(where.tolist(), doc.tolist()):
                        e, m = hot[int(h[i])]
                        a, z = max(first[d], i - WINDOW), min(first[d + 1], i + WINDOW + 1)
                        near_by = raw[starts[a] : ends[z - 1]].tobytes().lower()
                        f = QUOTED if any(q in near_by for q in QUOTES) or REPORTING & set(near_by.split()) else 1.0
                        exact[d] += f * e
                        near[d] += f * m
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, n) for c in b.columns], *[pa.array(np.log1p(x)) for x in (exact, 100 * exact / np.maximum(np.diff(first), 1), near)]], names=[*names, *HITS])

    return run


def with_hits(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    return docs.mapInArrow(_hits(shared, docs.columns), StructType([*docs.schema.fields, *[StructField(c, DoubleType()) for c in HITS]]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge; weights of hits are kept at zero or above."""
    x = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    b[1:] = np.maximum(b[1:], 0)
    return b


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> tuple[Lexicon, np.ndarray]:
    """(lexicon, logistic weights), from labelled rows whose crc32(doc_id as text) mod `folds` is not 0."""
    y = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(crc_remainder(folds) != 0)
    share = min(1.0, SAMPLE_ROWS / max(1, y.count()))
    y = y.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), 1 << 30) < int(share * (1 << 30))).select(F.col("doc_id").alias("__id"), "toxic")
    rows = cut(docs.select("doc_id", "text").join(checked(y, 2 * SAMPLE_ROWS), F.col("doc_id") == F.col("__id")).select("text", "toxic").dropDuplicates())
    lexicon = learn_lexicon(rows)
    seen = with_hits(rows, lexicon).select(*HITS, "toxic").toPandas()  # four numbers a sampled row
    if seen.empty:
        return lexicon, np.array([-2.0, 1.0, 1.0, 0.5])
    return lexicon, _logistic(seen[HITS].to_numpy(), (seen["toxic"] > 0).to_numpy(float))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row; a text without words scores as one without hits."""
    lexicon, b = fit(docs, labels, folds)
    out = with_hits(docs.select("doc_id", "text"), lexicon)
    z = F.lit(float(b[0]))
    for weight, c in zip(b[1:], HITS):
        z = z + float(weight) * F.col(c)
    score = 1 / (1 + F.exp(-z))
    return out.select("doc_id", (crc_remainder(folds) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
