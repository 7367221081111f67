"""Toxicity scores: Levenshtein automata meet a lexicon trie, and a window of context tells quotation from abuse.

The lexicon is learned from the labelled rows that are not held out: words, and word beginnings, that toxic rows have
more often than chance allows for so many candidates.  Labels weigh each term, and one that they do not support is none.
The terms' trie is intersected with the Levenshtein automaton of every term into one table of states; a state is the
set of (trie node, edits so far) that a word's letters can have reached.  All words of a batch walk the table side by
side, a letter a step, and most leave it after two or three letters.

Texts are walked as characters.  A word is a run of letters and digits; runs that only an apostrophe parts, and
whole words between white space from their first letter to their last, are walked too and count where they are
nearer to a term than the runs inside, so neither marks around a term nor marks within it hide it.

Each hit is weighed by its window, which ends with its sentence: hits near a second person are aimed; hits inside
quotation marks, and hits after a word of saying that are not aimed, are quoted.  A text's different words that hit
count, not how often it has one.  A logistic model of a few such sums gives the score: one term alone, not aimed, is a
mention, and two are abuse.

Defined cases: null and empty texts score like any text without hits; ties and repeated rows score alike;
without labelled rows nothing is learned and no text is toxic; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import characters_of
from .common import ascii_lower, fold, id_and_text, parts_of

HELD_OUT_FOLDS = 5
#: A term's least number of toxic training rows and least log odds, the share of false terms that is put up with, and the
#: log odds of a full weight.
MIN_ROWS, MIN_ODDS, FALSE_TERMS, FULL_ODDS = 3, 3.0, 0.01, 4.0
STEM_MIN, STEM_MAX = 4, 8
#: A word one edit from a term is an ordinary word if so many clean training rows have it.
MIN_PLAIN = 2
#: Terms shorter than this must match exactly; others within one edit.
FUZZY_LETTERS = 5
WINDOW = 6
PART = 1 << 20
#: Terms and weights are learned from so many labelled rows at most, those with the least hash.
MAX_FIT = 12_000
# Words that announce a quotation, and second persons.
SAYING = ("said", "says", "wrote", "called", "quoted", "dit", "sagte", "dijo")
AIMED = ("you", "your", "youre", "tu", "vous", "du", "ihr", "usted")
FEATURES = ("exact", "fuzzy", "quoted", "aimed", "rate")


Terms = tuple[tuple[str, bool, float], ...]


@dataclass
class Automaton:
    """step[state, letter class] -> state, 0 is dead; term edits at the end of a word: 0 exact, 1 one edit, 9 none; the nearest term's weight.

    A settled state stays whatever follows: the dead one, and a stem's.
    """

    step: np.ndarray
    accept: np.ndarray
    letter: np.ndarray = field(repr=False)
    settled: np.ndarray = field(repr=False)
    weight: np.ndarray | None = field(default=None, repr=False)


@lru_cache(maxsize=8)
def build_automaton(terms: tuple[tuple, ...]) -> Automaton:
    """terms: (letters, whether any ending may follow[, weight])."""
    words = {(tuple(map(ord, t[0])), t[1]): (t[2] if len(t) > 2 else 1.0) for t in terms if t[0]}
    used = sorted({b for w, _ in words for b in w})
    letter = np.zeros(max([255, *used]) + 2, np.int64)  # class 0: a character of no term, as all behind the last are
    for k, b in enumerate(used, 1):
        letter[b] = k
        if 97 <= b <= 122:
            letter[b - 32] = k
    nodes: list[dict[int, int]] = [{}]
    ends: list[dict[bool, tuple[int, float]]] = [{}]  # {stem?: (edits allowed, weight)}
    for (w, stem), weight in sorted(words.items()):
        at = 0
        for b in w:
            c = int(letter[b])
            if c not in nodes[at]:
                nodes.append({})
                ends.append({})
                nodes[at][c] = len(nodes) - 1
            at = nodes[at][c]
        ends[at][stem] = (1 if len(w) >= FUZZY_LETTERS and not stem else 0, weight)
    fuzzy = [False] * len(nodes)  # some fuzzy term lies below
    for at in range(len(nodes) - 1, -1, -1):
        fuzzy[at] = any(e == 1 for e, _ in ends[at].values()) or any(fuzzy[k] for k in nodes[at].values())

    # node -1 - k: the stem that ends at node k has matched; whatever follows
    def closure(items: set[tuple[int, int]]) -> frozenset:
        out, todo = set(), list(items)
        while todo:
            node, e = todo.pop()
            if (node, e) in out:
                continue
            out.add((node, e))
            if node >= 0 and e == 0 and fuzzy[node]:  # a letter of the term is left out
                todo += [(k, 1) for k in nodes[node].values() if fuzzy[k]]
        best: dict[int, int] = {}
        for node, e in out:
            best[node] = min(e, best.get(node, 9))
        return frozenset(best.items())

    def moved(state: frozenset, c: int) -> frozenset:
        out = set()
        for node, e in state:
            if node < 0:
                out.add((node, e))
                continue
            if c in nodes[node] and (e == 0 or fuzzy[nodes[node][c]]):
                k = nodes[node][c]
                out.add((k, e))
                if True in ends[k] and e == 0:
                    out.add((-1 - k, 0))
            if e == 0 and fuzzy[node]:
                out.add((node, 1))  # a letter too many
                out |= {(k, 1) for k in nodes[node].values() if fuzzy[k]}  # another letter
        return closure(out) if out else frozenset()

    index = {frozenset(): 0, closure({(0, 0)}): 1}
    states = list(index)
    step: list[list[int]] = [[0] * (len(used) + 1)]
    k = 1
    while k < len(states):
        row = []
        for c in range(len(used) + 1):
            to = moved(states[k], c)
            if to not in index:
                index[to] = len(states)
                states.append(to)
            row.append(index[to])
        step.append(row)
        k += 1

    def nearest_term(state: frozenset) -> tuple[int, float]:
        """Least edits, and the greatest weight of the terms that are so near."""
        found = [(9, 0.0)]
        for node, e in state:
            if node < 0:
                found.append((e, -ends[-1 - node][True][1]))
            else:
                found += [(e, -weight) for allowed, weight in ends[node].values() if e <= allowed]
        e, weight = min(found)
        return e, -weight

    table = np.array(step, np.int32)
    settled = (table == np.arange(len(table))[:, None]).all(axis=1)
    accept, weight = zip(*map(nearest_term, states), strict=True)
    return Automaton(table, np.array(accept, np.int8), letter, settled, np.array(weight))


def build_exact(words: tuple[str, ...]) -> Automaton | None:
    """The automaton of whole words without edits: a trie."""
    if not words:
        return None
    letters = sorted({ord(c) for w in words for c in w})
    letter = np.zeros(max([255, *letters]) + 2, np.int64)
    for k, b in enumerate(letters, 1):
        letter[b] = k
        if 97 <= b <= 122:
            letter[b - 32] = k
    step, accept = [[0] * (len(letters) + 1), [0] * (len(letters) + 1)], [9, 9]
    for w in words:
        at = 1
        for c in w:
            k = int(letter[ord(c)])
            if not step[at][k]:
                step[at][k] = len(step)
                step.append([0] * (len(letters) + 1))
                accept.append(9)
            at = step[at][k]
        accept[at] = 0
    settled = np.zeros(len(step), bool)
    settled[0] = True
    return Automaton(np.array(step, np.int32), np.array(accept, np.int8), letter, settled)


def final_states(a: Automaton, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The state in which each word leaves the table: all words go through it side by side."""
    got = np.zeros(len(start), np.int64)
    live = np.flatnonzero(end > start)
    state = np.ones(len(live), np.int64)
    at, stop = start[live], end[live]
    while len(live):
        state = a.step[state, a.letter[np.minimum(buf[at], np.int64(len(a.letter) - 1))]].astype(np.int64)
        at = at + 1
        over = (at == stop) | a.settled[state]
        if over.any():
            got[live[over]] = state[over]
        go = ~over
        live, state, at, stop = live[go], state[go], at[go], stop[go]
    return got


def walk(a: Automaton, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Edits of the nearest term for each word, 9 for none."""
    return a.accept[final_states(a, buf, start, end)]


SPACE, ALNUM, APOSTROPHE, OPEN_OR_CLOSE, CLOSE, QUOTES = 1, 2, 3, 4, 5, 6
#: Marks that end a sentence or one of its parts that stands alone, and the line's end.
SENTENCE_ENDS = ".!?;:\u2026\n"
#: Marks that open and close by turns, by family.
TURNS = ('"\uff02', "\u201c\u201d\u201e\u201f", "\u00ab\u00bb", "\u2039\u203a")


@cache
def character_kinds() -> np.ndarray:
    """By code point: white space, letter or digit, apostrophe, single quotation mark, or a family of TURNS from QUOTES on."""
    kind = np.zeros(sys.maxunicode + 1, np.uint8)
    kind[[k for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k))[0] in "LN"]] = ALNUM
    kind[[*range(9, 14), 32]] = SPACE
    kind[ord("'")] = APOSTROPHE
    kind[[0x2018, 0x201A, 0x201B]] = OPEN_OR_CLOSE
    kind[0x2019] = CLOSE
    for k, marks in enumerate(TURNS):
        kind[[ord(c) for c in marks]] = QUOTES + k
    return kind


@dataclass
class Runs:
    """The runs of letters and digits of some texts, and which of them one word holds together with the next."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    by_apostrophe: np.ndarray
    by_word: np.ndarray


def runs_of(kind: np.ndarray, offsets: np.ndarray) -> Runs:
    n = int(offsets[-1])
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    solid = np.concatenate([[False], kind[:n] == ALNUM, [False]])
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    same = doc[1:] == doc[:-1]
    spaces = np.concatenate([[0], np.cumsum(kind[:n] == SPACE, dtype=np.int32)])
    one = (start[1:] - end[:-1] == 1) & (kind[end[:-1]] == APOSTROPHE)
    return Runs(start, end, doc, same & one, same & (spaces[start[1:]] == spaces[end[:-1]]))


def nearest(a: Automaton, buf: np.ndarray, r: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each run's edits and term weight, and where its word ends; of several runs that together are nearer, the first has theirs."""
    states, stop = final_states(a, buf, r.start, r.end), r.end.copy()
    edits = a.accept[states].copy()
    for held in (r.by_apostrophe, r.by_word):
        if not held.any():
            continue
        head = np.flatnonzero(np.concatenate([[True], ~held]))
        tail = np.append(head[1:], len(edits))
        several = tail - head > 1
        best = np.minimum.reduceat(edits, head)[several]
        head, tail = head[several], tail[several]
        together = final_states(a, buf, r.start[head], r.end[tail - 1])
        for i, j, t in zip(*(x[a.accept[together] < best].tolist() for x in (head, tail, together)), strict=True):
            edits[i:j] = 9
            edits[i], states[i], stop[i] = a.accept[t], t, r.end[j - 1]
    return edits, a.weight[states], stop


def in_quotes(kind: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which places lie inside quotation marks of one family."""
    n = int(offsets[-1])
    out = np.zeros(len(start), bool)
    for k in range(len(TURNS)):
        mark = np.flatnonzero(kind[:n] == QUOTES + k)
        if len(mark):
            # an odd number of them between the text's start and the place, and one more behind it
            before = np.searchsorted(mark, start) - np.searchsorted(mark, offsets[doc])
            behind = np.searchsorted(mark, offsets[doc + 1]) - np.searchsorted(mark, end)
            out |= (before % 2 == 1) & (behind > 0)
    # Single marks open before a letter and close elsewhere; one that closes within a word is an apostrophe.
    mark = np.flatnonzero((kind[:n] == OPEN_OR_CLOSE) | (kind[:n] == CLOSE))
    opens = (np.append(kind[:n], 0)[mark + 1] == ALNUM) & ~np.isin(mark + 1, offsets)
    use = (kind[mark] == OPEN_OR_CLOSE) | ~opens
    mark, opens = mark[use], opens[use]
    if len(mark):
        last, then = np.searchsorted(mark, start) - 1, np.searchsorted(mark, end)
        after = np.minimum(then, len(mark) - 1)
        out |= (last >= 0) & opens[last] & (mark[last] >= offsets[doc]) & (then < len(mark)) & ~opens[after] & (mark[after] < offsets[doc + 1])
    return out


def features_of(column, a: Automaton, context: Automaton, plain: Automaton | None = None) -> np.ndarray:
    """One row of FEATURES for each text; words of `plain` are ordinary words and no misspelt terms."""
    buf, offsets = characters_of(column)
    docs = len(offsets) - 1
    out = np.zeros((docs, len(FEATURES)))
    kind = character_kinds()[buf]
    r = runs_of(kind, offsets)
    if not len(r.start):
        return out
    s, e, doc = r.start, r.end, r.doc
    edits, weight, stop = nearest(a, buf, r)
    near_miss = np.flatnonzero(edits == 1)
    if plain is not None and len(near_miss):
        edits[near_miss[walk(plain, buf, s[near_miss], e[near_miss]) == 0]] = 9
    hit = np.flatnonzero(edits < 9)
    if not len(hit):
        return out
    n = len(s)
    sentence = np.cumsum(np.isin(buf[: int(offsets[-1])], [ord(c) for c in SENTENCE_ENDS]))[s]
    aimed, said = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
    for k in range(-WINDOW, WINDOW + 1):
        near = np.clip(hit + k, 0, n - 1)
        same = (doc[near] == doc[hit]) & (sentence[near] == sentence[hit]) & (near == hit + k) & (k != 0)
        word = same & (walk(context, buf, s[near], e[near]) == 0)
        size = e[near] - s[near]
        first = buf[s[near]] | 32
        # said/says/wrote/called/quoted/dit/sagte/dijo against you/your/tu/vous/du/ihr/usted, told apart by first letters
        speech = word & (np.isin(first, [ord(c) for c in "swcq"]) | ((first == ord("d")) & (size > 2)))
        said |= speech & (k < 0)
        aimed |= word & ~speech
    quoted = in_quotes(kind, offsets, s[hit], e[hit], doc[hit]) | (said & ~aimed)
    aimed &= ~quoted
    d, w = doc[hit], weight[hit]
    names = [bytes(memoryview(np.ascontiguousarray(_folded(buf[i:j])))) for i, j in zip(s[hit].tolist(), stop[hit].tolist(), strict=True)]
    for column_of, which in ((0, (edits[hit] == 0) & ~quoted), (1, (edits[hit] == 1) & ~quoted), (2, quoted), (3, aimed)):
        own: dict[tuple[int, bytes], float] = {}  # a text's different words
        for k in np.flatnonzero(which).tolist():
            own[int(d[k]), names[k]] = w[k]
        if own:
            out[:, column_of] = np.bincount([k for k, _ in own], list(own.values()), docs)
    share = (out[:, 0] + out[:, 1]) / np.maximum(np.bincount(doc, minlength=docs), 1)
    out = np.log1p(out)
    out[:, 4] = share
    return out


def _folded(points: np.ndarray) -> np.ndarray:
    wide = points.astype(np.int32)
    return np.where((wide >= 65) & (wide <= 90), wide + 32, wide)


def counted_words(train: DataFrame) -> DataFrame:
    """(w, stem, t, c): words, and beginnings of words, with the toxic and clean training rows that have them, from one pass."""
    text = ascii_lower(F.col("text"))
    whole = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*)"))
    words = F.array_distinct(F.concat(whole, F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"))))
    begun = F.flatten(F.transform(F.filter("ws", lambda w: F.length(w) > STEM_MIN), lambda w: F.transform(
        F.filter(F.sequence(F.lit(STEM_MIN), F.lit(STEM_MAX)), lambda k: k < F.length(w)), lambda k: F.substring(w, 1, k))))
    kinds = F.array(F.struct(F.lit(False).alias("stem"), F.col("ws").alias("all")), F.struct(F.lit(True).alias("stem"), F.array_distinct(begun).alias("all")))
    rows = train.select("label", words.alias("ws")).select("label", F.explode(kinds).alias("k"))
    rows = rows.select("label", "k.stem", F.explode("k.all").alias("w"))
    return rows.groupBy("w", "stem").agg(F.sum("label").alias("t"), F.sum(F.lit(1) - F.col("label")).alias("c"))


def chance(t: int, n: int, share: float) -> float:
    """The chance that t or more of n rows are toxic where that share of all rows is."""
    total = 0.0
    for k in range(n, t - 1, -1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share))
    return min(1.0, total)


def learn_terms(counts: DataFrame, toxic: int, clean: int) -> Terms:
    """Terms with weights, from counted_words() of so many toxic and clean rows.

    Of all words and beginnings in MIN_ROWS rows, those that toxic rows have by more than chance: ordered by that chance,
    as many as keep the share of false ones under FALSE_TERMS.  A weight is the smoothed log odds over FULL_ODDS, 1 at most.
    """
    if not toxic or not clean:
        return ()
    asked = counts.filter(F.col("t") + F.col("c") >= MIN_ROWS)
    all_ = asked.count()
    # a term is at least four times as frequent among toxic rows; the rows are as many as MAX_FIT texts hold at most
    likely = asked.filter((F.col("t") >= MIN_ROWS) & (F.length("w") >= STEM_MIN) & (F.col("t") * clean >= F.col("c") * 4 * toxic)).collect()
    share = toxic / (toxic + clean)
    ranked = sorted(((chance(r["t"], r["t"] + r["c"], share), r["w"], r["stem"], r["t"], r["c"]) for r in likely), key=lambda x: x[:3])
    kept = max((k for k, x in enumerate(ranked, 1) if x[0] <= FALSE_TERMS * k / all_), default=0)
    odds = {(w, stem): math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for _, w, stem, t, c in ranked[:kept]}
    rows = {(w, stem): t for _, w, stem, t, _ in ranked[:kept] if odds[w, stem] >= MIN_ODDS}
    chosen = chosen_terms({w: t for (w, stem), t in rows.items() if not stem}, {w: t for (w, stem), t in rows.items() if stem})
    return tuple((w, stem, round(min(1.0, odds[w, stem] / FULL_ODDS), 4)) for w, stem in chosen)


def ordinary_words(counts: DataFrame, terms: Terms) -> tuple[str, ...]:
    """Words one edit from a term that clean training rows use: MIN_PLAIN rows or more, and more than toxic ones."""
    shortest = min((len(t[0]) for t in terms), default=1) - 1
    used = counts.filter(~F.col("stem") & (F.col("c") >= MIN_PLAIN) & (F.col("c") > F.col("t")) & (F.length("w") >= shortest))
    found = sorted(r["w"] for r in used.select("w").collect()) if terms else []  # as many as MAX_FIT texts hold at most
    if not found:
        return ()
    buf, offsets = characters_of(pa.array(found))
    edits = walk(build_automaton(terms), buf, offsets[:-1], offsets[1:])
    return tuple(w for w, e in zip(found, edits.tolist(), strict=True) if e == 1)


def chosen_terms(whole: dict[str, int], begun: dict[str, int]) -> list[tuple[str, bool]]:
    """Of the words and beginnings with their toxic rows: the shortest stems, and all whole terms beside them.

    A stem matches as it is whatever follows; the whole terms below it match with an edit too, so both stay.
    """
    # The shortest stem that covers nearly what a longer one does stands for it.
    stems: set[str] = set()
    for w in sorted(begun, key=lambda w: (len(w), w)):
        if not any(w[:k] in stems for k in range(STEM_MIN, len(w))):
            stems.add(w)
    below: dict[str, list[str]] = {}
    for w in whole:
        for k in range(STEM_MIN, min(STEM_MAX, len(w)) + 1):
            if w[:k] in stems:
                below.setdefault(w[:k], []).append(w)
    # a stem that is hardly more than one word is that word
    stems -= {w for w, inside in below.items() if len(inside) == 1 and whole[inside[0]] >= 0.9 * begun[w]}
    return [(w, True) for w in sorted(stems)] + [(w, False) for w in sorted(whole)]


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps for a logistic model whose weights are drawn to the prior; the last weight is the constant.

    A feature that the labelled rows say nothing about keeps its prior weight.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.zeros(x.shape[1]) if prior is None else prior
    w = prior.copy()
    penalty = np.diag([ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ (w - prior))
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Prior weights of FEATURES and the constant, and how strongly they hold: two terms, or one that is aimed or most of
#: the text, are past one half; a mention is not.
PRIOR = np.array([6.0, 3.0, 0.0, 3.0, 4.0, -5.5])
RIDGE = 30.0


@dataclass
class ToxicityModel:
    terms: Terms
    weights: np.ndarray
    plain: tuple[str, ...] = ()

    def automata(self) -> tuple[Automaton, Automaton, Automaton]:
        """Of the terms, the context words and the ordinary words."""
        return build_automaton(self.terms), build_automaton(tuple((w, False) for w in SAYING + AIMED)), build_exact(self.plain)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from labelled rows outside fold 0 of 5, MAX_FIT at most."""
    docs = id_and_text(df, id_col, text_col).filter(fold(F.col("doc_id"), HELD_OUT_FOLDS) != 0)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), HELD_OUT_FOLDS) != 0))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(MAX_FIT)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").persist()
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = counted_words(sample).filter(F.col("t") + F.col("c") >= MIN_PLAIN).persist()
    terms = learn_terms(counts, sizes.get(1, 0), sizes.get(0, 0))
    model = ToxicityModel(terms, PRIOR, ordinary_words(counts, terms))
    counts.unpersist()
    got = features(sample, model, extra="label").select("label", "features").toPandas()
    sample.unpersist()
    if got["label"].nunique() < 2:
        return model
    return ToxicityModel(terms, fit_logistic(np.array(got["features"].tolist()), got["label"].to_numpy(float), PRIOR, RIDGE), model.plain)


def _parts(b: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Slices with about PART bytes of text: a byte takes about a hundred while it is walked."""
    sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
    return parts_of(b, sizes, PART)


def features(df: DataFrame, model: ToxicityModel, extra: str | None = None) -> DataFrame:
    """(doc_id, [extra,] features) of rows with doc_id and text."""
    schema = "doc_id long, " + (f"{extra} int, " if extra else "") + "features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = model.automata()
        for b in batches:
            for part in _parts(b, "text"):
                x = features_of(part.column("text"), *automata)
                columns = [part.column("doc_id"), *([part.column(extra)] if extra else []), pa.array(list(x), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *([extra] if extra else []), "features"])

    return df.select("doc_id", *([extra] if extra else []), "text").mapInArrow(run, schema)


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = model.automata()
        for b in batches:
            for part in _parts(b, "text"):
                p = model.score(features_of(part.column("text"), *automata))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), HELD_OUT_FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def toxicity(df: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    return score(df, fit(df, labels, **columns), **columns)


def drop_toxic(df: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the rows that score `threshold` or more; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = model.automata()
        for b in batches:
            for part in _parts(b, text_col):
                texts = part.column(part.schema.get_field_index(text_col)).fill_null("")
                yield part.filter(pa.array(model.score(features_of(texts, *automata)) < threshold))

    return df.mapInArrow(run, df.schema)
