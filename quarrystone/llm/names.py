"""Linking of variant spellings of persons, organisations and products.

Each distinct spelling is read into a kind, a core (surname, organisation stem, model name) and a second part (first
name, line of business, number), with nicknames, abbreviations, legal forms, titles and order evened out; spellings
that read alike are one key. Keys of one block (kind and second part) are compared where at most two edits part their cores or
these sound alike, and the character n-gram vectors of the cores, weighted by rarity, have a cosine of 0.4. Such keys share a
form: the core with no, one or two letters left out, a piece of a long core, or its sound. Keys of any
block and kind meet by equal forms too: the whole name, or both parts of a person's, as they are and with one letter left
out, and cores that sound alike, so every pair within one edit of these is compared whatever its cosine. Pairs that share a
form are checked by edit distance, and all of them are grouped by average linkage, reciprocal nearest neighbours of each round at
once. A name in any share of the rows is one spelling; spellings of a group meet in blocks. There is no top-n cap: every
pair over the threshold is kept, as a cap would lose links.

Forms are hashes made where they are needed. As they are many times the names, they are shuffled in rounds by hash, each of a
bounded number of forms a key; the shuffle of a round is deleted when its pairs are written.

What the reading knows (nicknames, lines of business, titles) is a ``Lexicon``, a parameter; short forms, acronyms of listed
lines, misspelt and cut words follow by rule.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.runtime import discard, shuffles_deleted, small_side, stored

#: Cosine of two cores that are compared further.
COSINE = 0.4
#: Letters by which the lengths of two cores may differ to be within two edits; cores that sound alike meet elsewhere.
LENGTHS = 2
#: Average similarity from which groups are merged: more than two edits alone give.
AVERAGE = 0.46
#: Letters from which whole names of different kinds may differ by an edit.
WHOLE = 8
#: Spellings of a group that meet in one task, a side.
BLOCK = 500

#: Letters from which one edit makes a variant of a name's core; shorter cores that differ by a letter are other names.
EDITED = 7
#: Letters from which two edits are accepted.
TWICE = 8
#: Letters to which a core has forms with two letters left out; longer ones meet by pieces.
LONG = 24
#: Forms a key that are shuffled at once, on average; rounds have at least FEW in all.
AT_ONCE = 32
FEW = 4_000_000
#: Pairs or forms written in one Arrow batch, about.
BATCH = 500_000
#: Letters that a short form keeps of the beginning of a word, at least.
KEPT = 3

#: Public table of first names and the short and foreign forms people use for them that no rule gives. Forms that
#: are a beginning of the name, with or without a closing y, ie, i or o, need no entry.
NICKNAMES = {
    "alexander": "alex sascha xander sandro al lex", "charlotte": "charlie lotte lottie lotti charly",
    "dolores": "lola lolita loli", "edouard": "eddy edward eduard ed eddie edi", "elizabeth": "betty liz lisa beth lizzy eliza elisabeth lizzie",
    "francisco": "paco pancho curro frank francis quico", "friedrich": "fritz fred frederick friedel freddy", "gabriele": "gabi gaby gabriela",
    "isabelle": "belle isa bella isabella isabel", "johannes": "hans hannes johann jo johnny john", "jose": "pepe joe pepito joseph",
    "jurgen": "juergen jurg juerg jorg", "katharina": "kathi kaethe kathe kate katie cathy katja kati", "margaret": "peggy maggie meg marge madge greta",
    "michael": "mike mick mickey michi mikey micky", "nicolas": "nico nick nicholas nicky", "richard": "rick dick rich richie ricky",
    "robert": "bob rob bobby robbie bert", "susanne": "susi sanne susan sue suzanne susie", "theodore": "theo ted teddy theodor",
    "thomas": "tom tommy tomas", "wilhelmina": "willa mina minna wilma minnie", "william": "bill will willy billy liam wilhelm", "zoltan": "zoli zolika",
}
#: Public table of words that name a line of business or a form of enterprise, one key a row; misspelt, shortened
#: and abbreviated forms follow by rule.
BUSINESS = {
    "automotive": "automotive", "batteriewerke": "batteriewerke", "energysystems": "energy systems", "engineering": "engineering",
    "fahrzeugbau": "fahrzeugbau", "international": "international", "logistics": "logistics", "motors": "motors",
    "researchinstitute": "research institute", "technologies": "technologies technology", "versicherung": "versicherung",
    "group": "group", "holding": "holding", "industries": "industries", "solutions": "solutions", "partners": "partners", "bank": "bank",
    "pharmaceuticals": "pharmaceuticals", "services": "services", "consulting": "consulting", "foods": "foods", "media": "media",
    "robotics": "robotics", "software": "software", "electronics": "electronics", "chemicals": "chemicals",
}
#: Legal forms.
LEGAL = re.compile(
    r"(?:[\s,]+|^)(?:a\.?\s?g\.?|aktiengesellschaft|g\.?\s?m\.?\s?b\.?\s?h\.?|gesellschaft mbh|ltd\.?|limited|inc\.?|incorporated|"
    r"kft\.?|s\.?\s?a\.?|s\.?\s?r\.?\s?l\.?|llc|plc|corp\.?|corporation|company|co\.?|kg|se|b\.?\s?v\.?)$"
)
#: Titles.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "sir", "herr", "frau", "dipl", "ing", "sr", "sra", "mme"}


def _shorter(s: str) -> set[str]:
    """A text as it is and with each letter left out."""
    return {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}


class Lexicon:
    """Public knowledge about names, which ``link_names`` takes as a parameter: replace or empty it for other languages."""

    def __init__(self, nicknames: dict[str, str] = NICKNAMES, business: dict[str, str] = BUSINESS, titles: set[str] = TITLES):
        self.nicknames, self.business, self.titles = nicknames, business, titles
        self.first = {n: k for k, v in nicknames.items() for n in [k, *v.split()]}
        #: longer first names by their forms with a letter left out, of which two within one edit share one
        self.near: dict[str, list[str]] = {}
        for n in self.first:
            for f in _shorter(n) if len(n) >= 4 else ():
                self.near.setdefault(f, []).append(n)
        self.order = {n: i for i, n in enumerate(self.first)}
        self.words = {w: k for k, v in business.items() for w in v.split()}
        #: initials of keys of several words
        self.initials = {"".join(w[0] for w in v.split()): k for k, v in business.items() if len(v.split()) > 1 and k == v.replace(" ", "")}


_LEXICON = Lexicon()


def fold(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", s.casefold())
    return "".join(c for c in s if not unicodedata.combining(c))


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most + 1`` if it is larger than ``most``."""
    if a == b:
        return 0
    # an edit removes one letter of either at most
    if abs(len(a) - len(b)) > most or len((x := set(a)) - (y := set(b))) > most or len(y - x) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


@lru_cache(100_000)
def business(word: str, known: Lexicon = _LEXICON) -> str | None:
    """The line of business a word, misspelt or shortened, stands for."""
    if word in known.words:
        return known.words[word]
    if len(word) < 3 or word in known.first:
        return None
    for w, k in known.words.items():
        if len(word) < len(w) and w.startswith(word):
            return k
    best = None
    for w, k in known.words.items():
        if len(w) >= 5 and distance(word, w, 1 if len(w) < 9 else 2) <= (1 if len(w) < 9 else 2):
            best = best or k
        # letters left out: same first and last letter (or that of the plural), the others in order
        if best is None and len(word) >= 4 and len(w) >= 6 and word[0] == w[0] and word[-1] in w[-2:]:
            rest = iter(w)
            if all(c in rest for c in word) and len(re.sub("[aeiou]", "", word)) >= 0.6 * len(word):
                best = k
    return best


@lru_cache(100_000)
def first_name(word: str, known: Lexicon = _LEXICON) -> str | None:
    if word in known.first:
        return known.first[word]
    if len(word) >= 4:
        for n in sorted({n for f in _shorter(word) for n in known.near.get(f, ())}, key=known.order.__getitem__):
            if distance(word, n, 1) <= 1:
                return known.first[n]
    return None


def _cut_business(word: str, known: Lexicon) -> tuple[str, str] | None:
    """A stem with its line of business written on to it."""
    for w, k in known.words.items():
        if word.endswith(w) and len(word) - len(w) >= 4:
            return word[: -len(w)], k
    return None


def read_name(name: str, known: Lexicon = _LEXICON) -> tuple[str, str, str]:
    """(kind, core, second part) of a spelling."""
    s = " ".join(fold(name).replace("’", "'").split())
    m = re.fullmatch(r"(\w)\.? (.+?) ?\((.+)\)", s)
    if m and m[3].startswith(m[1]):
        s = f"{m[3]} {m[2]}"
    legal = False
    if s.startswith("the "):
        s, legal = s[4:], True
    while (m := LEGAL.search(s)) and m.start() > 0:
        s, legal = s[: m.start()].rstrip(" ,"), True
    m = re.fullmatch(r"(.*?[^\W\d_].*?)[\s,._-]*(\d+)", s)
    if m:
        return "product", re.sub(r"[\W_]+", "", m[1]), str(int(m[2]))
    comma = s.split(",")
    tokens = [re.sub(r"[\W_]+", "", t) for t in re.split(r"[\s,]+", s)]
    upper = {re.sub(r"\W+", "", t).lower() for t in re.split(r"[\s,]+", name) if 2 <= len(t) <= 4 and t.isupper()}
    tokens = [t for t in tokens if t]
    if not tokens:
        return "other", s, ""
    kinds: list[str | None] = [business(t, known) for t in tokens]
    for i, t in enumerate(tokens):
        if kinds[i] is None and t in upper and t in known.initials:
            kinds[i] = known.initials[t]
        if kinds[i] is None and (legal or len(tokens) > 1 or len(t) > 14) and (found := _cut_business(t, known)):
            tokens[i], kinds[i] = found[0], "+" + found[1]
    lines = [k.lstrip("+") for k in kinds if k]
    if lines and any(k is None or k[0] == "+" for k in kinds):
        stem = "".join(t for t, k in zip(tokens, kinds) if k is None or k[0] == "+")
        return "organisation", stem, max(lines, key=lambda k: (lines.count(k), len(k)))
    if legal:
        return "organisation", "".join(tokens), ""
    tokens = [t for t in tokens if t not in known.titles] or tokens
    if len(tokens) == 1:
        return "other", tokens[0], ""
    if len(comma) == 2 and comma[1].strip():
        split = len([t for t in re.split(r"\s+", comma[0].strip()) if t])
        tokens = tokens[split:] + tokens[:split]
    elif first_name(tokens[-1], known) and not first_name(tokens[0], known) and len(tokens[0]) > 1:
        tokens = tokens[-1:] + tokens[:-1]
    first, rest = tokens[0], [t for t in tokens[1:] if len(t) > 1]
    if not rest:
        return "other", "".join(tokens), ""
    return "person", "".join(rest), first if len(first) == 1 else first_name(first, known) or first


_ALIKE = str.maketrans("wyzk", "visc")
_DOUBLE = re.compile(r"(.)\1")


def by_ear(s: str) -> str:
    return _DOUBLE.sub(r"\1", s.replace("ph", "f").translate(_ALIKE))


def core_similarity(a: str, b: str) -> float:
    short = min(len(a), len(b))
    most = 2 if short >= TWICE else 1 if short >= EDITED else 0
    d = distance(a, b, most)
    if d > 1:
        if by_ear(a) == by_ear(b):
            d = 1
    return {0: 1.0, 1: 0.95, 2: 0.45}.get(d, 0.0) if d <= most else 0.0


def short_form(a: str, b: str) -> bool:
    """Whether one first name is the beginning of the other, with or without a closing y, ie or i (Sam, Andy, Danny)."""
    a, b = sorted((a, b), key=len)
    stem = re.sub(r"(?:ie|y|i)$", "", a)
    stems = [a, stem, stem[:-1] if stem[-2:-1] == stem[-1:] else stem]
    return any(len(x) >= KEPT and b.startswith(x) for x in stems)


def second_similarity(kind: str, a: str, b: str, known: Lexicon = _LEXICON) -> float:
    if a == b:
        return 1.0
    if kind == "person":
        if len(a) == 1 or len(b) == 1:
            return 0.8 if a[0] == b[0] else 0.0
        if a in known.nicknames and b in known.nicknames:
            return 0.0
        return 0.95 if (len(a) > 3 and len(b) > 3 and distance(a, b, 1) <= 1) or short_form(a, b) else 0.0
    return 0.0


def whole(kind: str, core: str, second: str) -> str | None:
    """The whole name in its written order; None for a person known by an initial."""
    if kind == "person":
        return second + core if len(second) > 1 else None
    return core + second


def pair_similarity(a: tuple[str, str, str], b: tuple[str, str, str], known: Lexicon = _LEXICON) -> float:
    """Similarity of two readings (kind, core, second part), which may differ in kind."""
    if a[0] == b[0]:
        if sim := core_similarity(a[1], b[1]) * second_similarity(a[0], a[2], b[2], known):
            return sim
        if a[0] == "person":
            return 0.95 if len(a[2]) > 1 and a[1:] == b[:0:-1] else 0.0
        # a line of business may not have been told from the stem
        if a[0] != "organisation" or (a[2] and b[2]):
            return 0.0
    x, y = whole(*a), whole(*b)
    if not x or not y or re.sub(r"\D", "", x) != re.sub(r"\D", "", y):
        return 0.0
    if x == y:
        return 1.0
    return 0.95 if min(len(x), len(y)) >= WHOLE and distance(x, y, 1) <= 1 else 0.0


#: Base of the hashes of texts, its inverse modulo 2^64, and odd numbers that tell kinds of forms apart.
_BASE = 0x9E3779B97F4A7C13
_BACK = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tagged(h: np.ndarray, tag: int) -> np.ndarray:
    return _mix(h + np.uint64(tag * 0xD6E8FEB86659FD93 % (1 << 64)))


def _powers(x: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))


def _by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the texts of one length, their code points, hashes of all their beginnings)."""
    at: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        at.setdefault(len(t), []).append(i)
    for n, rows in at.items():
        step = max(1, BATCH // (n + 1))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            codes = np.frombuffer("".join([texts[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(len(some), n)
            sums = np.zeros((len(some), n + 1), np.uint64)
            np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], axis=1, out=sums[:, 1:])
            yield np.array(some), codes, sums


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One (rows, hashes) of several."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _flat(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(rows, h.shape[1]), h.ravel()


def _texts(texts: list[str]) -> np.ndarray:
    """The hash of each text."""
    h = np.zeros(len(texts), np.uint64)
    for rows, _, sums in _by_length(texts):
        h[rows] = sums[:, -1]
    return h


def _one_left_out(texts: list[str], least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash): each text as it is and, from ``least`` letters, with each letter that is no digit left out."""
    found = []
    for rows, codes, sums in _by_length(texts):
        found.append((rows, sums[:, -1]))
        if codes.shape[1] and codes.shape[1] >= least:
            h = sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * np.uint64(_BACK)
            digits = np.array([c for c in np.unique(codes) if chr(c).isdigit()], np.uint32)
            # a letter beside its like gives the same form again
            keep = ~np.isin(codes, digits)
            keep[:, 1:] &= codes[:, 1:] != codes[:, :-1]
            found.append((np.repeat(rows, keep.sum(axis=1)), h[keep]))
    return _joined(found)


def _core_forms(cores: list[str], ears: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the core, hash): forms of which two cores share one if ``core_similarity`` isn't 0 and their lengths differ by no
    more than ``LENGTHS``. Two edits change at most four of a long core's five pieces, and move the others by two letters."""
    found = []
    for rows, codes, sums in _by_length(cores):
        n = codes.shape[1]
        found.append((rows, sums[:, -1]))
        if n > LONG:
            back = _powers(_BACK, n)
            for size in range(n - LENGTHS, n + 1):
                cuts = [size * k // 5 for k in range(6)]
                for k in range(5):
                    for p in range(max(0, cuts[k] - LENGTHS), min(cuts[k] + LENGTHS, n - cuts[k + 1] + cuts[k]) + 1):
                        found.append((rows, _tagged((sums[:, p + cuts[k + 1] - cuts[k]] - sums[:, p]) * back[p], 5 * size + k + 1)))
        if EDITED <= n <= LONG + LENGTHS:
            found.append(_flat(rows, sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * np.uint64(_BACK)))
        if TWICE <= n <= LONG + LENGTHS:
            i, j = np.triu_indices(n, 1)
            for k in range(0, len(rows), 2000):
                s = sums[k : k + 2000]
                two = s[:, i] + (s[:, j] - s[:, i + 1]) * np.uint64(_BACK) + (s[:, -1:] - s[:, j + 1]) * np.uint64(_BACK * _BACK % (1 << 64))
                found.append(_flat(rows[k : k + 2000], two))
    some = [i for i, c in enumerate(cores) if len(c) >= EDITED]
    found.append((np.array(some, np.int64), _tagged(_texts([ears[i] for i in some]), 1)))
    return _joined(found)


def _crossed(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): each form of ``a`` with each form of ``b`` of the same of n rows."""
    order = np.argsort(b[0], kind="stable")
    counts = np.bincount(b[0], minlength=n)
    first = np.cumsum(counts) - counts
    times = counts[a[0]]
    rows = np.repeat(a[0], times)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times) + first[rows]
    return rows, _mix(_mix(np.repeat(a[1], times)) + _tagged(b[1][order], 2)[place])


def block_forms(readings: list[tuple[str, str, str]], ears: list[str], blocks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the reading, hash): forms of which two readings with a common block share one if their cores, which sound like
    ``ears``, are similar."""
    place = np.repeat(np.arange(len(blocks)), [len(x) for x in blocks])
    return _crossed(len(readings), _core_forms([r[1] for r in readings], ears), (place, _texts([y for x in blocks for y in x])))


def name_forms(readings: list[tuple[str, str, str]], ears: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the reading, hash): forms of which two readings share one if ``pair_similarity`` can be 0.9 or more."""
    every = np.arange(len(readings))
    # cores that sound alike may differ by more letters than block_forms looks at
    found = [(every, _tagged(_texts([f"{kind}|{second}|{ear}" for (kind, _, second), ear in zip(readings, ears)]), 3))]
    wholes = [(i, w) for i, r in enumerate(readings) if (w := whole(*r)) is not None]
    rows, h = _one_left_out([w for _, w in wholes], WHOLE)
    found.append((np.array([i for i, _ in wholes], np.int64)[rows], _tagged(h, 4)))
    at = np.array([i for i, (kind, _, second) in enumerate(readings) if kind == "person" and len(second) > 1], np.int64)
    firsts = _one_left_out([readings[i][2] for i in at], 4)
    rows, h = _crossed(len(at), firsts, _one_left_out([readings[i][1] for i in at]))
    found.append((at[rows], _tagged(h, 5)))
    rows, h = _crossed(len(at), firsts, (np.arange(len(at)), _texts([ears[i] for i in at])))
    found.append((at[rows], _tagged(h, 6)))
    found.append((at, _tagged(_texts(["|".join(sorted(readings[i][1:])) for i in at]), 7)))
    return _joined(found)


def spelling_counts(spellings: list[DataFrame]) -> DataFrame:
    """(name, n): each distinct spelling of several one-column tables; nulls are left out."""
    every = spellings[0].toDF("name")
    for s in spellings[1:]:
        every = every.unionByName(s.toDF("name"))
    return every.where(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _read_batches(batches: Iterator[pa.RecordBatch], known: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read = [read_name(x, known) for x in batch.column("name").to_pylist()]
        columns = [pa.array([r[i] for r in read], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("n"), *columns], names=["name", "n", "kind", "core", "second"])


def with_blocks(keys: DataFrame, lexicon: Lexicon = _LEXICON) -> DataFrame:
    """Adds ``blocks``: keys that share none meet by ``name_forms`` only. A person's is the first name; an initial is in the blocks of all
    known first names it may stand for, and with the unknown ones that begin with it."""
    known = F.array(*[F.lit(n) for n in sorted(lexicon.nicknames)]).cast("array<string>")
    initial = F.substring("second", 1, 1)
    fitting = F.filter(known, lambda n: F.substring(n, 1, 1) == initial)
    person = F.when(F.length("second") == 1, F.concat(fitting, F.array(initial))).when(
        F.array_contains(known, F.col("second")), F.array("second")
    ).otherwise(F.array(initial))
    own = F.when(F.col("kind") == "person", person).otherwise(F.array("second"))
    return keys.withColumn("blocks", F.transform(own, lambda x: F.concat_ws("|", "kind", x)))


def _rounds(keys: DataFrame) -> int:
    """In how many rounds the forms of all keys (core, second, kind, blocks) are shuffled."""
    n, m = F.length("core").cast("double"), F.length("second").cast("double")
    inside = F.when(n > LONG + LENGTHS, 75).when(n >= TWICE, n * (n + 1) / 2 + 2).when(n >= EDITED, n + 2).otherwise(1)
    across = F.when((F.col("kind") == "person") & (m > 1), (n + 2) * (m + 1)).otherwise(0) + n + m
    total, count = keys.agg(F.sum(inside * F.size("blocks") + across), F.count(F.lit(1))).first()
    return max(1, math.ceil((total or 0) / max(FEW, AT_ONCE * count)))


def _form_batches(batches: Iterator[pa.RecordBatch], part: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """(at, key): the forms of one round; those by which keys meet across blocks are odd."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            some = batch.slice(start, 2000)
            key = some.column("key").to_numpy(zero_copy_only=False)
            readings = list(zip(*[some.column(c).to_pylist() for c in ("kind", "core", "second")]))
            ears = [by_ear(r[1]) for r in readings]
            for (rows, h), odd in ((block_forms(readings, ears, some.column("blocks").to_pylist()), 0), (name_forms(readings, ears), 1)):
                if rounds > 1:
                    own = (h >> np.uint64(32)) * np.uint64(rounds) >> np.uint64(32) == part
                    rows, h = rows[own], h[own]
                at = ((h & ~np.uint64(1)) | np.uint64(odd)).view(np.int64)
                for i in range(0, len(at), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(at[i : i + BATCH]), pa.array(key[rows[i : i + BATCH]])], names=["at", "key"])


def _pairs_of_runs(at: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, across) of the keys of each run of equal ``at``, some at a time; a pair comes once or more."""
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sizes = np.diff(np.append(starts, len(at)))
    for size in np.unique(sizes[sizes > 1]):
        own = starts[sizes == size]
        # of each place of a run with the later ones
        for i in range(size - 1):
            step = max(1, BATCH // (size - 1 - i))
            for k in range(0, len(own), step):
                x = np.repeat(own[k : k + step] + i, size - 1 - i)
                y = x + np.tile(np.arange(1, size - i), len(own[k : k + step]))
                a, b = np.minimum(key[x], key[y]), np.maximum(key[x], key[y])
                yield a[a < b], b[a < b], (at[x] & 1)[a < b]


def _met_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, across), a < b: keys that share a form, of rows (at, key) in the order of ``at``."""

    def once(some: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        a, b, across = (np.concatenate(x) for x in zip(*some))
        order = np.lexsort((-across, b, a))
        a, b, across = a[order], b[order], across[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(across[new] == 1)], names=["a", "b", "across"])

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole runs; the last of a batch may go on in the next one."""
        left: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            at, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "key"))
            if not len(at):
                continue
            if left and left[0][0][0] == at[-1]:
                left.append((at, key))
                continue
            last = int(np.searchsorted(at, at[-1]))
            yield tuple(np.concatenate(x) for x in zip(*left, (at[:last], key[:last])))
            left = [(at[last:], key[last:])]
        if left:
            yield tuple(np.concatenate(x) for x in zip(*left))

    some: list[tuple[np.ndarray, ...]] = []
    held = 0
    for at, key in runs():
        for found in _pairs_of_runs(at, key) if len(at) else ():
            some.append(found)
            held += len(found[0])
            if held >= BATCH:
                yield from once(some)
                some, held = [], 0
    if some:
        yield from once(some)


def met_keys(keys: DataFrame, lexicon: Lexicon = _LEXICON) -> list[DataFrame]:
    """(a, b, across), a < b: keys (key, kind, core, second) that share a form; one table a round, in several of which a pair may be."""
    every = with_blocks(keys.select("key", "kind", "core", "second"), lexicon)
    rounds = _rounds(every)
    found = []
    for part in range(rounds):
        forms = every.mapInArrow(partial(_form_batches, part=part, rounds=rounds), "at long, key long")
        met = forms.repartition("at").sortWithinPartitions("at").mapInArrow(_met_batches, "a long, b long, across boolean")
        found.append(_kept(met.groupBy("a", "b").agg(F.max("across").alias("across")), "met"))
    return found


def _kept(df: DataFrame, name: str) -> DataFrame:
    with shuffles_deleted(df.sparkSession):
        return stored(df, name)


def _grams(core: str) -> Column:
    text = F.concat(F.lit("^"), F.col(core), F.lit("$"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) > 2, F.concat(runs(2), runs(3))).otherwise(runs(2)))


def near_pairs(pairs: DataFrame, keys: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b, sim, core_a, core_b) whose cores' n-gram vectors have that cosine, weighted by rarity among the keys."""
    counts = keys.select(F.explode(_grams("core")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    total = keys.count()
    each = pairs.select("a", "b", "sim", _grams("core_a").alias("ga"), _grams("core_b").alias("gb"))
    each = each.select("a", "b", "sim", "ga", "gb", F.explode(F.array_union("ga", "gb")).alias("gram"))
    each = each.select("a", "b", "sim", "gram", F.array_contains("ga", F.col("gram")).alias("in_a"), F.array_contains("gb", F.col("gram")).alias("in_b"))
    w = F.pow(F.log(F.lit(1.5) + F.lit(float(total)) / F.col("df")), 2)
    of = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    sums = each.join(small_side(_kept(counts, "grams")), "gram").groupBy("a", "b", "sim").agg(
        of(F.col("in_a") & F.col("in_b")).alias("dot"), of(F.col("in_a")).alias("na"), of(F.col("in_b")).alias("nb")
    )
    return sums.where(F.col("dot") >= cosine * F.sqrt(F.col("na") * F.col("nb"))).select("a", "b", "sim")


def similar_keys(keys: DataFrame, cosine: float = COSINE, lexicon: Lexicon = _LEXICON) -> DataFrame:
    """(a, b, sim), a < b: keys (key, kind, core, second) whose checked similarity isn't 0."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = []
            for r in batch.to_pylist():
                x, y = tuple(r["ra"].values()), tuple(r["rb"].values())
                if r["across"]:
                    sim.append(pair_similarity(x, y, lexicon))
                else:
                    second = second_similarity(x[0], x[2], y[2], lexicon)
                    sim.append(second and core_similarity(x[1], y[1]) * second)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("a", "b", "across")], pa.array(sim, pa.float64()), *[pa.array(batch.column(c).field("core")) for c in ("ra", "rb")]],
                names=["a", "b", "across", "sim", "core_a", "core_b"],
            )

    rounds = met_keys(keys, lexicon)
    met = reduce(DataFrame.unionByName, rounds)
    if len(rounds) > 1:
        met = met.groupBy("a", "b").agg(F.max("across").alias("across"))
    side = keys.select("key", F.struct("kind", "core", "second").alias("r"))
    pairs = met.join(side.toDF("a", "ra"), "a").join(side.toDF("b", "rb"), "b").select("a", "b", "across", "ra", "rb")
    # a swap of neighbours counts as two letters here, and two edits are the most that is accepted
    near = (F.abs(F.length("ra.core") - F.length("rb.core")) <= LENGTHS) & (F.levenshtein("ra.core", "rb.core", 4) >= 0)
    checked = pairs.where(F.col("across") | near).mapInArrow(check, "a long, b long, across boolean, sim double, core_a string, core_b string")
    checked = _kept(checked.where("sim > 0"), "checked")
    for x in rounds:
        discard(x)
    sure = F.col("across") | (F.col("core_a") == F.col("core_b"))
    inside = near_pairs(checked.where(~sure), keys, cosine)
    return checked.where(sure).select("a", "b", "sim").unionByName(inside)


def average_linkage(keys: DataFrame, edges: DataFrame, average: float = AVERAGE) -> DataFrame:
    """(key, group): keys (key, weight, size) grouped by edges (a, b, sim). Keys without an edge count as similarity 0."""
    groups = keys.select("key", F.col("key").alias("group"))
    sizes = keys.select("key", F.col("size").cast("double").alias("size"))
    while True:
        g = groups.join(sizes, "key")
        total = g.groupBy("group").agg(F.sum("size").alias("total"))
        l, r = g.toDF("a", "ga", "na"), g.toDF("b", "gb", "nb")
        between = edges.join(l, "a").join(r, "b").where("ga != gb")
        between = between.groupBy(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).agg(F.sum(F.col("sim") * F.col("na") * F.col("nb")).alias("s"))
        tx, ty = total.toDF("x", "tx"), total.toDF("y", "ty")
        between = between.join(tx, "x").join(ty, "y").select("x", "y", F.round(F.col("s") / (F.col("tx") * F.col("ty")), 9).alias("avg"))
        between = _kept(between.where(F.col("avg") >= average), "between")
        if between.isEmpty():
            return groups
        order = F.struct("avg", (-F.col("x")).alias("x_"), (-F.col("y")).alias("y_"))
        ends = between.withColumn("o", order).select(F.explode(F.array("x", "y")).alias("at"), "x", "y", "o")
        best = ends.groupBy("at").agg(F.max("o").alias("o"))
        mutual = best.groupBy("o").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        merge = mutual.select((-F.col("o.y_")).alias("group"), (-F.col("o.x_")).alias("into"))
        before, groups = groups, _kept(groups.join(small_side(merge), "group", "left").select("key", F.coalesce("into", "group").alias("group")), "groups")
        for x in (before, between):
            discard(x)


def link_names(spellings: list[DataFrame], lexicon: Lexicon = _LEXICON) -> DataFrame:
    """(name, n, kind, group): the group of each distinct spelling; spellings of one group mean the same.

    Null names are left out; a blank name is a spelling like any other. Empty tables give no rows. Repeated rows
    only add to n.
    """
    read = spelling_counts(spellings).mapInArrow(partial(_read_batches, known=lexicon), "name string, n long, kind string, core string, second string")
    key = F.xxhash64("kind", "core", "second")
    read = _kept(read.withColumn("key", key), "names")
    keys = read.groupBy("key").agg(*[F.first(c).alias(c) for c in ("kind", "core", "second")], F.sum("n").alias("weight"), F.count(F.lit(1)).alias("size"))
    keys = _kept(keys, "keys")
    edges = _kept(similar_keys(keys, lexicon=lexicon), "links")
    groups = average_linkage(keys.select("key", "weight", "size"), edges)
    return read.select("name", "n", "kind", "key").join(groups, "key").select("name", "n", "kind", "group")


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b): pairs of different spellings of one group, name_a < name_b by code points."""
    sizes = linked.groupBy("group").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = linked.select("name", "group").join(sizes, "group")
    n = F.ceil(F.col("k") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("name"), n).cast("int")
    every = F.explode(F.sequence(F.lit(0), n - 1))
    a = rows.select("group", F.col("name").alias("name_a"), own.alias("i"), every.alias("j"))
    b = rows.select("group", F.col("name").alias("name_b"), every.alias("i"), own.alias("j"))
    return a.join(b, ["group", "i", "j"]).where("name_a < name_b").select("name_a", "name_b")
