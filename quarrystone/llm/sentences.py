"""Sentences of texts in any language and script, by semi-Markov dynamic programming over whole spans.

A text is divided at empty lines. Within a unit every mark that could end a sentence is a candidate boundary (in Thai,
which has no such mark, every space). The best division is the one with the highest sum of span scores, found by
dynamic programming: a span's score joins its length, its opening word, its closing word and mark, and whether
quotation marks and brackets are balanced within it, so that a quotation keeps together even where each of its marks
looks like an end. Each text is handled on its own: no shuffle, and memory for one batch of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations that stand before the word they belong to and so end no sentence.
NEVER_LAST = set(
    """mr mrs ms messrs dr prof st vs i.e e.g fig figs no nos pp p vol ch sec cf ca gen col sgt rev hon www
    mme mlle mm sr sra srta dra d dña ud uds núm pág págs art cap aprox ee ej av avda bd env chap suiv c.-à-d
    z z.b b d.h h u.a bzw inkl zzgl nr abb abs hr fr ggf evtl vgl sog u s m l r j k n o
    г стр рис см т тыс руб им ул д-р проф гл е""".split()
)
#: Abbreviations that may stand last in a sentence.
MAYBE_LAST = set("etc usw ff inc ltd co corp jr vd vds p.m a.m u.s uu s.a s.l al km kg cm mm min std euro".split())
#: Words that open German sentences; other capitalised words may be nouns within one.
GERMAN_OPENERS = set(
    """die der das den dem ein eine einen einem er sie es wir ich ihr man im in am auf bei mit nach vor für aus zu
    wenn als da dies diese dieser dieses hier dort nun dann aber und doch alle jede jeder""".split()
)
GERMAN = re.compile(r"\b(?:der|die|das|und|den|dem|nicht|ist|wird|von|ein|eine|er|sie)\b|[äöüß]", re.I)
NOT_GERMAN = re.compile(r"\b(?:the|of|and|la|le|les|el|los|las|du|des|del)\b")
#: What follows the number of a day or a quarter.
AFTER_ORDINAL = re.compile(
    r"(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Jahrhundert|Klasse|Auflage|Kapitel)\b"
)
#: What goes on after a quotation that ended with a mark of its own.
GOES_ON = re.compile(r"(?:然后|就|便|的|と|は|が|を|に|の|も|や|ثم|بوضوح|लिखा|ने |कहा|और )")

_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "（": "）", "[": "]"}
_CLOSE = "”’\"»«“)）」』》〉]"
_MARK = ".!?…。！？؟।॥．"
_MARKS = re.compile(rf"[{_MARK}]+")
_ONLY_CLOSE = "”’»）)」』》〉]"
_THAI_SPACE = re.compile(r"(?<=[ก-๛”\"»?!.\d%])[  \t\n]+(?=\S)")
_TOKEN_END = re.compile(r"[^\s(（“„«\"「『《]+$")
_EMPTY_LINE = re.compile(r"\r?\n[^\S\n]*\r?\n\s*|\n[^\S\n]*\n\s*|[  ]")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_THAI = re.compile(r"[ก-๛]")

SPAN_COST = 2.0
UNBALANCED = 10.0
#: What a cut within a quotation or bracket costs that is closed later on: more than any cut earns, however many there are.
WITHIN = 6.0
#: The most that ``_closing`` or ``_thai_space`` gives.
BEST_CLOSING = 4.0


def _depths(unit: str) -> tuple[list[int], list[int], list[int]]:
    """For each position, how many quotations and brackets are open before it, where the quotation that closes just
    before it was opened (-1: none), and how many of those open are closed later on."""
    turned = "»" in unit and ("«" not in unit or unit.index("»") < unit.index("«"))
    pairs = dict(_OPEN)
    if turned:
        del pairs["«"]
        pairs["»"] = "«"
    stack: list[str] = []
    places: list[int] = []
    out, opened = [0], [-1]
    change = [0] * (len(unit) + 2)
    for at, ch in enumerate(unit):
        came = -1
        if ch in stack and (ch == stack[-1] or ch in '"“' or ch not in pairs):
            first = stack.index(ch)
            came = places[first] if ch not in ")）]" else -1
            change[places[first] + 1] += 1
            change[at + 1] -= 1
            del stack[first:], places[first:]
        elif ch == '"' or ch in pairs:
            stack.append(pairs.get(ch, ch))
            places.append(at)
        out.append(len(stack))
        opened.append(came)
    return out, opened, list(accumulate(change))


def _stray(unit: str, start: int, end: int, depth: list[int]) -> int:
    """Marks without a partner within the span."""
    low = min(depth[start : end + 1])
    return (depth[start] - low) + (depth[end] - low)


def _opening(unit: str, at: int, german: bool, caseless: bool) -> float:
    """How well a sentence can begin at a position."""
    ch = unit[at]
    if ch in "¿¡“„«「『《\"‘'([":
        return 1.5
    if ch.isdigit():
        return 0.5
    if ch.islower():
        if caseless:
            return 0.5  # a text without capitals
        brand = at + 1 < len(unit) and unit[at + 1].isupper()
        return 1.0 if brand else -6.0
    if ch.isupper():
        word = re.match(r"\w+", unit[at:])[0].lower()
        if german:
            return 1.5 if word in GERMAN_OPENERS else 0.0
        return 1.0
    if ch.isalpha():
        return 1.0
    if ch in "-–—,;:.!?…。、，；：）)”»」』》":
        return -8.0
    return 0.0


def _closing(unit: str, start: int, mark_at: int, end: int, following: int, german: bool, opener: int) -> float:
    """How well a sentence can end with the mark at ``mark_at``; ``end`` is behind its closing quotes, ``opener`` where the
    last of these was opened, or -1."""
    run = unit[mark_at:end]
    quoted = any(c in _CLOSE for c in run)
    marks = run.rstrip(_CLOSE + "  \n")
    nxt = unit[following : following + 12]
    score = 0.0
    if quoted and GOES_ON.match(nxt):
        score -= 6.0
    if quoted and opener >= 0 and nxt[:1] not in _OPEN:
        ahead = unit[:opener].rstrip()
        if not ahead or ahead[-1] in _MARK + _CLOSE:
            # the quotation opens a sentence: who said it follows
            score -= 6.0
    if any(c in "!?。！？؟।॥" for c in marks):
        return score + 4.0
    if "…" in marks or len(marks) > 1:
        if german and nxt[:1].isupper() and re.match(r"\w+", nxt)[0].lower() not in GERMAN_OPENERS:
            return score - 2.0
        return score + 2.0
    before = _TOKEN_END.search(unit[max(start, mark_at - 24) : mark_at])
    token = before[0] if before else ""
    bare = token.lower().lstrip("'’([")
    if not token:
        return score - 1.0 if not quoted else score + 3.0
    last = token[-1]
    if "ऀ" <= last <= "ॿ" or "ก" <= last <= "๛":
        return score - 8.0  # scripts that use the point for abbreviations only
    if "؀" <= last <= "ۿ" and len(bare) == 1:
        return score - 8.0
    if len(bare) == 1 and bare.isalpha():
        # an initial; S. A. and S. L. after a name may stand last
        firm = token in "AL" and re.search(r"\bS\.\s?$", unit[max(start, mark_at - 5) : mark_at - 1])
        return score + 2.5 if firm else score - 8.0
    if bare in MAYBE_LAST:
        return score + 2.5
    if bare in NEVER_LAST:
        return score - 8.0
    if re.fullmatch(r"[^\W\d_](?:\.[^\W\d_])+", bare):
        return score + 2.0
    if bare.isdigit() and len(bare) <= 2 and AFTER_ORDINAL.match(unit, following):
        return score - 8.0
    if bare.isdigit() and len(bare) <= 2 and german and nxt[:1].isupper():
        word = re.match(r"\w+", nxt)[0].lower()
        return score + 3.0 if word in GERMAN_OPENERS else score - 8.0
    if nxt[:1].isdigit() and len(bare) <= 4 and bare.isalpha() and bare.islower() is False:
        return score - 1.0
    return score + 3.0


def _thai_space(unit: str, at: int, following: int) -> float:
    """How well a sentence can end before a space in Thai text."""
    before, after = unit[:at], unit[following:]
    number = re.search(r"[\d.,]*\d$", before)
    if re.match(r"[\"“«(]", after) or re.search(r"[(“«]$", before):
        return -8.0
    if re.match(r"(?:พ\.ศ\.|ค\.ศ\.|ๆ|ฯลฯ)", after) or re.search(r"(?:พ\.ศ\.|ค\.ศ\.)$", before):
        return -8.0
    if re.match(r"\d", after):
        return -8.0
    if number and re.match(r"(?:[ก-๛]{1,4}\.|ตัน|บาท|เมตร|ลิตร|ปี|วัน|คน|คัน|%)(?=\s|$|[”\"])", after):
        return -8.0
    if not _THAI.match(after) and not re.match(r"[A-Z]", after):
        return -8.0
    if re.match(r"[A-Za-z]", after) or re.search(r"[A-Za-z]$", before):
        return -3.0
    return 3.0


def _candidates(unit: str, depth: list[int]) -> list[tuple[int, int, int]]:
    """(end, following, mark): a sentence may end before ``end``, the next one begin at ``following``; mark is where its
    mark stands, -1 for a Thai space. Quotes and brackets that close belong to the sentence before them."""
    out = []
    n = len(unit)
    for m in _MARKS.finditer(unit):
        e = m.end()
        while e < n:
            gap = e + (unit[e] in "  \n\u202f" and e + 1 < n and unit[e + 1] == "»")
            if depth[gap + 1] < depth[gap] or (unit[gap] in _ONLY_CLOSE and depth[gap + 1] <= depth[gap]):
                e = gap + 1
            else:
                break
        if m[0] == "." and _THAI.match(unit[m.start() - 1 : m.start()]):
            continue  # an abbreviation; the space after it is a candidate
        f = e
        while f < n and unit[f].isspace():
            f += 1
        if f >= n:
            continue
        if f == e:
            prev, nxt = unit[m.start() - 1] if m.start() else "", unit[e]
            wide = any(c in "。！？．" for c in unit[m.start() : e]) or _WIDE.match(nxt) is not None
            word = re.search(r"[^\W\d_]{2,}$", unit[max(0, m.start() - 20) : m.start()])
            joined = (word is not None or prev in _CLOSE) and (nxt.isupper() or nxt in "“„«¿¡") and not re.match(r"\w+\.\w", unit[e:])
            if not (wide or joined):
                continue
        out.append((e, f, m.start()))
    if len(_THAI.findall(unit)) * 3 > n:
        taken = {c[1] for c in out}
        out.extend((m.start(), m.end(), -1) for m in _THAI_SPACE.finditer(unit) if m.end() not in taken)
    return sorted(out)


def divide(unit: str) -> list[tuple[int, int]]:
    """The sentences of a text without empty lines as (start, end)."""
    lead = len(unit) - len(unit.lstrip(" \t\r\n\v\f﻿　  ​"))
    n = len(unit)
    if lead >= n:
        return []
    german = len(GERMAN.findall(unit)) > len(NOT_GERMAN.findall(unit))
    depth, openers, within = _depths(unit)
    caseless = not any(map(str.isupper, unit))
    cuts = [c for c in _candidates(unit, depth) if c[0] > lead]
    if not cuts:
        return [(lead, n)]
    starts = [lead, *[c[1] for c in cuts]]
    ends = [*cuts, (n, n, None)]
    best = [0.0] + [-1e18] * len(ends)
    back = [0] * (len(ends) + 1)
    opened = [0.0, *[_opening(unit, c[1], german, caseless) for c in cuts]]
    # the best that any sentence beginning at one of the first starts can build on
    reach = [opened[0]] + [-1e18] * (len(ends) - 1)
    for j, (end, following, mark) in enumerate(ends, 1):
        low, low_from = depth[end], end
        for i in range(j - 1, -1, -1):
            if reach[i] - SPAN_COST + (BEST_CLOSING if mark is not None else 0.0) < best[j] - 1e-9:
                break  # no longer span can win
            s = starts[i]
            if end <= s:
                continue
            if s < low_from:
                low, low_from = min(low, min(depth[s:low_from])), s
            stray = depth[s] + depth[end] - 2 * low if s == low_from else _stray(unit, s, end, depth)
            score = best[i] + opened[i] - SPAN_COST - UNBALANCED * stray
            if mark is not None:
                score += _thai_space(unit, end, following) if mark < 0 else _closing(unit, s, mark, end, following, german, openers[end])
            if end - s < 3:
                score -= 3.0
            if within[end]:
                score -= WITHIN
            if score > best[j]:
                best[j], back[j] = score, i
        if j < len(ends):
            reach[j] = max(reach[j - 1], best[j] + opened[j])
    spans = []
    j = len(ends)
    while j > 0:
        i = back[j]
        spans.append((starts[i], ends[j - 1][0]))
        j = i
    return spans[::-1]


_BLANK = " \t\r\n\v\f\x1c\x1d\x1e\x1f\x85                 　﻿"


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """The sentences of a text as (start, end) in code points, without white space or byte order marks at either end."""
    out = []
    at = 0
    bounds = [(m.start(), m.end()) for m in _EMPTY_LINE.finditer(text)]
    for stop, resume in [*bounds, (len(text), len(text))]:
        unit = text[at:stop]
        for s, e in divide(unit):
            piece = unit[s:e]
            left = len(piece) - len(piece.lstrip(_BLANK))
            right = len(piece.rstrip(_BLANK))
            if left < right:
                out.append((at + s + left, at + s + right))
        at = resume
    return out


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, start_at, end_at) for each sentence of each text; with ``with_text`` also ``sentence``.

    A repeated key counts once (rows that share a key but not a text are told apart). Null, empty and blank texts
    have no sentences; rows with a null key keep it.
    """
    once = df.select(F.col(key), F.col(text).alias("_text")).where(F.length(F.trim("_text")) > 0)
    once = once.groupBy(key, F.xxhash64("_text").alias("_h")).agg(F.first("_text").alias("_text")).drop("_h")
    span = T.StructType([T.StructField("start_at", T.LongType()), T.StructField("end_at", T.LongType())])
    fields = [df.schema[key], T.StructField("_text", T.StringType())] if with_text else [df.schema[key]]
    schema = T.StructType([*fields, T.StructField("spans", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sentence_spans(t) for t in batch.column("_text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)]).astype(np.int32)
            flat = np.array([x for f in found for x in f], dtype=np.int64).reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start_at", "end_at"])
            columns = [batch.column(f.name) for f in fields] + [pa.ListArray.from_arrays(pa.array(offsets), pairs)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    spans = once.mapInArrow(run, schema)
    each = spans.select(*[f.name for f in fields], F.explode("spans").alias("s")).select(*[f.name for f in fields], "s.*")
    if not with_text:
        return each
    cut = F.substring(F.col("_text"), F.col("start_at").cast("int") + 1, (F.col("end_at") - F.col("start_at")).cast("int"))
    return each.select(key, "start_at", "end_at", cut.alias("sentence"))
