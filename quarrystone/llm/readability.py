"""Reading level of documents: the median of several classic readability formulas, each read on the scale of
rated samples.

A formula is applied to each sentence, and a document's value is the geometric mean over its sentences, so that a few
very long or very short ones weigh little. Only sentences with a closing mark count, unless a text has none: headings
and table rows are left out, as the formulas' authors ask. Syllables follow hyphenation: a group of vowels is one
nucleus, but pairs of vowels that the language hyphenates between are two, and silent endings of English and French
are none. The language is the one whose profile of character trigrams, learned from the samples, fits best.

All counts are array operations over the characters of a whole Arrow batch at once: one pass, no loop over rows or words.
A formula's cut point between neighbouring levels is where a logistic curve over the rated samples of a language
passes one half. The samples are the only thing the driver holds, at most ``SAMPLE_ROWS`` of them; documents are read once
and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = 5
#: A document with fewer words gets no level.
LEAST_WORDS = 40
#: Rated samples used at most (those with the smallest ids).
SAMPLE_ROWS = 20_000
#: Samples of a language that are enough for cut points of its own.
LEAST_SAMPLES = 20
#: Share of a text's trigrams that occur in the samples of its language, at least.
LEAST_KNOWN = 0.4
#: Letters of a line without a closing mark that is a heading, at most.
HEADING_CHARS = 60
#: Characters of a batch that are looked at together.
BLOCK_CHARS = 2_000_000

LANGUAGES = ["en", "de", "fr", "es"]
#: Vowels, marks that end sentences, and what may stand between a mark and the space after it.
VOWELS = "aeiouyáàâäãåæéèêëíìîïóòôöõøœúùûü"
MARKS = ".!?…"
CLOSERS = "\"'”’»“)]"
#: Pairs of vowels with a syllable boundary between them, by language. In German, all but the diphthongs.
HIATUS = {
    "en": "ia io iu eo ua uo yi ui",
    "fr": "aé éa éo oé aï oï eï aë oë uë",
    "es": "ae ao ea ee eo oa oe oo aí eí oí uí íe ío íu úa úe úi úo aú eú oú ía aé éa eá oé eó áe óe aá óa oá",
}
GERMAN_DIPHTHONGS = "ei ai au eu äu ie aa ee oo ey ay oi ui"
#: English letters before i that join it to a following vowel (nation, special, region).
SOFTENED = "tscxg"

FORMULAS = ["strain", "linsear", "ari", "flesch_kincaid", "lix"]
COUNTS = ["n_words", "n_sentences"]
_SIZE = 0x30000
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "áàâäãåæçéèêëíìîïñóòôöõøœúùûüß"


def _set(chars: str) -> np.ndarray:
    out = np.zeros(_SIZE, dtype=bool)
    out[[ord(x) for x in chars]] = True
    return out


def _class_of() -> np.ndarray:
    """A number below 64 for each character: 0 for what is no letter, 63 for letters that no language here uses."""
    out = np.fromiter((63 if not 0xD800 <= i < 0xE000 and chr(i).isalpha() else 0 for i in range(_SIZE)), dtype=np.int32, count=_SIZE)
    out[[ord(x) for x in _LETTERS]] = np.arange(1, len(_LETTERS) + 1)
    return out


class Characters:
    """The lower-case characters of many texts in one array, each text closed by a zero."""

    def __init__(self, texts: list[str]):
        joined = "\0".join(t.replace("\0", " ") for t in texts).lower() + "\0"
        self.c = np.minimum(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), _SIZE - 1)
        self.stops = np.flatnonzero(self.c == 0)
        self.starts = np.concatenate([[0], self.stops[:-1] + 1])

    def trigrams(self, class_of: np.ndarray) -> np.ndarray:
        """The code of the trigram around each character."""
        k = class_of[self.c]
        code = k << 6
        code[1:] |= k[:-1] << 12
        code[:-1] |= k[1:]
        return code


def profiles(texts: list[str], languages: list[str]) -> np.ndarray:
    """Log probabilities of trigrams, a column for each of LANGUAGES; learned with a half added to each count."""
    class_of = _class_of()
    counts = np.zeros((64**3, len(LANGUAGES)))
    for i, x in enumerate(LANGUAGES):
        own = [t for t, y in zip(texts, languages) if y == x]
        if own:
            counts[:, i] = np.bincount(Characters(own).trigrams(class_of), minlength=64**3)
    total = counts.sum(0)
    table = np.log((counts + 0.5) / (total + 0.5 * 20_000))
    table[:, total == 0] = -99.0
    return table.astype(np.float32)


class TextMeasure:
    """Counts over many texts at once; made once per task."""

    def __init__(self, table: np.ndarray) -> None:
        code = np.arange(64**3)
        parts = np.stack([code >> 12, (code >> 6) & 63, code & 63]) > 0
        self.used = ((parts.sum(0) >= 2) & parts[1]).astype(np.int64)
        # cost in thousandths below, whether the samples hold the trigram above: both sums in one
        known = (table > table.min(0)).astype(np.int64)
        self.packed = [(known[:, i] << 44 | np.round(-1000 * table[:, i]).astype(np.int64)) * self.used for i in range(len(LANGUAGES))]
        self.alnum = np.fromiter((chr(i).isalnum() if not 0xD800 <= i < 0xE000 else False for i in range(_SIZE)), dtype=bool, count=_SIZE)
        self.space = np.fromiter((chr(i).isspace() for i in range(_SIZE)), dtype=bool, count=_SIZE)
        self.vowel, self.mark, self.closer = (_set(x) for x in (VOWELS, MARKS, CLOSERS))
        self.class_of = _class_of()
        self.vowel_no = np.zeros(_SIZE, dtype=np.int32)
        self.vowel_no[[ord(x) for x in VOWELS]] = np.arange(1, len(VOWELS) + 1)
        n = len(VOWELS) + 1
        self.splits = np.zeros((len(LANGUAGES), n, n), dtype=bool)
        for i, x in enumerate(LANGUAGES):
            if x == "de":
                self.splits[i, 1:, 1:] = True
            for a, b in (GERMAN_DIPHTHONGS if x == "de" else HIATUS[x]).split():
                self.splits[i, self.vowel_no[ord(a)], self.vowel_no[ord(b)]] = x != "de"

    def languages(self, chars: Characters) -> np.ndarray:
        """The number of each text's language, -1 for none."""
        code = chars.trigrams(self.class_of)
        total = lambda x: np.add.reduceat(x[code], chars.starts)
        n, sums = total(self.used), np.stack([total(x) for x in self.packed])
        cost, known = sums & (1 << 44) - 1, sums >> 44
        best = cost.argmin(0)
        return np.where((n > 0) & (known[best, np.arange(len(n))] >= LEAST_KNOWN * n), best, -1)

    def syllables(self, c: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Syllables of each word from start to end, by the rules of its language ``of``."""
        vowel = self.vowel[c]
        onset = vowel & ~np.concatenate([[False], vowel[:-1]])
        nuclei = np.concatenate([[0], np.cumsum(onset)])
        syllables = nuclei[end] - nuclei[start]
        # boundaries within a group of vowels
        at = np.flatnonzero(vowel[1:] & vowel[:-1]) + 1
        word = np.searchsorted(start, at, "right") - 1
        inside = word >= 0
        at, word = at[inside], word[inside]
        own = of[word]
        apart = (own >= 0) & self.splits[own, self.vowel_no[c[at - 1]], self.vowel_no[c[at]]]
        english, french = LANGUAGES.index("en"), LANGUAGES.index("fr")
        soft = np.isin(c[np.maximum(at - 2, 0)], [ord(x) for x in SOFTENED]) & (c[at - 1] == ord("i"))
        silent_u = (c[np.maximum(at - 2, 0)] == ord("q")) | (c[np.maximum(at - 2, 0)] == ord("g"))
        apart &= ~((own == english) & (soft | ((c[at - 1] == ord("u")) & silent_u)))
        syllables = syllables + np.bincount(word[apart], minlength=len(start))
        # silent endings
        tail = lambda i: c[np.maximum(end - i, 0)]
        after_consonant = lambda i: ~self.vowel[tail(i)]
        e = (tail(1) == ord("e")) & after_consonant(2)
        le = e & (tail(2) == ord("l")) & after_consonant(3)
        es = (tail(2) == ord("e")) & (tail(1) == ord("s")) & after_consonant(3)
        ed = (tail(2) == ord("e")) & (tail(1) == ord("d")) & after_consonant(3)
        ent = (tail(3) == ord("e")) & (tail(2) == ord("n")) & (tail(1) == ord("t")) & after_consonant(4)
        hiss = np.isin(tail(3), [ord(x) for x in "szxhcgl"])
        stop = np.isin(tail(3), [ord("t"), ord("d")])
        silent = ((of == english) & ((e & ~le) | (es & ~hiss) | (ed & ~stop))) | ((of == french) & (e | es | ent))
        return np.maximum(syllables - silent, 1)

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """COUNTS and the FORMULAS' values of each text, and its language's number (-1 for none)."""
        chars = Characters(texts)
        c, n_docs = chars.c, len(texts)
        language = self.languages(chars)
        alnum = self.alnum[c]
        joint = np.zeros(len(c), dtype=bool)
        if len(c) > 2:
            joint[1:-1] = ((c[1:-1] == 0x27) | (c[1:-1] == 0x2019)) & alnum[:-2] & alnum[2:]
        edge = np.diff((alnum | joint).astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(chars.stops, start)
        n_words = np.bincount(doc, minlength=n_docs)
        length = end - start
        syllables = self.syllables(c, start, end, language[doc] if len(doc) else np.empty(0, dtype=int))
        close, marked = self.sentence_ends(c)
        # words by the sentence they stand in
        sentence = np.searchsorted(close, start)
        n = len(close)
        tally = lambda w=None: np.bincount(sentence, w, minlength=n).astype(np.float64)
        words, letters = tally(), np.bincount(np.searchsorted(close, np.flatnonzero(alnum)), minlength=n)
        # a row of a table written out
        row = np.bincount(np.searchsorted(close, np.flatnonzero(c == ord("="))), minlength=n) > 0
        owner = np.searchsorted(chars.stops, close)
        whole = marked & ~row & (words > 0)
        has = np.bincount(owner[whole], minlength=n_docs) > 0
        used = whole | ((words > 0) & ~has[owner])
        w = np.maximum(words, 1)
        poly, long = tally(syllables >= 3), tally(length >= 7)
        values = np.stack(
            [0.3 * tally(syllables), (words + 2 * poly) / 2, 4.71 * letters / w + 0.5 * words, 11.8 * tally(syllables) / w + 0.39 * words, words + 100 * long / w], axis=1
        )
        logs = np.log(np.maximum(values, 0.1)) * used[:, None]
        n_used = np.bincount(owner[used], minlength=n_docs)
        sums = np.stack([np.bincount(owner, x, minlength=n_docs) for x in logs.T], axis=1)
        with np.errstate(invalid="ignore"):
            means = np.exp(sums / np.where(n_used > 0, n_used, np.nan)[:, None])
        return np.stack([n_words, n_used], axis=1).astype(np.float64), means, language

    def sentence_ends(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which sentences end, and which of these have a closing mark. Blank lines, short lines without a
        mark, and texts end without one."""
        space = self.space[c] | (c == 0)
        mark, closer = self.mark[c], self.closer[c]
        after, after2 = np.concatenate([space[1:], [True]]), np.concatenate([space[2:], [True, True]])[: len(c)]
        closed = mark & (after | (np.concatenate([closer[1:], [False]]) & after2))
        feed = (c == 10) | (c == 0)
        breaks = np.flatnonzero(feed)
        lengths = np.diff(breaks, prepend=-1) - 1
        heading = breaks[lengths <= HEADING_CHARS]
        ends = np.union1d(np.flatnonzero(closed), np.union1d(heading, np.flatnonzero(c == 0)))
        return ends, closed[ends]


def with_features(df: DataFrame, keep: list[str], text: str, table: np.ndarray) -> DataFrame:
    """``keep``, ``language`` (en, de, fr, es or null), COUNTS and the formulas' values, which are null where there are no words."""
    numbers = [T.StructField(x, T.DoubleType()) for x in [*COUNTS, *FORMULAS]]
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("language", T.StringType()), *numbers])
    shared = df.sparkSession.sparkContext.broadcast(table)  # 4 MB, whatever the texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = TextMeasure(shared.value)
        names = np.array([*LANGUAGES, None], dtype=object)
        for batch in batches:
            step = max(1, int(batch.num_rows * BLOCK_CHARS / max(1, batch.column("_text").nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                counts, values, language = measure.measure(part.column("_text").fill_null("").to_pylist())
                columns = [part.column(k) for k in keep] + [pa.array(names[language].tolist(), pa.string())]
                numbers = [pa.array(x) for x in counts.T] + [pa.array(x, from_pandas=True) for x in values.T]
                yield pa.RecordBatch.from_arrays([*columns, *numbers], names=schema.names)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def cut_points(values: np.ndarray, levels: np.ndarray) -> list[float]:
    """LEVELS + 1 rising points: the level of a value is 0.5 plus the number of intervals it has passed. The inner ones are where
    a logistic curve of "above this level" over the values passes one half."""
    middle, spread = values.mean(), values.std() + 1e-9
    z = np.stack([np.ones(len(values)), (values - middle) / spread], axis=1)
    inner = []
    for level in range(1, LEVELS):
        above = (levels > level).astype(float)
        if above.all() or not above.any():
            inner.append(values.min() if above.all() else values.max())
            continue
        w = np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (p - above) + np.array([0, 0.01 * w[1]])
            w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-6, 0.01]), slope)
        inner.append(float(middle - spread * w[0] / w[1]) if w[1] > 1e-6 else float(middle))
    inner = np.maximum.accumulate(inner)
    width = max((inner[-1] - inner[0]) / (LEVELS - 2), 1e-6)
    points = np.concatenate([[inner[0] - width], inner, [inner[-1] + width]])
    return (points + np.arange(len(points)) * 1e-6).tolist()


def fit(samples: DataFrame) -> tuple[np.ndarray, dict[str, dict[str, list[float]]]]:
    """Trigram profiles, and cut points by language and formula, from (sample_id, lang, text, reading_level). Rows without a
    text or level are left out; a language with fewer than ``LEAST_SAMPLES`` takes the points of all together."""
    rated = samples.where("text is not null and reading_level between 1 and 5").orderBy("sample_id").limit(SAMPLE_ROWS)
    rows = rated.select("lang", "text", "reading_level").toPandas()
    if not len(rows):
        raise ValueError("no rated samples")
    table = profiles(rows["text"].tolist(), rows["lang"].tolist())
    _, values, told = TextMeasure(table).measure(rows["text"].tolist())
    language = np.where(rows["lang"].isin(LANGUAGES), rows["lang"], np.array([*LANGUAGES, None], dtype=object)[told])
    good, levels, points = ~np.isnan(values[:, 0]), rows["reading_level"].to_numpy(int), {}
    for x in LANGUAGES:
        own = good & (pd.Series(language) == x).to_numpy()
        own = good if own.sum() < LEAST_SAMPLES else own
        points[x] = {f: cut_points(np.log(values[own, i]), levels[own]) for i, f in enumerate(FORMULAS)}
    return table, points


def grade(points: dict[str, dict[str, list[float]]]) -> Column:
    """The median of the formulas' grades, rounded to a level."""
    grades = []
    for f in FORMULAS:
        by_language = F.lit(None).cast("double")
        for x in LANGUAGES:
            passed = F.lit(0.5)
            for a, b in pairwise(points[x][f]):
                passed = passed + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log(f) - a) / (b - a)))
            by_language = F.when(F.col("language") == x, passed).otherwise(by_language)
        grades.append(by_language)
    middle = F.array_sort(F.array(*grades))[len(FORMULAS) // 2]
    return F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.floor(middle + 0.5))).cast("long")


def reading_levels(documents: DataFrame, samples: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``language``, ``n_words``, the value of each formula and ``reading_level`` (1 to 5) of every document.

    The language is told from the text, of those that the samples hold; texts of another language in Latin letters are
    known by their poor fit only, so a close relative can be taken for one of the four. A level is null for null and empty texts, texts of fewer than
    ``LEAST_WORDS`` words and those not written in English, German, French or Spanish. Repeated rows are repeated.
    """
    table, points = fit(samples)
    measured = with_features(documents, keep, text, table)
    level = F.when(F.col("language").isNotNull() & (F.col("n_words") >= LEAST_WORDS), grade(points))
    return measured.select(*keep, "language", F.col("n_words").cast("long").alias("n_words"), *FORMULAS, level.alias("reading_level"))
