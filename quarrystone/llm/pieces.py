"""Splitting of oversized texts at natural boundaries, with overlap, by bounded-quantifier regular expressions.

One ``regexp_extract_all`` cuts a text into consecutive pieces: the alternatives of its pattern are ordered by
the strength of the boundary (end of text, paragraph, sentence, line, clause, word), each consuming as many words
as the limit allows and at least half of that. A run of letters longer than ``LONGEST_WORD`` characters counts as
several units, so that it is cut by characters. SQL array functions then put the last words of each piece
before the next one. Everything runs inside the JVM, row by row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import WORD, strip

LIMIT_WORDS = 450
OVERLAP_WORDS = 60
#: Characters after which a run of letters and digits is cut like two words.
LONGEST_WORD = 2000

_L = "\\p{L}\\p{N}"
_OTHER = f"[^{_L}]"
#: What stands before a word, and the word.
_UNIT = f"{_OTHER}*+[{_L}]{{1,{LONGEST_WORD}}}+(?:['’][{_L}]{{1,{LONGEST_WORD}}}+)*+"


def _alternatives(most: int, least: int) -> str:
    run = f"(?:{_UNIT}){{{least},{most}}}"
    mark = f"[^{_L}\\s]*+"
    return "|".join(
        [
            f"(?:{_UNIT}){{0,{most}}}+{_OTHER}*+\\z",
            f"{run}[^{_L}\\n]*+\\n[^{_L}\\n]*+\\n{_OTHER}*?(?=[^\\s])",
            f"{run}[^{_L}\\s]*?[.!?…؟।]{mark}\\s++",
            f"{run}[^{_L}\\s]*?[。！？]{mark}\\s*+",
            f"{run}[^{_L}\\n]*+\\n\\s*+",
            f"{run}[^{_L}\\s]*?[,;:،、，；：–—]{mark}\\s*+",
            f"(?:{_UNIT}){{1,{most}}}+[^{_L}\\s]*+\\s*+",
        ]
    )


def pattern(limit: int, overlap: int) -> str:
    fresh = limit - overlap
    return f"\\A(?:{_alternatives(limit, max(limit // 2, overlap))})|(?:{_alternatives(fresh, max(fresh // 2, min(overlap, fresh)))})"


def split_long(
    df: DataFrame, keep: list[str], text: str = "text", limit: int = LIMIT_WORDS, overlap: int = OVERLAP_WORDS
) -> DataFrame:
    """The pieces of every text of more than ``limit`` words: ``keep``, ``piece_no`` (from 0), ``n_pieces``,
    ``piece`` and ``n_words``.

    Each piece has at most ``limit`` words; each but the first begins with the last ``overlap`` words of the one
    before it. Without those repeats the pieces, one after the other, are the text (white space at the cuts
    aside). Null, empty and shorter texts give no rows; repeated rows give repeated pieces.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("overlap must be between 0 and half the limit")
    t = F.col("_text")
    long = (
        df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].alias("_text"))
        # no text with fewer characters can have so many words: spares most texts the count
        .where((F.length(t) > 2 * limit) & (F.regexp_count(t, F.lit(WORD)) > limit))
    )
    cut = F.filter(F.regexp_extract_all(t, F.lit(pattern(limit, overlap)), F.lit(0)), lambda p: p != "")
    cut = long.withColumn("_cut", cut).drop("_text")
    parts = cut.select("*", F.posexplode("_cut").alias("piece_no", "_fresh"), F.size("_cut").alias("n_pieces"))
    before = F.get("_cut", F.col("piece_no") - 1)
    units = F.regexp_extract_all(before, F.lit(_UNIT), F.lit(0))
    last = F.slice(units, F.greatest(F.lit(1), F.size(units) - (overlap - 1)), F.lit(max(overlap, 1)))
    tail = F.regexp_extract(before, f"{_OTHER}*+\\z", 0)
    repeated = F.concat(F.regexp_replace(F.array_join(last, ""), f"^{_OTHER}++", ""), tail)
    whole = F.when((F.col("piece_no") > 0) & F.lit(overlap > 0), F.concat(repeated, "_fresh")).otherwise(F.col("_fresh"))
    return parts.select(*keep, "piece_no", "n_pieces", strip(whole).alias("piece")).withColumn(
        "n_words", F.regexp_count("piece", F.lit(WORD))
    )
