"""Text scalar functions as column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of letters and digits with single apostrophes between such runs.
WORD = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*"
#: A term of the lexical graph has at least two letters, digits or underscores.
TERM = "[\\p{L}\\p{N}_]{2,}"
#: Unicode white space, spelled out because Java's \s is ASCII only.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]+"

#: The English stop list of the keyword and lexical channels.
STOP_WORDS = """
a about above across after afterwards again against all almost alone along already also although always am
among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back
be became because become becomes becoming been before beforehand behind being below beside besides between
beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down
due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything
everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front
full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself
him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter
latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my
myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off
often on once one only onto or other others otherwise our ours ourselves out over own part per perhaps please
put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty
so some somehow someone something sometime sometimes somewhere still such system take ten than that the their
them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin third
this those though three through throughout thru thus to together too top toward towards twelve twenty two un
under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas
whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will with
within without would yet you your yours yourself yourselves
""".split()

#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "dr e.g etc fig i.e jr mr mrs ms no prof sr st vs".split()


def clean_text(x: Column) -> Column:
    """White space of any kind collapsed to single spaces and stripped; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), SPACE, " "))


def words(x: Column) -> Column:
    """The words of a text in order, case kept; null gives null."""
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def keyword_tokens(x: Column) -> Column:
    """Case-folded words without stop words, in order and with repeats."""
    return F.filter(words(casefold(x)), lambda t: ~t.isin(STOP_WORDS))


def lexical_terms(x: Column) -> Column:
    """Distinct lower-case terms of at least two characters, without stop words."""
    terms = F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0))
    return F.filter(F.array_distinct(terms), lambda t: ~t.isin(STOP_WORDS))


def gaps(x: Column) -> Column:
    """What stands before, between and after the words: one element more than words."""
    return F.split(x, WORD, -1)


def text_span(x: Column, start: Column, length: Column) -> Column:
    """The text from word ``start`` (0-based) up to the beginning of word ``start + length``, stripped."""
    w, g = words(x), gaps(x)
    pieces = F.transform(
        F.slice(F.arrays_zip(w.alias("w"), F.slice(g, F.lit(2), F.size(g)).alias("g")), start + 1, length),
        lambda p: F.concat(p["w"], p["g"]),
    )
    return strip(F.array_join(pieces, ""))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "")


def group_numbers(x: Column) -> Column:
    """Removes the (no-break) spaces that group the digits of a number: ``41 256 010`` gives ``41256010``."""
    p = "(?<!\\d)\\d{1,3}(?:[\\s\\u00a0]\\d{3})+(?!\\d)"
    found = F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(0)), lambda m: F.regexp_replace(m, "[\\s\\u00a0]", ""))
    between = F.split(x, p, -1)
    tail = F.slice(between, F.lit(2), F.size(between))
    joined = F.concat(F.element_at(between, 1), F.array_join(F.zip_with(found, tail, lambda m, b: F.concat(m, b)), ""))
    return F.when(F.size(found) == 0, x).otherwise(joined)


def strip_code_fence(x: Column) -> Column:
    """A model's answer without a Markdown code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), "^```[A-Za-z0-9_-]*\\s*", ""), "\\s*```$", "")


def progress_counts(message: Column) -> Column:
    """The last ``n/m`` of a progress message as struct(done, total); null where there is none."""
    found = F.regexp_extract_all(message, F.lit("(\\d+)\\s*/\\s*(\\d+)"), F.lit(0))
    last = F.try_element_at(found, F.lit(-1))
    done = F.regexp_extract(last, "(\\d+)\\s*/", 1).cast("int")
    total = F.regexp_extract(last, "/\\s*(\\d+)", 1).cast("int")
    return F.when(last.isNotNull(), F.struct(done.alias("done"), total.alias("total")))


def retry_delay(message: Column) -> Column:
    """Seconds a quota message asks to wait; null where it names none."""
    return F.regexp_extract(
        message, "(?i)retry in ([0-9]+(?:\\.[0-9]+)?)\\s*s", 1
    ).try_cast("double")


#: A mark that no text holds, between sentences while they are told apart.
_CUT = "\u0001"


def sentence_marks(x: Column) -> Column:
    """A text with a mark for the white space after each sentence."""
    opener = f"(^|[\\s{_CUT}(\\[\"'“‘«])"
    listed = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    out = F.regexp_replace(F.replace(x, F.lit(_CUT), F.lit(" ")), "([.!?][\"'”’»)\\]]*)\\s+", f"$1{_CUT}")
    out = F.regexp_replace(out, f"(?i){opener}({listed})\\.{_CUT}", "$1$2. ")
    for _ in range(2):  # initials may follow each other
        out = F.regexp_replace(out, f"{opener}(\\p{{Lu}})\\.{_CUT}(\\p{{Lu}})", "$1$2. $3")
    out = F.regexp_replace(out, f"([0-9])\\.{_CUT}(\\p{{Ll}})", "$1. $2")
    return F.regexp_replace(out, f"\\.\\.{_CUT}", ".. ")


def split_sentences(x: Column, least_words: int = 3) -> Column:
    """The sentences of a text in order; those of fewer than ``least_words`` words are left out. Null gives null."""
    parts = F.transform(F.split(sentence_marks(x), _CUT, -1), strip)
    return F.filter(parts, lambda s: F.regexp_count(s, F.lit(WORD)) >= least_words)
