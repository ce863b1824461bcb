"""One consistent form for texts that look the same and differ in their characters.

Characters are mapped one by one (full-width forms, spaces, twins of other scripts, signs under several codes,
characters without width), ligatures are spelled out and combining accents are put together. Distinct mapped values
are then grouped in SQL under the Unicode collation, which is sensitive to case and accents and takes canonically
equivalent spellings as equal; the shortest, then smallest member of a class is its canonical form, and is joined
back to every value. All of it runs inside the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.runtime import small_side, stored

#: Letters of other scripts and their Latin twins.
TWINS = {
    "аеорсухѕіјһԁԛԝӏёїү": "aeopcyxsijhdqwlëïy",
    "АВЕЗКМНОРСТУХЅІЈԚԜӀҮЁЇ": "ABEЗKMHOPCTYXSIJQWIYËÏ",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳό": "ABEZHIKMNOPTYXovcjó",
    "ɡɑµℓ": "gaμl",
    "αρυι": "apui",
    "օհոսԼՏՕ": "ohnuLSO",
    "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ": "ABCDEGHJKLMPRSTVWZ",
    "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ": "ABCDEFGHIJKLMNOPRSTUVWXYZ",
}
#: Ligatures and the letters they look like.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ"}
#: Code ranges of characters without width.
INVISIBLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
]
#: Code ranges of spaces that look like the plain one, and hyphens that look like the plain one.
SPACES = [(0xA0, 0xA0), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
HYPHENS = [(0x2010, 0x2011), (0xFE63, 0xFE63)]

#: Between and before the headings of a path in its single-string form; must not be ignorable in a collation.
HEADING = "\n␞\n"
NO_HEADING = "\n␀\n"
#: Rows of one spelling that meet all rows of another in one task.
BLOCK_ROWS = 5_000


def character_map() -> dict[str, str]:
    """Every mapped character and what it looks like ('' for characters without width)."""
    out = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    out |= {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (0xFFE0, 0xFFE1, 0xFFE2, 0xFFE4, 0xFFE5, 0xFFE6)}
    for ranges, like in ((SPACES, " "), (HYPHENS, "-"), (INVISIBLE, "")):
        out |= {chr(c): like for a, b in ranges for c in range(a, b + 1)}
    for a, b in TWINS.items():
        out |= {x: y for x, y in zip(a, b, strict=True) if x != y}
    for c in range(0x80, 0xF900):  # signs under a second code, such as the ohm sign
        one = unicodedata.normalize("NFD", chr(c)) if not 0xD800 <= c < 0xE000 else chr(c)
        whole = unicodedata.normalize("NFC", chr(c)) if one != chr(c) else chr(c)
        if len(whole) == 1 and whole != chr(c):
            out[chr(c)] = out.get(whole, whole)
    for c in [*range(0x2160, 0x2180), *range(0x1D400, 0x1D800), 0x210E, 0x2124, 0x2128]:  # Roman numerals of one letter, letters of mathematics
        letter = unicodedata.normalize("NFKC", chr(c))
        if len(letter) == 1 and letter != chr(c) and letter.isalnum():
            out[chr(c)] = out.get(letter, letter)
    return out


def _composed() -> dict[str, str]:
    """Letter and combining accent -> the accented letter, for Latin letters."""
    pairs = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) == 2 and unicodedata.normalize("NFC", d) == chr(c):
            pairs[d] = chr(c)
    return pairs


def with_plain_form(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the text ``value`` with each character replaced by the one it looks like; null stays null. Case,
    accents, raised digits, added spaces and visible marks are kept."""
    x = F.col(value)
    ascii_only = F.length(x) == F.octet_length(x)  # by far the most texts; they are left alone
    table = character_map()
    kept = {k: v for k, v in table.items() if v}
    gone = "".join(k for k, v in table.items() if not v)
    mapped = F.translate(x, "".join(kept) + gone, "".join(kept.values()))
    for ligature, letters in LIGATURES.items():
        mapped = F.replace(mapped, F.lit(ligature), F.lit(letters))
    pairs = _composed()
    letters = F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[F.lit(v) for v in pairs.values()]))
    clusters = F.regexp_extract_all(F.col("_mapped"), F.lit("(?s)\\P{M}?\\p{M}*"), F.lit(0))
    joined = F.array_join(F.transform(clusters, lambda g: F.coalesce(F.try_element_at(letters, g), g)), "")
    staged = df.withColumn("_mapped", F.when(ascii_only, x).otherwise(mapped))
    whole = F.when(ascii_only, F.col("_mapped")).when(F.col("_mapped").rlike("[\\u0300-\\u036f]"), joined).otherwise(F.col("_mapped"))
    return staged.withColumn(out, whole).drop("_mapped")


def path_string(path: Column) -> Column:
    """A heading path as one string in which no two different paths are equal; null stays null."""
    return F.array_join(F.transform(path, lambda h: F.concat(F.lit(HEADING), F.coalesce(h, F.lit(NO_HEADING)))), "")


def class_key(form: Column) -> Column:
    """A hash that all forms of a class of the collation share: canonically equivalent spellings differ only in characters with
    combining marks and in such beyond ASCII, which are left out, as are those a collation ignores."""
    plain = F.regexp_replace(form, "(?s).?\\p{M}++|[^ -~]++", "")
    return F.xxhash64(F.when(form.rlike("[^ -~]"), plain).otherwise(form))


def canonical_forms(values: DataFrame, scope: list[str], form: str) -> DataFrame:
    """(scope, ``form``, ``canonical``) for each plain form that isn't the canonical member of its class: the shortest,
    then smallest of the forms that are equal under the Unicode collation.

    Only hashes of all forms are shuffled; forms are grouped under the collation where two of one ``class_key`` differ.
    """
    keyed = values.select(*scope, form, class_key(F.col(form)).alias("_key")).where(F.col(form).isNotNull())
    h = F.xxhash64(F.lit(1), F.col(form))
    several = keyed.groupBy(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(scope)], F.col("_key").alias("_k")).agg(F.min(h).alias("_a"), F.max(h).alias("_b"))
    several = small_side(stored(several.where("_a <> _b"), "keys"))
    on = [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(scope)] + [F.col("_key") == F.col("_k")]
    distinct = keyed.join(several, on, "left_semi").select(*scope, form).distinct()
    classes = distinct.groupBy(*scope, F.collate(F.col(form), "UNICODE").alias("_class")).agg(
        F.min(F.struct(F.length(form).alias("n"), F.col(form).alias("v")))["v"].alias("canonical"),
        F.collect_list(form).alias("_forms"),
        F.count(F.lit(1)).alias("_n"),
    )
    several = classes.where("_n > 1").select(*scope, F.explode("_forms").alias(form), "canonical")
    return several.where(F.col(form) != F.col("canonical"))


def with_canonical(df: DataFrame, scope: list[str], form: str) -> DataFrame:
    """``df`` with ``canonical``, the canonical member of the class that ``form`` belongs to; null for null."""
    # only forms that aren't canonical themselves: a few, but broadcast only if their stored size allows it
    c = stored(canonical_forms(df, scope, form), "canonical")
    c = small_side(c.select(*[F.col(s).alias(f"_{s}") for s in scope], F.col(form).alias("_form"), F.col("canonical").alias("_canonical")))
    on = [df[s].eqNullSafe(F.col(f"_{s}")) for s in scope] + [df[form] == F.col("_form")]
    joined = df.join(c, on, "left")
    return joined.withColumn("canonical", F.coalesce("_canonical", form)).drop("_form", "_canonical", *[f"_{s}" for s in scope])


def consistent(df: DataFrame, keys: list[str], text: str = "text", path: str = "heading_path") -> DataFrame:
    """``keys``, the canonical ``text`` and the canonical ``heading_path`` of every row.

    Equal-looking texts come out equal, and so do equal-looking paths, wherever they stand; null texts and paths
    stay null, a null heading comes out as null. Repeated rows are repeated.
    """
    base = df.select(*keys, F.col(text).alias("_t"), path_string(F.col(path)).alias("_p"))
    base = with_plain_form(with_plain_form(base, "_t", "_tf"), "_p", "_pf")
    texts = with_canonical(base, [], "_tf").withColumnRenamed("canonical", text)
    both = with_canonical(texts, [], "_pf")
    headings = F.split(F.substring(F.col("canonical"), len(HEADING) + 1, 2**31 - 1), HEADING, -1)
    each = F.transform(headings, lambda h: F.when(h != NO_HEADING, h))
    empty = F.array().cast("array<string>")
    return both.select(*keys, text, F.when(F.col("canonical") == "", empty).otherwise(each).alias(path))


def spelling_pairs(df: DataFrame, scope: list[str], keys: list[str], raw: str, form: str) -> DataFrame:
    """Pairs of rows of one ``scope`` whose ``raw`` values differ and look the same: ``<key>_a``, ``<key>_b``, keys of a
    before keys of b, each pair once.

    From the classes on, 128-bit digests stand for the texts. Rows of classes with a single spelling, nearly all,
    drop out before rows meet. Spellings of a class are paired first, then their rows, in blocks of at most
    ``BLOCK_ROWS`` a side, however many rows have one spelling.
    """
    held = with_canonical(with_plain_form(df.where(F.col(raw).isNotNull()), raw, form), scope, form)
    digest = lambda *c: F.unhex(F.md5(F.concat_ws("\u0001", *[F.col(x).cast("string") for x in c]).cast("binary")))
    held = stored(held.select(*keys, digest(*scope, "canonical").alias("_class"), digest(raw).alias("_raw")), "spellings")
    spelled = held.groupBy("_class", "_raw").agg(F.count(F.lit(1)).alias("_n"))
    mixed = spelled.groupBy("_class").agg(F.collect_list(F.struct("_raw", "_n")).alias("_all"), F.count(F.lit(1)).alias("_k"))
    mixed = stored(mixed.where("_k > 1"), "mixed")
    blocks = lambda c: F.ceil(F.col(c)["_n"] / F.lit(BLOCK_ROWS)).cast("int")
    duos = (
        mixed.select("_class", "_all", F.explode("_all").alias("_x"))
        .select("_class", "_x", F.explode("_all").alias("_y"))
        .where("_x._raw < _y._raw")
        .select(
            "_class", F.col("_x._raw").alias("_ra"), F.col("_y._raw").alias("_rb"), blocks("_x").alias("_na"), blocks("_y").alias("_nb")
        )
    )
    # the few rows of classes with several spellings
    rows = held.join(small_side(mixed.select("_class")), "_class", "left_semi").withColumn("_h", F.xxhash64(*keys))
    block = lambda n: F.pmod(F.col("_h"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def side(own: str, other: str, name: str) -> DataFrame:
        met = rows.join(duos.withColumn("_raw", F.col(f"_r{own}")), ["_class", "_raw"]).withColumn(f"_b{own}", block(f"_n{own}"))
        met = met.withColumn(f"_b{other}", every(f"_n{other}"))
        return met.select("_class", "_ra", "_rb", "_ba", "_bb", F.struct(*keys).alias(name))

    met = side("a", "b", "_1").join(side("b", "a", "_2"), ["_class", "_ra", "_rb", "_ba", "_bb"]).where("_1 != _2")
    ordered = met.select(F.least("_1", "_2").alias("_a"), F.greatest("_1", "_2").alias("_b")).distinct()
    return ordered.select(*[F.col(f"_{x}.{k}").alias(f"{k}_{x}") for x in "ab" for k in keys])


def lookalike_blocks(blocks: DataFrame) -> DataFrame:
    """(field, doc_id_a, pos_a, doc_id_b, pos_b): blocks that look the same in ``text`` (anywhere) or ``heading_path``
    (within a document) and differ in its characters. A block stored twice counts once; null texts and paths take
    part in no pair; rows without a key are left out."""
    keys = ["doc_id", "pos"]
    base = blocks.where("doc_id is not null and pos is not null")
    texts = base.select(*keys, F.col("text").alias("_v"))
    paths = base.select(*keys, F.col("doc_id").alias("_doc"), path_string(F.col("heading_path")).alias("_v"))
    found_t = spelling_pairs(texts, [], keys, "_v", "_f").select(F.lit("text").alias("field"), "*")
    found_p = spelling_pairs(paths, ["_doc"], keys, "_v", "_f").select(F.lit("heading_path").alias("field"), "*")
    return found_t.unionByName(found_p).select("field", "doc_id_a", "pos_a", "doc_id_b", "pos_b")
