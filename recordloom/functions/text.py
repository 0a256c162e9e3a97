"""Text functions, Column to Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V

#: What Unicode calls white space, as `(?U)\s` does.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; only the ends are looked at."""
    return F.btrim(c, F.lit(BLANK))


def key_form(c: Column) -> Column:
    return F.lower(strip(c))


def any_of(c: Column, words: list[str]) -> Column:
    """Whether any of the words is contained."""
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])


def first_of(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return otherwise if out is None else out.otherwise(otherwise)


def normalize_digits(c: Column, compat: bool = True) -> Column:
    """ASCII digits for those of nine scripts; null gives ''.

    `compat` keeps the original map, which leaves 13 digits alone and misreads one.
    """
    pairs = {zero + d: str(d) for zero in V.DIGIT_ZEROS.values() for d in range(10)}
    if compat:
        pairs = {k: v for k, v in pairs.items() if k not in V.DIGITS_UNMAPPED} | V.DIGITS_MISREAD
    return F.translate(F.coalesce(c, F.lit("")), "".join(map(chr, pairs)), "".join(pairs.values()))


def _block(first: int, last: int) -> str:
    return f"[\\x{{{first:04X}}}-\\x{{{last:04X}}}]"


def script_counts(c: Column) -> Column:
    """Characters of each script, as a struct; the Latin block is A to z with what lies between."""
    return F.struct(*[F.regexp_count(F.coalesce(c, F.lit("")), F.lit(_block(a, z))).cast("long").alias(name) for name, a, z, _ in V.SCRIPTS])


def _counts(c: Column) -> list[tuple[str, str, Column]]:
    return [(name, code, F.regexp_count(c, F.lit(_block(a, z)))) for name, a, z, code in V.SCRIPTS]


def dominant_language(c: Column, latin_first: bool = False) -> Column:
    """struct(code, script, confidence): the script with most characters; ties go by the table's order, with `latin_first` to Latin."""
    counts = _counts(F.coalesce(c, F.lit("")))
    if latin_first:
        counts.sort(key=lambda x: x[0] != "Latin")
    total = reduce(Column.__add__, [n for _, _, n in counts])
    top = F.greatest(*[n for _, _, n in counts])
    code = first_of([(n == top, F.lit(k)) for _, k, n in counts], F.lit("en"))
    code = F.when((code == "hi") & any_of(c, V.MARATHI), "mr").otherwise(code)
    return F.when(total == 0, F.struct(F.lit("en").alias("code"), F.lit("Latin").alias("script"), F.lit(0.1).alias("confidence"))).otherwise(
        F.struct(code.alias("code"), first_of([(n == top, F.lit(s)) for s, _, n in counts], F.lit("Latin")).alias("script"), (top / total).alias("confidence"))
    )


def detect_language(c: Column) -> Column:
    """Code by eight Indic scripts where more than two characters are of them, else 'en'; 'unknown' below five characters."""
    text = strip(F.coalesce(c, F.lit("")))
    by = {code: n for _, code, n in _counts(text)}
    counts = [(k, by[k]) for k in V.DETECTOR_B]
    top = F.greatest(*[n for _, n in counts])
    code = first_of([(n == top, F.lit(k)) for k, n in counts], F.lit("en"))
    indic = reduce(Column.__add__, [n for _, n in counts]) > 2
    return F.when(F.length(text) < 5, "unknown").when(indic, F.when((code == "hi") & any_of(text, V.MARATHI), "mr").otherwise(code)).otherwise("en")


def detect_script(c: Column) -> Column:
    """Code of the most frequent of nine scripts; 'en' without any."""
    by = {code: n for _, code, n in _counts(F.coalesce(c, F.lit("")))}
    counts = [(k, by[k]) for k in V.DETECTOR_C]
    top = F.greatest(*[n for _, n in counts])
    return F.when(top > 0, first_of([(n == top, F.lit(k)) for k, n in counts], F.lit("en"))).otherwise("en")


def script_distribution(c: Column, base: float = 0.95) -> Column:
    """array<struct(code, name, script, confidence, is_primary, char_share, char_count)>, most frequent first."""
    text = F.coalesce(c, F.lit(""))
    marathi = any_of(text, V.MARATHI)

    def row(code, name, script, confidence, primary, share, count):
        pairs = (("code", code), ("name", name), ("script", script), ("confidence", confidence), ("is_primary", primary), ("char_share", share), ("char_count", count))
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in pairs])

    counted = F.filter(
        F.array(*[F.struct((-n).alias("rank"), F.lit(i).alias("ord"), n.cast("long").alias("n"), F.lit(s).alias("script"), F.lit(k).alias("code")) for i, (s, k, n) in enumerate(_counts(text))]),
        lambda x: x["n"] > 0,
    )
    names = F.create_map(*[F.lit(x) for pair in V.LANGUAGE_NAMES.items() for x in pair])

    def described(pair: Column) -> Column:
        total = F.aggregate(pair, F.lit(0).cast("long"), lambda s, x: s + x["n"])

        def one(x: Column, i: Column) -> Column:
            share = x["n"] / total
            code = F.when((x["code"] == "hi") & marathi, "mr").otherwise(x["code"])
            confidence = F.least(base * (0.6 + 0.4 * F.least(share * 1.5, F.lit(1.0))), F.lit(0.99))
            return row(code, names[code], x["script"], F.bround(confidence, 4), i == 0, F.bround(share, 4), x["n"])

        return F.transform(pair, one)

    ranked = F.transform(F.array(F.sort_array(counted)), described)[0]
    blank = F.array(row("hi", "Hindi", "Devanagari", 0.40, True, 1.0, F.lit(0).cast("long")))
    none = F.array(row("en", "English", "Latin", 0.50, True, 1.0, F.lit(0).cast("long")))
    return F.when(strip(text) == "", blank).when(F.size(counted) == 0, none).otherwise(ranked)


def clean_label(c: Column) -> Column:
    bare = F.rtrim(F.ltrim(c, F.lit(BLANK)), F.lit(BLANK + ":：-–—."))
    return F.ltrim(F.regexp_replace(bare, r"^\d+[.)]\s*", ""), F.lit(BLANK))


def clean_value(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def is_valid_label(c: Column) -> Column:
    return is_valid_key(key_form(c))


def is_valid_key(low: Column) -> Column:
    """Whether a label is valid, by its key form."""
    return F.length(low).between(2, 80) & ~low.isin(V.NOISE_LABELS) & ~low.rlike(r"(?U)^[\d\s.,;:]+$")


def is_valid_value(c: Column) -> Column:
    return F.length(strip(c)).between(1, 500)


def compare_form(c: Column, compat: bool = True) -> Column:
    """Lower case, separators as one space. A null is 'none' with `compat`, else ''."""
    text = F.coalesce(c, F.lit("None" if compat else ""))
    return strip(F.regexp_replace(F.lower(text), r"(?U)[\s\-/.,;:]+", " "))


def translate_term(c: Column, entity_type: Column) -> Column:
    """English for the first term of the dictionary contained in the value; null for identifiers and without a term."""
    found = first_of([(F.contains(c, F.lit(a)), F.lit(b)) for a, b in V.TERMS], F.lit(None).cast("string"))
    return F.when(~entity_type.isin(V.UNTRANSLATED), found)


def translate_inline(c: Column) -> Column:
    """The value with the first contained term replaced; numbers and values without letters stay."""
    plain = c.rlike(r"^[\x00-\x7F]*$") & ~c.rlike("[A-Za-z]")
    return F.when(plain, c).otherwise(first_of([(F.contains(c, F.lit(a)), F.replace(c, F.lit(a), F.lit(b))) for a, b in V.TERMS], c))


def mask_secret(c: Column) -> Column:
    """Stars for up to eight characters, else the first and last four around four stars."""
    short = F.repeat(F.lit("*"), F.length(c))
    return F.when(F.length(c) <= 8, short).otherwise(F.concat(F.substring(c, 1, 4), F.lit("****"), F.right(c, F.lit(4))))


def layout_stats(c: Column) -> Column:
    """struct(lines, table_rows, headings) of the non-blank lines."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: strip(x) != "")
    count = lambda f: F.size(F.filter(lines, f)).cast("long")
    upper = lambda x: (F.upper(x) == x) & (F.lower(x) != x) & F.length(strip(x)).between(6, 79)
    return F.struct(F.size(lines).cast("long").alias("lines"), count(lambda x: F.size(F.split(x, r"[\t|]+")) >= 3).alias("table_rows"), count(upper).alias("headings"))


def block_type(text: Column, confidence: Column) -> Column:
    """unknown, title, table, field, form, signature or text; the first that fits."""
    t = strip(F.coalesce(text, F.lit("")))
    key = F.lower(F.substring_index(t, ":", 1))
    upper = (F.upper(t) == t) & (F.lower(t) != t)
    return (
        F.when(t == "", "unknown").when(upper & F.length(t).between(6, 79), "title").when(t.rlike(r"[\t|]"), "table")
        .when(F.contains(t, F.lit(":")), F.when(any_of(key, V.FIELD_WORDS), "field").otherwise("form"))
        .when((F.length(t) <= 3) & (confidence > 0.5), "signature").otherwise("text")
    )


def name_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, of stripped lower-case names."""
    x, y = key_form(a), key_form(b)
    return F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null if either is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def file_type(name: Column) -> Column:
    low = F.lower(name)
    return first_of([(any_of(low, marks), F.lit(kind)) for marks, kind in V.FILE_TYPES], F.lit("Land Revenue Deed"))


def class_colour(land_class: Column) -> Column:
    low = F.lower(F.coalesce(land_class, F.lit("")))
    return first_of([(F.contains(low, F.lit(k)), F.lit(c)) for k, c in V.CLASS_COLOURS], F.lit(dict(V.CLASS_COLOURS)["default"]))


def is_mixed(distribution: Column) -> Column:
    """Whether the second script of a distribution has 5 % or more and another language."""
    second = F.get(distribution, F.lit(1))
    return F.coalesce((second["char_share"] >= 0.05) & (second["code"] != F.get(distribution, F.lit(0))["code"]), F.lit(False))


def reading_models(distribution: Column, handwriting: Column) -> Column:
    """array<struct(engine, text_type, language, scope)>: the models to read a document with, by its languages."""

    def one(engine: Column, kind: str, language: Column, scope: str) -> Column:
        return F.struct(engine.alias("engine"), F.lit(kind).alias("text_type"), language.alias("language"), F.lit(scope).alias("scope"))

    first, second = F.get(distribution, F.lit(0))["code"], F.get(distribution, F.lit(1))["code"]
    engine = F.concat(F.when(first.isin(V.PADDLE_LANGUAGES), F.lit("paddle_")).otherwise(F.lit("tesseract_")), first)
    wanted = F.array(
        one(engine, "printed", first, "full_document"),
        F.when(is_mixed(distribution), one(F.concat(F.lit("paddle_"), second), "printed_secondary", second, "region_crops")),
        F.when(handwriting, one(F.lit("trocr"), "handwritten", first, "region_crops")),
    )
    return F.filter(wanted, lambda m: m.isNotNull())


#: First code points of the blocks that share one layout, from Devanagari to Malayalam.
ABUGIDAS = range(0x0900, 0x0D80, 0x80)


def transliterate(c: Column, compat: bool = True) -> Column:
    """Latin spelling of text in one of nine scripts, digits first; other text keeps its letters, a null gives ''.

    The first letter of a script says which is read. Its block is moved to that of
    Devanagari, all nine having one layout. A consonant without a vowel sign or virama
    gets its own vowel; then letters are spelled. With `compat` runs of capitals keep the first only.
    """
    base = 0x0900
    at = lambda *places: "".join(chr(base + p) for p in places)
    block = range(1, 0x80)
    text = normalize_digits(c, compat)
    first = F.regexp_extract(F.coalesce(c, F.lit("")), "[\\x{0900}-\\x{0D7F}]", 0)
    own = reduce(Column.__or__, [first.between(chr(z), chr(z + 0x7F)) & text.rlike(f"[\\x{{{z:04X}}}-\\x{{{z + 0x7F:04X}}}]") for z in ABUGIDAS])
    # Letters of other blocks stay: in a text of another script than Devanagari those of Devanagari are set aside.
    aside = "".join(chr(0xF0000 + p) for p in block)
    devanagari = "".join(chr(base + p) for p in block)
    kept = text
    for zero in ABUGIDAS:
        if zero != base:
            own_block = "".join(chr(zero + p) for p in block)
            kept = F.when(first.between(chr(zero), chr(zero + 0x7F)), F.translate(F.translate(text, devanagari, aside), own_block, devanagari)).otherwise(kept)
    dotted = kept
    for plain, dot in V.DOTTED.items():
        dotted = F.replace(dotted, F.lit(at(plain, V.DOT_BELOW)), F.lit(at(dot)))
    consonants, signs = at(*V.CONSONANTS), at(*V.VOWEL_SIGNS)
    spoken = F.regexp_replace(dotted, f"([{consonants}])(?![{signs}{at(V.VIRAMA, V.DOT_BELOW)}])", "$1a")
    spelled = {**V.VOWELS, **V.VOWEL_SIGNS, **V.CONSONANTS, **V.MARKS, V.DOT_BELOW: "", V.VIRAMA: ""}
    single = {p: s for p, s in spelled.items() if len(s) == 1}
    gone = [p for p, s in spelled.items() if not s]
    latin = F.translate(spoken, at(*single, *gone), "".join(single.values()))
    for place, s in spelled.items():
        if len(s) > 1:
            latin = F.replace(latin, F.lit(at(place)), F.lit(s))
    latin = F.translate(latin, aside, devanagari)
    if compat:
        pieces = F.regexp_extract_all(latin, F.lit("(?s)([A-Z]{2,}|[A-Z]?[^A-Z]+|[A-Z])"), F.lit(1))
        latin = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[A-Z]{2,}$"), F.concat(F.left(p, F.lit(1)), F.lower(F.substring(p, 2, 1 << 20)))).otherwise(p)), "")
    return F.when(own, strip(latin)).otherwise(text)
