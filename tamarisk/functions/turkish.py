"""Turkish text functions as Column expressions: folding, tokens, stems, content terms.

Everything stays in the JVM. A stemming pass is one regular expression that marks the longest
suffix whose stem keeps four characters and a vowel, and a second that undoes consonant softening;
each intermediate result is used once, so four passes stay small enough for code generation.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper-case letters whose Turkish lower case differs from the default, vowels, suffixes
# (longest first within a pass), softened consonants, stop words.
FOLD_FROM, FOLD_TO = "IİŞĞÜÖÇ", "ıişğüöç"
VOWELS, FRONT, BACK = "aeıioöuü", "eiöü", "aıou"
SUFFIXES = """
liklerinden lıklarından sizlik sızlık suzluk süzlük lik lık luk lük siz sız suz süz ci cı cu cü çi çı çu çü
mek mak iyor ıyor uyor üyor ecek acak miş mış muş müş dir dır dur dür tir tır tur tür
lerden lardan lerin ların lere lara lerde larda leri ları den dan ten tan de da te ta nin nın nun nün
in ın un ün ye ya yi yı yu yü le la imiz ımız umuz ümüz iniz ınız unuz ünüz ler lar ma me im ım um üm
i ı u ü e a
""".split()
SOFTENED = {"ğ": "k", "b": "p", "c": "ç", "d": "t"}
STOPWORDS = """
ve veya ile ama fakat ancak lakin çünkü zira eğer ise ki de da ne bir bu şu o bunlar şunlar onlar için gibi kadar
sonra önce daha en çok az hem her hiç bazı tüm bütün olarak olan olur oldu olduğu var yok değil mi mı mu mü ya yani
ayrıca iken üzere göre şey kez defa yine yeni artık henüz zaten sadece yalnız
""".split()
WORD = r"[0-9a-zçğıöşü]+(?:['’][0-9a-zçğıöşü]+)*"

SUFFIXES = sorted(SUFFIXES, key=len, reverse=True)
MIN_STEM, PASSES = 4, 4


def fold_case(text: Column) -> Column:
    """Lower case with the Turkish dotted and dotless i; null stays null."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


@cache
def _decompositions() -> tuple[str, str, list[tuple[str, list[tuple[str, str]]]]]:
    """How Unicode decomposes every character once combining marks are gone, as tables of ``translate``.

    The first two strings map characters to one character or, where the second is at its end, to
    nothing. Then, for characters that become up to three characters and for those that become more:
    a regular expression of them, and for each place of the result the strings that map them to what
    stands there.
    """
    one, gone, many = {"ı": "i"}, [], {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) > 1:
            many[c] = plain
        elif plain != c and c not in one:
            one[c] = plain
            if not plain:
                gone.append(c)
    kept = [c for c in one if one[c]]
    groups = []
    for low, high in ((2, 3), (4, 1 << 20)):
        some = [c for c in many if low <= len(many[c]) <= high]
        places = []
        for k in range(max(map(len, (many[c] for c in some)))):
            having = [c for c in some if len(many[c]) > k]
            places.append(("".join(having + [c for c in some if len(many[c]) <= k]), "".join(many[c][k] for c in having)))
        groups.append((_class(some), places))
    return "".join(kept + gone), "".join(one[c] for c in kept), groups


def _class(characters: list[str]) -> str:
    """A regular expression of one of the characters, as ranges."""
    codes, ranges = sorted(map(ord, characters)), []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def deaccent(text: Column) -> Column:
    """Letters without their diacritics, in compatibility decomposition; dotless i becomes i. Null stays null."""
    source, target, groups = _decompositions()

    def spelled(c: Column) -> Column:
        out = c
        for pattern, places in groups:
            out = F.when(c.rlike(pattern), F.concat(*(F.translate(c, a, b) for a, b in places))).otherwise(out)
        return out

    several = "|".join(pattern for pattern, _ in groups)
    wide = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), spelled), "")
    return F.translate(F.when(text.rlike(several), wide).otherwise(text), source, target)


def last_vowel(word: Column) -> Column:
    """The right-most vowel, or null."""
    return F.nullif(F.regexp_extract(word, f".*([{VOWELS}])", 1), F.lit(""))


def harmony(word: Column) -> Column:
    vowel = last_vowel(word)
    return F.when(vowel.isin(list(FRONT)), "front").when(vowel.isin(list(BACK)), "back")


def _strip_once(word: Column, suffixes: list[str]) -> Column:
    # a stem of four characters or more with a vowel: either one of the first four is, or it goes on to the first one
    stem = f"(?=[^{VOWELS}]{{0,{MIN_STEM - 1}}}[{VOWELS}]).{{{MIN_STEM},}}?|[^{VOWELS}]{{{MIN_STEM},}}[{VOWELS}].*?"
    marked = F.regexp_replace(word, f"^({stem})(?:{'|'.join(suffixes)})$", "$1~")
    for soft, hard in SOFTENED.items():
        marked = F.regexp_replace(marked, f"{soft}~$", hard)
    return F.regexp_replace(marked, "~$", "")


def strip_suffixes(word: Column) -> Column:
    """Up to four suffixes off a folded word, the longest first; single vowels go in the first pass only."""
    word = _strip_once(word, SUFFIXES)
    for _ in range(PASSES - 1):
        word = _strip_once(word, [s for s in SUFFIXES if len(s) > 1])
    return word


def stem_word(word: Column) -> Column:
    """The stem of a token: the part before an apostrophe, else short words as they are, else without suffixes."""
    head = fold_case(F.regexp_replace(word, "['’].*$", ""))
    return F.when(word.rlike("['’]"), head).when(F.length(word) <= MIN_STEM, fold_case(word)).otherwise(strip_suffixes(fold_case(word)))


def tokenize(text: Column) -> Column:
    """Folded surface tokens in order; null text has none."""
    return F.regexp_extract_all(fold_case(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def stems(text: Column) -> Column:
    return F.transform(tokenize(text), stem_word)


def expand_tokens(text: Column) -> Column:
    """Each token followed by its stem if that differs, in order, with repetitions."""
    pair = F.transform(tokenize(text), lambda t: F.struct(t.alias("t"), stem_word(t).alias("s")))
    both = F.transform(pair, lambda p: F.when((p["s"] != p["t"]) & (p["s"] != ""), F.array(p["t"], p["s"])).otherwise(F.array(p["t"])))
    return F.flatten(both)


def normalize(text: Column) -> Column:
    return F.array_join(stems(text), " ")


def shares_root(a: Column, b: Column) -> Column:
    return F.arrays_overlap(expand_tokens(a), expand_tokens(b))


def is_content(term: Column) -> Column:
    return (F.length(term) > 1) & ~term.isin(STOPWORDS)


def content_terms(text: Column) -> Column:
    """Expanded tokens without stop words and single characters, with repetitions."""
    return F.filter(expand_tokens(text), is_content)
