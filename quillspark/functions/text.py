"""Column functions on text: folding, tokens, shingles, hashes and small formats. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of the French index.
STOPWORDS = (
    "a ai aie ait alors as au aucun aucune aujourd auquel aura aurai auraient aurait aurez auront aussi autre autres aux "
    "avaient avait avant avec avez aviez avoir avons ayant beaucoup bien c car ce ceci cela celle celles celui cent "
    "cependant certain certaine certains ces cet cette ceux chaque chez ci comme comment d dans de dedans dehors deja "
    "depuis des desormais deux devrait doit donc dont du duquel durant elle elles en encore enfin entre est et etaient "
    "etait etant etc ete etes etre eu eux fait faire fois font furent hors ici il ils j je juste l la laquelle le lequel "
    "les lesquelles lesquels leur leurs lors lorsque lui m ma mais malgre me meme memes mes mien moi moins mon n ne ni non "
    "nos notre nous nul on ont or ou oui par parce parmi pas pendant peu peut peuvent plus plusieurs plutot pour pourquoi "
    "pourtant pouvait pu puis puisque qu quand que quel quelle quelles quels qui quoi s sa sans se sera serait ses si sien "
    "soit son sont sous soyez suis sur t ta tandis tant te tel telle tes toi ton tous tout toute toutes tres trop tu un "
    "une vers voici voila vos votre vous y"
).split()

#: Role words that name no one by themselves.
ROLE_WORDS = (
    "roi reine prince princesse empereur imperatrice chevalier chevaliers ecuyer sorcier sorciere magicien magicienne "
    "immortel immortels dieu deesse dieux seigneur dame maitre maitresse guerrier guerriere capitaine soldat soldats "
    "commandant chef general gouverneur monarque souverain souveraine heros heroine homme femme enfant fille garcon fils "
    "frere soeur pere mere ancien ancienne le la les un une de du des et d l a au aux"
).split()


def _plain() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is an ASCII letter and marks, and those letters."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c)))[0] != chr(c) and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain()
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def deaccent(col: Column) -> Column:
    """Letters without their accents, combining marks dropped. Ligatures and sharp s stay."""
    return F.translate(col, ACCENTED + _MARKS, PLAIN)


def fold(col: Column) -> Column:
    """Lower case without accents; runs of other signs than a-z and 0-9 are one space; trimmed."""
    return F.trim(F.regexp_replace(deaccent(F.lower(col)), "[^a-z0-9]+", " "))


def ui_fold(col: Column) -> Column:
    """The folding of filter boxes: accents and case go, punctuation stays."""
    return F.lower(deaccent(col))


def letters_only(col: Column) -> Column:
    return F.regexp_replace(F.lower(deaccent(col)), "[^a-z]", "")


def stem(word: Column) -> Column:
    """Without a final s, in words of over four letters that don't end in ss."""
    return F.when((F.length(word) > 4) & word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def raw_tokens(col: Column) -> Column:
    return F.filter(F.split(deaccent(F.lower(col)), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def tokenize(col: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Index tokens: folded words of two letters or more, stop words dropped, then stemmed."""
    words = raw_tokens(F.coalesce(col, F.lit("")))
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(stopwords))
    return F.transform(words, stem)


def bind(col: Column, f) -> Column:
    """f(col) with col worked out once, however often a lambda in f uses it."""
    return F.element_at(F.transform(F.array(col), f), 1)


def windows(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space; none if there are fewer."""
    return bind(words, lambda ws: _windows(ws, n))


def _windows(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def shingles(col: Column, n: int = 4) -> Column:
    return F.array_distinct(windows(tokenize(col), n))


def trigrams(col: Column) -> Column:
    """Distinct three-letter pieces."""
    return bind(col, _trigrams)


def _trigrams(col: Column) -> Column:
    return F.when(F.length(col) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(col) - 2), lambda i: F.substr(col, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements of two sets over the smaller one's size; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def fnv1a(col: Column) -> Column:
    """FNV-1a of 32 bits over the code units of ASCII text, as a long."""
    codes = F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def round_half_up(col: Column) -> Column:
    """Rounds halves towards plus infinity, at both signs."""
    return F.floor(col + 0.5)


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def sentences(col: Column) -> Column:
    return F.split(col, r"(?<=[.!?])\s+")


def slug(col: Column, most: int = 60) -> Column:
    """Folded words joined by hyphens, at most 60 signs; x if nothing is left."""
    s = F.substring(F.regexp_replace(fold(col), " ", "-"), 1, most)
    return F.when(F.length(s) > 0, s).otherwise("x")


def fingerprint(col: Column, n: int = 10) -> Column:
    return F.substring(F.sha1(col.cast("binary")), 1, n)


def strip_markers(col: Column, empty: str = "(…)") -> Column:
    """Past answers without their [n] marks and the space these leave before punctuation."""
    s = F.trim(F.regexp_replace(F.regexp_replace(col, r"\[\d+\]", ""), r"\s+([.,;:!?])", "$1"))
    return F.when(F.length(s) > 0, s).otherwise(empty)


def citations(col: Column) -> Column:
    """Distinct numbers of [n] marks, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int")))


def page_range(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("p. "), start.cast("string"))).otherwise(F.concat(F.lit("p. "), start.cast("string"), F.lit("-"), end.cast("string")))


def roman(col: Column) -> Column:
    """Roman numeral of 1 to 39; empty below 1."""
    tens, ones = F.array(*map(F.lit, ["", "X", "XX", "XXX"])), F.array(*map(F.lit, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]))
    return F.when((col >= 1) & (col < 40), F.concat(F.element_at(tens, (F.floor(col / 10) + 1).cast("int")), F.element_at(ones, (col % 10 + 1).cast("int")))).otherwise("")


def book_label(saga: Column, tome: Column, title: Column) -> Column:
    """A volume's full label; tome 0 stands outside the series."""
    return F.concat(saga, F.when(tome == 0, F.lit(", hors-série — ")).otherwise(F.concat(F.lit(", tome "), roman(tome), F.lit(" — "))), title)


def short_label(saga: Column, tome: Column) -> Column:
    return F.concat(saga, F.when(tome == 0, F.lit(" hors-série")).otherwise(F.concat(F.lit(" "), roman(tome))))


def book_id(saga: Column, tome: Column) -> Column:
    return F.concat(F.lit("s"), saga.cast("string"), F.lit("-t"), F.lpad(tome.cast("string"), 2, "0"))


def match_case(src: Column, dst: Column) -> Column:
    """``dst`` in the case of ``src``: all capitals (of two signs or more), first capital, or as it is."""
    upper = (src == F.upper(src)) & (F.length(src) > 1)
    first = F.substring(src, 1, 1) == F.upper(F.substring(src, 1, 1))
    return F.when(upper, F.upper(dst)).when(first, F.concat(F.upper(F.substring(dst, 1, 1)), F.substring(dst, F.lit(2), F.length(dst)))).otherwise(dst)


def drop_cap(col: Column) -> Column:
    """Joins a lone initial capital to the word after it, except the words A À Y O Ô."""
    return F.regexp_replace(col, r"^(?![AÀYOÔ]\s)([A-ZÀ-Ý])\s+(?=[a-zà-ÿ])", "$1")


def header_key(col: Column) -> Column:
    """Letters of a line that may be a running header: at most 70 signs, no end punctuation, six letters or more; else null."""
    t = F.trim(col)
    k = letters_only(t)
    return F.when((F.length(t) > 0) & (F.length(t) <= 70) & ~t.rlike(r'[.!?…,;:»"]$') & (F.length(k) >= 6), k)


def readable_title(col: Column) -> Column:
    """Whether a scanned title can be trusted: long enough, few words of scrambled case, no odd signs, vowels."""
    t = F.trim(col)
    words = F.regexp_extract_all(t, F.lit(r"([A-Za-zÀ-ÿŒœ’-]{2,})"), 1)
    count = lambda arr, pattern: F.size(F.filter(arr, lambda w: w.rlike(pattern)))
    long = F.filter(words, lambda w: F.length(w) >= 3)
    mute = F.size(long) - count(long, "(?i)[aeiouyàâäéèêëîïôöùûüÿœ]")
    return (
        (F.length(t) >= 4) & (F.size(words) > 0) & (count(words, "[a-zà-ÿ][A-ZÀ-Ý]") < 0.3 * F.size(words))
        & ~t.rlike(r"[¢©|§~^*\\{}<>=+_]") & ((F.size(long) == 0) | (mute < 0.5 * F.size(long)))
    )


def distinctive(alias: Column, role_words: list[str] = ROLE_WORDS) -> Column:
    """Whether an alias names one entity by itself: three letters or more and a word that is no role word."""
    f = fold(alias)
    words = F.filter(F.split(f, " "), lambda w: w != "")
    return (F.length(F.replace(f, F.lit(" "), F.lit(""))) >= 3) & F.exists(words, lambda w: ~w.isin(role_words))


#: A word's edge as ASCII sees it: accented letters are no word signs. Spaces as scripts on the web see them.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Terms of kinship, and comrades in arms, which are none.
KIN_TERMS = r"p[èe]re|m[èe]re|fils|fille|fr[èe]re|s(?:œ|oe)ur|[ée]pou[xs]e?|mari[ée]?|femme de|conjoint|enfant|parent|anc[êe]tre|descendant|petit[- ]fils|petite[- ]fille|oncle|tante|neveu|ni[èe]ce|a[îi]eul"
COMRADE_TERMS = r"(?:fr[èe]res?|s(?:œ|oe)urs?)BLANK+d['’BLANK]BLANK*armes?"
KIN = f"(?iu){EDGE}(?:{KIN_TERMS}){EDGE}"
COMRADES = f"(?iu){EDGE}{COMRADE_TERMS.replace('BLANK]', BLANK[1:]).replace('BLANK', BLANK)}{EDGE}"


def kinship(col: Column) -> Column:
    return col.rlike(KIN) & ~col.rlike(COMRADES)


def hex_tint(col: Column, n: int = 8) -> Column:
    """A stable small number for a name: (31 h + code) over its signs in 32 bits, modulo n."""
    codes = F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295))) % n


def json_in(text: str | None) -> str | None:
    """The text if it is JSON; else its first brace with all up to where that closes, braces in strings not counted, if
    that is JSON. Null otherwise."""
    import json

    def whole(t: str) -> str | None:
        try:
            json.loads(t)
        except ValueError:
            return None
        return t

    if text is None or whole(text) is not None:
        return text
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if (start := text.find("{")) >= 0 else ():
        c = text[i]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return whole(text[start : i + 1])
    return None


def first_json_object(col: Column) -> Column:
    """The JSON in a text (see :func:`json_in`), however deep it is nested; Python sees batches of texts."""
    return F.pandas_udf(lambda s: s.map(json_in, na_action="ignore"), "string")(col)

