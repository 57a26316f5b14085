"""Dense features of whole texts for the classifiers, computed over Arrow batches."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

WORD = re.compile(r"\w+")
#: Words that may hold characters which stand in for letters.
TOKEN = re.compile(r"(?:(?<![\w@$!|])[@$!|])?\w+(?:[@$!|]+\w+)*")
UPPER = re.compile(r"[A-Z]+")
#: Fixed words of abuse in four languages, known before any label is seen; the learned lexicon adds to them.
ABUSE = frozenset(
    "idiot idiots moron morons imbecile imbeciles stupid dumb dumbass scum trash loser losers clown clowns worthless pathetic disgusting fool fools garbage ugly hate shut vermin bastard bitch crap "
    "idioten dumm dumme dummkopf trottel abschaum versager wertlos widerlich arschloch depp deppen blöd blöde schwachkopf miststück hässlich hasse "
    "idiote idiots crétin crétins imbécile imbéciles débile abruti abrutis connard connards salaud ordure minable stupide dégoûtant nul nulle "
    "idiota idiotas imbécil imbéciles estúpido estúpida estúpidos tonto tonta basura escoria inútil patético asqueroso asquerosa perdedor payaso cabrón odio".split()
)
#: Fixed second-person pronouns of four languages.
SECOND = frozenset(
    "you your yours yourself yourselves u ur thou thee thy "
    "du dich dir dein deine deinen deinem deiner deines euch euer eure "
    "tu toi ton ta tes te vous votre vos vôtre "
    "usted ustedes tú ti tus tuyo tuya vosotros vosotras os vuestro vuestra".split()
)
#: Characters that stand in for letters.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")
PREFIXES = (4, 6)
#: Units of at least this weight (a natural logarithm of a ratio) count as abuse.
STRONG = 2.0


def units(words: list[str]) -> set[str]:
    """What a lexicon may list: whole words, and word starts (marked by a hyphen)."""
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + "-" for w in words if len(w) > n)
    return found


TOXIC_FEATURES = (
    "abuse", "abuse_count", "strong", "learned", "learned_max", "learned_sum", "starts", "starts_count", "near_second", "second", "capitals", "shouted",
    "exclaims", "punctuation", "symbols", "disguised", "disguised_count", "digits_in_words", "repeats", "log_words",
)


def _undisguised(text: str, lexicon: dict[str, float]) -> tuple[list[str], dict[str, str]]:
    """The words of a text in order, and the disguised ones among them with the word they stand for.

    A token with characters or digits that stand in for letters is one word if it then is a word of abuse or a strong unit; otherwise those characters divide words.
    """
    tokens = TOKEN.findall(text)
    odd = {t for t in set(tokens) if not t.isalpha()}
    hidden = {}
    for t in odd:
        for form in (t, t.lstrip("@$!|")):
            plain = form.lower().translate(DISGUISE)
            if plain != form.lower() and (plain in ABUSE or lexicon.get(plain, 0.0) >= STRONG):
                hidden[t] = plain
                break
    if not odd:
        return tokens, hidden
    words: list[str] = []
    for t in tokens:
        if t in odd and t not in hidden:
            words.extend(WORD.findall(t))
        else:
            words.append(t)
    return words, hidden


def toxic_features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Lexicon densities, nearness of abuse to the second person, capitals, punctuation and obfuscation rates of a whole text.

    ``lexicon`` weighs words and word starts by how much more frequent they are in toxic texts.
    """
    raw, hidden = _undisguised(text, lexicon)
    n = max(1, len(raw))
    chars = max(1, len(text))
    words = [hidden[w] if w in hidden else w.lower() for w in raw]
    counts = Counter(words)
    hits = [(lexicon[w], c) for w, c in counts.items() if w in lexicon]
    starts = Counter()
    for w, c in counts.items():
        for m in PREFIXES:
            if len(w) > m and (key := w[:m] + "-") in lexicon:
                starts[key] += c
    begun = sum(lexicon[k] * c for k, c in starts.items())
    strong = {w for w in counts if w in ABUSE or lexicon.get(w, 0.0) >= STRONG}
    near = second = 0
    if not SECOND.isdisjoint(counts):
        you = [k for k, w in enumerate(words) if w in SECOND]
        second = len(you)
        if strong:
            around = {k + d for k in you for d in (-3, -2, -1, 1, 2, 3)}
            near = sum(1 for k in around if 0 <= k < len(words) and words[k] in strong)
    upper = sum(map(len, UPPER.findall(text)))
    abuse = sum(counts[w] for w in strong if w in ABUSE)
    masked = sum(1 for w in raw if w in hidden) if hidden else 0
    return [
        abuse / n,
        float(abuse),
        sum(counts[w] for w in strong) / n,
        sum(c for _, c in hits) / n,
        max((w for w, _ in hits), default=0.0),
        sum(w * c for w, c in hits),
        begun / n,
        begun,
        near / n,
        second / n,
        upper / chars,
        sum(1 for w in raw if len(w) > 2 and w.isupper()) / n,
        text.count("!") / chars,
        sum(text.count(c) for c in ".,;:?") / chars,
        sum(text.count(c) for c in "#$%&*@|") / chars,
        masked / n,
        float(masked),
        sum(1 for w in counts if not w.isalpha() and any(map(str.isdigit, w)) and any(map(str.isalpha, w))) / n,
        1 - len(counts) / n,
        float(np.log1p(len(raw))),
    ]


#: Fixed function words of four languages.
FUNCTION_WORDS = frozenset(
    "the and of to in is it that for was on are as with be by this at or an a from not have he which you "
    "der die das und ist nicht ein eine mit von zu den im auf für sich des dem auch als "
    "le la les de des et un une est que qui dans pour pas sur au par avec il "
    "el los las y que en un una es por con para se del al no su lo".split()
)

QUALITY_FEATURES = (
    "log_words", "distinct", "top_word", "repeats_next", "word_length", "word_length_deviation", "function_words", "letters", "digits", "symbols",
    "pipes", "exclaims", "upper", "shouted", "stops", "log_lines", "repeated_lines", "short_lines", "odd_ends", "longest_word", "entropy", "commas",
)


def quality_features(text: str) -> list[float]:
    """Rates of repetition, symbols, capitals, function words and line shapes of a whole text."""
    words = text.split()
    n = max(1, len(words))
    chars = max(1, len(text))
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    codes = np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype="<u4")) if text else np.zeros(1, np.int64)
    present = np.flatnonzero(codes)
    letters = Counter(dict(zip(map(chr, present.tolist()), codes[present].tolist(), strict=True)))
    total = (codes[present] if len(present) else np.ones(1)) / chars
    alphabetic = sum(c for x, c in letters.items() if x.isalpha())
    return [
        float(np.log1p(len(words))),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        float(sizes.mean()) / 10,
        float(sizes.std()) / 10,
        sum(c for w, c in counts.items() if w.strip(".,").lower() in FUNCTION_WORDS) / n,
        alphabetic / chars,
        sum(c for x, c in letters.items() if x.isdigit()) / chars,
        sum(letters[x] for x in "#$%&*@^~=<>{}[]\\/") / chars,
        letters["|"] / n,
        letters["!"] / n,
        sum(c for x, c in letters.items() if x.isupper()) / max(1, alphabetic),
        sum(c for w, c in counts.items() if len(w) > 3 and w.isupper()) / n,
        letters["."] / n,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(1 for x in lines if len(x) < 20) / max(1, len(lines)),
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?") / n,
        float(np.log1p(sizes.max())) / 10,
        float(-(total * np.log2(total)).sum()) / 10,
        letters[","] / n,
    ]
