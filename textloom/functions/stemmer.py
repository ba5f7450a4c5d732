"""Stemmers: Porter's, after M. F. Porter, An algorithm for suffix stripping (1980), and Snowball's for some other languages."""

from __future__ import annotations

_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
_BY_LENGTH = [sorted(x, key=lambda r: -len(r[0])) for x in (_2, _3, [(s, "") for s in _4])]


def _shape(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _short_end(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replace(w: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, put in rules:
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if _measure(stem) > least and not (end == "ion" and stem[-1:] not in ("s", "t")):
                return stem + put
            return w
    return w


def porter(word: str) -> str:
    """The stem of a word in lower case; words of up to two letters stay."""
    w = word.lower()
    if len(w) <= 2:
        return w
    for end, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + put
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, _BY_LENGTH[0], 0)
    w = _replace(w, _BY_LENGTH[1], 0)
    w = _replace(w, _BY_LENGTH[2], 1)
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# Snowball's algorithms for German, Swedish, Norwegian and Danish. A region begins behind the first
# letter that isn't a vowel and follows one; it leaves three letters before it, at least.


def _region(w: str, vowels: str, start: int = 0) -> int:
    for i in range(start + 1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


def _longest(w: str, endings: str) -> str:
    return max((e for e in endings.split() if w.endswith(e)), key=len, default="")


def german(w: str) -> str:
    vowels = "aeiouyäöü"
    w = w.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in vowels and w[i + 1] in vowels else c for i, c in enumerate(w))
    first = _region(w, vowels)
    second = _region(w, vowels, first)
    first = max(first, 3)
    within = lambda e, r: bool(e) and len(w) - len(e) >= r
    e = _longest(w, "em ern er e en es s")
    if within(e, first) and (e != "s" or w[-2:-1] and w[-2] in "bdfghklmnrt"):
        w = w[: -len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    e = _longest(w, "en er est st")
    if within(e, first) and (e != "st" or len(w) >= 6 and w[-3] in "bdfghklmnt"):
        w = w[: -len(e)]
    e = _longest(w, "end ung ig ik isch lich heit keit")
    if within(e, second):
        if e in ("end", "ung"):
            w = w[: -len(e)]
            if w.endswith("ig") and within("ig", second) and not w.endswith("eig"):
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            if w[-len(e) - 1 : -len(e)] != "e":
                w = w[: -len(e)]
        elif e in ("lich", "heit"):
            w = w[: -len(e)]
            if w.endswith(("er", "en")) and within("er", first):
                w = w[:-2]
        else:
            w = w[:-4]
            e = _longest(w, "lich ig")
            if within(e, second):
                w = w[: -len(e)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


def _northern(w: str, vowels: str) -> int:
    return max(3, _region(w, vowels))


def _ending(w: str, first: int, endings: str) -> str:
    """The longest ending that lies in the region."""
    return _longest(w[first:], endings)


def swedish(w: str) -> str:
    first = _northern(w, "aeiouyäåö")
    e = _ending(w, first, "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast s")
    if e and (e != "s" or w[-2:-1] and w[-2] in "bcdfghjklmnoprtvy"):
        w = w[: -len(e)]
    if _ending(w, first, "dd gd nn dt gt kt tt"):
        w = w[:-1]
    e = _ending(w, first, "lig ig els löst fullt")
    return w[:-1] if e in ("löst", "fullt") else w[: len(w) - len(e)]


def norwegian(w: str) -> str:
    vowels = "aeiouyæåø"
    first = _northern(w, vowels)
    e = _ending(w, first, "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast s erte ert")
    if e in ("erte", "ert"):
        w = w[: -len(e)] + "er"
    elif e and (e != "s" or w[-2:-1] and (w[-2] in "bcdfghjlmnoprtvyz" or w[-2] == "k" and len(w) > 2 and w[-3] not in vowels)):
        w = w[: -len(e)]
    if _ending(w, first, "dt vt"):
        w = w[:-1]
    e = _ending(w, first, "leg eleg ig eig lig elig els lov elov slov hetslov")
    return w[: len(w) - len(e)]


def danish(w: str) -> str:
    vowels = "aeiouyæåø"
    first = _northern(w, vowels)
    e = _ending(w, first, "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret s")
    if e and (e != "s" or w[-2:-1] and w[-2] in "abcdfghjklmnoprtvyzå"):
        w = w[: -len(e)]
    pair = "gd dt gt kt"
    if _ending(w, first, pair):
        w = w[:-1]
    if w.endswith("igst"):
        w = w[:-2]
    e = _ending(w, first, "ig lig elig els løst")
    if e == "løst":
        w = w[:-1]
    elif e:
        w = w[: -len(e)]
        if _ending(w, first, pair):
            w = w[:-1]
    if len(w) - 1 >= first and len(w) > 1 and w[-1] == w[-2] and w[-1] not in vowels:
        w = w[:-1]
    return w


STEMMERS = {"en": porter, "porter": porter, "de": german, "sv": swedish, "no": norwegian, "da": danish}
