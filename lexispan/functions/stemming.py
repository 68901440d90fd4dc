"""Snowball stemming, written from the published descriptions of the algorithms."""

from __future__ import annotations

from functools import lru_cache

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPT = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **dict.fromkeys(["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]),
}
_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _after_vc(word: str, start: int, vowels: str) -> int:
    """The place after the first non-vowel that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _english(word: str) -> str:
    if word in _EXCEPT:
        return _EXCEPT[word] or word
    if len(word) <= 2:
        return word
    word = word.lstrip("'") if word.startswith("'") else word
    chars = list(word)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in _V):
            chars[i] = "Y"
    w = "".join(chars)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _after_vc(w, 0, _V) if r1 is None else r1
    r2 = _after_vc(w, r1, _V)

    def short(s: str) -> bool:
        if len(s) == 2:
            return s[0] in _V and s[1] not in _V
        return len(s) > 2 and s[-3] not in _V and s[-2] in _V and s[-1] not in _V + "wxY"

    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _KEEP:
        return w
    for end in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            if end.startswith("eed"):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + "ee"
            elif any(c in _V for c in w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif len(w) <= r1 and short(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, to in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and not (end == "ogi" and not w.endswith("logi")) and not (end == "li" and w[-3:-2] not in tuple("cdeghkmnrt")):
                w = w[: -len(end)] + to
            break
    for end, to in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + to
            break
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and not (end == "ion" and w[-4:-3] not in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    chars = list(w)
    for i in range(1, len(chars) - 1):
        if chars[i] in "uy" and chars[i - 1] in v and chars[i + 1] in v:
            chars[i] = chars[i].upper()
    w = "".join(chars)
    r1 = _after_vc(w, 0, v)
    r2 = _after_vc(w, r1, v)
    r1 = max(r1, 3)
    for end in ("ern", "em", "er", "en", "es", "e", "s"):
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
                w = w[: -len(end)]
                if end in ("en", "es", "e") and w.endswith("niss"):
                    w = w[:-1]
            break
    for end in ("est", "en", "er", "st"):
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "st" or (w[-3:-2] in tuple("bdfghklmnt") and len(w) >= 6)):
                w = w[: -len(end)]
            break
    for end in ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"):
        if w.endswith(end):
            stem_ = w[: -len(end)]
            if len(stem_) >= r2:
                if end in ("end", "ung"):
                    w = stem_[:-2] if stem_.endswith("ig") and not stem_.endswith("eig") and len(stem_) - 2 >= r2 else stem_
                elif end in ("ig", "ik", "isch"):
                    w = w if stem_.endswith("e") else stem_
                elif end in ("lich", "heit"):
                    w = stem_[:-2] if stem_.endswith(("er", "en")) and len(stem_) - 2 >= r1 else stem_
                else:
                    w = stem_
                    for more in ("lich", "ig"):
                        if w.endswith(more) and len(w) - len(more) >= r2:
                            w = w[: -len(more)]
                            break
            break
    return w.lower().translate(str.maketrans("äöü", "aou"))


def _cut(word: str, region: int, endings: tuple[str, ...]) -> str | None:
    """The longest of the endings that lies in the region."""
    tail = word[region:]
    return next((e for e in sorted(endings, key=len, reverse=True) if tail.endswith(e)), None)


def _r1(word: str, vowels: str) -> int:
    return max(3, _after_vc(word, 0, vowels))


def _swedish(w: str) -> str:
    r1 = _r1(w, "aeiouyäåö")
    first = ("a", "arna", "erna", "heterna", "orna", "ad", "e", "ade", "ande", "arne", "are", "aste", "en", "anden", "aren", "heten", "ern", "ar", "er", "heter", "or", "as", "arnas", "ernas", "ornas", "es", "ades", "andes", "ens", "arens", "hetens", "erns", "at", "andet", "het", "ast")
    end = _cut(w, r1, (*first, "s"))
    if end and (end != "s" or w[-2:-1] in tuple("bcdfghjklmnoprtvy")):
        w = w[: -len(end)]
    if _cut(w, r1, ("dd", "gd", "nn", "dt", "gt", "kt", "tt")):
        w = w[:-1]
    end = _cut(w, r1, ("lig", "ig", "els", "löst", "fullt"))
    if end in ("löst", "fullt"):
        w = w[:-1]
    elif end:
        w = w[: -len(end)]
    return w


def _norwegian(w: str) -> str:
    v = "aeiouyæåø"
    r1 = _r1(w, v)
    first = ("a", "e", "ede", "ande", "ende", "ane", "ene", "hetene", "en", "heten", "ar", "er", "heter", "as", "es", "edes", "endes", "enes", "hetenes", "ens", "hetens", "ers", "ets", "et", "het", "ast", "s", "erte", "ert")
    end = _cut(w, r1, first)
    if end in ("erte", "ert"):
        w = w[: -len(end)] + "er"
    elif end == "s":
        if w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or (w[-2:-1] == "k" and w[-3:-2] not in tuple(v)):
            w = w[:-1]
    elif end:
        w = w[: -len(end)]
    if _cut(w, r1, ("dt", "vt")):
        w = w[:-1]
    end = _cut(w, r1, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"))
    return w[: -len(end)] if end else w


def _danish(w: str) -> str:
    v = "aeiouyæåø"
    r1 = _r1(w, v)
    first = ("hed", "ethed", "ered", "e", "erede", "ende", "erende", "ene", "erne", "ere", "en", "heden", "eren", "er", "heder", "erer", "heds", "es", "endes", "erendes", "enes", "ernes", "eres", "ens", "hedens", "erens", "ers", "ets", "erets", "et", "eret", "s")
    end = _cut(w, r1, first)
    if end and (end != "s" or w[-2:-1] in tuple("abcdfghjklmnoprtvyzå")):
        w = w[: -len(end)]
    pairs = ("gd", "dt", "gt", "kt")
    if _cut(w, r1, pairs):
        w = w[:-1]
    if w.endswith("igst"):
        w = w[:-2]
    end = _cut(w, r1, ("ig", "lig", "elig", "els", "løst"))
    if end == "løst":
        w = w[:-1]
    elif end:
        w = w[: -len(end)]
        if _cut(w, r1, pairs):
            w = w[:-1]
    if len(w) > r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in v:
        w = w[:-1]
    return w


_RUSSIAN_GERUND = ("вшись", "вши", "в"), ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив")
_RUSSIAN_ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_RUSSIAN_PARTICIPLE = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_RUSSIAN_VERB = (
    ("ете", "йте", "ешь", "нно", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н"),
    ("ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю"),
)
_RUSSIAN_NOUN = ("иями", "ями", "ами", "ией", "иям", "ием", "иях", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")


def _russian(w: str) -> str:
    v = "аеиоуыэюя"
    w = w.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in v), len(w))
    r2 = _after_vc(w, _after_vc(w, 0, v), v)

    def drop(groups: tuple[tuple[str, ...], tuple[str, ...]]) -> str | None:
        """Without an ending of the groups; those of the first follow а or я."""
        end = _cut(w, rv, groups[0] + groups[1])
        if end in groups[0] and end not in groups[1]:
            return w[: -len(end)] if len(w) - len(end) - 1 >= rv and w[-len(end) - 1] in "ая" else None
        return w[: -len(end)] if end else None

    got = drop(_RUSSIAN_GERUND)
    if got is not None:
        w = got
    else:
        end = _cut(w, rv, ("ся", "сь"))
        w = w[:-2] if end else w
        end = _cut(w, rv, _RUSSIAN_ADJECTIVE)
        if end:
            w = w[: -len(end)]
            got = drop(_RUSSIAN_PARTICIPLE)
            w = w if got is None else got
        else:
            got = drop(_RUSSIAN_VERB)
            if got is None:
                end = _cut(w, rv, _RUSSIAN_NOUN)
                got = w[: -len(end)] if end else w
            w = got
    if len(w) > rv and w.endswith("и"):
        w = w[:-1]
    end = _cut(w, max(rv, r2), ("ост", "ость"))
    w = w[: -len(end)] if end else w
    if _cut(w, rv, ("нн",)):
        w = w[:-1]
    elif (end := _cut(w, rv, ("ейше", "ейш"))) is not None:
        w = w[: -len(end)]
        w = w[:-1] if _cut(w, rv, ("нн",)) else w
    elif _cut(w, rv, ("ь",)):
        w = w[:-1]
    return w


_SPANISH_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_SPANISH_GERUNDS = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
_SPANISH_Y = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
_SPANISH_VERB = tuple("arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split())
_SPANISH_E = ("en", "es", "éis", "emos")


def _spanish(w: str) -> str:
    v = "aeiouáéíóúü"
    r1 = _after_vc(w, 0, v)
    r2 = _after_vc(w, r1, v)
    if len(w) < 3:
        rv = len(w)
    elif w[1] not in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    elif w[0] in v and w[1] in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    else:
        rv = 3
    plain = str.maketrans("áéíóú", "aeiou")
    end = _cut(w, rv, _SPANISH_PRONOUNS)
    if end:
        stem_ = w[: -len(end)]
        verb = _cut(stem_, rv, (*_SPANISH_GERUNDS, "ando", "iendo", "ar", "er", "ir", "yendo"))
        if verb in _SPANISH_GERUNDS:
            w = stem_[: -len(verb)] + _SPANISH_GERUNDS[verb]
        elif verb and (verb != "yendo" or stem_.endswith("uyendo")):
            w = stem_
    before = w
    groups = {
        "": ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"),
        "ic": ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"),
        "log": ("logía", "logías"),
        "u": ("ución", "uciones"),
        "ente": ("encia", "encias"),
        "amente": ("amente",),
        "mente": ("mente",),
        "idad": ("idad", "idades"),
        "iv": ("iva", "ivo", "ivas", "ivos"),
    }
    kind = {e: k for k, es in groups.items() for e in es}
    end = next((e for e in sorted(kind, key=len, reverse=True) if w.endswith(e)), None)
    if end:
        k, stem_ = kind[end], w[: -len(end)]
        if len(stem_) >= (r1 if k == "amente" else r2):
            w = stem_ + (k if k in ("log", "u", "ente") else "")
            more = {"ic": ("ic",), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "iv": ("at",), "amente": ("iv", "os", "ic", "ad")}.get(k, ())
            extra = next((e for e in more if w.endswith(e) and len(w) - len(e) >= r2), None)
            if extra:
                w = w[: -len(extra)]
                if extra == "iv" and k == "amente" and w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
    if w == before:
        end = _cut(w, rv, _SPANISH_Y)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = _cut(w, rv, (*_SPANISH_VERB, *_SPANISH_E))
            if end:
                w = w[: -len(end)]
                if end in _SPANISH_E and w.endswith("gu") and len(w) > rv - 1:
                    w = w[:-1]
    end = _cut(w, rv, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if end:
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)


STEMMERS = {"da": _danish, "de": _german, "en": _english, "es": _spanish, "no": _norwegian, "ru": _russian, "sv": _swedish}


@lru_cache(1 << 16)
def stem(word: str, language: str) -> str:
    return STEMMERS[language](word)
