"""Snowball stemmers for English and Italian, written from the published algorithms, and a vectorised
function that stems distinct terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published English algorithm.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
               "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_STOP_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
          ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", None), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int, vowels: str) -> int:
    """The place after the first non-vowel that follows a vowel from ``start`` on."""
    m = re.search(f"[{vowels}][^{vowels}]", word[start:])
    return start + m.end() if m else len(word)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def english(word: str) -> str:
    w = word.lower().lstrip("'")
    if len(w) <= 2:
        return w
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _region(w, 0, _V)
    r2 = _region(w, r1, _V)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _STOP_1A:
        return w
    # 1b
    if w.endswith(("eedly", "eed")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        m = re.search(r"(ingly|edly|ing|ed)$", w)
        if m and re.search("[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # 2
    for end, to in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w.endswith("logi"):
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and len(w) > 2 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    # 3
    for end, to in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (to is not None or len(w) - len(end) >= r2):
                w = w[: -len(end)] + (to or "")
            break
    # 4
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_IV = "aeiouàèìòù"
# Fixed values of the published Italian algorithm.
_PRONOUNS = ("gliela", "gliele", "glieli", "glielo", "gliene", "sene", "mela", "mele", "meli", "melo", "mene", "tela", "tele", "teli", "telo", "tene", "cela", "cele", "celi", "celo", "cene", "vela", "vele", "veli", "velo", "vene",
             "gli", "ci", "la", "le", "li", "lo", "mi", "ne", "si", "ti", "vi")
_IT1 = [("R2", "", ("anza", "anze", "ico", "ici", "ica", "ice", "iche", "ichi", "ismo", "ismi", "abile", "abili", "ibile", "ibili", "ista", "iste", "isti", "istà", "istè", "istì", "oso", "osi", "osa", "ose", "mente", "atrice", "atrici", "ante", "anti")),
        ("R2ic", "", ("azione", "azioni", "atore", "atori")), ("R2", "log", ("logia", "logie")), ("R2", "u", ("uzione", "uzioni", "usione", "usioni")), ("R2", "ente", ("enza", "enze")), ("RV", "", ("amento", "amenti", "imento", "imenti")),
        ("amente", "", ("amente",)), ("ità", "", ("ità",)), ("iv", "", ("ivo", "ivi", "iva", "ive"))]
_IT2 = ("erebbero", "irebbero", "assero", "assimo", "eranno", "erebbe", "eremmo", "ereste", "eresti", "essero", "iranno", "irebbe", "iremmo", "ireste", "iresti", "iscano", "iscono", "issero", "arono", "avamo", "avano", "avate", "eremo",
        "erete", "erono", "evamo", "evano", "evate", "iremo", "irete", "irono", "ivamo", "ivano", "ivate", "ammo", "ando", "asse", "assi", "emmo", "enda", "ende", "endi", "endo", "erai", "erei", "yamo", "iamo", "immo", "irai", "irei",
        "isca", "isce", "isci", "isco", "ano", "are", "ata", "ate", "ati", "ato", "ava", "avi", "avo", "erà", "ere", "erò", "ete", "eva", "evi", "evo", "irà", "ire", "irò", "ita", "ite", "iti", "ito", "iva", "ivi", "ivo", "ono", "uta", "ute", "uti", "uto", "ar", "ir")


def italian(word: str) -> str:
    w = word.lower().translate(str.maketrans("áéíóú", "àèìòù"))
    w = re.sub("qu", "qU", w)
    w = re.sub(f"(?<=[{_IV}])([ui])(?=[{_IV}])", lambda m: m[1].upper(), w)
    if len(w) < 2:
        rv = len(w)
    elif w[1] not in _IV:
        m = re.search(f"[{_IV}]", w[2:])
        rv = 2 + m.end() if m else len(w)
    elif w[0] in _IV:
        m = re.search(f"[^{_IV}]", w[2:])
        rv = 2 + m.end() if m else len(w)
    else:
        rv = min(3, len(w))
    r1 = _region(w, 0, _IV)
    r2 = _region(w, r1, _IV)
    inside = lambda end, r: w.endswith(end) and len(w) - len(end) >= r
    p = next((x for x in _PRONOUNS if w.endswith(x)), None)
    if p:
        rest = w[: -len(p)]
        if len(rest) >= rv:
            if rest.endswith(("ando", "endo")) and len(rest) - 4 >= rv:
                w = rest
            elif rest.endswith(("ar", "er", "ir")) and len(rest) - 2 >= rv:
                w = rest + "e"
    before = w
    ends = [(end, kind, to) for kind, to, ends in _IT1 for end in ends]
    hit = max((e for e in ends if w.endswith(e[0])), key=lambda e: len(e[0]), default=None)
    if hit:
        end, kind, to = hit
        if kind == "RV" and inside(end, rv) or kind in ("R2", "R2ic", "ità", "iv") and inside(end, r2) or kind == "amente" and inside(end, r1):
            w = w[: -len(end)] + to
            more = {"R2ic": ("ic",), "amente": ("iv", "os", "ic", "abil"), "ità": ("abil", "ic", "iv"), "iv": ("at",)}.get(kind, ())
            m = next((x for x in more if inside(x, r2)), None)
            if m:
                w = w[: -len(m)]
                if kind in ("amente", "iv") and m in ("iv", "at") and inside("at" if m == "iv" else "ic", r2):
                    w = w[:-2]
    if w == before:
        v = max((e for e in _IT2 if inside(e, rv)), key=len, default=None)
        if v:
            w = w[: -len(v)]
    if len(w) > rv and w[-1] in "aeioàèìò":
        w = w[:-1]
        if len(w) > rv and w[-1] == "i":
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 1 >= rv:
        w = w[:-1]
    return w.lower()


LANGUAGES = {"en": english, "it": italian}


def stems(terms: DataFrame) -> DataFrame:
    """``terms``: term. term, lang, stem of each distinct term, for stems of two or more letters."""
    @F.pandas_udf("array<struct<lang:string,stem:string>>")
    def all_stems(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"lang": k, "stem": x} for k, f in LANGUAGES.items() if len(x := f(t)) >= 2])

    rows = terms.select("term").filter("term is not null").distinct()
    return rows.select("term", F.explode(all_stems("term")).alias("s")).select("term", "s.lang", "s.stem")
