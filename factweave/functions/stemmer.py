"""The published English stemmer ("Porter 2"): suffixes fall by steps, and only within the regions R1 and R2 of a word."""

from __future__ import annotations

import re

#: Fixed values of the algorithm: whole words with stems of their own, and words that stay or that stop after the plural step.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
STOP_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes that are replaced in R1, in two steps, and those that are deleted in R2.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_VOWEL = re.compile(r"[aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    if head := re.match(r"gener|commun|arsen", word):
        r1 = head.end()
    else:
        found = _REGION.search(word)
        r1 = found.end() if found else len(word)
    found = _REGION.search(word, r1)
    return r1, found.end() if found else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in SPECIAL or word in SAME:
        return SPECIAL.get(word, word)
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in STOP_AFTER_PLURAL:
        return word

    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: len(word) - len(end)] + "ee"
    elif end and _VOWEL.search(word[: len(word) - len(end)]):
        word = word[: len(word) - len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.match(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    end = _longest(word, SECOND)
    at = len(word) - len(end)
    if end and at >= r1 and (end != "ogi" or word[at - 1] == "l") and (end != "li" or word[at - 1] in "cdeghkmnrt"):
        word = word[:at] + SECOND[end]
    end = _longest(word, THIRD)
    at = len(word) - len(end)
    if end and at >= r1 and (end != "ative" or at >= r2):
        word = word[:at] + THIRD[end]
    end = _longest(word, FOURTH)
    at = len(word) - len(end)
    if end and at >= r2 and (end != "ion" or word[at - 1] in "st"):
        word = word[:at]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _SHORT_END.match(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
