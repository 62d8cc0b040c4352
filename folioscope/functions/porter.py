"""Porter's suffix stripping, by the published algorithm (1980). Words that are not plain lower-case ASCII stay as they are."""

import re

# The rule tables of the paper, longest suffix first within a step.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def shape(stem):
    """Vowels and consonants as a string of v and c; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(stem):
        vowel = letter in "aeiou" or (letter == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(stem):
    return len(re.findall("v+c+", shape(stem)))


def has_vowel(stem):
    return "v" in shape(stem)


def doubled(stem):
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def short_end(stem):
    """consonant, vowel, consonant other than w, x, y"""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def replaced(word, rules, least):
    """The rule with the longest fitting suffix decides, whether or not its condition holds."""
    fitting = [(s, r) for s, r in rules if word.endswith(s)]
    if not fitting:
        return word
    suffix, new = max(fitting, key=lambda x: len(x[0]))
    stem = word[: len(word) - len(suffix)]
    return stem + new if measure(stem) >= least else word


def plural(word):
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def past(word):
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: len(word) - len(suffix)]
        if word.endswith(suffix):
            if not has_vowel(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if doubled(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if measure(stem) == 1 and short_end(stem) else stem
    return word


def final_suffix(word):
    fitting = [s for s in STEP4 if word.endswith(s)]
    if not fitting:
        return word
    suffix = max(fitting, key=len)
    stem = word[: len(word) - len(suffix)]
    allowed = suffix != "ion" or stem.endswith(("s", "t"))
    return stem if allowed and measure(stem) > 1 else word


def tidy(word):
    if word.endswith("e"):
        stem = word[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not short_end(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def stem(word):
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = past(plural(word))
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP2, 1), STEP3, 1)
    return tidy(final_suffix(word))
