"""Small invented corpora."""

import random

SYLLABLES = {"en": ["the", "an", "ing", "sh", "wh", "er", "ed", "ly"], "fr": ["eau", "ou", "ç", "é", "le", "tion", "ai", "qu"], "de": ["sch", "ung", "ü", "ein", "keit", "ge", "pf", "z"]}


def word(rng, lang="en"):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))


def words(rng, n, lang="en"):
    return [word(rng, lang) for _ in range(n)]


def text(rng, n, lang="en"):
    out = words(rng, n, lang)
    for k in range(0, n, 9):
        out[k] = out[k].capitalize()
        if k:
            out[k - 1] += "."
    return " ".join(out)


def changed(rng, t, n):
    """A near copy: n words replaced."""
    out = t.split(" ")
    for k in rng.sample(range(len(out)), n):
        out[k] = "x" + word(rng)
    return " ".join(out)


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, nulls, blanks, ties and repeats."""
    rng = random.Random(seed)
    texts = [text(rng, rng.randint(3, 160)) for _ in range(n)]
    passage = text(rng, 50)
    for k in range(0, n, 7):
        texts[k] += "\n" + passage
    texts += [texts[3], texts[3], texts[5], changed(rng, texts[9] + " " + passage, 2), changed(rng, texts[9] + " " + passage, 1), None, None, "", " \t\n", "word", "word", ". , !", passage, f"{passage} {passage}"]
    long = text(rng, 3000)
    texts += [long, changed(rng, long, 5)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, (None, texts[1]), (4, texts[4]), (4, texts[4])]
