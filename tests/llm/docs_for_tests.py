"""Small documents with every oddity."""

import random

WORDS = "the of and a to der die le la que alpha beta gamma delta omega Straße élan niño kappa!".split()
_ODD = [None, "", " ", "\n\n", "one", "  x", "tab\tand\x0bvt\x0cff\rcr", "🙂 emoji 🙂 text", "a" * 3000, ("the same line\n" * 40)]


def make_docs(n=60, seed=0):
    """(doc_id, text, lang, source, n_chars): random texts, odd ones, repeated rows, and nulls in every column."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(rng.randint(1, 80)))
        rows.append((i, text, "en", f"s{rng.randrange(4)}", len(text)))
    rows += [(n + i, t, None, None if i % 2 else "s0", None if t is None else len(t)) for i, t in enumerate(_ODD)]
    rows += [(900, rows[0][1], "en", "s1", 1), (901, rows[0][1], "en", "s1", 1), (902, " ".join(rng.choices(WORDS, k=20_000)), "en", "s2", 1)]
    rows += [(903, "twice", "en", "s3", 5)] * 2 + [(None, "no id at all", "en", "s3", 12)]
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
