"""Documents with every odd case, and brute-force versions to hold the operators against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """Null, empty and blank texts, a null id and null groups, repeats, one word, one long text."""
    rng = random.Random(7)
    text = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, text), (7, text), (7, text), (8, text + " more"), (None, prose(rng, 40)), (9, prose(rng, 30_000, 5000)), (10, "naïve ümlaut 😀 ß " * 8), (11, "a\nb\n\na\n"), (12, "x" * 5000)]
    return [(i, t, None if i in (4, None) else "en", None if i == 5 else f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]


def family_rows(n=60, seed=3):
    """Originals, copies with a few words changed, exact copies, and texts apart."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = prose(rng, rng.randint(30, 120), 3000).split()
        rows.append(" ".join(base))
        for k in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 12])):
                other[rng.randrange(len(other))] = f"v{rng.randrange(10**6)}"
            rows.append(" ".join(other))
    rng.shuffle(rows)
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)]


def clashing(df):
    """The same rows with more columns, whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    names = "id kept n_words words key root bands band shard slot size gone _gone _doc _again start ids bucket score place n item_id line".split()
    return df.select("*", *[F.lit(1).alias(n) for n in names if n not in df.columns])


def shingles(text, width):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(rows, width, percent):
    """{doc_id: smallest doc_id reachable}, by comparing all pairs; a null id is -inf."""
    ids = [(-(10**30) if r[0] is None else r[0]) for r in rows]
    sets = [shingles(r[1], width) for r in rows]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(ids[a]), find(ids[b])
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}
