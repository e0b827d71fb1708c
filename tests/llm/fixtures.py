"""Small documents with copies, near copies, odd and missing values, and the brute-force rules of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Columns that the operators use inside, as other columns of the input.
CLASHES = {"keep_id": "x", "text_sha256": "y", "block": 3, "word": "z", "n": 1, "chunk": 2, "bit": 5, "_blob": "q", "label": 9, "family": 4, "removed": "r", "_bucket": 6, "line": 7}


def documents(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(60)
    texts = [say(rng.randint(1, 120)) for _ in range(40)]
    for i in range(12):  # near copies, some a word apart, some further
        words = texts[i % 4].split()
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    texts += [texts[0]] * 5 + [texts[1].replace(" ", "  \n"), texts[2].upper()]
    texts += [f"{say(9)}\n{passage}\n{say(4)}" for _ in range(4)]
    texts += ["", None, " \t\n ", "one", "one two three", "a b c d", "the password: hunter2345 and AKIA" + "Q" * 16 + " then " + "0af1" * 8]
    texts += ["secret: token = abcdefgh", "İstanbul ﬁn x² don't’s <|endoftext|> é", "w" * 5000, say(3000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[0]), (None, None)]


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {'string' if isinstance(v, str) else 'int'}" for c, v in CLASHES.items())
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *CLASHES.values()) for i, t in rows], schema)


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def grouped(ids, linked):
    """The least id that each id reaches."""
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}
