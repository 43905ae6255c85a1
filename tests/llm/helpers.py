"""Awkward rows that every operator must stand, and small references."""
import random

EDGE = [
    (1, "The quick brown Fox jumps over the lazy dog and runs away.\nSecond line here.\nThird."),
    (2, "the quick brown fox jumps over the lazy dog and runs away.\nsecond line here.\nthird."),
    (3, None), (4, ""), (5, " \n\t \n"), (6, "word"), (7, "É é Ünï 日本語 \x1c 👩‍👩‍👧 'tis  two  blanks"),
    (8, "long " * 30_000), (9, "x" * 50_000), (None, "no id"), (None, None), (None, "no id"),
    (11, "same row twice"), (11, "same row twice"), (12, "one id"), (12, "other text"),
    (13, "a\nb\nc\nd\ne\nf\ng\nh"), (14, "z\na\nb\nc\nd\ne\nf\ng\nh"), (15, "<|endoftext|> a\r\nb  \n"),
]
CLASH = ["id", "h", "raw", "norm", "head", "size", "salt", "sha", "rn", "fp", "who", "kept", "lines",
         "hashes", "ends", "gone", "e", "t", "k", "row", "n", "m", "x", "a", "start", "end", "shard",
         "spans", "place", "file", "y", "f", "v", "ring", "part", "chunk", "new"]


def edge_docs(spark):
    """``EDGE`` as documents, with extra columns of many names, null in every other row."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{c} string" for c in CLASH)
    rows = [(d, t, None if i % 2 else "en", None, None if t is None else len(t),
             *([None if i % 2 else "q"] * len(CLASH))) for i, (d, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, schema)


def no_docs(spark):
    return edge_docs(spark).limit(0)


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))


def random_texts(seed, n=80):
    """Short texts over few words, with copies, shared passages and odd blanks."""
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "déjà", "x1", "the", "of", "it's", "end."]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.3:
            t = rnd.choice(out)
            if rnd.random() < 0.5:
                t = t + rnd.choice([" ", "\n", ""]) + rnd.choice(words)
        else:
            t = rnd.choice([" ", "\n", "  "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))
        out.append(t)
    return out


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
