"""Small corpora with every kind of row that operators must stand."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _bucket int, tokens string, n int, ids string, score string, fingerprint string, n_words string, hashes string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "an er in th re on ti at en he st ou ea ha nd ing ed or es ly".split()


def prose(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(words))


def texts(seed=1):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    base = prose(rng, 300)
    out = [None, "", "   \n\t ", "one", "one two three four", "a b c d\u0085e", "x<|endoftext|>y  \x00\x01", "\U0001f600 漢字 ñandú Éaux it's 3.14 can't", "tab\tsep\x0bvt\x0cff\rcr"]
    out += [prose(rng, rng.randrange(1, 400)) for _ in range(30)]
    out += [base, base, base.upper()]  # copies; upper case shares no words but all lower-cased shingles
    for k in range(12):  # near copies
        w = base.split()
        for _ in range(1 + k):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(99))
        out.append(" ".join(w))
    out += [prose(rng, 40) + " " + passage + "\n" + prose(rng, 30) for _ in range(8)]  # a shared passage
    out.append("same line\n" * 50)
    out.append(" ".join(["spam"] * 400))
    out.append("na " * 3000)
    out.append("q" * 5000)
    out.append(prose(rng, 20_000))  # very long
    return out


def rows(seed=1, gaps=True):
    """doc_ids with gaps, shuffled; one null id and one repeated row."""
    rng = random.Random(seed)
    made = []
    for i, t in enumerate(texts(seed)):
        made.append([i * 37 % 4001 if gaps else i, t])
    rng.shuffle(made)
    made.append([None, "a text without an id " * 6])
    made.append(list(made[5]))
    return [(i, t, rng.choice(["en", "de", None]), "src", None if t is None else len(t), 7, "x", 1, "y", "z", "f", "w", "h") for i, t in made]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def plain(spark, data):
    return spark.createDataFrame([r[:5] for r in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, k=5, low=True):
    w = words(lower(t) if low else t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
