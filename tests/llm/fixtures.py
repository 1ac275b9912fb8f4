"""Small document tables with the awkward cases, and plain versions of what the operators compute."""

import random
import re
from collections import Counter

from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def texts(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvéñü", k=rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=50))
    out = []
    for k in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 9, 34, 35, 36, 60, 120, 300]))
        text = " ".join(words)
        if k % 7 == 3 and out:
            text = out[rng.randrange(len(out))]
        elif k % 7 == 5 and out:
            source = WORDS.findall(out[-1]) or ["x"]
            source[rng.randrange(len(source))] = "changed"
            text = " ".join(source)
        elif k % 6 == 1:
            text = f"{text} {passage}\n{text[:40]}"
        out.append(text.capitalize())
    out += ["a b " * 60, "\t\n", "!!! ???", "x y z", "It's <|im_end|> & it's", "漢字 かな 🙂 ok", "w " * 3000]
    return out


def documents(spark, extra=True):
    rows = [(k * 3, t, "en" if k % 2 else "fr", f"s{k % 4}", len(t)) for k, t in enumerate(texts())]
    if extra:
        rows += [(1000, None, None, None, None), (None, "some text without an id that is long enough", "en", "s1", 43), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORDS.findall(text or "")


def shingles(text, size=5, lower=True):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def removed_words(all_texts, length=35):
    """Per text a list of flags: covered by a window whose words also start elsewhere."""
    lists = [words(t) for t in all_texts]
    seen = Counter(tuple(w[i : i + length]) for w in lists for i in range(len(w) - length + 1))
    flags = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        flags.append(gone)
    return flags


def link_components(ids, all_texts, up=75, down=100):
    sets = [shingles(t) for t in all_texts]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both * down >= up * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(x for x in (least.get(find(k)), i) if x is not None) if (least.get(find(k)), i) != (None, None) else None
    return [least[find(k)] for k in range(len(ids))], [len(s) for s in sets]
