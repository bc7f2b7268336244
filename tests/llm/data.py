"""Small documents with the awkward cases: nulls, empty and long texts, copies, near copies,
repeated rows, columns whose names clash with the operators' own."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count int, key string, rank int, label string"


def texts(n=40, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    word = lambda: rng.choice(vocab)
    sentence = lambda: " ".join(word() for _ in range(rng.randint(5, 12))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(8))
    line = "  The same line stands here in many texts  "
    out = []
    for i in range(n):
        t = "\n".join(" ".join(sentence() for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(2, 6)))
        if i % 7 == 3:
            t += "\n" + passage
        if i % 5 == 1:
            t += "\n" + line.upper() + "\n" + t[:30]
        out.append(t)
    for i in range(0, 12, 2):
        words = out[i].split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    out += [out[1], out[1].upper(), out[2], None, "", "   \n\t", "a", "é", "ab ab", "ab ab ab " * 700, "x" * 5000, "word " * 9000, "\n\n\n", "a\0b" * 200]
    return out


def rows():
    t = texts()
    out = [(3 * i, x, "en" if i % 3 else None, "s", len(x or ""), 1, "k", 2, "l") for i, x in enumerate(t)]
    return out + [out[1], out[5]]


def frame(spark, partitions=3, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(partitions)
