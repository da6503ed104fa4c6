"""Small tables and plain restatements that the operators are held against."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows, schema=DOCS, folder=None):
    """A table read from files, as places must be those of a scan."""
    made = spark.createDataFrame(rows, schema)
    if folder is None:
        return made
    made.repartition(3).write.mode("overwrite").parquet(str(folder))
    return spark.read.parquet(str(folder))


def corpus(seed=1, n=60, copies=12):
    """Documents with copies, near copies, shared passages, ties, nulls and texts from none to long."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgilmnorstuéß") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = prose(90)
    texts = [prose(rng.choice([5, 40, 120, 300])) for _ in range(n)]
    texts += [texts[0]] * copies
    for _ in range(copies):
        w = texts[1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [prose(20) + "\n" + passage + "\t" + prose(20) for _ in range(copies)]
    texts += [passage * 2, passage + " " + passage, "", " \n ", "one", "two words", "ab " * 700, "x" * 1500, prose(5000)]
    rows = [(k, t, rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3/x", "s3/y"]), len(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(len(rows), None, None, None, None), (None, passage, "en", "s1", 3), (None, None, None, "s9", None), rows[3], rows[3]]
    return rows
