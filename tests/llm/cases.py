"""Small inputs with everything that can be odd, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Names that operators use for columns of their own.
CLASHING = "n long, v long, words string, kept string, place int, token long, n_words string, first long, c int, sha int"


def frame(spark, rows, kind="doc_id long, text string", clash=True):
    """Rows of two columns, with other columns whose names could clash."""
    df = spark.createDataFrame(rows, kind)
    if clash:
        extra = [f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in CLASHING.split(", ")]
        df = df.selectExpr(*extra, *df.columns)
    return df


def words(text):
    return WORD.findall(text or "")


def documents(seed=1, n=60):
    """Texts of few words, so that sequences repeat, with copies, near copies and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "dé", "e,", "f.", "ÿ", "日本"]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 7, 12, 25, 40]))) for _ in range(n)]
    for i in range(0, n, 5):
        made[i] = made[rng.randrange(n)]
    for i in range(1, n, 7):
        mine = made[rng.randrange(n)].split(" ")
        mine[rng.randrange(len(mine))] = "new"
        made[i] = " ".join(mine)
    rows = [(i * 3, t) for i, t in enumerate(made)]
    long = " ".join(rng.choice(vocabulary) for _ in range(20_000))
    rows += [(1000, None), (1001, ""), (1002, " \n\t\x0b "), (1003, long), (1004, long + " end"),
             (1005, "x" * 50_000), rows[3], rows[10], (None, rows[3][1]), (None, None),
             (2000, rows[7][1].replace(" ", " \n ")), (2001, "one\x1ctwo three")]
    rng.shuffle(rows)
    return rows


def removed(rows, window):
    """(id, words, words removed, hash of the rest) by comparing every window."""
    first = {}
    for doc_id, text in rows:
        w = words(text)
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i:i + window])] < doc_id:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(rows, percent=75):
    """(id, shingles, smallest id reached) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    reach = {doc_id: doc_id for doc_id, _ in rows if doc_id is not None}

    def root(x):
        while reach[x] != x:
            x = reach[x]
        return x

    live = [i for i, (doc_id, _) in enumerate(rows) if doc_id is not None and sets[i]]
    for i in live:
        for j in live:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                reach[b] = a
    return [(doc_id, len(s), None if doc_id is None else root(doc_id) if s else doc_id)
            for (doc_id, _), s in zip(rows, sets)]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def ordered(rows):
    return sorted(rows, key=repr)
