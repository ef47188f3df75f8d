"""Small tables with every awkward row, and brute-force versions."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, tag string, hit_items string"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()) + str(rng.randrange(40)) for _ in range(n)]


def documents(seed=3, n=60):
    """Plain texts, near copies, exact copies (case aside), and rows with nulls, nothing, ties and repeats."""
    rng = random.Random(seed)
    base = words(rng, 60)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 80)))) for i in range(n)]
    for k in range(25):
        w = list(base)
        for _ in range(k % 5):
            w[rng.randrange(60)] = f"edit{rng.randrange(99)}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, "Same TEXT again".upper() if k % 2 else "same text again") for k in range(6)]
    rows += [(3000, None), (3001, ""), (3002, "   \n\t"), (None, "no id at all here"), (None, None), (3003, "twice the row"), (3003, "twice the row"), (3003, "another text under one id"), (3004, "x" * 5000), (3005, "one two"), (3006, "one two"), (3007, " ".join(words(rng, 12_000)))]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, "clash", "clash", "clash") for i, t in rows], SCHEMA).repartition(3)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def jaccard_components(rows, n, num, den):
    """(doc_id, n_shingles, component_id) of every row, from all pairs."""
    return Counter(jaccard_rows(rows, n, num, den))


def jaccard_rows(rows, n, num, den):
    """The same, row by row."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split("[ \t-\r]+", lower(text)) if x]
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), lab in zip(rows, label, strict=True):
        least[lab] = min((x for x in (least.get(lab), i) if x is not None), default=None)
    return [(i, len(s), least[lab]) for (i, _), s, lab in zip(rows, sets, label, strict=True)]
