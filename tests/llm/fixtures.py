"""Small documents with awkward rows, and brute-force versions to compare with."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def corpus(seed=0, n=60):
    """Random texts that share passages, with exact and near copies, runs, long and odd texts."""
    rng = random.Random(seed)
    vocab = ["the", "of", "a", *("".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 8))) for _ in range(300))]

    def say(k):
        return [rng.choice(vocab) for _ in range(k)]

    shared = [say(rng.randint(14, 70)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = say(rng.randint(0, 120))
        if rng.random() < 0.5:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        if rng.random() < 0.3 and rows:
            w = (rng.choice(rows)[1] or "").split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "Changed"
        text = "".join(x + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)
        rows.append((i, text, rng.choice(["en", "de"]), f"src{rng.randint(0, 3)}", len(text)))
    run = " ".join(["same"] * 40)
    rows += [(n, run, "en", "src0", 0), (n + 1, run + " same same end", "en", "src0", 0), (n + 2, "x" * 300, "en", "src0", 0),
             (n + 3, "y" + "x" * 200 + "y", "en", "src0", 0), (n + 4, "", "en", "src0", 0), (n + 5, None, None, None, None),
             (n + 6, " \n\t ", "en", None, 0), (n + 7, rows[5][1], "en", "src1", 0), (n + 7, rows[5][1], "en", "src1", 0),
             (None, rows[7][1], "en", "src1", 0), (None, "only here " * 30, "en", "src1", 0),
             (n + 8, " ".join(say(3000)), "en", "src0", 0)]
    rng.shuffle(rows)
    return rows


def rank(doc_id):
    return (doc_id is None, doc_id or 0)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
