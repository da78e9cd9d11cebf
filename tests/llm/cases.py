"""A small table of documents with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string"


def documents() -> list[tuple]:
    """Prose, exact and near copies, shared passages, null, empty and very long texts, repeated rows, clashing columns."""
    draw = random.Random(5)
    vocabulary = ["the", "of", "and"] + ["".join(draw.choices("abcdefghijklmnopé", k=draw.randint(2, 9))) for _ in range(800)]

    def prose(n: int) -> list[str]:
        return [draw.choice(vocabulary[:3] if draw.random() < 0.3 else vocabulary) for _ in range(n)]

    base = [prose(draw.randint(30, 200)) for _ in range(24)]
    passage = prose(60)
    texts: list = [" ".join(w) for w in base]
    texts += [texts[0], texts[0], texts[1].replace(" ", "\n"), texts[2].upper(), texts[3] + " "]
    for k in (1, 2, 4, 12):
        for w in base[:6]:
            copy = list(w)
            for i in draw.sample(range(len(copy)), min(k, len(copy))):
                copy[i] = draw.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(prose(20) + passage + prose(25)) for _ in range(4)] + [" ".join(passage[:13]), " ".join(passage[:12])]
    texts += [None, "", None, " \n\t ", "one", "one two", "One TWO", "!!! ???", "12 34", "x" * 3000, " ".join(prose(6000)), "a" + " b c \x1c d", "<|endoftext|> it's WE'LL <|x", "日本語 テキスト 😀 ① ﬁ"]
    ids = draw.sample(range(1, 10_000), len(texts))
    rows = [(i, t, draw.choice(["en", "fr", None]), "s", 0 if t is None else len(t), "k", "z") for i, t in zip(ids, texts)]
    return rows + [rows[0], rows[7]]


def removed(rows: list[tuple], window: int = 13) -> dict:
    first: dict = {}
    words = {i: (t or "").encode().split() for i, t, *_ in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, ws in words.items():
        keep = [True] * len(ws)
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        left = [w for w, x in zip(ws, keep) if x]
        out[i] = (len(ws), len(ws) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def shingles(text: str | None, size: int) -> frozenset:
    ws = (text or "").encode().lower().split()
    if len(ws) < size:
        return frozenset([tuple(ws)] if ws else [])
    return frozenset(zip(*(ws[j:] for j in range(size))))


def linked(rows: list[tuple], size: int, percent: int) -> dict:
    """id -> (n_shingles, component, kept) by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            common.update((j, i) for j in holders[g])
            holders[g].append(i)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
