"""Plain Python versions of the corpus operators, for small tables; they share no code with them but the fitted trees."""

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return SPACED.findall(text or "")


def good(text):
    """Six rules, none of which may fail."""
    ws, text = words(text), text or ""
    n = len(ws)
    windows = [tuple(ws[i : i + 5]) for i in range(n - 4)]
    times = Counter(windows)
    again = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    chars = sum(map(len, ws))
    return not (
        n < 10
        or 100 * len(again) > 20 * n
        or 100 * sum(c in "#*$%&|<>" for c in text) > 20 * n
        or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
        or chars < 2 * n
        or chars > 15 * n
        or 100 * sum("A" <= c <= "Z" for c in text) > 50 * chars
    )


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def classes(rows):
    """The smallest linked id per id, by comparing all pairs of shingle sets."""
    sets = {}
    for i, text in rows:
        ws = words(fold(text))
        n = min(5, len(ws))
        sets[i] = {tuple(ws[s : s + n]) for s in range(len(ws) - n + 1)} if ws else set()
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= 75 * (len(x) + len(y) - common):
                    low, high = sorted((top(a), top(b)))
                    label[high] = low
    return {i: top(i) for i in ids}


def hits(text, items):
    """Words, hit positions and items by plain search; items are (id, text)."""
    fold_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    ws, hit, found = fold_words(text), set(), set()
    for item, own in items:
        own = fold_words(own)
        n = min(10, len(own))
        windows = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if own else set()
        for s in range(len(ws) - n + 1) if windows else ():
            if tuple(ws[s : s + n]) in windows:
                hit.update(range(s, s + n))
                found.add(item)
    return len(ws), hit, sorted(found)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), kind, m.end()))
    return out


def all_spans(text, pii):
    """Base spans, and candidates that the fitted trees score above their threshold, by numpy instead of Columns."""
    import numpy as np

    base = base_spans(text)
    found = list(base)
    for kind, (_, pattern) in pii.GENERATORS.items():
        trees, cut = pii.models()[kind]
        for m in re.finditer(pattern, text, re.ASCII):
            if any(s < m.end() and m.start() < e for s, _, e in base):
                continue
            own = pii.features_of(m[0], text[max(0, m.start() - pii.CONTEXT_CHARS) : m.start()], text[m.end() : m.end() + pii.AFTER_CHARS])
            if trees.scores(np.array([own]))[0] > cut:
                found.append((m.start(), kind, m.end()))
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[1]), x[2]))


def redacted(text, pii):
    out, at = [], 0
    for s, kind, e in all_spans(text or "", pii):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return text if not out else "".join(out) + text[at:]


def mixed(rows):
    """Words taken per row of (id, source, text): copies of whole sources, then the documents with the smallest keys."""
    size = [len(words(t)) for _, _, t in rows]
    total = Counter()
    for (_, source, _), n in zip(rows, size, strict=True):
        total[source] += n
    order = sorted(total, key=lambda x: (x is None, x or ""))
    weight = {x: (5.0, 2.0, 1.0)[i % 3] for i, x in enumerate(order)}
    left, open_, target = 1.5 * sum(size), set(order), {}
    while open_:  # sources that would get more than twice their size are filled, and the rest is shared again
        level = left / sum(weight[x] for x in open_)
        full = [x for x in open_ if 2 * total[x] <= level * weight[x]]
        for x in full or list(open_):
            target[x] = 2.0 * total[x] if full else level * weight[x]
            left -= target[x]
            open_.remove(x)
    key = [hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15] for i, _, _ in rows]
    taken = [0] * len(rows)
    for source in order:
        copies = min(2, int(target[source] // total[source])) if total[source] else 0
        budget = target[source] - copies * total[source]
        mine = [k for k, r in enumerate(rows) if r[1] == source]
        for at in sorted({key[k] for k in mine}):
            same = [k for k in mine if key[k] == at]
            n = sum(size[k] for k in same)
            for k in same:
                more = 0 if copies >= 2 or n == 0 or budget <= 0 else size[k] if n <= budget else int(budget * size[k] // n)
                taken[k] = copies * size[k] + more
            budget -= n
    return taken, target
