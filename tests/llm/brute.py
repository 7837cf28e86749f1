"""Plain restatements of what the operators promise, row by row."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

EDGE_TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "two words",
    "a b c d e f g h i j a b c d e f g h i j",
    "\x1codd\x1f sep arated   wide",
    "line\nline\n\nline\n other\n",
    "Repeat Repeat repeat",
    "Repeat repeat Repeat",
    "tail space ",
    " lead space",
    "double  space and\n newline \n mix",
    "don't can't I'll we've",
    "number 12345 and #tags *** $$$ <b>|x|</b> 100%",
    "emoji \U0001f600 café naïve 中文",
    "<|endoftext|> inside <|endoftext|>text",
    "x" * 3000,
    ("word " * 3000).strip(),
]


def words(text):
    return WORD.findall(text or "")


def stats(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = {}
    for x in windows:
        times[x] = times.get(x, 0) + 1
    covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def fingerprint(text, width=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_ids(ids, prints, radius=3):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def substring_dedup(rows, width=20):
    """rows: (doc_id, text) with distinct ids; what op3 returns for each."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            if x in seen:
                gone |= set(range(i, i + width))
            seen.add(x)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
