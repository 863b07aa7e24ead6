"""Plain versions of the contracts, on the driver, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

SPACES = r"[^\x20\x09-\x0D]+"


def held_out(key, parts, part):
    return key is not None and zlib.crc32(str(key).encode()) % parts == part


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text: str | None, words: int = 4) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(SPACES, lower)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def components(ids, linked) -> dict:
    """Smallest id reachable; linked(a, b) over all pairs."""
    ids = sorted(set(ids))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def _luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (2 if n % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    digits = lambda v: re.sub("[^0-9]", "", v)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and _luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    ]
    return _spans(text, rules)


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    assign = (
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    out = []
    for m in re.finditer(assign, text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    rest = [
        ("access", r"AKIA[A-Z0-9]+", lambda v: len(v) >= 20),
        ("hex", r"[0-9a-f]+", lambda v: len(v) >= 24),
    ]
    for rank, (kind, pattern, keep) in enumerate(rest, 1):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if keep(m.group())]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def _spans(text, rules):
    out = []
    for rank, (kind, pattern, keep) in enumerate(rules):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if keep(m.group())]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shingle_set(text: str | None, words: int = 5) -> set[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(SPACES, lower)
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def groups(pairs) -> dict:
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out


def spelled(rows) -> dict[str, int]:
    """Words and their counts from (doc_id, text)."""
    out = defaultdict(int)
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 7:
                out[word] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[at:] == b[at + 1 :] or (len(a) == len(b) and a[at + 1 :] == b[at + 1 :])


def variants(words: dict[str, int]) -> dict[str, tuple]:
    """word -> (form, root, n, n_near, form_n); pairs meet under what is left without one letter."""
    holes = defaultdict(set)
    for w in words:
        for hole in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            holes[hole].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out
