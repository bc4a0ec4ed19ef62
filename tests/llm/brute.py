"""The results of the operators by plain, slow code, for small tables of (doc_id, text, source)."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small_letters(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def simhash(text: str | None) -> int:
    words = WORD.findall(small_letters(text or ""))
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows):
    """Rows of (doc_id, fingerprint, component_id)."""
    prints = [simhash(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for k, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(least.get(root(k), doc), doc)
    return [(doc, f"{prints[k]:016x}", least.get(root(k))) for k, (doc, _, _) in enumerate(rows)]


def pieces(rows, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out = []
    for doc, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            out.append((doc, k, a, b - a, zlib.crc32(b"".join(struct.pack("<I", i) for i in ids[a:b]))))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_data(text: str | None):
    """Counts and base spans as listed: by kind, then start."""
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    counts = Counter(kind for kind, _, _ in found)
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return tuple(counts[k] for k in ("email", "ip", "card", "phone")), sha(listed), listed


def repeated_bytes(rows):
    places = defaultdict(int)
    texts = [(doc, (t or "").encode()) for doc, t, _ in rows]
    for _, data in texts:
        for i in range(len(data) - 199):
            places[data[i: i + 200]] += 1
    out = []
    for doc, data in texts:
        removed = bytearray(len(data))
        for i in range(len(data) - 199):
            if places[data[i: i + 200]] > 1:
                removed[i: i + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(removed)))
        kept = bytes(b for b, r in zip(data, removed) if not r)
        out.append((doc, len(data), sum(removed), spans, sha(kept)))
    return out


def repeated_words(rows):
    """Null ids come last, and equal ids lose nothing to each other."""
    least = {}
    texts = [(doc, WORD.findall(t or "")) for doc, t, _ in rows]
    order = [float("inf") if doc is None else doc for doc, _ in texts]
    for rank, (_, words) in zip(order, texts):
        for i in range(len(words) - 49):
            key = tuple(words[i: i + 50])
            least[key] = min(least.get(key, rank), rank)
    out = []
    for rank, (doc, words) in zip(order, texts):
        removed = set()
        for i in range(len(words) - 49):
            if least[tuple(words[i: i + 50])] < rank:
                removed.update(range(i, i + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in removed)
        out.append((doc, len(words), len(removed), sha(kept)))
    return out


def exact_duplicates(rows):
    """Rows of (doc_id, keep_id, group_size, text_sha256), and how many rows stay in each group."""
    groups = defaultdict(list)
    for doc, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), sha(norm)) for m in members]
    return out, len(groups)


PHRASES = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}


def license_base(text: str | None):
    """(n_words, n_base, first_word, last_word, base_labels)."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small_letters(text or ""))
    places = []
    for phrase, label in PHRASES.items():
        sought = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i: i + len(sought)] == sought]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def quality(text: str | None):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, longest_repeat, base_failed)."""
    text = text or ""
    words = WORD.findall(text)

    def covered(size):
        windows = Counter(tuple(words[i: i + size]) for i in range(len(words) - size + 1))
        marked = set()
        for i in range(len(words) - size + 1):
            if windows[tuple(words[i: i + size])] > 1:
                marked.update(range(i, i + size))
        return len(marked)

    longest = 0
    while len({tuple(words[i: i + longest + 1]) for i in range(len(words) - longest)}) < len(words) - longest:
        longest += 1
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    triples = covered(3)
    failed = len(words) < 50 or 100 * triples > 50 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, triples,
        covered(8), longest, failed,
    )


def good(text: str | None) -> bool:
    """The verdict of the quality rules with their production settings."""
    words, *_, covered, longest, failed = quality(text)
    return not failed and covered <= max(0.2 * words, 40) and longest <= max(0.2 * words, 20)
