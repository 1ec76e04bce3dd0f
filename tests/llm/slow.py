"""Slow versions of what SQL cannot express, for the tests."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np

from millrace.llm.language_id import PROFILE


def grams(text):
    """N-grams of one to three characters as numbers, word boundaries as 1."""
    words, word = [], ""
    for c in text.lower():
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    words += [word] if word else []
    if not words:
        return Counter()
    s = [1, *(ord(c) for w in words for c in w + "\1")]
    found = Counter(c for c in s if c != 1)
    found.update((a << 21) | b for a, b in zip(s, s[1:], strict=False))
    found.update((a << 42) | (b << 21) | c for a, b, c in zip(s, s[1:], s[2:], strict=False) if b != 1)
    return found


def ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:PROFILE]


def learned(rows):
    """Profiles by language from (text, lang)."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        if text is not None and lang is not None:
            counts[lang] += grams(text)
    return {lang: ranked(c) for lang, c in counts.items() if c}


def language(text, profiles):
    own = ranked(grams(text or ""))
    if not own or not profiles:
        return "und", 0.0
    best = None
    for lang in sorted(profiles):
        place = {g: i for i, g in enumerate(profiles[lang])}
        distance = sum(min(PROFILE, abs(place[g] - i)) if g in place else PROFILE for i, g in enumerate(own))
        if best is None or distance < best[0]:
            best = distance, lang
    return best[1], 1.0 - best[0] / (PROFILE * len(own))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def pieces(tokenizer, doc_id, text, capacity=2048):
    """(doc_id, piece, start, length, crc) of a document's ids and the end mark."""
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    for at in range(0, len(ids), capacity):
        part = np.array(ids[at : at + capacity], "<u4").tobytes()
        yield doc_id, at // capacity, at, len(part) // 4, zlib.crc32(part)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check_places(rows, capacity=2048):
    """Sequences without gaps, of at most ``capacity`` tokens; returns how many there are."""
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= capacity
    return len(ends)
