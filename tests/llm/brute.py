"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib


def repeats(docs: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a dictionary of all strings of `length` bytes."""
    top = 2**63 - 1
    first: dict[bytes, int] = {}
    raw = [(top if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for at in range(len(b) - length + 1):
            w = b[at:at + length]
            if first.get(w, top) > i or w not in first:
                first[w] = min(i, first.get(w, top))
    out = []
    for (own, _), (i, b) in zip(docs, raw):
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if first[b[at:at + length]] < i:
                gone[at:at + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sentences(text: str) -> list[tuple[tuple[str, ...], int, int]]:
    """(words in lower case, where they start, where the next sentence starts) of each sentence."""
    found, held = [], []
    for line in re.finditer(r"[^\n]+", text):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", line[0]))
        for k, word in enumerate(words):
            held.append((word[0], line.start() + word.start()))
            low = word[0].lower().encode("utf-8", "surrogatepass")
            if word[0][-1] in ".!?…。！？" or zlib.crc32(low) % 8 == 0 or k == len(words) - 1:
                found.append(held)
                held = []
    starts = [s[0][1] for s in found] + [len(text)]
    return [(tuple(w.lower() for w, _ in s), starts[i], starts[i + 1]) for i, s in enumerate(found)]


def without_repeated_runs(docs: list[tuple[int | None, str | None]], least: int = 3, words: int = 15) -> list[tuple]:
    """(doc_id, text, words removed): of all runs of `least` sentences and `words` words or more that a smaller document
    has, or that stand further left in the same text, all sentences go. Runs of up to ten times that are looked at."""
    top = 2**63 - 1
    first: dict[tuple, int] = {}
    cut = [(top if i is None else i, sentences(t or "")) for i, t in docs]

    def runs(parts):
        for a in range(len(parts)):
            n, run = 0, ()
            for b in range(a, min(len(parts), a + 10 * least)):
                n, run = n + len(parts[b][0]), (*run, parts[b][0])
                if b - a + 1 >= least and n >= words:
                    yield a, b + 1, hash(run)

    for i, parts in cut:
        for _, _, run in runs(parts):
            first[run] = min(i, first.get(run, top))
    out = []
    for (own, text), (i, parts) in zip(docs, cut):
        gone, seen = [False] * len(parts), set()
        for a, b, run in runs(parts):
            if first[run] < i or run in seen:
                gone[a:b] = [True] * (b - a)
            seen.add(run)
        if not any(gone):
            out.append((own, text, 0))
            continue
        kept = text[:parts[0][1]] + "".join(text[s:e] for (_, s, e), g in zip(parts, gone) if not g)
        out.append((own, kept.rstrip(" \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85\xa0"), sum(len(w) for (w, _, _), g in zip(parts, gone) if g)))
    return out
