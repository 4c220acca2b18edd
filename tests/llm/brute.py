"""Plain, slow definitions of what the operators must return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows(text):
    w = words(text)
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def hits(texts, items):
    """Per text: number of words, hit word places, names of items."""
    known = defaultdict(set)
    for name, text in items:
        for window in windows(text):
            known[window].add(name)
    widths = {len(w) for w in known}
    out = []
    for text in texts:
        w, places, names = words(text), set(), set()
        for k in widths:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in known:
                    places |= set(range(i, i + k))
                    names |= known[tuple(w[i : i + k])]
        out.append((len(w), places, names))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pii_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def secret_spans(text):
    text = text or ""
    out = []
    pattern = r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for m in re.finditer(pattern, text):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 18:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m.group()) >= 16:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


def written(spans, names):
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def component_ids(ids, prints, bits=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    smallest = {}
    for i, x in enumerate(ids):
        r = find(i)
        smallest[r] = min(smallest.get(r, x), x)
    return [smallest[find(i)] for i in range(len(ids))]


def drop_lines(rows, min_length=40, min_docs=5):
    """rows: (id, text).  Returns per row: lines, dropped, kept text."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(WHITE).translate(LOWER)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(WHITE).translate(LOWER)
            if len(key) < min_length or len(holders[key]) < min_docs or max(holders[key]) == i:
                kept.append(line)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def jump(key, shards):
    shard, following = -1, 0
    while following < shards:
        shard = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((shard + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return shard


def best_fit_decreasing(lengths, capacity):
    import bisect

    free, bins = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, length)
        room = free.pop(at) if at < len(free) else capacity
        bins += room == capacity
        bisect.insort(free, room - length)
    return bins


def damage(rows):
    """rows: (conv_id, turn, role, text)."""
    out = []
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(c, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest_edits(rows):
    """rows: (role, text, fault).  Least (cost, letters) with the lines that they leave."""
    order = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}

    def due(state):
        return "a" if state == "u" else "u"

    def inserted(live):
        for _ in range(2):
            for state, (cost, letters, lines) in list(live.items()):
                to = due(state)
                new = (cost + 5, letters + "I", [*lines, f"{name[to]}:"])
                live[to] = min(live.get(to, new), new)
        return live

    live = {"": (0, "", [])}
    for role, text, fault in rows:
        after = {}
        for state, (cost, letters, lines) in inserted(live).items():
            moves = [(state, (cost + 2, letters + "D", lines))]
            if fault not in ("blank", "duplicate"):
                cost += 5 * (fault == "truncated")
                if (state, role[:1]) in order:
                    moves.append((role[:1], (cost, letters + "K", [*lines, f"{role}:{text}"])))
                moves.append((due(state), (cost + 1, letters + "R", [*lines, f"{name[due(state)]}:{text}"])))
            for to, new in moves:
                after[to] = min(after.get(to, new), new)
        live = after
    live = inserted(live)
    return min(live[s] for s in ("", "a") if s in live)


def repair(rows, damaged):
    """rows, damaged: (conv_id, turn, role, text).  Per conversation what the query returns."""
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in damaged if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults, turns = set(), [], {r[0] for r in own} - {None}
        for _, role, text in own:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append((role, text, fault))
        cost, letters, lines = cheapest_edits(faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        counts = [sum(f[2] == kind for f in faults) for kind in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[c] = (gaps, *counts, illegal, cost, letters, sha("\n".join(lines)))
    return out


def rebuilt(rows):
    """rows: (conv_id, turn, role, text).  Per conversation its list of (role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 4
        base = None if c is None else c - c % 20
        out[c] = own.get(base, [])[:h] + turns[h:] if c is not None else turns[h:]
    return out


def prefix_trie(sequences):
    """sequences: {id: list of (role, text)}.  The nodes, as the query returns them."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)

    def smallest(ids):
        return min((i for i in ids if i is not None), default=None)

    total, leaves, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        total[node] += (len(members[node]) - 1) * words
        leaves[node] = leaves[node] or 1
        if node:
            for sums, more in ((total, total[node]), (leaves, leaves[node]), (children, 1)):
                sums[node[:-1]] += more
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if c is not None and len(sequences[c]) == len(node))))
        parent = smallest(members[node[:-1]]) if node else None
        out.append((smallest(ids), len(node), parent, len(ids), children[node], leaves[node], total[node], sha(ends)))
    return out
