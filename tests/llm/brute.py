"""Plain versions of the operators, for small tables in memory."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

from tokenizers import Tokenizer

from faultline.llm.encoding import library_path


def archives(pages):
    """``(page_id, html) -> (bytes, digest, type, refers to)``."""
    groups = defaultdict(list)
    for page_id, html in pages:
        groups[html or ""].append(page_id)
    out = []
    for page_id, html in pages:
        raw = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        last = max(ids) if ids else page_id
        revisit = page_id != last
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return out


def shingles(text, size=5):
    words = text.split()
    return Counter(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))) if words else Counter()


def probability_jaccard(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys())
    return total


def classes(docs, similarity=0.8):
    """``doc_id -> smallest id connected by copies and similar pairs``."""
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first, sets, by_shingle = {}, {}, defaultdict(list)
    for d, t in sorted(docs):
        if t in first:
            parent[root(d)] = root(first[t])
            continue
        first[t], sets[d] = d, shingles(t)
        for s in sets[d]:
            by_shingle[s].append(d)
    pairs = {(a, b) for ids in by_shingle.values() for i, a in enumerate(ids) for b in ids[:i]}
    for a, b in pairs:
        if sum((sets[a] & sets[b]).values()) * 3 > max(sum(sets[a].values()), sum(sets[b].values())) and probability_jaccard(sets[a], sets[b]) >= similarity:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d, _ in docs}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def token_ids(name, texts):
    tokenizer = Tokenizer.from_file(library_path(name))
    return [e.ids for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


UNIT = re.compile(r"(?:[^ \t\r\n]*[^ \t\r\n.!?][ \t]+){0,7}[^ \t\r\n]+")


def lanes(text):
    v = [0] * 128
    for unit in UNIT.findall(text):
        digest = hashlib.md5(unit.encode()).hexdigest()
        for j in range(4):
            word = int(digest[8 * j : 8 * j + 8], 16)
            for i in range(32):
                v[32 * j + i] += 1 if word >> i & 1 else -1
    return v


def fingerprints(docs):
    """Rows of the fingerprint query for ``(doc_id, text)`` with different ids."""
    docs = sorted((d, t or "") for d, t in docs)
    out = []
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        a, b, c = lanes(t), lanes(edited), lanes(following)
        text = lambda v: "".join(f"{x % 65536:04x}" for x in v)

        def like(x, y):
            both = sum(p * p for p in x) + sum(p * p for p in y)
            if x == y:
                return 1.0
            return min(max(2.0 * sum(p * q for p, q in zip(x, y)) / both, 0.0), 1.0) if both else 0.0

        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), like(a, b), like(a, c)))
    return out


def fill_in_middle(doc_id, text, seed=42):
    """``(n, form, prefix chars, middle chars, output)`` by slices of the list of tokens."""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def vector_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """``(vec_id, label, vector)`` to ``(vec_id, label, code, error)`` and the codebooks, entry by entry."""
    import math

    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    smallest = {}
    for i, _, v in kept:
        if i is not None:
            smallest[i] = min(v, smallest.get(i, v))
    books = [[smallest[i][p * width : (p + 1) * width] for i in sorted(smallest)[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, _, v in kept:
                x = v[p * width : (p + 1) * width]
                members[near(p, x)[1]].append(x)
            for e, found in members.items():
                books[p][e] = [sum(c) // len(found) for c in zip(*found)]
    out = []
    for i, label, v in kept:
        best = [near(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, books


def gram_buckets(text, sizes, most):
    """Buckets of the n-grams of each word with its spaces, one n-gram after another."""
    out, full = set(), (1 << 64) - 1
    for word in set(text.lower().split()):
        padded = f" {word} "
        for n in sizes:
            for gram in {padded[i : i + n] for i in range(len(padded) - n + 1)}:
                x = 0
                for c in gram:
                    x = (x * 0x100000001B3 + ord(c)) & full
                x = (x + n) & full
                x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
                x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
                out.add((x ^ (x >> 31)) % most)
    return sorted(out)


def pattern_scores(marks, least_score, least_instances, own_vote, least_belief):
    """Scores of patterns by rounds over dictionaries, until nothing rises."""
    import math

    seeds = {m["instance"] for m in marks if m["kind"] is not None}
    instances = defaultdict(set)
    for m in marks:
        for p in m["patterns"]:
            instances[p].add(m["instance"])
    instances = {p: s for p, s in instances.items() if len(s) >= least_instances}
    voter = {p: p.split(" ")[-1].lstrip("<") for p in instances}
    around = defaultdict(list)
    for p, members in instances.items():
        for i in members - seeds:
            around[i].append(p)
    score = {}
    for _ in range(500):
        beliefs = defaultdict(float)
        for i, patterns in around.items():
            best = {}
            for p in patterns:
                if score.get(p, 0) >= least_score:
                    best[voter[p]] = max(best.get(voter[p], 0), score[p])
            doubt = {v: math.log(1 - min(s, 0.999999)) for v, s in best.items()}
            for p in patterns:
                belief = max(1 - math.exp(sum(doubt.values()) - doubt.get(voter[p], 0)), 0)
                beliefs[p] += 1.0 if belief >= least_belief else belief
        new = {}
        for p, members in instances.items():
            mean = (len(members & seeds) + beliefs[p]) / len(members)
            new[p] = mean / (1 - (1 - mean) * own_vote)
        done = score and max(new[p] - score[p] for p in new) <= 1e-6
        score = new
        if done:
            break
    return {p: s for p, s in score.items() if s >= least_score}
