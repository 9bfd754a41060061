"""Plain versions of the contracts, one document after the other, for small inputs."""

import hashlib
import itertools
import re
from collections import defaultdict

import xxhash

WS_WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def pii(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def fingerprint(text):
    words = WS_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(docs):
    fps = {i: fingerprint(t) for i, t in docs}
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    distinct = defaultdict(list)
    for i, f in fps.items():
        distinct[f].append(i)
    values = list(distinct)
    for a, f in enumerate(values):
        for i in distinct[f]:
            parent[root(i)] = root(distinct[f][0])
        for g in values[:a]:
            if (f ^ g).bit_count() <= 2:
                parent[root(distinct[g][0])] = root(distinct[f][0])
    least = {}
    for i in fps:
        least[root(i)] = min(i, least.get(root(i), i))
    return {i: (f"{fps[i]:016x}", least[root(i)]) for i in fps}


def decontaminate(docs, items):
    words_of = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        if w:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for i, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def near_items(text, items, slop=7, share=0.75):
    """Items of which a phrase has most of its different words among as many words of the text as it is long, plus slop."""
    words, found = (text or "").translate(LOWER).split(), set()
    for item, body in items:
        w = body.split()
        n = min(13, len(w))
        for i in {*range(0, len(w) - n + 1, n), len(w) - n}:
            wanted, reach = set(w[i : i + n]), n + slop
            if any(4 * len(wanted & set(words[s : s + reach])) >= 3 * len(wanted) for s in range(len(words))):
                found.add(str(item))
    return found


def remove_repeats(docs, size=35):
    words = {i: WS_WORD.findall(t or "") for i, t in docs}
    seen = defaultdict(int)
    for w in words.values():
        for s in range(len(w) - size + 1):
            seen[tuple(w[s : s + size])] += 1
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - size + 1):
            if seen[tuple(w[s : s + size])] > 1:
                gone.update(range(s, s + size))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def deduplicate(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    return {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


def mix_targets(sizes):
    """Sharing by rounds: what is above a source's bound goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over
    return target


def spelling_variants(docs):
    """All pairs of words through their letters, one by one."""
    import zlib

    n = defaultdict(int)
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    places = defaultdict(set)  # a word with one letter taken out, where, and whether it was taken out
    for w in n:
        places[w, None].add(w)
        for k in range(len(w)):
            places[w[:k] + w[k + 1 :], k].add(w)
    near = {w: set() for w in n}
    for (rest, k), found in places.items():
        for w in found:
            near[w] |= found - {w}
            if k is not None and rest in n:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o.encode()), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], form[w], root, len(near[w]), n.get(form[w]))
    return out


def cross_align(docs, a_path, b_path):
    """Whole texts by the libraries, ends by sums, groups by sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_model.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte, extra = {chr(b): b for b in keep}, 256
    for b in range(256):
        if b not in keep:
            to_byte[chr(extra)] = b
            extra += 1
    rows = []
    for i, text in docs:
        groups = []
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            a_bytes = [bytes(to_byte[c] for c in a_model.id_to_token(x)) for x in a]
            b_bytes = [bytes([int(b_model.id_to_piece(x)[3:5], 16)]) if b_model.is_byte(x) else b_model.id_to_piece(x).replace("\u2581", " ").encode() for x in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a_ends, b_ends = (list(itertools.accumulate(map(len, tokens))) for tokens in (a_bytes, b_bytes))
                common, at_a, at_b = sorted(set(a_ends) & set(b_ends)), 0, 0
                for e in common:
                    group = ([], [])
                    while at_a < len(a) and a_ends[at_a] <= e:
                        group[0].append(a[at_a])
                        at_a += 1
                    while at_b < len(b) and b_ends[at_b] <= e:
                        group[1].append(b[at_b])
                        at_b += 1
                    groups.append(group)
        rows.append((i, groups))
    n = defaultdict(int)
    for _, groups in rows:
        for x, y in groups:
            n[x[-1], y[-1]] += 1
    highest = defaultdict(int)
    for (_, y), c in n.items():
        highest[y] = max(highest[y], c)
    out = {}
    for i, groups in rows:
        counts = [(n[x[-1], y[-1]], highest[y[-1]]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[i] = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(groups), sum(c == h for c, h in counts), sum(c for c, _ in counts), text)
    return out
