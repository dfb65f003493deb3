import xxhash


def simhash_of(text, size=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def joined(ids, linked):
    """id -> smallest id reachable."""
    ids = sorted(ids)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def links(fps):
    """id -> smallest id reachable by links of at most 4 bits."""
    return joined(fps, lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)


def shingled(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(texts):
    """id -> smallest id reachable by fingerprints of five words or by similarity 0.8."""
    sets, fps = {d: shingled(t) for d, t in texts.items()}, {d: simhash_of(t or "", 5) for d, t in texts.items()}

    def linked(i, j):
        a, b = sets[i], sets[j]
        return a == b or 5 * len(a & b) >= 4 * len(a | b) or bool(a and b) and bin(fps[i] ^ fps[j]).count("1") <= 4

    return joined(texts, linked)
