"""What the operators should find, by plain loops over all rows."""

import math
import re
import zlib
from collections import Counter

from tidelog.llm import langid, quality


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def least_padding(lengths, buckets):
    """Of all ways to put the sorted lengths into that many buckets, the least sum of what is missing to each one's longest."""
    count = sorted(Counter(lengths).items())
    cost = [0] + [math.inf] * len(count)
    for _ in range(buckets):
        new = [0] + [math.inf] * len(count)
        for j in range(1, len(count) + 1):
            padded = 0
            for i in range(j - 1, -1, -1):
                padded += count[i][1] * (count[j - 1][0] - count[i][0])
                new[j] = min(new[j], cost[i] + padded)
        cost = new
    return cost[-1]


def quality_weights(texts, good):
    """Log weight by id, of texts by id: models by counting words and pairs one by one, weights by summing logs."""
    size, features, raw, target = quality.WORDS + quality.PAIRS, {}, Counter(), Counter()
    for doc_id, text in texts.items():
        hashed = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
        found = [w % quality.WORDS for w in hashed]
        for a, b in zip(hashed, hashed[1:], strict=False):
            mixed = ((a * 0x9E3779B1 ^ b) % (1 << 32) * 0x85EBCA77 % (1 << 32)) >> 16
            found.append(quality.WORDS + (0 if a == b else mixed % (quality.PAIRS - 1) + 1))
        features[doc_id] = found
        raw.update(found)
        if doc_id in good:
            target.update(found)
    ratio = {}
    for part in (range(quality.WORDS), range(quality.WORDS, size)):
        r_all, t_all = sum(raw[i] + 1e-9 for i in part), sum(target[i] for i in part)
        for i in part:
            r = (raw[i] + 1e-9) / r_all
            ratio[i] = math.log((1 - quality.MIX) * (target[i] + quality.PRIOR * r) / (t_all + quality.PRIOR) + quality.MIX * r) - math.log(r)
    return {d: sum(ratio[i] for i in f) for d, f in features.items()}


def expected_number(weight, slack=3):
    return int(sum(min(1.0, math.exp(min(0.0, w + slack))) for w in weight.values()) + 0.5)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def trigrams(text):
    s = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    found, m = Counter(), [int(x) for x in langid.MULTIPLIERS]
    for i in range(len(s) - 2):
        h = 0
        for c, k in zip(s[i : i + 3], m, strict=True):
            h ^= ord(c) * k % (1 << 32)
        found[(h * m[0] % (1 << 32)) >> 17] += 1
    return found


def mixture(models, counts):
    """Proportions of some models in counts, by expectation-maximisation, and the log-likelihood."""
    share = [1 / len(models)] * len(models)
    total = sum(counts.values())
    for _ in range(40):
        new = [0.0] * len(models)
        for b, n in counts.items():
            parts = [s * m[b] for s, m in zip(share, models, strict=True)]
            whole = sum(parts)
            for i, p in enumerate(parts):
                new[i] += n * p / whole / total
        done = max(abs(a - b) for a, b in zip(share, new, strict=True)) < 1e-3
        share = new
        if done:
            break
    return share, sum(n * math.log(sum(s * m[b] for s, m in zip(share, models, strict=True))) for b, n in counts.items())


def languages(rows):
    """(language, score) by id, of rows (id, text, lang); learned from those that aren't held out."""
    found = {i: trigrams(t or "") for i, t, _ in rows}
    seen: dict[str, Counter] = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and not held_out(i):
            seen.setdefault(lang, Counter()).update(found[i])
    langs, models = sorted(seen), []
    for lang in langs:
        whole = sum(seen[lang].values()) + 0.5 * langid.BUCKETS
        models.append([(seen[lang][b] + 0.5) / whole for b in range(langid.BUCKETS)])
    out = {}
    for i, counts in found.items():
        if not counts or not langs:
            out[i] = "und", 0.0
            continue
        share, _ = mixture(models, counts)
        order = sorted(range(len(langs)), key=lambda x: -share[x])
        best, top = None, -math.inf
        for k in range(1, len(order) + 1):
            if k > 1 and share[order[k - 1]] < 0.02:
                break
            of, value = mixture([models[x] for x in order[:k]], counts)
            value -= 0.5 * (k - 1) * math.log(sum(counts.values()))
            if value <= top:
                break
            best, top = (langs[order[of.index(max(of))]], max(of)), value
        out[i] = best
    return out


def shingle_set(text):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} if found else set()


def components(rows):
    """Component by id, of rows (id, text), over all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    least = {i: i for i, _ in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                least[max(p, q)] = min(p, q)
    return {i: find(i) for i in least}
